"""Paths as text, by the rules of a POSIX file system without symbolic links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolved(path: Column, at: str = "/") -> Column:
    """The absolute path without empty, `.` and `..` parts; a relative one starts at the folder `at`."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(at.rstrip("/") + "/"), path))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    up = lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, p))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.slice(parts, 1, 0), up), "/"))


def names_folder(path: Column) -> Column:
    """Whether the path can only name a folder, as it ends with a slash, `.` or `..`."""
    return path.rlike(r"(^|/)\.{0,2}$")


def parent(path: Column) -> Column:
    """The path without its last part, as written: `/` for a part of the root, empty for a bare name, null for the root or nothing."""
    bare = F.regexp_replace(path, r"(/|/\.)+$", "")
    above = F.regexp_replace(F.regexp_replace(bare, "[^/]+$", ""), r"(/|/\.)+$", "")
    return F.when(bare != "", F.when((above == "") & bare.startswith("/"), "/").otherwise(above))
