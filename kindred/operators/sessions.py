"""The session store: filters, pages, counts, retention, upserts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_status(sessions: DataFrame, status: str | None) -> DataFrame:
    """Sessions of a status, trimmed and lower-cased; a blank one is no filter."""
    wanted = (status or "").strip().lower()
    return sessions.filter(F.col("status") == wanted) if wanted else sessions


def event_filter(scan_id: str | None = None, action: str | None = None, since: int | None = None, until: int | None = None) -> Column:
    """Predicate of the given parameters: equal id, action containing a text in any ASCII case (% and _ are wild), closed times."""
    out = F.lit(True)
    for given, test in (
        (scan_id, lambda: F.col("scan_id") == scan_id), (action, lambda: F.col("action").ilike(f"%{action}%")),
        (since, lambda: F.col("at_ms") >= since), (until, lambda: F.col("at_ms") <= until),
    ):
        if given is not None:
            out = out & test()
    return out


def with_event_counts(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Each session with its number of events, counted before the join; 0 without events."""
    counts = events.groupBy("scan_id").agg(F.count("*").alias("event_count"))
    return sessions.join(counts, "scan_id", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))


def with_events(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Each session with its events as an array in time order; empty without events."""
    lists = events.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("at_ms", "id", "action"))).alias("events"))
    return sessions.join(lists, "scan_id", "left").withColumn("events", F.coalesce("events", F.array().cast("array<struct<at_ms:bigint,id:bigint,action:string>>")))


@dataclass(frozen=True)
class Page:
    """What a page request asks for, after the rules: 1 to 200 rows, and a whole cursor beats an offset."""

    limit: int
    offset: int
    cursor: tuple | None
    offset_ignored: bool

    @classmethod
    def of(cls, limit: int | None = None, offset: int | None = None, cursor: tuple | None = None, default: int = 25) -> Page:
        whole = cursor is not None and all(c is not None for c in cursor)
        return cls(min(max(default if limit is None else limit, 1), 200), 0 if whole else offset or 0, cursor if whole else None, bool(whole and offset))


def page_rules(limit: Column, offset: Column, *cursor: Column, default: int = 25) -> tuple[Column, Column, Column]:
    """The rules of Page for requests that are rows: limit, offset, and whether an offset was ignored for a whole cursor."""
    whole = F.lit(bool(cursor))
    for c in cursor:
        whole = whole & c.isNotNull()
    asked = F.coalesce(offset, F.lit(0))
    return F.least(F.greatest(F.coalesce(limit, F.lit(default)), F.lit(1)), F.lit(200)), F.when(whole, 0).otherwise(asked), whole & (asked > 0)


def session_page(sessions: DataFrame, page: Page) -> DataFrame:
    """Newest sessions first, ties by id as text; from the cursor (updated_at_ms, scan_id) on, if given."""
    rows = sessions
    if page.cursor:
        at, key = page.cursor
        rows = rows.filter((F.col("updated_at_ms") < at) | ((F.col("updated_at_ms") == at) & (F.col("scan_id") < key)))
    return rows.orderBy(F.desc("updated_at_ms"), F.desc("scan_id")).offset(page.offset).limit(page.limit)


def event_page(events: DataFrame, page: Page) -> DataFrame:
    """Newest events first, by id; from the cursor (id,) on, if given."""
    rows = events.filter(F.col("id") < page.cursor[0]) if page.cursor else events
    return rows.orderBy(F.desc("id")).offset(page.offset).limit(page.limit)


def next_cursor(rows: list, *columns: str) -> tuple | None:
    """The cursor after a page, also after a short one; None after an empty one."""
    return tuple(rows[-1][c] for c in columns) if rows else None


def newest(rows: DataFrame, n: int, by: str = "scan_id", order: tuple[str, ...] = ("at_ms", "id")) -> DataFrame:
    """The newest n rows of each group."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def expired(sessions: DataFrame, now_ms: int, age_ms: int, least_age_ms: int = 60_000) -> DataFrame:
    """Sessions last updated before now - age; an age below a minute counts as one."""
    return sessions.filter(F.col("updated_at_ms") < now_ms - max(age_ms, least_age_ms))


def beside(*rows: DataFrame) -> DataFrame:
    """Tables of one row each, with different columns, as one row."""
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.agg(*[F.first(c, ignorenulls=True).alias(c) for c in out.columns])


def without(rows: DataFrame, keys: DataFrame, on: str = "scan_id") -> DataFrame:
    return rows.join(keys.select(on), on, "left_anti")


def maintenance(sessions: DataFrame, events: DataFrame, now_ms: int, age_ms: int = 7 * 86_400_000, per_scan: int = 120) -> dict[str, DataFrame]:
    """Retention: old sessions go with their events, then each session keeps its newest events.

    counts has deleted_sessions and deleted_events; the latter counts the trim alone.
    """
    old = expired(sessions, now_ms, age_ms)
    left_events = without(events, old)
    kept = newest(left_events, max(per_scan, 10)).drop("rn")
    counts = beside(
        old.agg(F.count("*").alias("deleted_sessions")),
        left_events.groupBy("scan_id").agg(F.greatest(F.count("*") - max(per_scan, 10), F.lit(0)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("deleted_events")),
    )
    return {"sessions": without(sessions, old), "events": kept, "counts": counts}


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` in place of those of `old` with the same key; Parquet has no MERGE. `new` must not repeat a key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def replace_events(old: DataFrame, new: DataFrame, saved: DataFrame) -> DataFrame:
    """The events of saved sessions are replaced whole, those of others stay."""
    return without(old, saved).unionByName(new)


def patch(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Set the given columns of the rows that `changes` names; others keep theirs."""
    new = changes.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = old.join(new, key, "left")
    picked = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns]
    return joined.select(*picked)


def save(df: DataFrame, root: str, version: int) -> str:
    """A new version of a table in a folder of its own; readers move on by its name."""
    path = f"{root}/v{version:06d}"
    df.write.mode("overwrite").parquet(path)
    return path


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
