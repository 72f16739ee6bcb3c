"""Exact deduplication by progressive refinement, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, checked_broadcast, cut, same, table, times

#: At most so many (length, prefix hash) keys are broadcast; 24 bytes each. More of them are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: At most so many groups of equal texts are broadcast; some 120 bytes each.
BROADCAST_GROUPS = 200_000


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 128,
    digest_all: bool = False,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Group rows whose texts are equal after lower-casing A-Z; one row per input row.

    Lengths are grouped first, then prefix hashes within lengths that repeat, and the whole text is hashed
    only for rows whose (length, prefix hash) repeats. Returns doc_id, keep_id (largest id of the group),
    group_size, kept and text_sha256 (null for rows that needed no full hash, unless digest_all).

    Null text counts as empty; a null id is below every other id. Rows that repeat an id and its text are
    counted each, and one of them is kept. An empty table gives no rows. Other columns are ignored.
    Only narrow rows are grouped, with map-side counts, so a group of any size is never gathered.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    rows = rows.select(
        "doc_id",
        "_text",
        F.octet_length("_text").alias("_len"),
        F.xxhash64(ascii_lower(F.substring("_text", 1, prefix_chars))).alias("_prefix"),
    )
    narrow = cut(rows.select("_len", "_prefix").groupBy("_len", "_prefix").agg(F.count("*").alias("_n")))
    lengths = narrow.groupBy("_len").agg(F.sum("_n").alias("_m")).filter("_m > 1").select("_len")
    keys = cut(narrow.filter("_n > 1").join(lengths, "_len", "left_semi").select("_len", "_prefix", F.lit(True).alias("_again")))
    flagged = rows.join(checked_broadcast(keys, keys.count(), broadcast_keys), ["_len", "_prefix"], "left")
    again = F.coalesce(F.col("_again"), F.lit(False))
    full = F.sha2(ascii_lower(F.col("_text")), 256)
    hashed = cut(flagged.select("doc_id", again.alias("_again"), (full if digest_all else F.when(again, full)).alias("text_sha256")))
    copies = cut(hashed.filter("_again").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("_m")))
    # written out, so that where there are too many to broadcast the join meets two plain exchanges and a skewed one can be split
    groups = cut(copies.groupBy(F.col("text_sha256").alias("_sha")).agg(F.max("doc_id").alias("keep_id"), F.sum("_m").alias("group_size")))
    groups = checked_broadcast(groups, groups.count(), min(BROADCAST_GROUPS, broadcast_keys))
    decided = (
        times(copies.join(groups, F.col("text_sha256") == F.col("_sha")), "_m")
        .select("doc_id", "keep_id", "group_size", (same(F.col("doc_id"), F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"), "text_sha256")
    )
    alone = hashed.filter(~F.col("_again")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return decided.unionByName(alone)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, with all their columns.

    The rows to drop are named by id and text hash; their keys are broadcast if they are few, so the texts stay where they are.
    Of rows that repeat an id and a text one stays, with the other columns of any of them; a null id is below all others. An
    empty table gives no rows; columns are kept whatever their names.
    """
    names = docs.columns
    found = exact_dedup(docs, id_col, text_col).filter("group_size > 1")
    verdict = cut(
        found.groupBy(F.col("doc_id").alias("_k_id"), F.col("text_sha256").alias("_k_sha")).agg(F.max("kept").alias("_k_kept"), F.count("*").alias("_k_rows"))
    )
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("_k_doc"), sha.alias("_k_text"), F.struct(*names).alias("_k_row"))
    is_it = same(F.col("_k_doc"), F.col("_k_id")) & (F.col("_k_text") == F.col("_k_sha"))
    # rows that repeat id and text are all taken out, and one of each is put back
    repeated = verdict.filter("_k_kept and _k_rows > 1").select("_k_id", "_k_sha")
    gone = verdict.filter("not _k_kept or _k_rows > 1").select("_k_id", "_k_sha")
    out = rows.join(checked_broadcast(gone, gone.count(), broadcast_keys), is_it, "left_anti").select("_k_row.*")
    n = repeated.count()
    if not n:
        return out
    again = rows.join(checked_broadcast(repeated, n, broadcast_keys), is_it).dropDuplicates(["_k_id", "_k_sha"]).select("_k_row.*")
    return out.unionByName(again)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its group of equal texts."""
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


OP6_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
