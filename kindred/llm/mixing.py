"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checked_broadcast, cut, running_total, same, table, times

WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9
#: Rows of per-source tables that are broadcast at most; with more sources, documents and sources are joined by a shuffle.
BROADCAST_SOURCES = 200_000
#: Documents whose copies are broadcast at most (an id and a number each); those of more documents are joined by a shuffle.
BROADCAST_PLAN = 500_000


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], cap: float) -> DataFrame:
    """One row per source: its size and target. The excess over `cap` is reshared by weight until none is above it.

    Only totals reach the driver; sources are ranked by a range partitioning, so their number is not bounded.
    """
    per = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    per = per.withColumn("_none", F.col("_source").isNull())
    ranked = running_total(per, [F.col("_none").asc(), F.col("_source").asc()], F.lit(1), "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap))))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        at = F.col("_cap") <= F.col("_weight") * F.lit(level)
        held, free, n = ranked.agg(F.sum(F.when(at, F.col("_cap"))), F.sum(F.when(~at, F.col("_weight"))), F.sum(at.cast("long"))).first()
        if not free or n == full:
            break
        full, level = n, max(level, (total - float(held or 0)) / float(free))
    target = F.least(F.col("_cap"), F.col("_weight") * F.lit(level)) if free else F.col("_cap")
    return ranked.select(F.col("_source").alias("_of"), "source_size", target.cast("double").alias("target"))


def _uniform(*of: Column) -> Column:
    """A number in [0, 1) that depends only on `of`."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _round_group() -> Column:
    """Fold the array column nodes: each step moves words between the open document and the next until one of the two is whole.

    Returns struct(open, done): the residual, and the documents whose extra copy is decided.
    """
    # acc.open = the residual (p in [0, 1]); u decides the direction; g is the ratio of the sizes
    step = """aggregate(slice(nodes, 2, size(nodes)), named_struct('open', nodes[0], 'done', slice(nodes, 1, 0)), (acc, x) ->
      CASE WHEN acc.open.p <= {e} OR acc.open.p >= 1 - {e}
           THEN named_struct('open', x, 'done', array_append(acc.done, acc.open))
      ELSE element_at(transform(array(named_struct(
             'up', least(1 - acc.open.p, x.p * x.size / acc.open.size),
             'down', least(acc.open.p, (1 - x.p) * x.size / acc.open.size))), m ->
        CASE WHEN x.u * (m.up + m.down) < m.down THEN
          CASE WHEN 1 - acc.open.p <= x.p * x.size / acc.open.size
            THEN named_struct('open', named_struct('key', x.key, 'doc_id', x.doc_id, 'size', x.size, 'u', x.u, 'p', x.p - m.up * acc.open.size / x.size),
                 'done', array_append(acc.done, named_struct('key', acc.open.key, 'doc_id', acc.open.doc_id, 'size', acc.open.size, 'u', acc.open.u, 'p', 1D)))
            ELSE named_struct('open', named_struct('key', acc.open.key, 'doc_id', acc.open.doc_id, 'size', acc.open.size, 'u', acc.open.u, 'p', acc.open.p + m.up),
                 'done', array_append(acc.done, named_struct('key', x.key, 'doc_id', x.doc_id, 'size', x.size, 'u', x.u, 'p', 0D))) END
        ELSE
          CASE WHEN acc.open.p <= (1 - x.p) * x.size / acc.open.size
            THEN named_struct('open', named_struct('key', x.key, 'doc_id', x.doc_id, 'size', x.size, 'u', x.u, 'p', x.p + m.down * acc.open.size / x.size),
                 'done', array_append(acc.done, named_struct('key', acc.open.key, 'doc_id', acc.open.doc_id, 'size', acc.open.size, 'u', acc.open.u, 'p', 0D)))
            ELSE named_struct('open', named_struct('key', acc.open.key, 'doc_id', acc.open.doc_id, 'size', acc.open.size, 'u', acc.open.u, 'p', acc.open.p - m.down),
                 'done', array_append(acc.done, named_struct('key', x.key, 'doc_id', x.doc_id, 'size', x.size, 'u', x.u, 'p', 1D))) END
        END), 1) END)"""
    return F.expr(step.format(e=EPS))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    weights: tuple[int, ...] = (3, 1, 2),
    cap: float = 2.0,
    fan_in: int = 32,
    seed: int = 17,
) -> DataFrame:
    """How many copies of each document a mix takes; one row per input row.

    Returns doc_id, source, size (words), source_size, target (its source's), copies and taken = copies * size.
    Each document of a source has the same expected number of copies, target / source_size. Its whole part
    is taken; the fractional parts are rounded by the pivotal method, size-weighted so that a source's words stay
    at its target: in groups of about `fan_in` a fold moves words between two documents until one is whole, each
    group hands one residual to the next level of the tree, and the last residual of a source is rounded at random.
    A source thus misses its target by less than one document. Random numbers are hashes of ids: reruns agree.

    Null text has size 0 and is taken as 0 words; null source is a source of its own, ranked last. Rows that share an id, null
    too, are rounded each on their own: those alike in source and size are numbered. An empty table gives no rows; other columns
    are ignored, whatever their names. Groups are dealt by a hash of id, size and number, so neither a source with a third of all rows
    nor an id with as many meets in one group.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("_source"), size.alias("size"))
    sizes = cut(times(sizes.groupBy("doc_id", "_source", "size").agg(F.count("*").alias("_m")), "_m"))
    targets = source_targets(sizes, share, weights, cap)
    targets = checked_broadcast(targets, targets.count(), BROADCAST_SOURCES)
    rated = sizes.join(targets, same(F.col("_source"), F.col("_of")), "left").drop("_of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = rated.withColumn("_whole", F.floor(rate + EPS).cast("long")).withColumn("_p", F.greatest(rate - F.floor(rate + EPS), F.lit(0.0)))
    open_row = (F.col("_p") > EPS) & (F.col("size") > 0)
    keep = ["doc_id", "_source", "size", "source_size", "target", "_whole"]
    still = rated.filter(~open_row).select(*keep, F.lit(0).cast("long").alias("_extra"))

    per = rated.filter(open_row).groupBy("_source", "source_size", "target", "_whole", "_p").agg(F.count("*").alias("_n"))
    groups = cut(per.select(F.col("_source").alias("_of"), F.ceil(F.col("_n") / fan_in).cast("long").alias("_groups")))
    many, most = groups.agg(F.count("*"), F.max("_groups")).first()
    most, groups = most or 0, checked_broadcast(groups, many, BROADCAST_SOURCES)
    nodes = (
        rated.filter(open_row)
        .join(groups, same(F.col("_source"), F.col("_of")))
        .select(
            "_source", "source_size", "target", "_whole",
            F.pmod(F.xxhash64("doc_id", "size", "_i", F.lit(seed)), F.col("_groups")).alias("_group"),
            F.struct(
                F.xxhash64(F.lit(seed), "doc_id", "size", "_i").alias("key"), "doc_id", "size",
                _uniform(F.col("doc_id"), F.col("size"), F.col("_i"), F.lit(seed + 1), F.lit(0)).alias("u"), F.col("_p").alias("p"),
            ).alias("node"),
        )
    )
    parts, level = [still], 0
    of = ["_source", "source_size", "target", "_whole"]
    while most > 0:
        level += 1
        folded = nodes.groupBy(*of, "_group").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
        folded = cut(folded.select(*of, "_group", _round_group().alias("r")))
        done = folded.select(*of, F.explode("r.done").alias("d"))
        parts.append(done.select(F.col("d.doc_id").alias("doc_id"), "_source", F.col("d.size").alias("size"), "source_size", "target", "_whole", F.round("d.p").cast("long").alias("_extra")))
        if most == 1:
            last = folded.select(*of, F.col("r.open").alias("d"))
            up = _uniform(F.col("d.key"), F.lit(seed + 2)) < F.col("d.p")
            parts.append(last.select(F.col("d.doc_id").alias("doc_id"), "_source", F.col("d.size").alias("size"), "source_size", "target", "_whole", up.cast("long").alias("_extra")))
            break
        most = -(-most // fan_in)
        nodes = folded.select(
            *of, F.floor(F.col("_group") / fan_in).alias("_group"),
            F.struct(
                F.col("r.open.key").alias("key"), F.col("r.open.doc_id").alias("doc_id"), F.col("r.open.size").alias("size"),
                _uniform(F.col("r.open.key"), F.lit(seed + 1), F.lit(level)).alias("u"), F.col("r.open.p").alias("p"),
            ).alias("node"),
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    copies = F.col("_whole") + F.col("_extra")
    return out.select(
        "doc_id", F.col("_source").alias("source"), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of `docs` as often as the mix takes them; documents without words stay once.

    Rows that share an id, null too, are taken as often as the first of them by size. An empty table gives no rows; all
    columns of `docs` are kept, whatever their names.
    """
    names = docs.columns
    taken = mix_sources(docs, id_col=id_col, **how)
    often = F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(1)).cast("int")
    plan = taken.groupBy(F.col("doc_id").alias("_k_id")).agg(F.min_by(often, F.struct("size", "copies")).alias("_k_copies"))
    plan = cut(plan)
    mine = docs.select(F.col(id_col).alias("_k_doc"), F.struct(*names).alias("_k_row"))
    joined = mine.join(checked_broadcast(plan, plan.count(), BROADCAST_PLAN), same(F.col("_k_doc"), F.col("_k_id"))).filter("_k_copies > 0")
    return joined.select("_k_row", F.explode(F.sequence(F.lit(1), F.col("_k_copies")))).select("_k_row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
