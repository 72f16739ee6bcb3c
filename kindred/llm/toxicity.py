"""Toxic passages: token log-odds with Dirichlet priors, maximum-scoring segments, extreme-value calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, small_batches, table

_TOKEN = re.compile(r"[^\W\d_]+")
#: Labelled documents that the model is fitted on at most.
MAX_TRAIN = 20_000
#: Different tokens that a counting task holds before it writes their counts.
COUNTS_AT_ONCE = 200_000


@dataclass
class Model:
    """Scores of tokens and of prefixes; `drift` is taken off every token, so that clean text scores below zero."""

    tokens: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    base: float = -0.05
    drift: float = 0.4
    scale: float = 1.0  # lambda of the extreme-value law of clean texts' best scores
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = -3.0
    joined: bool = False  # whether further segments count, which needs a fitted extreme-value law

    def token_scores(self, words: list[str]) -> np.ndarray:
        known, prefixes, base = self.tokens, self.prefixes, self.base
        out = list(map(known.get, words))
        if None in out:
            for i, s in enumerate(out):
                if s is None:
                    w = words[i]
                    s = prefixes.get(w[:7]) if len(w) > 6 else None
                    if s is None:
                        s = prefixes.get(w[:5], base) if len(w) > 4 else base
                    out[i] = s
        return np.array(out, np.float64) - self.drift

    def best(self, scores: np.ndarray) -> tuple[float, int]:
        """The score of the best segment, 0 at least; if `joined`, plus what each further segment has above `floor`.

        So `excess` is the sum of the normalised excesses of all segments where any is positive (the sum statistic of Karlin and
        Altschul), and that of the best segment otherwise. Second, how many segments are above `floor`.
        """
        if not len(scores):
            return 0.0, 0
        sums = np.cumsum(scores)
        lowest = np.minimum.accumulate(np.concatenate(([0.0], sums[:-1])))
        top = max(0.0, float((sums - lowest).max()))
        floor = max(0.0, self.floor(len(scores)))
        if not self.joined or top <= floor:  # no segment is better than the best
            return top, int(top > floor)
        further = sorted((v for _, _, v in segments(scores, floor)), reverse=True)[1:]
        return top + sum(v - floor for v in further), 1 + len(further)

    def floor(self, n: int) -> float:
        """The segment score at which `excess` is zero."""
        return (self.log_k + math.log(max(n, 1))) / max(self.scale, 1e-9)

    def excess(self, best: float, n: int) -> float:
        """Minus the log of the number of segments as good that a clean text of n tokens is expected to hold."""
        return self.scale * best - self.log_k - math.log(max(n, 1))

    def probability(self, best: float, n: int) -> float:
        z = self.slope * self.excess(best, n) + self.offset
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))

    def threshold(self, n: int, p: float) -> float:
        """The segment score at which `probability` reaches p."""
        return ((math.log(p / (1 - p)) - self.offset) / max(self.slope, 1e-9) + self.log_k + math.log(max(n, 1))) / max(self.scale, 1e-9)


def lowered(text: str | None) -> str:
    """The text in lower case, code point by code point: places stay; a letter whose lower case is longer (İ) keeps its form."""
    low = (text or "").lower()
    if len(low) == len(text or ""):
        return low
    return "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(lowered(text))


def segments(scores: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of at least `least`, as (first, end, score), in one left-to-right scan in linear time.

    Each open segment keeps a link to the last one before it whose left sum is lower. A search for such a segment follows links, and a
    segment that it passes is never met again, as those that a join takes in are dropped and the others lie behind a link.
    """
    sums = np.cumsum(scores)
    at = np.flatnonzero(np.asarray(scores) > 0)
    before = np.concatenate(([0.0], sums[:-1]))[at] if len(at) else at
    starts: list[int] = []
    ends: list[int] = []
    lefts: list[float] = []
    rights: list[float] = []
    links: list[int] = []
    for i, left, total in zip(at.tolist(), before.tolist(), sums[at].tolist()):
        start, j = i, len(lefts) - 1
        while True:
            while j >= 0 and lefts[j] >= left:
                j = links[j]
            if j < 0 or rights[j] >= total:
                break
            start, left = starts[j], lefts[j]
            del starts[j:], ends[j:], lefts[j:], rights[j:]
            j = links[j]  # the last one with a lower left sum than the segment just taken in
            del links[len(lefts) :]
        starts.append(start)
        ends.append(i + 1)
        lefts.append(left)
        rights.append(total)
        links.append(j)
    return [(a, b, t - l) for a, b, l, t in zip(starts, ends, lefts, rights) if t - l >= least]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def significant(bad: Column, good: Column, overall: float, least: float = 15.0) -> Column:
    """Whether `bad` and `good` (occurrences in toxic and in clean documents) lean to toxic by a likelihood ratio of at least `least`."""
    p = bad / (bad + good)
    ratio = bad * F.log(p / overall) + F.when(good > 0, good * F.log((1 - p) / (1 - overall))).otherwise(0.0)
    return (p > overall) & (2 * ratio >= least)


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """At most about `most` labelled rows outside the held-out fifth, chosen by a hash of the id."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~F.coalesce(held_out(F.col(id_col)), F.lit(True)))
    marks = marks.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    n = marks.count()
    if n > most:
        marks = marks.filter(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    # the sample is bounded by `most`, so its ids may be broadcast and the texts stay where they are
    found = docs.join(F.broadcast(marks), F.col(id_col) == F.col("_id")).select(F.col(text_col).alias("_text"), "_y")
    return found.groupBy("_text").agg(F.max("_y").alias("_y"))  # copies would count as independent evidence


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_TRAIN,
    prior: float = 4.0,
) -> Model:
    """Learn a Model from the labels. Counting runs on Spark; the driver gets the tokens that matter and a number per sampled row.

    A token's rate of occurring in toxic documents has a Dirichlet prior centred on the rate of its 7-letter prefix, which
    leans on its 5-letter prefix, which leans on all tokens. Scores are log-odds against the overall rate, and 0 for tokens
    and prefixes that do not significantly lean to toxic documents; only the others, which need several occurrences in the bounded
    sample, leave Spark. Copies of a text count once. Without labels of both kinds every text scores the same low value.
    """
    small_batches(docs.sparkSession)
    train = cut(_training(docs, labels, id_col, text_col, label_col, most))  # bounded, and read three times

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad, seen = Counter(), Counter(), [0, 0]

        def packed() -> pa.RecordBatch:
            words = list(good.keys() | bad.keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([bad[w] for w in words], pa.int64()), pa.array([good[w] for w in words], pa.int64())],
                names=["w", "bad", "good"],
            )

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (bad if y else good).update(set(tokens(text)))
                seen[bool(y)] += 1
            if len(good) + len(bad) > COUNTS_AT_ONCE:
                yield packed()
                good.clear()
                bad.clear()
        good[""], bad[""] = seen  # the numbers of documents
        yield packed()

    counts = train.select("_text", "_y").mapInArrow(count, "w string, bad long, good long")
    counts = cut(counts.groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    of_docs, of_words = counts.filter("w = ''").agg(F.sum("bad"), F.sum("good")).first(), counts.filter("w <> ''").agg(F.sum("bad"), F.sum("good")).first()
    model = Model()
    if not of_docs[0] or not of_docs[1] or not of_words[0]:
        return model
    overall = of_words[0] / (of_words[0] + of_words[1]) if of_words[1] else 0.5
    logit = lambda p: math.log(p / (1 - p))
    base = logit(overall)

    def prefixes(n: int) -> DataFrame:
        return counts.filter(F.length("w") >= n).groupBy(F.substring("w", 1, n).alias("w")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))

    def rated(rows: DataFrame, around: Column) -> DataFrame:
        return rows.withColumn("rate", (F.col("bad") + prior * around) / (F.col("bad") + F.col("good") + prior))

    five = rated(prefixes(5), F.lit(overall))
    of_five = five.select(F.col("w").alias("_w5"), F.col("rate").alias("_r5"))
    seven = rated(prefixes(7).join(of_five, F.substring("w", 1, 5) == F.col("_w5"), "left"), F.col("_r5"))
    of_seven = seven.select(F.col("w").alias("_w7"), F.col("rate").alias("_r7"))
    words = counts.filter("w <> ''").filter(significant(F.col("bad"), F.col("good"), overall))
    words = words.join(of_five, F.substring("w", 1, 5) == F.col("_w5"), "left").join(of_seven, F.substring("w", 1, 7) == F.col("_w7"), "left")
    words = rated(words, F.coalesce("_r7", "_r5", F.lit(overall)))
    kept = words.select(F.lit(0).alias("n"), "w", "rate")
    for n, rows in ((5, five), (7, seven)):
        kept = kept.unionByName(rows.filter(significant(F.col("bad"), F.col("good"), overall)).select(F.lit(n).alias("n"), "w", "rate"))
    for r in kept.collect():
        (model.prefixes if r.n else model.tokens)[r.w] = logit(r.rate) - base
    model.base = 0.0

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, n = [], []
            for text in batch.column(0).to_pylist():
                scores = model.token_scores(tokens(text))
                best.append(model.best(scores)[0])
                n.append(len(scores))
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(n, pa.int64()), batch.column(1)], names=["s", "n", "y"])

    measured = lambda: train.select("_text", "_y").mapInArrow(measure, "s double, n long, y int").toPandas()
    rows = measured()
    s, n, y = rows.s.to_numpy(), np.maximum(rows.n.to_numpy(), 1), rows.y.to_numpy()
    clean = s[y == 0]
    # Gumbel by moments of what is left of the best clean scores after the growth with log n
    lam = 1.0
    for _ in range(20):
        left = clean - np.log(n[y == 0]) / lam
        lam = min(10.0, max(0.05, math.pi / (math.sqrt(6) * max(float(left.std()), 1e-6))))
    model.scale = lam
    model.log_k = lam * float(left.mean()) - 0.5772156649
    model.joined = True
    rows = measured()  # the law is that of single segments; the probability is fitted on all of a text
    y = rows.y.to_numpy()
    x = np.array([model.excess(a, b) for a, b in zip(rows.s, rows.n)])
    a, b = 0.5, -2.0
    for _ in range(60):  # logistic regression on one feature, by damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((y - p) * x).sum() - 1e-3 * a, (y - p).sum()])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a + step[0], b + step[1]
    model.slope, model.offset = max(float(a), 1e-3), float(b)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """doc_id, score, predicted and n_passages of each row; with `passages` also a toxic text's passages, in code points.

    n_passages counts the segments that are better than a clean text of the length is expected to hold.

    Only the text is used. Null and empty texts have the score of a text without tokens. An empty table gives no
    rows; repeated rows are scored each; other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, score double, predicted int, n_passages long"
    if passages:
        schema += ", passages array<struct<first:int,end:int,score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out, counts, spans = [], [], []
            for text in batch.column(1).to_pylist():
                s = m.token_scores(tokens(text))
                best, n = m.best(s)
                out.append(m.probability(best, len(s)))
                counts.append(n)
                if passages:
                    least = max(m.threshold(len(s), 0.5), 1e-9)
                    got = segments(s, max(min(least, m.floor(len(s))), 1e-9)) if best >= least else []
                    at = [x.span() for x in _TOKEN.finditer(lowered(text))] if got else []
                    spans.append([{"first": at[i][0], "end": at[j - 1][1], "score": v} for i, j, v in got])
            columns = [batch.column(0), pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32()), pa.array(counts, pa.int64())]
            names = ["doc_id", "score", "predicted", "n_passages"]
            if passages:
                kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                columns.append(pa.array(spans, kind))
                names.append("passages")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with their columns; the model is fitted on `labelled` with `labels`.

    A null text counts as empty and stays unless the model finds empty texts toxic. Equal texts stay or go together; an empty table
    gives no rows; other columns are kept as they are, whatever their names.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            stay = []
            for text in batch.column(text_col).to_pylist():
                s = m.token_scores(tokens(text))
                stay.append(m.probability(m.best(s)[0], len(s)) < 0.5)
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "n_passages")
