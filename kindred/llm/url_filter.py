"""URL filters: listed rules, and for other urls naive Bayes over words that a unigram Viterbi finds in host and path."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, cut, small_batches, table

#: Fixed values of the rule list: verdict, host, start of the path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Letters of a word of the unigram model. Longer runs of letters are no words.
SHORTEST, LONGEST = 2, 24
#: Bytes of a table of parts that is broadcast at most; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20
_WORD = re.compile(r"[a-z]+")
_TAG = re.compile(r"<[^>]*>")
_PART = "[a-z]+|[0-9]+"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def viterbi(name: str, words: dict[str, float], unknown: float) -> list[str]:
    """The likeliest words that make up `name`; unknown ones of n letters cost `unknown` and n letters' worth."""
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        top, at = -math.inf, end - 1
        for start in range(max(0, end - LONGEST), end):
            p = words.get(name[start:end])
            p = best[start] + (p if p is not None else unknown - 2.3 * (end - start))
            if p > top:
                top, at = p, start
        best.append(top)
        back.append(at)
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def _counted(rows: DataFrame, by: str, count) -> DataFrame:
    """Sums of the Counters that `count` makes of each batch, with map-side sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            total.update(count(batch))
            if len(total) > 200_000:
                yield packed(total)
                total = Counter()
        yield packed(total)

    def packed(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=[by, "n"])

    return rows.mapInArrow(run, f"{by} string, n long").groupBy(by).agg(F.sum("n").alias("n"))


def word_counts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """How often each word of SHORTEST to LONGEST letters stands in all pages' texts and urls: w, n."""

    def words(batch: pa.RecordBatch) -> Counter:
        found = Counter()
        for html in batch.column(0).to_pylist():
            found.update(_WORD.findall(_TAG.sub(" ", (html or "").lower())))
        for url in batch.column(1).to_pylist():
            found.update(_WORD.findall((url or "").lower()))
        return Counter({w: n for w, n in found.items() if SHORTEST <= len(w) <= LONGEST})

    return _counted(pages.select(html_col, url_col), "w", words)


def split_parts(parts: DataFrame, counts: DataFrame, total: float) -> DataFrame:
    """part and words: every distinct run of letters of `parts` (part) as its likeliest words under all `counts`; # for a number.

    A part's substrings are joined with the whole vocabulary, however large, so each part meets its own small dictionary of at
    most LONGEST entries a letter; no vocabulary is gathered anywhere.
    """
    parts = parts.select("part").distinct()
    letters = cut(parts.filter(F.col("part").rlike("^[a-z]")))
    starts = letters.filter(F.length("part") >= SHORTEST).select("part", F.explode(F.sequence(F.lit(1), F.length("part") - (SHORTEST - 1))).alias("_at"))
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("part") - F.col("_at") + 1))
    pieces = starts.select("part", F.explode(F.transform(lengths, lambda k: F.substring(F.col("part"), F.col("_at"), k))).alias("w")).distinct()
    own = pieces.join(counts, "w").groupBy("part").agg(F.collect_list("w").alias("ws"), F.collect_list("n").alias("ns"))
    met = letters.join(own, "part", "left").select("part", "ws", "ns")
    log_total, unknown = math.log(total), -math.log(total + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, ws, ns in zip(*(batch.column(k).to_pylist() for k in range(3))):
                out.append(viterbi(part, {w: math.log(n) - log_total for w, n in zip(ws or (), ns or ())}, unknown))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["part", "words"])

    split = met.mapInArrow(run, "part string, words array<string>")
    return split.unionByName(parts.filter(~F.col("part").rlike("^[a-z]")).select("part", F.array(F.lit("#")).alias("words")))


def _judged(pages: DataFrame, url_col: str) -> DataFrame:
    parts = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return parts.withColumn("rule", rule).withColumn("_listed", verdict)


def _parted(rows: DataFrame) -> DataFrame:
    """A row for each run of letters or digits of host (kind h) and path (kind p), with the row's other columns."""
    runs = lambda kind, text: F.transform(F.regexp_extract_all(text, F.lit(_PART), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("part")))
    both = F.concat(runs("h", F.col("host")), runs("p", ascii_lower(F.col("path"))))
    rest = [c for c in rows.columns if c not in ("host", "path")]
    return rows.withColumn("_x", F.explode(both)).select(*rest, "_x.kind", "_x.part")


def _small(df: DataFrame, text: str) -> DataFrame:
    """Hint a broadcast where the counted rows and bytes of text are few."""
    rows, size = df.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    return F.broadcast(df) if rows * 40 + (size or 0) <= BROADCAST_BYTES else df


@dataclass
class UrlModel:
    """Tables that grow with the pages stay DataFrames: the word counts, and the log ratio block : allow of each word of each kind."""

    counts: DataFrame
    total: float
    ratios: DataFrame  # kind, word, ratio
    prior: float = 0.0
    unseen: float = 0.0
    only: str | None = "allow"  # the verdict where there are no pages of both classes to learn from


def fit(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> UrlModel:
    """Word counts over all pages' texts and urls; classes from all pages that the rules judge."""
    small_batches(pages.sparkSession)
    counts = cut(word_counts(pages, url_col, html_col))
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    listed = _judged(pages.select(url_col), url_col).filter("_listed is not null").select("host", "path", "_listed")
    of_class = {r._listed: r["count"] for r in listed.groupBy("_listed").count().collect()}  # two rows at most
    seen = cut(_parted(listed).groupBy("kind", "part").agg(*[F.count_if(F.col("_listed") == c).alias(c) for c in ("allow", "block")]))
    split = split_parts(seen, counts, total)
    words = cut(
        seen.join(split, "part").select("kind", F.explode("words").alias("word"), "allow", "block")
        .groupBy("kind", "word").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    )
    size, all_allow, all_block = words.agg(F.count("*"), F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first()
    whole = {"allow": all_allow + size + 1, "block": all_block + size + 1}  # one more for words never seen
    ratio = F.log((F.col("block") + 1) / F.lit(float(whole["block"]))) - F.log((F.col("allow") + 1) / F.lit(float(whole["allow"])))
    model = UrlModel(counts, total, words.select("kind", "word", ratio.alias("ratio")))
    if len(of_class) < 2:
        model.only = next(iter(of_class), "allow")
        return model
    model.only, model.prior = None, math.log(of_class["block"]) - math.log(of_class["allow"])
    model.unseen = math.log(whole["allow"]) - math.log(whole["block"])
    return model


def filter_urls(pages: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of each row.

    A url without :// and a null url have an empty host and path, no rule, and the verdict of the prior. Repeated rows and those
    without an id are judged each; an empty table gives no rows; other columns are ignored, whatever their names. Without pages of
    both classes to learn from, unlisted urls get the only class, or allow. Hosts and paths are used whole.
    """
    small_batches(pages.sparkSession)
    rows = _judged(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")), "_url").drop("_url")
    if model.only:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("_listed", F.lit(model.only)).alias("verdict"))
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    parts = _parted(rows.filter("_listed is null").select("_row", "host", "path"))
    wanted = cut(parts.select("kind", "part").distinct())
    words = wanted.join(split_parts(wanted, model.counts, model.total), "part").select("kind", "part", F.explode("words").alias("word"))
    scored = words.join(model.ratios, ["kind", "word"], "left").groupBy("kind", "part").agg(F.sum(F.coalesce("ratio", F.lit(model.unseen))).alias("ratio"))
    # a few parts are in most urls: written out, so that a join by shuffle meets two plain exchanges and a skewed one can be split
    scored = _small(cut(scored), "part")
    sums = parts.join(scored, ["kind", "part"]).groupBy(F.col("_row").alias("_of")).agg(F.sum("ratio").alias("ratio"))
    blocked = F.coalesce("ratio", F.lit(0.0)) + model.prior > 0
    learned = rows.join(sums, F.col("_row") == F.col("_of"), "left")
    return learned.select("page_id", "host", "path", "rule", F.coalesce("_listed", F.when(blocked, "block").otherwise("allow")).alias("verdict"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's url, judged."""
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, fit(pages))
