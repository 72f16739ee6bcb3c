"""Personal data: base patterns with positions, and bootstrapped contextual extraction; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, checked_broadcast, cut, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns for Java's engine. Each starts only where a run of its characters starts (or the last match ended): a later
#: start in the same run meets the same rest and fails alike, so the matches are those of the plain patterns, in linear time.
#: A card is a whole run of digits with single separators; runs of fewer than 12 digits can never be valid.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Code points of an identifier at least; every kind's own pattern asks for as many.
SHORTEST = 5
#: Matches that are placed one after another, each copying the ones before it in its block.
_BLOCK = 64


def _lit(pattern: str) -> Column:
    return F.lit(pattern)


#: Trusted patterns (some 100 bytes each) that are broadcast at most; with more, instances and patterns are joined by a shuffle.
BROADCAST_PATTERNS = 100_000
_PLACE = "struct<start:int,end:int,value:string,piece:string>"


def _placed(text: Column, found: Column, pattern: str) -> Column:
    """array<struct<start, end, value, piece>>: the matches with their code point positions, and the piece of text before each.

    Positions are sums of the lengths of pieces and matches, taken within blocks and over blocks, so that a text of very many
    matches copies short arrays only.
    """
    pieces = F.when(F.size(found) > 0, F.split(text, pattern, -1))
    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match"), F.char_length(p).alias("gap"), F.char_length(m).alias("n")))
    none = F.expr(f"cast(array() as array<{_PLACE}>)")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int")), lambda i: F.slice(pairs, i * _BLOCK + 1, _BLOCK))
    sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["n"]))
    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    bases = F.aggregate(sizes, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["n"]
        place = F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("value"), x["piece"].alias("piece"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], place).alias("out"))

    inside = F.zip_with(blocks, bases, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"]))
    return F.when(F.size(found) > 0, F.flatten(inside)).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        v = F.ascii(c) - 48
        return F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2)

    values = F.transform(F.regexp_extract_all(F.reverse(digits), _lit("[0-9]"), F.lit(0)), worth)
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(value))).otherwise(False)
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _row, base (array of start, end, rank, kind, value by start and kind), _refused and _token.

    _token has the identifier-like words with the one and the two words before each, A-Z lower-cased. A text between two tokens
    and the tokens before it hold these words whole, so no window cuts them.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("*", *[F.regexp_extract_all("_text", _lit(p), F.lit(0)).alias(f"_{k}") for k, p in PATTERNS.items()])
    rows = rows.withColumn("_token", F.regexp_extract_all("_text", _lit(_CANDIDATE), F.lit(0)))
    placed = rows.select(
        "doc_id", *[F.transform(_placed(F.col("_text"), F.col(f"_{k}"), p), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))).alias(f"_{k}") for k, p in PATTERNS.items()],
        _placed(F.col("_text"), F.col("_token"), _CANDIDATE).alias("_t"),
    )

    def kept(k: str) -> Column:
        valid = F.filter(F.col(f"_{k}"), lambda m: _valid(k, m["value"]))
        return F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), m["end"].alias("end"), F.lit(k).alias("kind"), m["value"].alias("value")))

    def failed(k: str) -> Column:
        return F.filter(F.col(f"_{k}"), lambda m: ~_valid(k, m["value"]))

    def context(m: Column, i: Column) -> Column:
        one, two = F.get(F.col("_t"), i - 1), F.get(F.col("_t"), i - 2)
        before = ascii_lower(F.concat(F.coalesce(two["value"], F.lit("")), F.coalesce(one["piece"], F.lit("")), F.coalesce(one["value"], F.lit("")), m["piece"]))
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
            F.regexp_extract(before, r"(\S+\s+\S+)\s+$", 1).alias("left2"), F.regexp_extract(before, r"(\S+)\s+$", 1).alias("left"),
        )

    refused = F.concat(*[failed(k) for k in KINDS])
    base = F.array_sort(F.concat(*[kept(k) for k in KINDS]))
    return placed.select("doc_id", base.alias("base"), refused.alias("_refused"), F.transform("_t", context).alias("_token"))


def _shape(value: Column) -> Column:
    """Letters become a, digits 9, and runs of letters one a."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{L}", "a"), "[0-9]", "9"), "a+", "a")


def _instances(based: DataFrame) -> DataFrame:
    """A row per identifier-like token: the kind of the base span that starts with it (or null), the words before it, its shape and place.

    Tokens meet the spans of their text as rows in order of position, in time linear in both.
    """
    none = F.lit(None).cast("string")
    entry = lambda what, m, rank, kind, left2, left: F.struct(
        F.lit(what).alias("what"), m["start"].alias("start"), m["end"].alias("end"), rank.alias("rank"), kind.alias("kind"), m["value"].alias("value"), left2.alias("left2"), left.alias("left"))
    rows = based.filter(F.size("_token") > 0).select("_row", F.explode(F.concat(
        F.transform("_token", lambda t: entry("token", t, F.lit(9), none, t["left2"], t["left"])),
        F.transform("base", lambda b: entry("base", b, b["rank"], b["kind"], none, none)),
        F.transform("_refused", lambda r: entry("refused", r, F.lit(9), none, none, none)),
    )).alias("x")).select("_row", "x.*")
    here = Window.partitionBy("_row").orderBy("start").rangeBetween(0, 0)
    before = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    of = lambda what, c: F.when(F.col("what") == what, F.col(c))
    rows = rows.withColumns({
        "b": F.min(F.when(F.col("what") == "base", F.struct("rank", "end", "kind", "value"))).over(here),
        **{f"{w}_end": F.max(of(w, "end")).over(before) for w in ("base", "refused")},
    }).withColumns({f"{w}_next": F.min(of(w, "start")).over(after) for w in ("base", "refused")})
    meets = lambda w: F.coalesce(F.col(f"{w}_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col(f"{w}_next") < F.col("end"), F.lit(False))
    bare = F.regexp_replace("value", r"[.,;:!?)\]}\"']+$", "")
    tokens = rows.filter("what = 'token'").filter(F.col("b").isNotNull() | ~meets("base")).select(
        "_row", F.col("b.kind").alias("kind"), meets("refused").alias("refused"), "start",
        F.coalesce(F.col("b.end"), F.col("start") + F.char_length(bare)).alias("end"), F.coalesce(F.col("b.value"), bare).alias("value"), "left2", "left",
    )
    return tokens.filter((F.length("value") >= SHORTEST) & (F.length("left") > 0)).withColumn("shape", _shape(F.col("value")))


def _patterns(rows: DataFrame) -> DataFrame:
    """Each instance under its lexical patterns: the two words before it (if there are two), the word with its shape, and the word alone."""
    return rows.withColumn("pattern", F.explode(F.array_compact(F.array(
        F.when(F.length("left2") > 0, F.concat_ws(" ", F.lit("2"), F.regexp_replace("left2", r"\s+", " "))),
        F.concat_ws(" ", F.lit("s"), "left", "shape"),
        F.concat_ws(" ", F.lit("1"), "left"),
    ))))


def bootstrap(instances: DataFrame, least_support: int = 5, least_precision: float = 0.9) -> DataFrame:
    """Instances outside the seeds that high-confidence patterns find: _row, kind, start, end.

    Scores run over the graph of patterns and instances. A pattern's precision for a kind is the share of its distinct values
    that are known to be of the kind; refused values (a base pattern matched, its check failed) count against every kind. Patterns
    with `least_support` distinct known values and `least_precision` are trusted; what they match joins the known values of the
    next round, until a round finds no new value. Only per-pattern sums are shuffled, so a very common word costs one row per task.
    """
    every = cut(instances.select("_row", "kind", "refused", "start", "end", "value", "left", "left2", "shape"))
    known = cut(every.filter(F.col("kind").isNotNull()).groupBy("value").agg(F.min("kind").alias("kind")))
    edges = cut(_patterns(every).select("pattern", "value", "refused").distinct())
    n = known.count()
    while True:
        tagged = edges.join(known, "value", "left")
        sums = tagged.groupBy("pattern").agg(
            F.count("*").alias("n"), *[F.sum(F.when((F.col("kind") == k) & ~F.col("refused"), 1).otherwise(0)).alias(k) for k in KINDS]
        )
        best = F.greatest(*[F.col(k) for k in KINDS])
        trusted = cut(sums.filter((best >= least_support) & (best >= least_precision * F.col("n"))).select(
            "pattern", F.coalesce(*[F.when(F.col(k) == best, F.lit(k)) for k in KINDS]).alias("as_kind"), (best / F.col("n")).alias("precision"), best.alias("support")
        ))
        trusted = checked_broadcast(trusted, trusted.count(), BROADCAST_PATTERNS)
        hits = _patterns(every.filter(F.col("kind").isNull() & ~F.col("refused"))).join(trusted, "pattern")
        score = F.col("precision") * F.log2(F.col("support"))
        found = cut(hits.groupBy("_row", "start", "end", "value").agg(F.max_by("as_kind", F.struct(score, "as_kind")).alias("kind")))
        grown = cut(known.unionByName(found.join(known.select("value"), "value", "left_anti").groupBy("value").agg(F.min("kind").alias("kind"))))
        before, n = n, grown.count()
        known = grown
        if n == before:
            return found.select("_row", "kind", "start", "end")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, base and spans of each row: the spans of the base patterns, and those with what bootstrapping adds.

    Both are arrays of struct(start, rank, end, kind), code points with the end exclusive, sorted by start and kind. Base spans
    are never dropped. Null and empty texts have none; rows that repeat an id, null too, are each searched. An empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    based = cut(base_spans(docs, id_col, text_col)).withColumn("_row", F.monotonically_increasing_id())
    based = based.select("doc_id", "_row", "base", "_refused", "_token")
    more = bootstrap(_instances(based), **how)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    more = more.distinct().groupBy(F.col("_row").alias("_of")).agg(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind")).alias("more"))
    bare = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["end"].alias("end"), b["kind"].alias("kind")))
    joined = based.select("doc_id", "_row", bare.alias("base")).join(more, F.col("_row") == F.col("_of"), "left")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.array_union("base", "more")))
    return joined.select("doc_id", "base", every.alias("spans"))


def _text_of(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    found = find_pii(table(spark, sf_dir, "documents"))

    def count(k: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_text_of("base"), 256).alias("base_sha256"), _text_of("spans").alias("spans"))
