"""Phrase mining, centroid clustering and packing against plain loops, with their edges."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kindred.llm import centroids, collocations, packing, token_files

PIECES, WORDS = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def mined(rows, least, keep):
    """lang, rank, phrase, a, l, r, n, score by counting every phrase of every piece."""
    out = []
    for lang in sorted({lang or "und" for _, lang in rows}):
        f = Counter()
        for text, of in rows:
            if (of or "und") == lang:
                for piece in PIECES.split(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
                    words = WORDS.findall(piece)
                    f.update(tuple(words[i : i + n]) for i in range(len(words)) for n in (1, 2, 3, 4) if i + n <= len(words))
        n = sum(c for w, c in f.items() if len(w) == 1)
        good = {w: c for w, c in f.items() if len(w) > 1 and c >= least}
        inside = lambda w, v: len(w) < len(v) and any(v[i : i + len(w)] == w for i in range(len(v)))
        found = []
        for w, a in good.items():
            if not any(inside(w, v) and 100 * c >= 80 * a for v, c in good.items()):
                score, k = min((2_000_000 * a // (f[w[:k]] + f[w[k:]]), k) for k in range(1, len(w)))
                found.append((-score, -a, " ".join(w).encode(), " ".join(w), f[w[:k]], f[w[k:]]))
        out += [(lang, i + 1, x[3], -x[1], x[4], x[5], n, -x[0]) for i, x in enumerate(sorted(found)[:keep])]
    return out


def as_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("block_words", [7, 64, 1 << 20])
@pytest.mark.parametrize("few", [0, 1000])
def test_phrases_by_counting(spark, monkeypatch, block_words, few):
    monkeypatch.setattr(collocations, "BROADCAST_PHRASES", few)
    monkeypatch.setattr(collocations, "BROADCAST_PARTS", few)
    monkeypatch.setattr(collocations, "_SLICE", 50)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "B", "b", "cé", "d,", "e.\n", "the", "\t", "of\x0b", "  x"], k=rng.randint(0, 120))) for _ in range(40)]
    rows = [(t, rng.choice(["en", "fr", None])) for t in texts] + [("a " * 300, "en"), (None, "en"), ("", None), (texts[0], "en"), (texts[0], "en"), ("a a a a a", "und")]
    docs = spark.createDataFrame([(t, g, 1, 2, 3) for t, g in rows], "text string, lang string, block int, n int, id int").repartition(3)
    got = as_rows(collocations.collocations(docs, least=5, keep=12, block_words=block_words))
    assert got == sorted(mined(rows, 5, 12)) and len(got) > 20


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("x y " * 29, "en")], "text string, lang string")).count() == 0
    # exactly 30 occurrences of "x y", 29 of "y x"; both go, as "x y x" has 29
    assert as_rows(collocations.collocations(spark.createDataFrame([("x y " * 30, "en")], "text string, lang string"))) == mined([("x y " * 30, "en")], 30, 2000)


def shuffled(spark, run):
    """Rows and bytes of each stage's shuffle writes while it runs."""
    jvm = spark.sparkContext._jvm
    stages = lambda: {x.stageId(): (x.shuffleWriteRecords(), x.shuffleWriteBytes()) for x in list(
        jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)))}
    before = stages()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return [v for k, v in stages().items() if k not in before]


def test_phrases_are_shuffled_in_bundles(spark):
    # nearly every pair of words is rare and of its own: a row each would be 80,000 rows for the first level alone
    rng = random.Random(8)
    texts = [(" ".join(f"w{rng.randrange(1500)}" for _ in range(400)), "en") for _ in range(200)]
    docs = spark.createDataFrame(texts, "text string, lang string").repartition(4)
    moved = shuffled(spark, lambda: collocations.frequent_phrases(docs)[0].count())
    assert max(rows for rows, _ in moved) < 10_000 and sum(b for _, b in moved) < 1_000_000


@pytest.mark.parametrize("away", [0, 1 << 40])
def test_parts_count_and_tell(spark, away):
    # blocks of words with large ids and few; told lists are those of frequent phrases, with their positions
    rng = np.random.default_rng(4)
    blocks = [rng.integers(0, 6, 90) for _ in range(5)]
    rows = [(k, int(w) + away, np.diff(np.flatnonzero(x == w) + 3, prepend=0).tolist()) for k, x in enumerate(blocks) for w in np.unique(x)]
    bundles = collocations._bundled(spark.createDataFrame(rows, "block long, id long, at array<int>"))
    lists = collocations.extend(bundles.selectExpr("block", "cast(null as long) part", "n", "m", "ids", "sizes", "steps", "cast(null as binary) kept"), 4)
    told = collocations._counted(lists, 4, 12, False).cache()
    want = Counter((int(a) + away, int(b) + away) for x in blocks for a, b in zip(x, x[1:]))
    found = told.filter("block is null").selectExpr("inline(arrays_zip(id, a, b, f))").collect()
    assert {(r.a, r.b): r.f for r in found} == {k: f for k, f in want.items() if f >= 12} and len({r.id for r in found}) == len(found) > 5
    named = {r.id: (r.a - away, r.b - away) for r in found}
    for k, x in enumerate(blocks):
        of = lists.filter(f"block = {k}").withColumn("kept", F.lit(None).cast("binary")).withColumn("ids", F.lit(None).cast("binary"))
        told_of = told.filter(f"block = {k}").select("block", "part", "n", "kept", "ids")
        seen = [r.asDict() for r in of.unionByName(told_of, allowMissingColumns=True).collect()]
        have = set()
        for ids, sizes, steps in collocations._kept(seen, 4):
            for i, at in zip(ids.tolist(), np.split(steps, np.cumsum(sizes)[:-1])):
                have |= {(named[i], p) for p in np.cumsum(at).tolist()}
        assert have == {((int(a), int(b)), i + 4) for i, (a, b) in enumerate(zip(x, x[1:])) if (int(a), int(b)) in named.values()}


def clustered(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024.0 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centres[j] = [sum(x) // len(vs) for x in zip(*vs)]
    placed = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in placed:
        inertia[j] += d
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), tuple(centres[j])) for i, d, j in placed)


def clusters(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect())


def test_centroids_by_trying_all(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(0, 0.2, (6, 64))
    rows = [(i, (base[i % 6] * rng.choice([1, 1, 3]) + rng.normal(0, 0.05, 64)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(500 + i, rows[3][1]) for i in range(30)] + [(3, rows[3][1]), (None, rows[5][1]), (None, None), (200, [0.1] * 63), (201, [0.1] * 65), (202, [])]
    rows += [(203, [None] + [0.1] * 63), (204, [float("nan")] * 64), (205, [float("inf")] + [0.0] * 63), (206, [0.0] * 64), (207, [-0.0] * 64)]
    df = spark.createDataFrame([(i, v, 7, 8, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, _v int, distance string").repartition(5)
    got = clusters(centroids.cluster_vectors(df))
    assert got == clustered(rows) and len(got) == 154
    # ties of distance go to the smaller number, also at the annulus' boundary
    tied = [(i, [float(x)] + [0.0] * 63) for i, x in enumerate([1, -1, 0, 0, 2, -2, 0.5, -0.5, 1, -1, 0, 0])]
    df = spark.createDataFrame(tied, "vec_id long, embedding array<double>")
    for rounds in (0, 1, 3):
        assert clusters(centroids.cluster_vectors(df, k=4, rounds=rounds)) == clustered(tied, 4, rounds)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (2, None)], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.cluster, r.distance) for r in centroids.cluster_vectors(df).collect()] == [(1, 0, 0)]
    assert centroids.cluster_vectors(df.filter("vec_id = 2")).count() == 0
    assert centroids.op12_centroids.__doc__ and centroids.cluster_vectors(df.limit(0)).count() == 0


def test_annulus_is_exact():
    rng = np.random.default_rng(5)
    for k in (1, 2, 50):
        x, c = rng.integers(-30, 30, (400, 5)), rng.integers(-30, 30, (k, 5))
        c[k // 2] = c[0]
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        chosen, far = centroids.Annulus(c).nearest(x)
        assert (chosen == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_packed(rows, ids_of, window):
    """Every id in one piece, sequences without gaps or overlaps, no padding."""
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for group in sequences.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == window or at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    want = Counter((i, at, n) for i, ids in ids_of for n in [len(ids)] for at in range(n))
    have = Counter((r.doc_id, r.start + k, r.doc_tokens) for r in rows for k in range(r.length))
    assert want == have


@pytest.mark.parametrize("few", [0, 1000])
def test_packing_is_whole(spark, data, library, monkeypatch, few):
    monkeypatch.setattr(packing, "BROADCAST_CUTS", few)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "same text"), (5, "same text"), (5, "same text"), (7, None), (8, ""), (9, "word " * 9000)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, part int, length int, ids int").repartition(4)
    ids_of = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [1], np.uint32)) for i, t in rows]
    got = packing.pack_documents(docs, window=256, with_ids=bool(few)).collect()
    check_packed(got, ids_of, 256)
    by_doc = {}
    for i, ids in ids_of:
        by_doc.setdefault((i, len(ids)), []).append(ids)
    for r in got:
        assert any(zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32 for ids in by_doc[r.doc_id, r.doc_tokens])
        assert not few or zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_pieces_leave_no_memory_behind():
    # a worker serves many tasks: ids of pieces that were handed on must be freed
    model = token_files.WordIds(token_files.default_tokenizer(), 1000)
    texts = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": ["some words, again " * 700] * 300})

    def held():
        rows = sum(batch.num_rows for batch in packing._pieces(iter([texts]), model, 0, 2048, 1))
        return rows, tracemalloc.get_traced_memory()[0]

    tracemalloc.start()
    try:
        held()
        rows, before = held()
        assert held() == (rows, pytest.approx(before, abs=1 << 20)) and rows == 600
    finally:
        tracemalloc.stop()


def test_packed_sequences_hold_the_ids(spark, library):
    docs = spark.createDataFrame([(i, "one two three " * i) for i in range(40)], "doc_id long, text string")
    rows = packing.packed_sequences(docs, window=64).collect()
    assert all(len(r.ids) in (64, 32, 16, 8, 4, 2, 1) and sum(r.lengths) == len(r.ids) for r in rows)
    assert Counter(x for r in rows for x in r.ids) == Counter(x for i in range(40) for x in library.encode("one two three " * i, add_special_tokens=False).ids + [1])
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_combinations_fill_the_window():
    ways = packing.combinations(96)
    made = {tuple(sorted([a] * k + [b] * (b > 0))) for a, k, b in zip(ways.first.tolist(), ways.times.tolist(), ways.second.tolist())}
    want = {tuple(sorted([a] * k + ([96 - a * k] if 96 > a * k else []))) for a in range(1, 97) for k in range(1, 96 // a + 1)}
    assert made == want and len(ways.first) == len(want)


def test_least_squares_meets_its_conditions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 5000):
        lengths = np.minimum(64, rng.geometric(0.05, n))
        h = np.bincount(lengths, minlength=65)
        ways = packing.combinations(64)
        x = packing.solve(h, ways, passes=20_000, close=1e-9)
        used = np.bincount(ways.first, x * ways.times, 65) + np.bincount(ways.second, x, 65)
        slope = (used - h)[ways.first] * ways.times + np.where(ways.second > 0, (used - h)[ways.second], 0)
        may = (h[ways.first] > 0) & ((h[ways.second] > 0) | (ways.second == 0))
        assert (x >= 0).all() and (x[~may] == 0).all() and (slope[may] > -1e-4).all() and (np.abs(slope[x > 1e-6]) < 1e-4).all()
        counts = packing.whole_counts(h, ways, x)
        used = np.bincount(ways.first, counts * ways.times, 65) + np.bincount(ways.second, counts, 65)
        assert (used[1:] <= h[1:]).all() and (counts >= 0).all()
