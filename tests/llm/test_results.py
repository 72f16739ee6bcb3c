"""Whole results of op1, op2 and op5 by plain loops, and what stages make of nothing and of odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
import tiktoken

import corpus_pipeline
import public_tokenizers
from kindred.llm import byte_bpe, mixing, queries, simhash, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def water_filled(sizes, share=Fraction(3, 2), weights=(3, 1, 2), cap=2):
    """Targets by source, in exact fractions: the excess over the cap is reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(full.values())
        even = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s: Fraction(cap * sizes[s]) for s in free if even[s] > cap * sizes[s]}
        if not over:
            return full | even
        full |= over


def test_mixing_is_recomputed(spark, rows):
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    sizes, most = Counter(), Counter()
    for r in rows:
        sizes[r.source] += words[r.doc_id]
        most[r.source] = max(most[r.source], words[r.doc_id])
    targets, of, taken = water_filled(sizes), {r.doc_id: r.source for r in rows}, Counter()
    found = queries.QUERIES["op1_mixing"](spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(of)
    for r in found:
        source = of[r.doc_id]
        rate = targets[source] / sizes[source]
        assert r.size == words[r.doc_id] and r.source_size == sizes[source] and abs(r.target - targets[source]) < 1e-6 * targets[source]
        # each document is taken the whole part of its source's rate, and at most once more
        assert r.taken % max(r.size, 1) == 0 and (r.size == 0 or math.floor(rate) <= r.taken // r.size <= math.ceil(rate))
        taken[source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= most[s] for s in targets)


def test_water_filling_with_full_sources(spark):
    words = {"a": 1, "b": 400, "c": 30, "d": 2, None: 50}
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(words.items())], "doc_id long, text string, source string")
    want = water_filled(Counter(words))
    assert {r.source: round(r.target, 6) for r in mixing.mix_sources(docs).collect()} == {s: round(float(t), 6) for s, t in want.items()}


def test_byte_bpe_digests_are_recomputed(spark, rows):
    ranks = byte_bpe.merges(byte_bpe.default_ranks()).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = {}
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op2_byte_bpe"](spark, SF).collect()} == want


def plain_segments(scores):
    """Maximal segments by looking for the best one and then left and right of it, in exact fractions of the scores."""
    out, todo = [], [(0, len(scores))]
    while todo:
        low, high = todo.pop()
        best, total, start, top = Fraction(0), Fraction(0), low, None
        for i in range(low, high):
            if total <= 0:
                total, start = Fraction(0), i
            total += scores[i]
            if total > best:
                best, top = total, (start, i + 1)
        if top:
            out.append(float(best))
            todo += [(low, top[0]), (top[1], high)]
    return out


def test_toxicity_scores_are_recomputed(spark, rows):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = toxicity.fit(docs, labels)
    found = {r.doc_id: r for r in toxicity.score(docs, m).collect()}
    whole = {r.doc_id: r for r in queries.QUERIES["op5_toxicity"](spark, SF).collect()}
    assert set(found) == set(whole) == {r.doc_id for r in rows} and m.tokens
    for r in rows:
        words = [w.lower() for w in re.findall(r"[^\W\d_]+", r.text or "")]
        scores = []
        for w in words:
            s = m.tokens.get(w)
            if s is None and len(w) > 6:
                s = m.prefixes.get(w[:7])
            if s is None and len(w) > 4:
                s = m.prefixes.get(w[:5])
            scores.append((m.base if s is None else s) - m.drift)
        n = max(len(scores), 1)
        got = sorted(plain_segments([Fraction(s) for s in scores]), reverse=True) if len(scores) < 1500 else None
        if got is None:
            continue  # exact fractions are slow on the longest texts
        floor = max(0.0, (m.log_k + math.log(n)) / m.scale)
        total = (got[0] if got else 0.0) + sum(v - floor for v in got[1:] if v >= floor and got[0] > floor)
        p = 1 / (1 + math.exp(-(m.slope * (m.scale * total - m.log_k - math.log(n)) + m.offset)))
        assert abs(found[r.doc_id].score - p) < 1e-6 and found[r.doc_id].predicted == int(found[r.doc_id].score >= 0.5)
        assert (whole[r.doc_id].score, whole[r.doc_id].predicted) == (found[r.doc_id].score, found[r.doc_id].predicted)
        assert whole[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_a_pipeline_of_no_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() == 0 and "doc_id" in found.columns


def test_near_copies_of_nothing_and_of_nulls(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e f"), (4, "a b c d e f"), (None, "x"), (None, None)], "doc_id long, text string")
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in simhash.drop_near_copies(docs).collect() if r.text is not None)
    assert [k for k in kept if k[2] == "a b c d e f"] and len([k for k in kept if k[2] == "a b c d e f"]) == 1 and (True, 0, "x") in kept
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0
