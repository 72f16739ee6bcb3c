"""The pipeline against a brute-force version."""

from collections import Counter

import tiktoken

import corpus_pipeline
import public_tokenizers
from kindred.llm import byte_bpe, mixing, simhash, toxicity


def test_run_is_its_brute_force_version(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = {k for k, t in texts.items() if model.probability(model.best(model.token_scores(toxicity.tokens(t)))[0], len(toxicity.tokens(t))) < 0.5}

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    best = {}
    for k in left:
        key = texts[k].translate(lower)
        best[key] = max(best.get(key, -1), k)
    left = sorted(best.values())

    sets = {k: set(simhash.shingle_hashes(texts[k], 5).tolist()) for k in left}
    root = {k: k for k in left}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(left):
        for b in left[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[x] = y
    left = {find(k) for k in left}

    taken = mixing.mix_sources(docs.filter(docs.doc_id.isin(sorted(left)))).collect()
    want = Counter({r.doc_id: r.copies if r.size else 1 for r in taken})

    rows = corpus_pipeline.run(spark, data).collect()
    assert Counter(r.doc_id for r in rows) == +want
    ranks = byte_bpe.merges(byte_bpe.default_ranks()).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r.ids == library.encode_ordinary(r.text) and r.text == texts[r.doc_id] for r in rows)
