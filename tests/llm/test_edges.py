"""Null, empty, long, tied and repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest

import corpus_pipeline
from kindred.llm import byte_bpe, exact_dedup, line_dedup, mixing, pii, simhash, token_files, toxicity, url_filter, winnowing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, score double, id string, value int, block int, bucket int"
LONG = "word " * 30_000 + "x" * 20_000
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, LONG, "en", "a"), (4, "one two three four five six", None, None), (4, "one two three four five six", None, None),
    (None, "call +1 (234) 567-8901 or a@b.co", "en", "b"), (6, "ONE two three four five six", "en", "b"), (7, " \n\t ", "en", ""), (8, "é\n" * 50, "fr", "b"),
]


def nasty(spark):
    return spark.createDataFrame([(*r, None, 5, True, 0.5, "x", 1, 2, 3) for r in ROWS], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 1, 1), (6, 0, 1), (8, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "mixing": mixing.mix_sources,
    "byte_bpe": lambda d: byte_bpe.encode_documents(d, digests=True),
    "winnowing": winnowing.edited_fingerprints,
    "fingerprints": winnowing.fingerprint_documents,
    "exact": lambda d: exact_dedup.exact_dedup(d, digest_all=True),
    "lines": lambda d: line_dedup.apply_bitmaps(d, line_dedup.line_bitmaps(d, least_docs=2, least_chars=3)),
    "pii": pii.find_pii,
    "simhash": simhash.simhash_components,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    docs = nasty(spark)
    assert OPERATORS[name](docs).count() == len(ROWS)
    assert OPERATORS[name](docs.limit(0)).count() == 0
    one = docs.filter("doc_id = 1")
    assert OPERATORS[name](one).count() == 1


def test_toxicity_edges(spark):
    docs = nasty(spark)
    for marks in (labels(spark), labels(spark).limit(0)):
        model = toxicity.fit(docs, marks)
        found = toxicity.score(docs, model, passages=True).collect()
        assert len(found) == len(ROWS)
        assert all(0 <= r.score <= 1 for r in found)
        assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs.limit(0), labels(spark)).tokens == {}


def test_token_files_edges(spark, tmp_path):
    for k, docs in enumerate((nasty(spark), nasty(spark).limit(0))):
        token_files.write_token_files(docs, str(tmp_path / f"f{k}"))
        found = sorted(token_files.read_token_files(spark, str(tmp_path / f"f{k}"), with_ids=True).collect(), key=lambda r: r.start)
        assert len(found) == docs.count()
        assert [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(len(found))]
        assert all(r.ids[-1] == 1 and len(r.ids) == r.n_tokens for r in found)


def test_url_edges(spark):
    rows = [(1, None, None), (2, "", "<p>x"), (3, "nope", None), (4, "http://A.Net/es/x?y#z", "<b>hello"), (4, "http://A.Net/es/x?y#z", "<b>hello"), (None, "x://" + "ab" * 9000, None)]
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, html string, host string, verdict string")
    model = url_filter.fit(pages)
    found = url_filter.filter_urls(pages, model).collect()
    assert len(found) == len(rows)
    assert {(r.host, r.path, r.rule, r.verdict) for r in found if r.page_id == 4} == {("a.net", "/es/x", "net/es/", "block")}
    assert url_filter.filter_urls(pages.limit(0), url_filter.fit(pages.limit(0))).count() == 0


@pytest.mark.parametrize("at", range(5))
def test_stages_keep_the_columns_of_documents(spark, at, tmp_path):
    docs = nasty(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[at]
    for rows in (docs, docs.limit(0)):
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == docs.columns or at == 4
        n = out.count()
        if at == 4:
            assert n == rows.count() and {"doc_id", "text", "ids", "n_tokens"} <= set(out.columns)
        assert n <= 2 * rows.count()
        if name == "exact dedup" and rows is docs:
            assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 2, 3, 6, 7, 8]


def test_replaced_columns(spark):
    docs = spark.createDataFrame([(1, "ab", "old")], "doc_id long, text string, ids string")
    row = byte_bpe.encode_documents(docs).first()
    assert row.n_tokens == len(row.ids) and bytes(byte_bpe.merges(byte_bpe.default_ranks()).decode(row.ids)) == b"ab"
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).first()
    assert back.decoded == "ab"


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(9, "Same text")] * 3 + [(2, "same TEXT"), (None, "same text")], "doc_id long, text string")
    found = exact_dedup.exact_dedup(docs).collect()
    assert sum(r.kept for r in found) == 1 and {r.group_size for r in found} == {5} and {r.keep_id for r in found} == {9}
    assert [r.text for r in exact_dedup.drop_exact_copies(docs).collect()] == ["Same text"]
    assert exact_dedup.exact_dedup(docs, broadcast_keys=0).filter("kept").count() == 1
