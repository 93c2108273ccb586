"""Queries on the given tables against brute force, and against DuckDB where there is a text."""

import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import frame
from tests.oracle_check import compare, connect
from tillwise.llm import quality, queries


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    assert compare(spark, connect(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf) is None


def test_sharding(spark, sf, documents):
    got = {r["doc_id"]: r for r in queries.op1_sharding(spark, sf).collect()}
    assert len(got) == len(documents)
    loads = Counter()
    for doc, text in documents:
        data = (text or "").encode()
        assert (got[doc]["size"], got[doc]["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        loads[got[doc]["shard"]] += len(data) + 1
    assert set(loads) == set(range(8))
    assert max(loads.values()) - min(loads.values()) <= 200
    for shard in range(8):
        places = sorted(r["slot"] for r in got.values() if r["shard"] == shard)
        assert places == list(range(len(places)))


def test_suffix_dedup(spark, sf, documents):
    got = rows(queries.op3_suffix_dedup(spark, sf), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.suffix_dedup(documents))


def test_jaccard(spark, sf, documents):
    assert rows(queries.op4_jaccard_join(spark, sf), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(documents))


def test_decontamination(spark, sf, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = rows(queries.op5_decontamination(spark, sf), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.decontamination(documents, items))


def test_quality(spark, sf, documents):
    got = {r["doc_id"]: r for r in queries.op6_quality_rules(spark, sf).collect()}
    assert set(got) == {d for d, _ in documents}
    for doc, text in documents:
        r = got[doc]
        base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert tuple(r[c] for c in base) == brute.quality_base(text)
        assert not (r["base_failed"] and r["kept"])


def test_quality_agrees_with_labels(spark, sf):
    report = queries.op6_quality_rules(spark, sf).where("not base_failed")
    labelled = report.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in labelled) >= 0.95 * len(labelled)


def test_secrets(spark, sf, documents):
    found = queries.op7_secret_scans(spark, sf)
    got = rows(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == sorted((d, *brute.fixed_secrets(t)) for d, t in documents)
    texts = dict(documents)
    for doc, spans in found.select("doc_id", "spans").collect():
        for span in filter(None, spans.split(",")):
            kind, start, end = span.split(":")
            assert kind in ("assign", "access", "hex", "crf") and 0 <= int(start) < int(end) <= len(texts[doc])


def test_bpe(spark, sf, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    coded = [e.ids for e in tokenizer.encode_batch([t or "" for _, t in documents], add_special_tokens=False)]
    plain = tokenizer.decode_batch(coded, skip_special_tokens=False)
    want = [(d, len(i), brute.sha(",".join(map(str, i))), brute.sha(p)) for (d, _), i, p in zip(documents, coded, plain)]
    assert rows(queries.op8_bpe(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_warc(spark, sf):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = rows(queries.op10_warc(spark, sf), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted(brute.warc(pages))


def brute_pipeline(documents, items):
    """Rows of the pipeline, and the number of documents below the least number of words after line dedup."""
    from tokenizers import Tokenizer

    docs = [(d, j["cleaned"]) for d, j in ((d, quality.judge(t)) for d, t in documents) if j["kept"]]
    words = lambda t: len(brute.WORD.findall(t))
    docs = [(d, left) for d, _, dropped, left in brute.line_dedup(docs) if not dropped or words(left) >= 50]
    short = sum(words(t) < 50 for _, t in docs)
    _, roots = brute.components(docs, 5, 80)
    docs = [row for i, row in enumerate(docs) if roots[i] == i]
    bad = {r[0] for r in brute.decontamination(docs, items) if r[-1]}
    docs = [row for row in docs if row[0] not in bad]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = [(d, len(i), brute.sha(",".join(map(str, i))), brute.sha(t)) for d, t in docs for i in [tokenizer.encode(t, add_special_tokens=False).ids]]
    return sorted(rows), short


def test_pipeline(spark, sf, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want, short = brute_pipeline(documents, items)
    got = rows(corpus_pipeline.run(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == want and 0 < len(got) < len(documents) and short == 0
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_of_odd_tables(spark, odd, odd_docs, no_docs, tmp_path):
    """Null, repeated and long rows run through; of equal rows one stays; empty tables give nothing."""
    bench = frame(spark, [(1, None), (2, ""), (None, "The shared line, of many documents!")], "item_id")
    for name, docs in (("odd", odd_docs), ("empty", no_docs)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").select("ids_sha256").collect()
    assert 0 < len(got) < len(odd) and len({r[0] for r in got}) == len(got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
