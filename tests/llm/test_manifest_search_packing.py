"""The Merkle manifest, ranked search and packing against brute force, on the given tables and on odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import frame
from tests.llm.test_odd_cases import BENCHMARK, bag
from tillwise.llm import lexical, merkle, packing, queries

MERKLE = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def versions(docs, **more):
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.versions(docs, changed, F.translate("text", queries.UPPER, queries.LOWER), **more)


def source_rows(odd):
    """The odd rows over sources of no, one, 16, 17 and many rows, with nulls in every column."""
    rng = random.Random(5)
    names = [None, "", "é", "src1", "src1", "src2", *[f"s{i:02}" for i in range(40)]]
    rows = [(d, rng.choice(names), rng.choice([None, "en"]), rng.choice([None, 0, 7]), t) for d, t in odd]
    rows += [(i, "full", "en", 1, f"Text {i}") for i in range(16)] + [(i, "over", "en", 1, "Same") for i in range(17)]
    return rows + [(None, "hot", None, None, None)] * 20 + [(3, "alone", "en", 1, "A")]


def merkle_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("grp", F.lit("x")).repartition(3)


def test_merkle_given(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute.merkle([tuple(r) for r in docs.select(*merkle.COLUMNS).collect()])
    assert bag(queries.op11_merkle(spark, sf), *MERKLE) == Counter(want)


def test_merkle_odd(spark, odd):
    rows = source_rows(odd)
    got = versions(merkle_frame(spark, rows), proofs=True)
    assert bag(got, *MERKLE) == Counter(brute.merkle(rows))
    for r in got.collect():
        assert brute.sha("".join(r["proof"])) == r["proof_sha256"]
        assert (r["copied"][-1] if r["copied"] else r["new_leaf"] or r["leaf"]) == r["folded_root"]
    lone = versions(merkle_frame(spark, rows[-1:])).first()
    assert lone["leaf"] == lone["root"] and lone["proof_sha256"] == brute.sha("") and lone["copied"] == []
    assert versions(merkle_frame(spark, [])).count() == 0


def test_merkle_over_many_blocks(spark):
    """A source of more than 16 blocks: two levels above them, and a last run of one node at every level."""
    n = 65_537
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"),
        F.concat(F.lit("Doc "), F.col("id").cast("string")).alias("text"),
    ).unionByName(merkle_frame(spark, [(1, None, "de", 2, "Zwei"), (2, "z", None, None, None)]).drop("grp"))
    rows = [(i, "hot", "en", 1, f"Doc {i}") for i in range(n)] + [(1, None, "de", 2, "Zwei"), (2, "z", None, None, None)]
    assert bag(versions(docs), *MERKLE) == Counter(brute.merkle(rows))


def test_versions_share_nodes():
    root = merkle.block_tree([f"{i}" for i in range(4096)], False)
    way = merkle.trail(root, 1000)
    copied = merkle.with_leaf(way, "new")
    assert len(copied) == 3 and copied[-1].digest != root.digest
    old, new = root, copied[-1]
    for at in (1000 // 256, 1000 // 16 % 16, 1000 % 16):
        assert all(a is b for k, (a, b) in enumerate(zip(old.children, new.children)) if k != at)
        old, new = old.children[at], new.children[at]
    assert (old.digest, new.digest) == ("1000", "new") and merkle.with_leaf(way, "1000")[-1].digest == root.digest


SEARCH = ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("chunk, group", [(1 << 20, 1 << 14), (9000, 5)])
def test_search_odd(spark, odd, odd_docs, no_docs, chunk, group):
    items = [(8, odd[0][1]), (8, odd[0][1]), (9, "q" * 40_000), (10, "nowhere xyzzy"), (11, "ab ab AB éÉ"), (12, odd[-4][1]), *BENCHMARK]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = lexical.search(odd_docs, asked, chunk=chunk, group=group)
    assert bag(got, *SEARCH) == Counter(brute.lexical(odd, items))
    assert lexical.search(no_docs, asked).count() == lexical.search(odd_docs, asked.limit(0)).count() == 0


def test_search_in_small_trees(spark, documents, sf, monkeypatch):
    """The same result however many documents a tree holds."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = [(d, Counter(lexical.terms((t or "").encode()))) for d, t in documents]
    found = [(d, c) for d, c in found if c]
    words = sorted({t for _, t in items for t in lexical.terms(t.encode())})
    place = {w: i for i, w in enumerate(words)}
    df = np.array([sum(w in c for _, c in found) for w in words])
    length = sum(sum(c.values()) for _, c in found)
    (group,) = lexical.grouped([[place[w] for w in lexical.terms(t.encode())] for _, t in items], df, len(found), 1 << 20)
    tf = np.array([[c[words[t]] for t in group.order] for _, c in found], np.int32)
    m = np.array([75 + 25 * sum(c.values()) * len(found) // length for _, c in found], np.int64)
    ids = np.array([d for d, _ in found])
    want = Counter(brute.lexical(documents, items))
    for size in (7, 64, len(found)):
        best, seen = lexical.Best(len(items), 20), 0
        for at in range(0, len(found), size):
            seen += lexical.look(lexical.plant(tf[at : at + size], m[at : at + size], ids[at : at + size]), group, best)
        got = [(items[i][0], k + 1, -d, s) for i, heap in enumerate(best.heaps) for k, (s, d) in enumerate(sorted(heap, reverse=True))]
        assert Counter(got) == want
    assert seen <= 2 * len(found)


def test_bounds_leave_out_subtrees():
    """A group that cannot reach the best is never entered."""
    tf = np.zeros((1200, 40), np.int32)
    tf[:200, :20] = 5  # holds the item's terms
    rng = np.random.default_rng(1)
    tf[200:, 20:] = rng.integers(0, 2, (1000, 20))
    tf[200:, 0] = 1
    tf[:200, 0] = 0
    group = lexical.Group([0], np.arange(40), np.arange(20), np.full(20, 10), np.array([0]))
    best = lexical.Best(1, 20)
    seen = lexical.look(lexical.plant(tf, np.full(1200, 100, np.int64), np.arange(1200)), group, best)
    assert len(best.heaps[0]) == 20 and seen < 300


def packed_rows(df):
    """Rows by document, after checking that sequences are gapless and within capacity."""
    rows, at = df.collect(), defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end <= 1024
    return rows, at


def want_pieces(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    out = []
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if k == 0 else start + 1024]
            out.append((doc, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def first_fit(lengths):
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        for i, free in enumerate(bins):
            if free >= n:
                bins[i] -= n
                break
        else:
            bins.append(1024 - n)
    return len(bins)


def test_packing_given(spark, sf, documents):
    rows, at = packed_rows(queries.op13_packing(spark, sf))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter(want_pieces(documents))
    assert len(at) <= first_fit([r["length"] for r in rows])


def test_packing_odd(odd, odd_docs, no_docs):
    path = queries.tokenizer_path()
    packed = packing.pack_documents(odd_docs, path, keep_ids=True)
    rows, at = packed_rows(packed)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter(want_pieces(odd))
    held = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert set(held) == set(at)
    for r in rows:
        assert held[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert packing.pack_documents(no_docs, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1024), max_size=300), st.integers(1, 5))
def test_plan_uses_every_piece_once(lengths, copies):
    counts = Counter(lengths * copies)
    plan = packing.plan(counts)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 1024 and times > 0
        for n in pattern:
            used[n] += times
    assert used == counts
    assert sum(t for _, t in plan) <= 1.02 * first_fit(list(counts.elements())) + 1


def test_plan_fills_gaps_exactly():
    assert packing.plan({1000: 3, 24: 2, 12: 2}) == [((1000, 24), 2), ((1000, 12, 12), 1)]
    assert packing.plan({700: 5, 100: 5, 200: 5, 24: 5}) == [((700, 200, 100, 24), 5)]
    assert packing.plan({512: 7}) == [((512, 512), 3), ((512,), 1)]
    assert packing.plan({1024: 10**12, 1: 2048}) == [((1024,), 10**12), ((1,) * 1024, 2)]
