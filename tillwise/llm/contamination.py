"""Benchmark decontamination with a broadcast hash set of test n-grams.

The normalised windows of the benchmark form a hash set that every task holds; each document's word
windows are looked up in it, and a hit is verified word by word (the set's keys are the windows
themselves). A benchmark of more than ``block_words`` words is taken in blocks of counted words: an
item longer than a block is cut into pieces that share ``window`` - 1 words, so each window lies in one
piece. Blocks are taken one after another, and each block's hits are written before the next is
fetched: the texts of a block are broadcast, each worker builds its set from them and holds one at a
time, and the broadcast is destroyed after use. The hits are joined on the row's identity, so the
result is the same.

Defined cases: a null document or item has no words; an item of fewer than ``window`` words is one
window; equal items are both reported; items with a null id mark words but are not listed; a row that
is repeated is judged alike each time; empty tables give an empty or a clean result; columns other
than the id and the text are carried along or ignored, whatever their names. Documents never shuffle
unless the benchmark needs several blocks.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import raw, same, ship, slices, text_key

WINDOW = 13
#: Words of the benchmark that one broadcast set may hold (about 200 bytes a window).
BLOCK_WORDS = 2_000_000

_WORD_BYTES = bytes(c for c in range(256) if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)
_NORMAL = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if (c + 32 if 0x41 <= c <= 0x5A else c) in _WORD_BYTES else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: bytes) -> list[bytes]:
    """Words of a text: ASCII letters in lower case, digits and every character beyond ASCII."""
    return text.translate(_NORMAL).split()


class NgramSet:
    """Windows of benchmark items by length; keys are the windows' word numbers, so a hit is exact."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        self.windows: dict[int, dict[bytes, tuple[int, ...]]] = {}
        for at, (_, text) in enumerate(items):
            words = normal_words(text)
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32)
            size = min(window, len(words))
            table = self.windows.setdefault(size, {})
            for i in range(len(words) - size + 1):
                key = ids[i : i + size].tobytes()
                if at not in table.get(key, ()):
                    table[key] = (*table.get(key, ()), at)
        self.filters = {size: self._filter(size) for size in self.windows}

    @staticmethod
    def _hash(columns: np.ndarray) -> np.ndarray:
        h = np.zeros(columns.shape[0], np.uint64)
        for j in range(columns.shape[1]):
            h = (h ^ columns[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def _filter(self, size: int) -> np.ndarray:
        """Sorted hashes of the windows of one length: the vectorised first look."""
        rows = np.frombuffer(b"".join(self.windows[size]), np.int32).reshape(-1, size)
        return np.unique(self._hash(rows))

    def hits(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
        """For each text: number of words, word ranges that are hit, items that occur."""
        get = self.vocabulary.get
        split = [normal_words(t) for t in texts]
        starts = np.cumsum([0, *(len(w) + 1 for w in split)])
        flat = np.zeros(int(starts[-1]), np.int32)  # a zero after each text, and for each unknown word
        for at, words in zip(starts, split):
            flat[at : at + len(words)] = [get(w, 0) for w in words]
        unknown = np.concatenate([[0], np.cumsum(flat == 0)])
        found: list[tuple[list, set]] = [([], set()) for _ in texts]
        for size, table in self.windows.items():
            if len(flat) < size:
                continue
            here = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(here):
                continue
            marks = self._hash(flat[here[:, None] + np.arange(size)])
            order = self.filters[size]
            place = np.minimum(np.searchsorted(order, marks), len(order) - 1)
            for i in here[order[place] == marks]:
                items = table.get(flat[i : i + size].tobytes())
                if items:
                    doc = int(np.searchsorted(starts, i, side="right")) - 1
                    found[doc][0].append((int(i - starts[doc]), int(i - starts[doc]) + size))
                    found[doc][1].update(items)
        return [(len(w), *f) for w, f in zip(split, found)]


_held: dict[str, NgramSet] = {}


def _set_of(key: str, items: list[tuple[str | None, bytes]], window: int) -> NgramSet:
    """The set of a block, built once per worker; the one before it is let go."""
    if key not in _held:
        _held.clear()
        _held[key] = NgramSet(items, window)
    return _held[key]


def _pieces(items: DataFrame, window: int, block_words: int) -> DataFrame:
    """``name, words, n``: items cut where they are longer than a block; each window lies in one piece."""
    step = max(1, block_words - window + 1)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WORD.pattern), F.lit(0))
    split = items.select(F.col("item_id").cast("string").alias("name"), words.alias("all"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)), F.lit(step))
    cut = split.select("name", "all", F.explode(starts).alias("start"))
    part = F.slice("all", F.col("start") + 1, step + window - 1)
    return cut.select("name", F.array_join(part, " ").alias("words"), F.size(part).alias("n")).distinct()


def _blocks(items: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in lists of ``block_words`` words at most (or one window), each to be broadcast on its own.

    Pieces are dealt to parts by hash, about half a block each, and a part is fetched when its turn comes.
    """
    pieces = _pieces(items, window, block_words)
    total = pieces.agg(F.sum("n")).first()[0] or 0
    parts = 1
    if total > block_words:
        pieces, parts = materialize(pieces, "benchmark-pieces"), -(-2 * total // block_words)
    block, held = [], 0
    for i in range(parts):
        here = pieces.where(F.pmod(F.xxhash64("name", "words"), F.lit(parts)) == i) if parts > 1 else pieces
        for row in here.collect():
            if block and held + row["n"] > block_words:
                yield block
                block, held = [], 0
            block.append((row["name"], row["words"].encode()))
            held += row["n"]
    yield block


_HITS = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def _scan(docs: DataFrame, items: list[tuple[str | None, bytes]], window: int) -> tuple[DataFrame, Broadcast]:
    """Document id, text key, and what one block of the benchmark hits; and the broadcast that this needs."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items, window))
    hit_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _set_of(*shared.value)
        names = index.names
        for part in slices(batches, 1):
            found = index.hits(raw(part.column(1)))
            spans = [[{"start": a, "end": b} for a, b in merged(s)] for _, s, _ in found]
            listed = [sorted({names[i] for i in items if names[i] is not None}) for _, _, items in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([n for n, _, _ in found], pa.int64()), pa.array(spans, hit_type), pa.array(listed, pa.list_(pa.string()))],
                ["doc_id", "text_key", "n_words", "spans", "items"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, {_HITS}"), shared


def _settled(scan: tuple[DataFrame, Broadcast], only_hits: bool = True) -> DataFrame:
    """What a scan finds, written; its broadcast goes."""
    found, shared = scan
    out = materialize(found.where(F.size("items") + F.size("spans") > 0).distinct() if only_hits else found, "contamination")
    shared.destroy()
    return out


def _gathered(found: list[DataFrame]) -> DataFrame:
    """The hits of several blocks, one row a document."""
    return reduce(DataFrame.union, found).groupBy("doc_id", "text_key").agg(
        F.flatten(F.collect_list("spans")).alias("more"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("names")
    )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, text_key, n_words, spans, items``: word ranges in benchmark windows, and those items.

    Ranges of several blocks may touch or overlap; :func:`judged` counts each word once.
    """
    blocks = _blocks(benchmark, window, block_words)
    scan, second = _scan(docs, next(blocks), window), next(blocks, None)
    if second is None:
        return scan[0]
    first = _settled(scan, only_hits=False)
    both = _gathered([_settled(_scan(docs, items, window)) for items in chain([second], blocks)])
    joined = first.join(both, same(first, both, "doc_id", "text_key"), "left")
    return joined.select(
        first["doc_id"], first["text_key"], first["n_words"],
        F.concat(first["spans"], F.coalesce("more", F.array())).alias("spans"),
        F.array_union(first["items"], F.coalesce("names", F.array().cast("array<string>"))).alias("items"),
    )


def _covered(spans):
    """Words in a union of ranges, in order of start: a running end spares the union itself."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0).cast("long"))).alias("n"),
        F.greatest(acc["end"], s["end"]).alias("end"),
    )
    zero = F.lit(0).cast("long")
    return F.aggregate(F.array_sort(spans), F.struct(zero.alias("n"), zero.alias("end")), step, lambda acc: acc["n"])


def judged(hits: DataFrame) -> DataFrame:
    """``hits`` with n_hit, n_items, the items' digest and the verdict: a twentieth of the words hit."""
    counted = hits.withColumn("n_hit", _covered(F.col("spans")))
    return counted.select(
        "doc_id", "text_key", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, cut: str = "documents", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Remove contaminated documents, or (``cut="spans"``) the hit words of such documents.

    All columns of ``docs`` stay. With one block this is a single narrow pass over the documents. With
    several, each block's hits are written on their own and then joined to the documents once.
    """
    if cut not in ("documents", "spans"):
        raise ValueError(cut)
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    mark = "hits"
    while mark in docs.columns:
        mark += "_"
    blocks = _blocks(benchmark, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        marked = _marked(docs, first, window, at, mark)
    else:
        hits = _gathered([_settled(_scan(docs, items, window)) for items in chain([first, second], blocks)])
        flat = F.flatten(F.transform("more", lambda s: F.array(s["start"], s["end"])))
        hits = hits.select(F.struct("doc_id", "text_key").alias(mark), flat.alias("_ranges"))
        rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.struct(docs["doc_id"], text_key(docs["text"]).alias("text_key")).alias("own"))
        joined = rows.join(hits, F.col("own") == F.col(mark), "left")
        ranges = F.coalesce("_ranges", F.array().cast("array<bigint>")).alias(mark)
        marked = joined.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], ranges)
    return marked.mapInArrow(_cutter(at, cut), docs.schema)


def _marked(docs: DataFrame, items: list[tuple[str | None, bytes]], window: int, at: int, mark: str) -> DataFrame:
    """``docs`` with the word ranges that the one block hits in the last column, ``mark``."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _set_of(*shared.value)
        for part in slices(batches, at):
            found = index.hits(raw(part.column(at)))
            spans = pa.array([[x for s in f[1] for x in s] for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, spans], [*part.schema.names, mark])

    return docs.mapInArrow(run, docs.withColumn(mark, F.array().cast("array<bigint>")).schema)


def _cutter(at: int, cut: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            spans = [merged(list(zip(s[::2], s[1::2]))) for s in part.column(part.num_columns - 1).to_pylist()]
            texts = raw(part.column(at))
            bad = [bool(s) and 20 * sum(b - a for a, b in s) >= len(normal_words(t)) for s, t in zip(spans, texts)]
            out = part.select(range(part.num_columns - 1))
            if cut == "documents":
                yield out.filter(pa.array([not b for b in bad], pa.bool_()))
            else:
                texts = [without(t, s) if b else t for t, s, b in zip(part.column(at).to_pylist(), spans, bad)]
                columns = list(out.columns)
                columns[at] = pa.array(texts, out.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=out.schema)

    return run


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of each range."""
    places = [m.span() for m in _WORD.finditer(text)]
    for a, b in reversed(spans):
        text = text[: places[a][0]] + text[places[b - 1][1] :]
    return text
