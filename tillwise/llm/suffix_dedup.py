"""Suffix-array dedup: bytes of passages that stand earlier in the corpus.

A passage is ``SPAN`` bytes long. Sorting a suffix for every byte would need many times the input, so
the suffix array is sparse: every passage picks one anchor in it, the place whose ``LEAD`` bytes (the
suffix's leading tokens) have the least hash. Equal passages pick the same place, so each repeated
passage shows up as two suffixes with equal leading tokens. About one byte in 35 is an anchor.

1. Anchors whose leading tokens occur once are dropped. Map tasks settle repeats inside a batch and
   send one row per key on, so very common tokens are combined before the shuffle.
2. The others become suffixes: an anchor with the text on both sides that its passages cover.
   Splitters from a bounded sample range-partition them by (hash of the leading tokens, document, place), so
   a very common key spreads over several buckets, also where one document of padding repeats it.
3. A bucket sorts its suffixes, forwards and backwards, by multikey quicksort with eight-byte digits:
   only runs of equal prefixes are sorted by the next digit. Common prefix lengths of neighbours give
   the class of every passage, and all but the first of a class are repeats. No bytes are hashed here.
4. Keys cut by a splitter are compared across the boundary: their passages that are first in a
   bucket meet by content, one row per passage and bucket.

Defined cases: a null text is empty; texts shorter than a passage stay whole; rows that share an id
are documents of their own, ordered by a hash of the text; rows equal in id and text are one
document, and each gets its result; a null id comes first; an empty table gives an empty result.
Passages never cross documents. A long text is worked through in pieces. Only the id and the text
are read.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Scratch, partitions, raw, ship, slices, text_key

SPAN = 100
LEAD = 32
#: Leading-token places in a passage, one of which is its anchor.
PLACES = SPAN - LEAD + 1
#: Suffixes that a bucket is meant to sort at once (180 bytes each).
BUCKET_ROWS = 100_000
#: Bounds of the sample behind the splitters: rows a bucket, and rows in all.
SAMPLE_PER_BUCKET, MAX_SAMPLE = 40, 1_000_000
#: Bytes worked through at a time.
PIECE = 1 << 20

_BYTE_HASH = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def lead_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``LEAD`` bytes from each place on, by doubling."""
    h = _BYTE_HASH[data]
    for step, factor in zip((1, 2, 4, 8, 16), _MULTIPLIERS):
        h = h[:-step] * factor + h[step:]
        h ^= h >> np.uint64(32)
    return h * _MULTIPLIERS[0]


def anchors(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the passages in texts that lie one after another in ``data``.

    Returns place, hash of the leading tokens, and the first and last start of the passages that
    pick the anchor.
    """
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none.astype(np.uint64), none, none
    lead = lead_hashes(data)
    low = np.uint64(0xFFFFFFFF)
    key = (lead & ~low) | np.arange(len(lead), dtype=np.uint64)  # the least hash, and of equal ones the first place
    for step in (1, 2, 4, 8, 16, 32):
        key = np.minimum(key[:-step], key[step:])
    picked = (np.minimum(key[: -(PLACES - 64)], key[PLACES - 64 :]) & low).astype(np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)[: len(picked)]
    starts = np.flatnonzero(np.arange(len(picked)) + SPAN <= ends)
    if not len(starts):
        return none, none.astype(np.uint64), none, none
    picked = picked[starts]
    new = np.concatenate([[True], (picked[1:] != picked[:-1]) | (starts[1:] != starts[:-1] + 1)])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:] - 1, [len(starts) - 1]])
    return picked[at], lead[picked[at]], starts[at], starts[last]


def text_anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """For pieces of bounded size: number of the text, place, hash, first and last start, all within the text."""
    group: list[tuple[int, int, bytes]] = []
    held = 0
    for number, text in enumerate(texts):
        for start in range(0, max(1, len(text) - SPAN + 1), PIECE):
            piece = text[start : start + PIECE + SPAN - 1]
            if len(piece) >= SPAN:
                group.append((number, start, piece))
                held += len(piece)
            if held >= PIECE:
                yield _group_anchors(group)
                group, held = [], 0
    if group:
        yield _group_anchors(group)


def _group_anchors(group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    lengths = np.array([len(p) for _, _, p in group])
    begin = np.cumsum(lengths) - lengths
    place, lead, first, last = anchors(np.frombuffer(b"".join(p for _, _, p in group), np.uint8), lengths)
    at = np.searchsorted(begin, first, side="right") - 1
    shift = np.array([s for _, s, _ in group])[at] - begin[at]
    return np.array([n for n, _, _ in group])[at], place + shift, lead, first + shift, last + shift


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """``uid, pos, lead`` of anchors whose leading tokens occur again (by hash; strangers do no harm)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy()
            found = []
            base = 0
            for part in slices(iter([batch]), 1):
                found += [(n + base, p, h) for n, p, h, _, _ in text_anchors(raw(part.column(1)))]
                base += part.num_rows
            if not found:
                continue
            number, pos, lead = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(lead, kind="stable")
            lead, uid, pos = lead[order], uids[number[order]], pos[order]
            first = np.concatenate([[True], lead[1:] != lead[:-1]])
            again = ~first | np.concatenate([~first[1:], [False]])
            # one row a key goes on: with salt 0, its place negative when the batch itself repeats the key
            rows = [
                np.concatenate([lead[first], lead[again]]).view(np.int64),
                np.concatenate([uid[first], uid[again]]),
                np.concatenate([np.where(again[first], -1 - pos[first], pos[first]), pos[again]]),
                np.concatenate([np.zeros(first.sum(), np.int64), 1 + np.arange(again.sum()) % 1000]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], ["lead", "uid", "pos", "salt"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = []
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            sure = rows[3] > 0
            if sure.any():
                yield _candidates(rows[:, sure])
            keep.append(rows[:3, ~sure])
        if keep:
            rows = np.concatenate(keep, axis=1)
            rows = rows[:, np.argsort(rows[0], kind="stable")]
            equal = rows[0][1:] == rows[0][:-1]
            again = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
            yield _candidates(rows[:, again & (rows[2] >= 0)])

    ship(docs.sparkSession)
    rows = docs.select("uid", "text").mapInArrow(scan, "lead long, uid long, pos long, salt long")
    return rows.repartition("lead", "salt").mapInArrow(settle, "uid long, pos long, lead long")


def _candidates(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[i], pa.int64()) for i in (1, 2, 0)], ["uid", "pos", "lead"])


def splitters(found: DataFrame, buckets: int) -> np.ndarray:
    """Up to ``buckets - 1`` keys (lead, uid, pos) that cut ``found`` into about equal ranges."""
    rows = found.count()
    wanted = min(buckets * SAMPLE_PER_BUCKET, MAX_SAMPLE)
    step = max(1, rows // max(1, wanted))
    sample = found.where(F.pmod(F.xxhash64("lead", "uid", "pos"), F.lit(step)) == 0).select("lead", "uid", "pos").collect()
    keys = np.array(sorted(map(tuple, sample)), np.int64).reshape(-1, 3)
    cuts = keys[np.linspace(0, len(keys), buckets + 1)[1:-1].astype(int)] if len(keys) >= buckets else keys
    return np.unique(cuts, axis=0)


def bucket_of(cuts: np.ndarray, *key: np.ndarray) -> np.ndarray:
    """Number of splitters below each key (lead, uid, pos)."""
    both = [np.concatenate([cuts[:, i], column]) for i, column in enumerate(key)]
    is_key = np.concatenate([np.zeros(len(cuts), np.int8), np.ones(len(key[0]), np.int8)])
    order = np.lexsort((1 - is_key, *both[::-1]))  # a key equal to a splitter stands before it
    below = np.empty(len(order), np.int64)
    below[order] = np.cumsum(1 - is_key[order])
    return below[len(cuts) :]


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of rows of big digits: each pass sorts, inside runs that are equal so far, by the next digit."""
    order = np.argsort(words[:, 0], kind="stable")
    run = np.cumsum(np.concatenate([[0], words[order[1:], 0] != words[order[:-1], 0]]))
    open_ = np.arange(len(order))
    for digit in range(1, words.shape[1]):
        size = np.bincount(run)
        open_ = open_[size[run[open_]] > 1]
        if not len(open_):
            break
        rows = order[open_]
        inner = np.lexsort((words[rows, digit], run[open_]))
        order[open_] = rows = rows[inner]
        head = run[open_]  # runs keep their places, so this stays in order
        cut = np.concatenate([[True], (head[1:] != head[:-1]) | (words[rows[1:], digit] != words[rows[:-1], digit])])
        new = np.zeros(len(order), np.int64)
        new[open_[cut]] = 1
        border = np.concatenate([[0], run[1:] != run[:-1]])
        run = np.cumsum(np.maximum(border, new)) - max(int(border[0]), int(new[0]))
    return order


def neighbour_lcp(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in ``order`` has in common with the one before it (0 for the first)."""
    n, digits = words.shape
    lcp = np.zeros(n, np.int64)
    for start in range(1, n, 1 << 15):
        a = words[order[start - 1 : start - 1 + (1 << 15)]]
        b = words[order[start : start + (1 << 15)]]
        a = a[: len(b)]
        differs = a != b
        at = np.where(differs.any(axis=1), differs.argmax(axis=1), digits)
        x = np.zeros(len(b), np.uint64)
        some = at < digits
        x[some] = a[some, at[some]] ^ b[some, at[some]]
        same = np.zeros(len(b), np.int64)
        for byte in range(1, 8):
            same += some & (x < np.uint64(1 << (64 - 8 * byte)))
        lcp[start : start + len(b)] = 8 * at + same
    return lcp


def _matrix(data: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int, step: int) -> np.ndarray:
    """Bytes from ``begin`` on, forwards or backwards, padded with zeros, as rows of eight-byte digits."""
    out = np.zeros((len(begin), width), np.uint8)
    columns = np.arange(width)
    for at in range(0, len(begin), 1 << 14):
        here = slice(at, at + (1 << 14))
        inside = columns[None, :] < length[here, None]
        places = np.where(inside, begin[here, None] + step * columns[None, :], 0)
        out[here] = np.where(inside, data[places], 0)
    return out.view(">u8").astype(np.uint64)


def repeats(uid: np.ndarray, pos: np.ndarray, first: np.ndarray, last: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in order of (uid, pos): which passages exist, and which repeat an earlier one.

    Both results have a row per suffix and a column per distance of the anchor from the passage's
    start. Passages with one distance are equal when the text before the anchor agrees over that
    distance and the text after it over the rest.
    """
    n = len(uid)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    anchor = np.cumsum(sizes) - sizes + (pos - first)
    after = _matrix(data, anchor, last + SPAN - pos, 104, 1)
    before = _matrix(data, anchor - 1, pos - first, 72, -1)
    ranks, common = [], []
    for words in (after, before):
        order = multikey_sort(words)
        common.append(neighbour_lcp(words, order))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        ranks.append(rank)
    exists = np.zeros((n, PLACES), bool)
    repeat = np.zeros((n, PLACES), bool)
    for distance in range(PLACES):
        rows = np.flatnonzero((pos - distance >= first) & (pos - distance <= last))
        if not len(rows):
            continue
        exists[rows, distance] = True
        right = np.cumsum(common[0] < SPAN - distance)[ranks[0][rows]]
        left = np.cumsum(common[1] < distance)[ranks[1][rows]]
        _, head = np.unique(right * (n + 1) + left, return_index=True)
        rows = np.delete(rows, head)
        repeat[rows, distance] = True
    return exists, repeat


def _suffixes(docs: DataFrame, found: DataFrame, cuts: np.ndarray) -> DataFrame:
    """Suffixes of the anchors in ``found``, with their bucket and the text that their passages cover."""
    places = found.groupBy("uid").agg(F.collect_set("pos").alias("places")).withColumnRenamed("uid", "f_uid")
    joined = docs.join(places.hint("shuffle_hash"), docs["uid"] == F.col("f_uid")).select("uid", "text", "places")
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            texts, uids = raw(part.column(1)), part.column(0).to_numpy()
            wanted = [np.array(p) for p in part.column(2).to_pylist()]
            key_base = max(map(len, texts), default=0) + 1
            pairs = np.sort(np.concatenate([i * key_base + w for i, w in enumerate(wanted)]))
            for number, pos, lead, first, last in text_anchors(texts):
                keys = number * key_base + pos
                at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
                here = np.flatnonzero(pairs[at] == keys)
                number, pos, lead, first, last = (x[here] for x in (number, pos, lead.view(np.int64), first, last))
                uid = uids[number]
                context = [texts[i][a : b + SPAN] for i, a, b in zip(number, first, last)]
                columns = [bucket_of(shared.value, lead, uid, pos), lead, uid, pos, first, last]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns), pa.array(context, pa.binary())],
                    ["bucket", "lead", "uid", "pos", "first", "last", "context"],
                )

    return joined.mapInArrow(run, "bucket long, lead long, uid long, pos long, first long, last long, context binary")


def _compared(suffixes: DataFrame, cuts: np.ndarray) -> DataFrame:
    """``uid, start, stop, passage``: repeated ranges, or with ``passage`` a first one that another bucket may have."""
    shared = suffixes.sparkSession.sparkContext.broadcast(np.unique(cuts[:, 0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        lead, uid, pos, first, last = (table.column(c).to_numpy() for c in ("lead", "uid", "pos", "first", "last"))
        order = np.lexsort((first, pos, uid))
        contexts = table.column("context").to_pylist()
        contexts = [contexts[i] for i in order]
        lead, uid, pos, first, last = (x[order] for x in (lead, uid, pos, first, last))
        exists, repeat = repeats(uid, pos, first, last, contexts)
        flat = np.pad(repeat[:, ::-1].astype(np.int8), ((0, 0), (1, 1)))  # by start of the passage
        change = np.diff(flat, axis=1)
        row, begin = np.nonzero(change == 1)
        _, end = np.nonzero(change == -1)
        start = pos[row] - (PLACES - 1) + begin
        yield _found(uid[row], start, start + (end - begin) - 1 + SPAN, [None] * len(row))
        cut = np.flatnonzero(np.isin(lead, shared.value))
        for at in range(0, len(cut), 2000):
            rows, distance = np.nonzero(exists[cut[at : at + 2000]] & ~repeat[cut[at : at + 2000]])
            rows = cut[at : at + 2000][rows]
            begin = pos[rows] - distance
            passages = [contexts[r][b : b + SPAN] for r, b in zip(rows, begin - first[rows])]
            yield _found(uid[rows], begin, begin + SPAN, passages)

    return suffixes.mapInArrow(run, "uid long, start long, stop long, passage binary")


def _found(uid: np.ndarray, start: np.ndarray, stop: np.ndarray, passages: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (uid, start, stop)), pa.array(passages, pa.binary())], ["uid", "start", "stop", "passage"])


def release(scratch: Scratch) -> None:
    """Drop all stages but the last and their shuffle files, also those that the listeners of a plan still hold at first."""
    for _ in range(3):
        scratch.tidy(1)
        time.sleep(0.4)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``uid, start, stop`` byte ranges of ``docs`` (``uid, text``) that repeat earlier passages; ranges may overlap."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(repeated_anchors(docs), "anchors")
    release(scratch)  # the shuffle behind it goes
    buckets = max(partitions(docs.sparkSession), -(-found.count() // BUCKET_ROWS))
    cuts = splitters(found, buckets)
    suffixes = _suffixes(docs, found, cuts).repartitionById(buckets, F.col("bucket").cast("int"))
    compared = scratch.keep(_compared(suffixes, cuts), "repeats")
    del suffixes
    release(scratch)  # the anchors, and the shuffles of texts and suffixes
    # across boundaries: each bucket gives a passage once at most, so a group is bounded by the number of buckets
    met = compared.where("passage is not null").groupBy("passage").agg(F.collect_list(F.struct("uid", "start", "stop")).alias("places"))
    later = F.array_sort("places")
    across = met.where(F.size("places") > 1).select(F.inline(F.slice(later, 2, F.size(later) - 1)))
    return compared.where("passage is null").select("uid", "start", "stop").union(across)


def identified(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``uid, text`` with a unique ``uid`` in the order of ids, and the table of ids if they are not unique themselves."""
    docs = docs.select("doc_id", "text")
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("uid"), "text"), None
    keys = docs.select("doc_id", text_key(F.col("text")).alias("text_key")).distinct().sort(F.asc_nulls_first("doc_id"), "text_key")
    keys = materialize(keys.withColumn("uid", F.monotonically_increasing_id()), "uids")
    rows = docs.withColumn("text_key", text_key(F.col("text"))).dropDuplicates(["doc_id", "text_key"])
    joined = rows.join(keys, rows["doc_id"].eqNullSafe(keys["doc_id"]) & (rows["text_key"] == keys["text_key"]))
    return materialize(joined.select("uid", "text"), "identified"), keys


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges; such as touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_repeats(docs: DataFrame, kept: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and with ``kept`` the bytes that are left."""
    rows, keys = identified(docs)
    ranges = repeated_ranges(rows).groupBy("uid").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")).withColumnRenamed("uid", "r_uid")
    joined = rows.join(ranges.hint("shuffle_hash"), rows["uid"] == F.col("r_uid"), "left").select("uid", "text", "starts", "stops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            out = []
            for text, starts, stops in zip(raw(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
                spans = merged(list(zip(starts or [], stops or [])))
                edges = [0, *(x for s in spans for x in s), len(text)]
                left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if kept else None))
            n, removed, spans, sha, left = zip(*out)
            columns = [part.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha), *([pa.array(left, pa.binary())] if kept else [])]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if kept else [])])

    ship(docs.sparkSession)
    out = joined.mapInArrow(run, "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept)
    if keys is None:
        return out.withColumnRenamed("uid", "doc_id")
    ids = docs.select("doc_id", text_key(F.col("text")).alias("text_key"))
    named = ids.join(keys, ids["doc_id"].eqNullSafe(keys["doc_id"]) & (ids["text_key"] == keys["text_key"])).select(ids["doc_id"], "uid")
    return named.join(out, "uid").drop("uid")
