"""N-gram Jaccard self-join by PartEnum signatures.

A document's set is its distinct word shingles, as 64-bit fingerprints. Equal sets are one class,
found by a 128-bit digest; everything else works on classes. Sets are grouped into bands of size; two
sets of one band group that reach the threshold differ in at most ``k`` shingles. The shingle domain
is partitioned on two levels: into about ``k / 2`` parts, and each of these into three. In one part at
least, such sets differ in one of the three at most, so they agree on two; each subset of two gives
one signature, a hash of the set's shingles there, and similar sets share one at least. (Subsets
without a shingle would be shared by strangers. A few more parts than needed are cut, and a set leaves
out as many of its empty subsets as it can spare without losing a partner; see :func:`signatures`.)

Classes that share a signature form a bucket; buckets of equal members are one. A bucket's members are
first compared by odd sketches: a set's shingles each flip one bit, so two sets differ in as many
shingles as their sketches differ in bits, at least, and pairs beyond ``k`` are dropped without
looking at the sets. Buckets are compared in blocks, and only a spanning forest of the pairs that
stay possible is given out. It joins classes into coarse groups; every link lies inside one. There
the sets are compared exactly: groups of up to ``BLOCK`` classes in one task, larger ones against a
pivot first, and then those that the pivot does not link in blocks of bounded size against the
others. Again only a forest of each task's links is given out. Links between classes then give the
components.

Defined cases: null texts and texts without a word have an empty set, which links with nothing; a
text of fewer words than a shingle is one shingle; rows that share an id are judged as documents of
their own; a null id is larger than every other and names a component only when nothing else can;
an empty table gives an empty result. Only the id and the text are read. Two different sets with
equal digests (chance n * n / 2**65 in the 64-bit part) are detected and raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Scratch, raw, ship, slices, text_key
from .components import connected_components, spanning_forest

#: Least growth of the upper size from band to band; about the cheapest for thresholds from 0.8 to 0.9.
BAND_GROWTH = 1.6
#: Second-level parts of each first-level part of the domain, and how many of them a signature leaves out.
SECOND = 3
LEFT_OUT = 1
#: Classes and bytes of sets that one comparison task gets from each side.
BLOCK = 256
BLOCK_BYTES = 32 << 20
#: Members of a bucket whose sketches one task compares with one another.
SKETCHES = 1024
_LAST = (1 << 63) - 1
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct fingerprints of each text's ``size``-word shingles, A-Z in lower case."""
    ids: dict[bytes, int] = {}
    number = ids.setdefault
    split = [t.lower().split() for t in texts]
    flat = [np.fromiter((number(w, len(ids)) for w in words), np.int64, len(words)) for words in split]
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in ids], np.uint64)
    out = []
    for words in flat:
        n = len(words)
        if n == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        h = table[words]
        k = min(size, n)
        acc = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            acc = mixed(acc + h[j : n - k + 1 + j])
        out.append(np.unique(acc))
    return out


@lru_cache(maxsize=8)
def band_tops(percent: int, last: int = 1 << 40) -> np.ndarray:
    """Upper sizes of the bands, which grow so much that partners are in the same or in neighbouring bands."""
    tops = [1]
    while tops[-1] < last:
        grown = max(int(tops[-1] * BAND_GROWTH), 100 * tops[-1] // percent)
        tops.append(max(tops[-1] + 1, grown))
    return np.array(tops)


def most_apart(total: int, percent: int) -> int:
    """Largest symmetric difference of two sets of ``total`` elements together that reach the threshold."""
    return (100 - percent) * total // (100 + percent)


@lru_cache(maxsize=64)
def _edges(parts: int) -> np.ndarray:
    """Fingerprints at which the parts of the domain begin."""
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def first_level(k: int) -> int:
    """First-level parts for sets that differ in ``k`` shingles at most; a few more than needed, so that empty subsets can be left out."""
    return k // (LEFT_OUT + 1) + 2 + k // 16


def least_agreements(first: int, d: int) -> int:
    """Subsets on which two sets agree that differ in ``d`` shingles, at least.

    A first-level part with ``e`` differing parts leaves ``comb(SECOND - e, SECOND - LEFT_OUT)`` subsets;
    this is convex in ``e``, so the sum is least where the differences are spread evenly.
    """
    each, more = divmod(d, first)
    agree = [comb(max(SECOND - e, 0), SECOND - LEFT_OUT) for e in (each, each + 1)]
    return (first - more) * agree[0] + more * agree[1]


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set, for the band groups in which it can have a partner.

    A group's sets have at most ``top`` elements, so a linked pair differs in at most ``k`` of them. The
    domain is cut into :func:`first_level` parts and each of these into ``SECOND``. Somewhere at most
    ``LEFT_OUT`` second-level parts of a first-level part differ, so the pair agrees on one of its
    subsets of ``SECOND - LEFT_OUT`` parts; each such subset gives a signature, a hash of the set's
    shingles there. A set of ``n`` elements differs from its partners in ``d <= k`` and agrees with
    them on :func:`least_agreements` subsets or more. Of the subsets without a shingle a set leaves out
    the first, one fewer than that: should a pair agree on empty subsets only, the last of these is
    preceded by that many at least, and both sets give it.
    """
    n = len(shingles)
    tops = band_tops(percent)
    band = int(np.searchsorted(tops, n))
    out = []
    for group in (band, band + 1):
        if group > band and 100 * n < percent * (int(tops[band]) + 1):
            continue  # too small for a partner in the next band
        top = int(tops[group])
        k = most_apart(2 * top, percent)
        if k == 0:
            continue  # only equal sets reach the threshold
        first = first_level(k)
        spare = least_agreements(first, most_apart(n + min(top, 100 * n // percent), percent)) - 1
        ends = np.concatenate([[0], np.searchsorted(shingles, _edges(first * SECOND)), [n]])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(shingles), dtype=np.uint64)])
        content = (sums[ends[1:]] - sums[ends[:-1]]).reshape(first, SECOND)
        counts = np.diff(ends).reshape(first, SECOND)
        subsets = list(combinations(range(SECOND), SECOND - LEFT_OUT))
        content = np.stack([content[:, c].sum(axis=1, dtype=np.uint64) for c in subsets], axis=1).ravel()
        give = np.stack([counts[:, c].any(axis=1) for c in subsets], axis=1).ravel()
        empty = np.flatnonzero(~give)
        give[empty[spare:]] = True
        mark = np.arange(first * len(subsets), dtype=np.uint64) * _ODD[2] + np.uint64(group)
        out.append(mixed(content + mixed(mark))[give])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def set_profiles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``id, text_key, n_shingles, k1, k2, signatures`` of each document; equal sets of a batch carry signatures once, others null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for part in slices(iter([batch]), 2):
                sets = shingle_sets(raw(part.column(2)), size)
                keys = [_digest(s) for s in sets]
                given: list[np.ndarray | None] = []
                for s, (key, _) in zip(sets, keys):
                    new = len(s) > 0 and key not in seen
                    given.append(signatures(s, percent).view(np.int64) if new else None)
                    seen.add(key)
                ends = pa.array(np.cumsum([0, *(0 if g is None else len(g) for g in given)]), pa.int32())
                flat = np.concatenate([np.zeros(0, np.int64), *(g for g in given if g is not None)])
                lists = pa.ListArray.from_arrays(ends, pa.array(flat), mask=pa.array([g is None for g in given]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), lists],
                    ["id", "text_key", "n_shingles", "k1", "k2", "signatures"],
                )

    ship(docs.sparkSession)
    return _keyed(docs).mapInArrow(run, "id long, text_key long, n_shingles long, k1 long, k2 long, signatures array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), text_key(F.col("text")).alias("text_key"), "text")


def buckets(profiles: DataFrame) -> DataFrame:
    """``bucket, key``: the classes that share a signature; buckets with the same members are one.

    A reduce task holds the 16-byte rows of its share of the signatures.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        sig, key = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])])
        sig, key = sig[new], key[new]  # equal sets of several batches
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        count = np.diff(np.concatenate([first, [len(sig)]]))
        name = mixed(np.add.reduceat(mixed(key.view(np.uint64)), first) + count.astype(np.uint64))
        shared = np.flatnonzero(count > 1)
        shared = shared[np.unique(name[shared], return_index=True)[1]]
        for at in range(0, len(shared), 1 << 14):
            some = shared[at : at + (1 << 14)]
            rows = np.concatenate([np.arange(first[i], first[i] + count[i]) for i in some])
            names = np.repeat(name[some], count[some]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(key[rows])], ["bucket", "key"])

    ship(profiles.sparkSession)
    rows = profiles.select(F.explode("signatures").alias("sig"), F.col("k1").alias("key"))
    return rows.repartition("sig").mapInArrow(gather, "bucket long, key long").distinct()


def odd_sketch(shingles: np.ndarray, percent: int) -> bytes:
    """One bit of parity for each value of the shingles' top bits; about four bits for each that may differ."""
    n = len(shingles)
    wanted = max(256, 4 * most_apart(n + 100 * n // percent, percent))
    bits = 1 << int(wanted - 1).bit_length()
    odd = np.bincount((mixed(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> int:
    """A sketch of ``size`` bytes, as a number: folding keeps parities, as bits are numbered by low bits."""
    x = int.from_bytes(sketch, "little")
    at = len(sketch)
    while at > size:
        at //= 2
        x = (x >> (8 * at)) ^ (x & ((1 << (8 * at)) - 1))
    return x


def possible_pairs(left: list[tuple[int, bytes]], right: list[tuple[int, bytes]] | None, percent: int) -> list[tuple[int, int]]:
    """Forest of pairs (positions in ``left + right``) whose sketches allow the threshold; within ``left`` if ``right`` is None."""
    rows = left + (right or [])
    size = min(len(s) for _, s in rows)
    marks = np.array([np.frombuffer(folded(s, size).to_bytes(size, "little"), np.uint64) for _, s in rows])
    sizes = np.array([n for n, _ in rows])
    start = len(left) if right else 0
    found: list[np.ndarray] = []
    for i in range(len(left)):
        others = np.arange(max(start, i + 1), len(rows))
        apart = np.bitwise_count(marks[others] ^ marks[i]).sum(axis=1)
        near = others[apart <= (100 - percent) * (sizes[others] + sizes[i]) // (100 + percent)]
        found.append(np.stack([np.full(len(near), i), near]))
    pairs = np.concatenate(found, axis=1)
    return list(zip(*spanning_forest(pairs[0], pairs[1])))


def possible_edges(met: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``a, b``: forests of the pairs in each bucket that the sketches of ``met`` (``bucket, key, n, sketch``) allow.

    A bucket beyond ``SKETCHES`` members is dealt into blocks, and each pair of blocks is a task's work.
    """
    spark = met.sparkSession
    sizes = met.groupBy("bucket").agg(F.count("*").alias("members"))
    large = scratch.keep(sizes.where(F.col("members") > SKETCHES).select("bucket", F.ceil(F.col("members") / SKETCHES).cast("int").alias("blocks")), "large-buckets")
    own = F.expr("int(pmod(xxhash64(key), blocks))")
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j"), own.alias("own")))
    dealt = met.join(large, "bucket").select("bucket", "key", "n", "sketch", F.explode(other).alias("at"))
    small = met.join(large, "bucket", "left_anti")
    rows = small.select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "key", "n", "sketch").unionByName(
        dealt.select("bucket", "at.i", "at.j", "at.own", "key", "n", "sketch")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now = [], None
        a: list[int] = []
        b: list[int] = []

        def close() -> None:
            if len(group) > 1:
                i, j = now[1:]
                left = [g for g in group if g[0] == i]
                right = [g for g in group if g[0] != i] if i != j else None
                if right is None or (left and right):
                    keys = [g[1] for g in left + (right or [])]
                    for x, y in possible_pairs([g[2:] for g in left], right and [g[2:] for g in right], percent):
                        a.append(keys[x])
                        b.append(keys[y])

        for batch in batches:
            for *at, own_, key, n, sketch in zip(*(c.to_pylist() for c in batch.columns)):
                if at != now:
                    close()
                    group, now = [], at
                group.append((own_, key, n, sketch))
            if len(a) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a.clear()
                b.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ship(spark)
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long")


def _live_sets(docs: DataFrame, live: DataFrame, size: int, percent: int) -> DataFrame:
    """``key, n, bytes, sketch`` of each class in ``live`` (``id, text_key, key``)."""
    rows = _keyed(docs)
    names = live.select(F.col("id").alias("l_id"), F.col("text_key").alias("l_text_key"), "key")
    joined = rows.join(names.hint("shuffle_hash"), (rows["id"] == F.col("l_id")) & (rows["text_key"] == F.col("l_text_key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            sets = shingle_sets(raw(part.column(1)), size)
            columns = [
                part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()),
                pa.array([odd_sketch(x, percent) for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "bytes", "sketch"])

    return joined.select("key", "text").mapInArrow(run, "key long, n long, bytes binary, sketch binary")


def linked(far: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs ``i, j`` of positions in ``far + others``, i among the far ones and below j, that reach the threshold."""
    sets = far + others
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(far), len(sets)), np.float32)
    step = 4096
    for start in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [start, start + step])
        block = np.zeros((len(sets), step), np.float32)
        block[owner[a:b], column[a:b] - start] = 1
        both += block[: len(far)] @ block.T  # counts stay far below 2**24 for each pair and step
    both = both.astype(np.int64)
    union = sizes[: len(far), None] + sizes[None, :] - both
    hit = (100 * both >= percent * union) & (both > 0)
    hit &= np.arange(len(sets))[None, :] > np.arange(len(far))[:, None]
    return np.argwhere(hit)


def _compared(groups: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` inside each group of ``groups`` (``part, key, far, bytes``), a forest for each."""

    def run(table: pa.Table) -> pa.Table:
        order = sorted(range(table.num_rows), key=lambda i: not table.column("far")[i].as_py())
        table = table.take(order)
        keys = table.column("key").to_numpy()
        n_far = sum(table.column("far").to_pylist())
        sets = [np.frombuffer(x, np.uint64) for x in table.column("bytes").to_pylist()]
        pairs = linked(sets[:n_far], sets[n_far:], percent) if n_far else np.zeros((0, 2), np.int64)
        a, b = spanning_forest(keys[pairs[:, 0]], keys[pairs[:, 1]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return groups.groupBy("component", "i", "j").applyInArrow(run, "a long, b long")


def _links(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links that connect what is linked inside the coarse groups of ``sets``, exactly."""
    sizes = sets.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.length("bytes")).alias("size"), F.min(F.struct(F.xxhash64("key").alias("h"), "key")).alias("p"))
    sizes = scratch.keep(sizes.select("component", "n", "size", F.col("p.key").alias("pivot")), "group-sizes")
    large = sizes.where((F.col("n") > BLOCK) | (F.col("size") > BLOCK_BYTES))
    pivots = sets.join(large.select("component", F.col("pivot").alias("key")), ["component", "key"]).dropDuplicates(["component"])
    pivots = scratch.keep(pivots.select("component", F.col("key").alias("pivot"), F.col("bytes").alias("pivot_bytes")), "pivots")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = []
            for mine, other in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                x, y = np.frombuffer(mine, np.uint64), np.frombuffer(other or b"", np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if other else 0
                far.append(not both or 100 * both < percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(far, pa.bool_())], ["component", "key", "bytes", "pivot", "far"])

    met = sets.join(pivots, "component", "left").select("component", "key", "bytes", "pivot", "pivot_bytes")
    marked = scratch.keep(met.mapInArrow(near, "component long, key long, bytes binary, pivot long, far boolean"), "met-pivot")
    by_pivot = marked.where("not far and key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b"))

    blocks = lambda n, size: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(size) / BLOCK_BYTES)).cast("int")
    counts = marked.groupBy("component").agg(
        F.count_if("far").alias("nf"), F.count_if(~F.col("far")).alias("nn"),
        F.sum(F.when(F.col("far"), F.length("bytes")).otherwise(0)).alias("sf"), F.sum(F.when(~F.col("far"), F.length("bytes")).otherwise(0)).alias("sn"),
    )
    counts = scratch.keep(counts.select("component", blocks("nf", "sf").alias("far_blocks"), blocks("nn", "sn").alias("near_blocks")).where("far_blocks > 0"), "group-blocks")
    dealt = marked.drop("pivot").join(counts, "component").withColumn("h", F.xxhash64("key"))
    far_at, near_at = F.expr("int(pmod(h, far_blocks))"), F.expr("int(pmod(h, near_blocks))")
    meets_far = F.transform(F.sequence(F.lit(0), F.col("far_blocks") - 1), lambda j: F.struct(F.least(j, far_at).alias("i"), F.greatest(j, far_at).alias("j")))
    meets_near = F.transform(F.sequence(F.lit(0), F.col("near_blocks") - 1), lambda j: F.struct(far_at.alias("i"), (-1 - j).alias("j")))
    far_rows = dealt.where("far").select("component", "key", "far", "bytes", F.explode(F.when(F.col("near_blocks") > 0, F.concat(meets_far, meets_near)).otherwise(meets_far)).alias("at"))
    near_rows = dealt.where("not far").select(
        "component", "key", "far", "bytes",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("far_blocks") - 1), lambda i: F.struct(i.alias("i"), (-1 - near_at).alias("j")))).alias("at"),
    )
    groups = far_rows.union(near_rows).select("component", "at.i", "at.j", "key", "far", "bytes")
    return _compared(groups, percent).union(by_pivot)


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, text_key, n_shingles, class, component_id, group`` of each document.

    Two documents link when their sets' Jaccard similarity is ``percent`` hundredths or more;
    ``component_id`` is the smallest id that links reach, ``class`` the smallest id of an equal set,
    ``group`` a number that differs between components even where ids are repeated.
    """
    docs = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession)
    signed = scratch.keep(set_profiles(docs, size, percent), "signed-sets")
    profiles = materialize(signed.drop("signatures"), "set-profiles")
    classes = profiles.where("n_shingles > 0").groupBy("k1").agg(
        F.min(F.struct("id", "text_key")).alias("first"), F.min("k2").alias("low"), F.max("k2").alias("high")
    )
    classes = materialize(classes.select(F.col("k1").alias("key"), "first.*", (F.col("low") != F.col("high")).alias("clash")), "set-classes")
    if not classes.where("clash").isEmpty():
        raise RuntimeError("two different shingle sets have the same 64-bit digest")
    shared = scratch.keep(buckets(signed), "buckets")
    scratch.tidy(1)
    live = scratch.keep(shared.select("key").distinct().join(classes, "key").select("id", "text_key", "key"), "live-classes")
    sets = scratch.keep(_live_sets(docs, live, size, percent), "live-sets")
    scratch.tidy(3)
    met = shared.join(sets.select("key", "n", "sketch"), "key")
    coarse = scratch.keep(connected_components(possible_edges(met, percent, scratch)), "coarse-groups")
    grouped = coarse.select(F.col("node").alias("key"), "component").join(sets.select("key", "bytes"), "key").select("component", "key", "bytes")
    grouped = scratch.keep(grouped, "grouped-sets")
    found = materialize(connected_components(_links(grouped, percent, scratch)), "linked")
    scratch.tidy()
    named = found.join(classes, found["node"] == classes["key"]).groupBy("component").agg(F.min("id").alias("smallest"))
    named = found.join(named, "component").select(F.col("node").alias("n_key"), "smallest", "component")
    by_class = classes.join(named, F.col("key") == F.col("n_key"), "left")
    by_class = materialize(by_class.select("key", F.col("id").alias("class"), F.coalesce("smallest", "id").alias("component_id"), F.coalesce("component", "key").alias("group")), "class-components")
    out = profiles.join(by_class, profiles["k1"] == by_class["key"], "left")
    named_id = lambda c: F.nullif(F.coalesce(c, "id"), F.lit(_LAST))
    return out.select(
        F.nullif("id", F.lit(_LAST)).alias("doc_id"), "text_key", "n_shingles", named_id("class").alias("class"), named_id("component_id").alias("component_id"), "group"
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: the one of smallest id, and of equal ids the one of smallest text key.

    Documents without a word stay. All columns are kept; of rows equal in id and text one stays.
    """
    found = materialize(jaccard_components(docs, size, percent), "components")
    words = found.where("n_shingles > 0")
    chosen = words.groupBy("group").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "text_key")).alias("best")).select("best.*")
    empty = found.where("n_shingles = 0").select(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "text_key").distinct()
    chosen = materialize(chosen.union(empty).select("id", "text_key"), "chosen")
    own, key = F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)), text_key(docs["text"])
    kept = docs.join(chosen.hint("shuffle_hash"), (own == chosen["id"]) & (key == chosen["text_key"]), "left_semi")
    again = found.groupBy("doc_id", "text_key").count().where("count > 1")
    return kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
