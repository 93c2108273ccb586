"""Packing documents into sequences of fixed capacity by exact complements.

Documents are encoded and end with a closing token; longer ones are cut, the first piece taking what does
not fill a sequence. Where a piece goes depends on its length alone, so packing is planned on the
number of pieces of each length, at most ``capacity`` numbers whatever the corpus:

* **Exact complements.** From the longest length down, what a piece leaves free is looked up among the sums
  of one, two and three other lengths; each combination found is taken as often as its lengths last.
* **Best fit.** What is left goes, longest first, to the open sequence it leaves least free in. Long pieces may go
  first, so that complements fill the gaps that they leave (:func:`plan`).

The plan is a list of patterns (lengths, how often). Pieces of one length are numbered without
meeting (:mod:`numbering`), and a range of numbers belongs to each place of a pattern, so a piece finds
its sequence and offset by a lookup. No text or token is moved, unless sequences are asked for.

Defined cases: a null or empty text is the closing token alone; repeated rows and ids are documents of
their own; an empty table gives an empty result. Only the id and the text are read. A task holds the
tokens of a few megabytes of text, or of one document.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LEAF, encoder
from .common import Scratch, ship, slices
from .numbering import offsets

#: Tokens of a sequence.
CAPACITY = 1024
#: The closing token of a document.
END = 2


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens; all but the first are full."""
    first = n % capacity or capacity
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece; ``part, place`` number the pieces of a length within a task."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, LEAF)
        part_no, seen = TaskContext.get().partitionId(), Counter()
        for part in slices(batches, 1):
            at, rows, ids = [], [], []
            for i, tokens in enumerate(coder.encode(part.column(1).to_pylist())):
                tokens.append(end)
                flat = np.array(tokens, "<u4")
                for piece, (start, length) in enumerate(cut(len(tokens), capacity)):
                    mine = flat[start : start + length]
                    at.append(i)
                    rows.append((piece, start, length, zlib.crc32(mine.tobytes()), part_no, seen[length]))
                    seen[length] += 1
                    if keep_ids:
                        ids.append(mine.astype(np.int32))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            more = [pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), *columns, *more], names)

    ship(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, place long"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))


class Stock:
    """How many pieces of each length are left, and the sums that one, two and three of them give."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        there = np.flatnonzero(self.left)
        sums = there[:, None] + there[None, :]
        self.pairs = np.zeros(2 * capacity + 1, bool)  # sums that two lengths of the stock can have
        self.pairs[sums.ravel()] = True
        self.tried: dict[int, int] = {}  # gaps that no combination of so many pieces fills any more; the stock only shrinks

    def take(self, parts: tuple[int, ...], most: int) -> int:
        """Take ``parts`` out as often as they last, ``most`` times at the most."""
        need = Counter(parts)
        times = min([most, *(int(self.left[p]) // k for p, k in need.items())])
        for p, k in need.items():
            self.left[p] -= k * times
        return times

    def complements(self, gap: int) -> Iterator[tuple[int, ...]]:
        """Combinations of one, two, three lengths in stock with the sum ``gap``, larger lengths first. The stock may shrink meanwhile."""
        if self.left[gap]:
            yield (gap,)
        yield from self._two(gap, gap)
        for a in np.flatnonzero(self.left[: max(0, gap - 1)])[::-1].tolist():
            if 3 * a < gap:
                break
            if self.pairs[gap - a]:
                for rest in self._two(gap - a, a):
                    if not self.left[a]:
                        break
                    yield (a, *rest)

    def _two(self, total: int, most: int) -> Iterator[tuple[int, int]]:
        """Pairs (a, b) with a >= b, both in stock, a at most ``most``."""
        high = min(most, total - 1)
        low = (total + 1) // 2
        if high < low or not self.pairs[total]:
            return
        a = np.arange(high, low - 1, -1)
        for x in a[(self.left[a] > 0) & (self.left[total - a] > 0)].tolist():
            if self.left[x] and self.left[total - x]:
                yield (x, total - x)


Groups = list[tuple[tuple[int, ...], int]]  # lengths in a sequence, and how many sequences hold them


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Groups:
    """Patterns ``(lengths, how often)`` that use every piece once; no pattern is longer than ``capacity``.

    Exact complements use up short pieces that other sequences could need, so it matters how much is placed
    before them: nothing, or the pieces longer than a quarter or a sixteenth of a sequence. All are
    planned, on counts alone, and the plan of fewest sequences is taken, the more exact one of equal ones.
    """
    plans = [planned(counts, capacity, capacity >> k) for k in (0, 2, 4)]
    return min(plans, key=lambda groups: sum(times for _, times in groups))


def planned(counts: dict[int, int], capacity: int, long: int) -> Groups:
    """The plan where what is longer than ``long`` and has no single complement is placed by best fit first."""
    stock = Stock(counts, capacity)
    out: Groups = []
    if stock.left[capacity]:
        out.append(((capacity,), int(stock.left[capacity])))
        stock.left[capacity] = 0
    for deepest in (1, 3):  # single complements of all pieces, then the others of short ones
        for length in range(capacity - 1 if deepest == 1 else min(long, capacity - 1), 0, -1):
            if stock.left[length]:
                out += filled(stock, (length,), int(stock.left[length]), capacity, deepest, taken=False)[0]
        if deepest == 1:
            first = {n: int(stock.left[n]) for n in np.flatnonzero(stock.left).tolist() if n > long}
            for n in first:
                stock.left[n] = 0
            open_ = best_fit(first, [], capacity)
    for size in (1, 2, 3):
        left: Groups = []
        for held, times in sorted(open_, key=lambda group: sum(group[0])):
            full, rest = filled(stock, held, times, capacity, size, least=size)
            out += full
            left += [(held, rest)] * (rest > 0)
        open_ = left
    return out + best_fit({n: int(stock.left[n]) for n in np.flatnonzero(stock.left).tolist()}, open_, capacity)


def filled(stock: Stock, held: tuple[int, ...], times: int, capacity: int, most: int, least: int = 1, taken: bool = True) -> tuple[Groups, int]:
    """Fill sequences exactly with ``least`` to ``most`` pieces; also how many stay open. ``taken``: what they hold is out of the stock."""
    out: Groups = []
    gap = capacity - sum(held)
    if taken and stock.tried.get(gap, 0) >= most:
        return out, times
    for parts in stock.complements(gap) if gap else ():
        if len(parts) > most or not times:
            break
        if len(parts) >= least:
            used = stock.take(parts if taken else (*held, *parts), times)
            if used:
                out.append(((*held, *parts), used))
                times -= used
    if taken and times:
        stock.tried[gap] = most
    return out, times


def best_fit(counts: dict[int, int], groups: Groups, capacity: int = CAPACITY) -> Groups:
    """Best fit into open ``groups`` and new sequences, longest first, over equal pieces and equally filled sequences at a time."""
    open_: dict[int, Groups] = defaultdict(list)  # by what is free
    for held, times in groups:
        open_[capacity - sum(held)].append((held, times))
    open_[capacity].append(((), sum(counts.values())))
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for gap in sorted(g for g in open_ if g >= length):
            while left and open_[gap]:
                held, times = open_[gap].pop()
                each = min(gap // length, left)  # best fit fills one sequence before the next
                used = min(times, left // each)
                left -= used * each
                open_[gap - each * length].append((held + (length,) * each, used))
                if times > used:
                    open_[gap].append((held, times - used))
            if not left:
                break
    return [(held, times) for same in open_.values() for held, times in same if held]


def seats(patterns: Groups) -> dict[int, tuple[np.ndarray, ...]]:
    """By length, ranges of piece numbers: ``first`` number, first ``sequence``, ``offset`` there, and pieces ``each`` sequence takes in a row."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for length, each in Counter(lengths).items():  # equal lengths stand together
            rows[length].append((used[length], sequence, offset, each))
            used[length] += times * each
            offset += length * each
        sequence += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*found)) for length, found in rows.items()}


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece, and its ``ids`` on request.

    ``path`` is the tokenizer file, present on every machine.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    stored = scratch.keep(pieces(docs, path, capacity, end, keep_ids), "packing-pieces")
    per_part = scratch.keep(stored.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``capacity`` rows at most
    table = spark.sparkContext.broadcast(seats(plan(counts, capacity)))
    before = offsets(per_part, "length", "part").select("length", "part", "before")
    numbered = stored.join(before, ["part", "length"]).withColumn("number", F.col("before") + F.col("place")).drop("part", "place", "before")
    rest = [c for c in numbered.columns if c not in ("length", "number")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = table.value
        for batch in batches:
            lengths, numbers = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            by_length = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[by_length], prepend=-1))
            for mine in np.split(by_length, cuts[1:]):
                if len(mine):
                    length = int(lengths[mine[0]])
                    first, start, place, each = ranges[length]
                    k = np.searchsorted(first, numbers[mine], side="right") - 1
                    behind, slot = np.divmod(numbers[mine] - first[k], each[k])
                    sequence[mine], offset[mine] = start[k] + behind, place[k] + slot * length
            columns = [batch.column(0), *batch.columns[2:], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, ["length", *rest, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in numbered.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("length", *rest)) + ", sequence_id long, offset long"
    placed = numbered.select("length", "number", *rest).mapInArrow(run, schema)
    order = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    return placed.select(*order)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` from pieces packed with their ids: at most ``capacity`` tokens meet."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(held, lambda x: x["ids"])).alias("ids"))
