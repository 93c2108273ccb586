"""Ranked lexical search: the best documents of every item, by a document FP-tree and branch and bound.

One scan reduces each document to its terms that stand in any item, with their counts (a restricted term
vector), and gives the corpus figures. The vectors are then searched where they lie, a block of documents
at a time:

* **Tree.** Terms are put in order of falling document frequency, so that documents begin alike; the sorted
  vectors form a trie whose paths are shared beginnings. Chains without a branch are one node. Each
  node holds, for its subtree, the largest count of every term, the least length figure ``m`` and the
  least id.
* **Search.** A document's score grows with its counts and falls with ``m``, so a node's maxima and
  minimum bound every score below it. The search goes depth first, best child first, and leaves out
  a subtree for every item whose best documents so far all score more than the bound. Items are carried down
  together; each is dropped on its own.

A task keeps the best of each item over all its blocks, and two small sorts merge the tasks.

Memory: items are dealt into chunks of about ``CHUNK`` words, each with a scan of its own, and within a
chunk into groups of at most ``GROUP`` words (or one item), which share trees; the number of documents in a
block follows from the group's terms, so that a tree's matrix has at most ``CELLS`` cells. Only one
item's distinct terms must fit in a task.

Defined cases: a null or empty text, or one without a term, has no score and is not counted; an item
without terms, or whose terms are in no document, gives no row; repeated rows are documents of their own,
as are repeated items; null ids rank before others at equal scores; empty tables give an empty
result. Only ids and texts are read. Document ids are integers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, raw, ship, slices

#: Documents to return for an item.
TOP = 20
#: Words of items whose terms are broadcast at a time, on average.
CHUNK = 1 << 20
#: Words of items that share a tree.
GROUP = 1 << 14
#: Cells of a tree's matrix, four bytes each.
CELLS = 1 << 24
#: Cells of a bound computation, eight bytes each.
STEP = 1 << 20
#: Least number that stands for a null id.
NO_ID = -(1 << 63)

#: Bytes between terms become blanks, A-Z become a-z.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: runs of letters and digits of ASCII and of any other characters, A-Z lower-cased."""
    return text.translate(_TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, terms, n`` of each item that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            found = [terms(t) for t in raw(part.column(1))]
            keep = pa.array([bool(f) for f in found])
            lists = pa.array([f for f in found if f], pa.list_(pa.binary()))
            sizes = pa.array([len(f) for f in found if f], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), lists, sizes], ["item_id", "terms", "n"])

    ship(items.sparkSession)
    id_kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {id_kind}, terms array<binary>, n long")


def term_vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """``doc_id, n, term, tf``: of each document with terms their number, and those of the broadcast ``vocabulary`` with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = vocabulary.value
        for part in slices(batches, 1):
            keep, sizes, ends, ids, counts = [], [], [0], [], []
            for text in raw(part.column(1)):
                words = terms(text)
                keep.append(bool(words))
                if not words:
                    continue
                found = Counter(words)
                for word in found.keys() & places.keys():
                    ids.append(places[word])
                    counts.append(found[word])
                sizes.append(len(words))
                ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).filter(pa.array(keep, pa.bool_())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "term", "tf"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Group:
    """Items that share a tree: their terms by falling document frequency, and each item's terms as places in that order."""

    items: list[int]
    order: np.ndarray
    places: np.ndarray
    weights: np.ndarray
    starts: np.ndarray

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, weights and starts of some of the items."""
        ends = np.append(self.starts[1:], len(self.places))
        spans = [np.arange(self.starts[r], ends[r]) for r in rows]
        take = np.concatenate(spans)
        return self.places[take], self.weights[take], np.cumsum([0, *map(len, spans[:-1])])


def grouped(items: Sequence[list[int]], df: np.ndarray, n_docs: int, words: int) -> list[Group]:
    """Groups of items (term numbers, repeats included) of at most ``words`` words, or one item. Terms in no document are left out."""
    out: list[Group] = []
    batch: list[int] = []
    held = 0

    def close() -> None:
        found = [Counter(t for t in items[i] if df[t]) for i in batch]
        some = [(i, c) for i, c in zip(batch, found) if c]
        if some:
            used = np.array(sorted({t for _, c in some for t in c}), np.int64)
            order = used[np.lexsort((used, -df[used]))]
            rank = {int(t): k for k, t in enumerate(order)}
            places = np.array([rank[t] for _, c in some for t in c], np.int64)
            weights = np.array([weight(n_docs, int(df[t])) * k for _, c in some for t, k in c.items()], np.int64)
            out.append(Group([i for i, _ in some], order, places, weights, np.cumsum([0, *[len(c) for _, c in some[:-1]]])))

    for i, item in enumerate(items):
        if batch and held + len(item) > words:
            close()
            batch, held = [], 0
        batch.append(i)
        held += len(item)
    if batch:
        close()
    return out


@dataclass
class Tree:
    """Trie over a block's vectors. Rows 0 to ``docs`` - 1 of the figures are documents, the others inner nodes; the last is the root."""

    docs: int
    children: list[list[int]]
    tf: np.ndarray
    m: np.ndarray
    first: np.ndarray
    ids: np.ndarray = field(repr=False)


def plant(tf: np.ndarray, m: np.ndarray, ids: np.ndarray) -> Tree:
    """The tree over documents with counts ``tf`` (terms by falling frequency), length figures and ids."""
    n = len(m)
    rows, ranks = np.nonzero(tf)
    cuts = np.searchsorted(rows, np.arange(n + 1))
    paths = [ranks[a:b] for a, b in zip(cuts, cuts[1:])]
    keys = [p.astype(">u4").tobytes() for p in paths]
    order = sorted(range(n), key=keys.__getitem__)
    children: list[list[int]] = [[]]  # of inner nodes; 0 is the root
    stack = [(0, 0)]  # (inner node, depth) from the root to the last document
    for k, doc in enumerate(order):
        shared = 0
        if k:
            a, b = paths[order[k - 1]], paths[doc]
            size = min(len(a), len(b))
            differ = np.flatnonzero(a[:size] != b[:size])
            shared = int(differ[0]) if len(differ) else size
        while stack[-1][1] > shared:
            stack.pop()
        if stack[-1][1] < shared:
            above = children[stack[-1][0]]
            children.append([above.pop()])
            above.append(-len(children) + 1)  # inner nodes as negative numbers
            stack.append((len(children) - 1, shared))
        children[stack[-1][0]].append(doc + 1)
    upward, todo = [], [0]
    while todo:  # from the root down; turned round, children stand before their parents
        node = todo.pop()
        upward.append(node)
        todo += [-c for c in children[node] if c < 0]
    upward.reverse()
    row = {node: n + i for i, node in enumerate(upward)}
    kids = [[c - 1 if c > 0 else row[-c] for c in children[node]] for node in upward]
    all_tf = np.concatenate([tf, np.zeros((len(kids), tf.shape[1]), tf.dtype)])
    all_m = np.concatenate([m, np.zeros(len(kids), np.int64)])
    first = np.concatenate([ids, np.zeros(len(kids), np.int64)])
    for i, below in enumerate(kids):
        all_tf[n + i], all_m[n + i], first[n + i] = all_tf[below].max(axis=0), all_m[below].min(), first[below].min()
    return Tree(n, kids, all_tf, all_m, first, ids)


class Best:
    """The best documents of each item so far: higher scores first, then smaller ids."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.score = np.zeros(items, np.int64)  # what a document must reach ...
        self.last = np.full(items, NO_ID, np.int64)  # ... and at that score, be below

    def hopes(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a document of such a score and id would be among the best; scores and ids may be bounds."""
        least = self.score[items]
        return (scores > least) | ((scores == least) & (scores > 0) & (ids < self.last[items]))

    def put(self, item: int, score: int, doc: int) -> None:
        heap, entry = self.heaps[item], (score, -doc)
        if len(heap) < self.top:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.top:
            self.score[item], self.last[item] = heap[0][0], -heap[0][1]


def scores(tree: Tree, rows: Sequence[int], places: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Score (or bound) of every row for every item."""
    tf = tree.tf[rows].astype(np.int64)
    share = (1_000_000_000 * tf) // (1000 * tf + 12 * tree.m[rows][:, None])
    return np.add.reduceat(share[:, places] * weights, starts, axis=1)


def look(tree: Tree, group: Group, best: Best) -> int:
    """Depth-first branch and bound over one tree for all items of the group. Returns the number of rows scored."""
    every = np.arange(len(group.items))
    numbers = np.array(group.items)
    todo = [(len(tree.m) - 1, every, (group.places, group.weights, group.starts))]
    seen = 0
    while todo:
        node, rows, entries = todo.pop()
        kids = tree.children[node - tree.docs]
        width = max(1, STEP // max(len(entries[0]), tree.tf.shape[1]))
        for at in range(0, len(kids), width):
            some = np.array(kids[at : at + width])
            found = scores(tree, some, *entries)
            seen += len(some)
            inner = some >= tree.docs
            hopeful = best.hopes(numbers[rows][None, :], found, tree.first[some][:, None])
            for k, j in zip(*np.nonzero(hopeful & ~inner[:, None])):
                best.put(group.items[rows[j]], int(found[k, j]), int(tree.ids[some[k]]))
            hopeful &= inner[:, None]
            hopeful &= best.hopes(numbers[rows][None, :], found, tree.first[some][:, None])
            alive = np.flatnonzero(hopeful.any(axis=1))
            for k in alive[np.argsort(found[alive].max(axis=1), kind="stable")]:
                left = rows[hopeful[k]]
                todo.append((int(some[k]), left, entries) if len(left) == len(rows) else (int(some[k]), left, group.of(left)))
    return seen


def best_here(vectors: DataFrame, plan, n_items: int, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """``part, item, doc_id, score``: the best documents of each item within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, vocabulary = plan.value
        best = Best(n_items, top)
        for group in groups:
            group.local = np.full(vocabulary, -1, np.int64)
            group.local[group.order] = np.arange(len(group.order))
        widest = max((len(g.order) for g in groups), default=1)
        size = max(16, CELLS // (2 * widest))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                m = np.array([100 - 25 + 25 * n * n_docs // n_terms for n in part.column(1).to_pylist()], np.int64)
                ends = part.column(2).offsets.to_numpy()
                flat = part.column(2).values.to_numpy()[ends[0] : ends[-1]]
                tfs = part.column(3).values.to_numpy()[ends[0] : ends[-1]]
                owner = np.repeat(np.arange(len(ids)), np.diff(ends))
                for group in groups:
                    local = group.local[flat]
                    there = local >= 0
                    held, mine = np.unique(owner[there], return_inverse=True)
                    if not len(held):
                        continue
                    tf = np.zeros((len(held), len(group.order)), np.int32)
                    tf[mine, local[there]] = tfs[there]
                    look(plant(tf, m[held], ids[held]), group, best)
        found = [(i, None if -d == NO_ID else -d, s) for i, heap in enumerate(best.heaps) for s, d in heap]
        columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        part_no = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part_no] * len(found), pa.int32()), *columns], ["part", "item", "doc_id", "score"])

    return vectors.select("doc_id", "n", "term", "tf").mapInArrow(run, "part int, item int, doc_id long, score long")


def ranked(found: DataFrame, by: Sequence[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item, scores above 0, ties by id."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    asked = scratch.keep(item_terms(items), "lexical-items")
    words = asked.agg(F.sum("n")).first()[0] or 0
    chunks = max(1, -(-words // chunk))
    dealt = asked.withColumn("_chunk", F.pmod(F.xxhash64("item_id", "terms"), F.lit(chunks)))
    out = None
    for number in range(chunks):
        rows = dealt.where(F.col("_chunk") == number).collect()  # about ``chunk`` words
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
        places = spark.sparkContext.broadcast(vocabulary)
        vectors = scratch.keep(term_vectors(docs, places), "lexical-vectors")
        places.destroy()
        n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(max(1, len(vocabulary)), np.int64)
        for term, count in vectors.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row per term of the chunk
            df[term] = count
        numbers = [[vocabulary[bytes(t)] for t in r["terms"]] for r in rows]
        groups = grouped(numbers, df, n_docs, group)
        plan = spark.sparkContext.broadcast((groups, len(vocabulary)))
        here = scratch.keep(best_here(vectors, plan, len(rows), n_docs, n_terms, top), "lexical-best")
        plan.destroy()
        some = ranked(here.withColumn("_lot", F.pmod("part", F.lit(64))), ["item", "_lot"], top).drop("rank", "_lot")
        names = spark.createDataFrame(
            [(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}"
        )
        done = ranked(some, ["item"], top).join(names, "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
        out = done if out is None else out.unionByName(done)
    return out
