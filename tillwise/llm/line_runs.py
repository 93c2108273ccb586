"""Line dedup over levelled sorted runs of line hashes.

The index of lines seen so far is a set of runs, each a table bucketed and sorted by the lines'
128-bit hash, one file a bucket. A new batch reduces its lines to one row per key and is merge-joined
with every run once; the keys that no run holds are the batch's own run of level 0, the others are
those an earlier batch holds. Both are parts of one table, written by one job. When a level has
``fanout`` runs they are merged into one run of the next level, so that few runs exist and each key is
rewritten a logarithmic number of times. Runs are read in their stored order (:func:`stored_order`):
no run is shuffled, and none is sorted to be joined; the shuffle that reduces a batch's lines is the
only one of its keys. A merge of two runs shuffles nothing either; its writer sorts each bucket.

The owner of a key is the smallest document id that holds it, provided that batches come in order of
ids, as :func:`dropped_lines` deals them. All steps are DataFrame operations. A hot line is combined
before the shuffle; the join that marks its occurrences is one that Spark can split.

Defined cases: a null or empty text is one empty line; a null id is the smallest id; rows that share
an id are one document for the rule, each with its own text; equal rows lose the same lines; an
empty table gives an empty result. Only the id and the text are read by :func:`line_verdicts`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shared_folder
from .common import BLANKS, Scratch, partitions, remove_folder, text_key

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() would also change letters beyond ASCII; it is the fast way for lines without any
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``id, text_key, pos, k1, k2`` of each line long enough to count."""
    smallest = F.lit(-(1 << 63)).cast("long")
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), smallest).alias("id"),
        text_key(F.col("text")).alias("text_key"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"),
    ).where(F.octet_length("line") >= min_chars)
    keys = lines.select("id", "text_key", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("id", "text_key", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


@contextmanager
def stored_order(spark: SparkSession) -> Iterator[None]:
    """Let plans made inside rely on the order of bucketed tables; Spark checks that a bucket is one file."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Runs of line hashes; ``add`` takes the next batch and tells what an earlier one holds.

    Use it in a ``with`` block: the runs' tables go at its end, after a failure too.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.folder = f"{shared_folder(spark)}/line-runs-{uuid.uuid4().hex}"
        self.buckets = partitions(spark)
        self.levels: list[list[str]] = [[]]

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def run(self, name: str) -> DataFrame:
        """The keys of one run; of a batch's table the part that was new."""
        table = self.spark.table(name)
        return table.where("NOT known").select("k1", "k2") if "known" in table.columns else table

    def marked(self, keys: DataFrame) -> DataFrame:
        """``keys``, distinct in ``(k1, k2)``, and whether a run holds them: one merge join with each run."""
        flags = []
        for i, name in enumerate(name for level in self.levels for name in level):
            flags.append(f"_in_{i}")
            keys = keys.join(self.run(name).withColumn(flags[-1], F.lit(True)).hint("merge"), ["k1", "k2"], "left")
        return keys.withColumn("known", F.coalesce(*flags, F.lit(False))).drop(*flags)

    def _store(self, keys: DataFrame, name: str, by: list[str]) -> None:
        """Write a table bucketed and sorted by hash; ``keys`` lie by hash in as many partitions, so a bucket is one file."""
        path = f"{self.folder}/{name}"
        with stored_order(self.spark):
            rows = keys.write.partitionBy(*by) if by else keys.write
            rows.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", path).saveAsTable(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(self.spark, f"{self.folder}/{name}")

    def add(self, keys: DataFrame) -> DataFrame:
        """Keep the new ones of distinct ``(k1, k2)`` as a run; return all rows with ``known``, true for the old ones.

        ``keys`` come from a grouping by ``(k1, k2)`` and may have further columns; partitioned otherwise, they
        make several files a bucket, and Spark sorts that run when it is read. What is returned
        is read apart from its buckets, so that a join with many occurrences of a key can be split.
        """
        name = f"line_run_{uuid.uuid4().hex}"
        rows = self.marked(keys)
        self.levels[0].append(name)  # before it is written, so that a half-written one goes too
        self._store(rows, name, ["known"])
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def compact(self) -> None:
        """Merge the runs of each full level into one run of the next level; call it when what ``add`` returned is used."""
        for level, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                merged = f"line_run_{uuid.uuid4().hex}"
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
                runs = [self.run(n).hint("merge") for n in names]
                self._store(reduce(lambda a, b: a.join(b, ["k1", "k2"], "full"), runs), merged, [])
                self.levels[level] = []
                for name in names:
                    self._drop(name)

    def close(self) -> None:
        for name in [n for level in self.levels for n in level]:
            self._drop(name)
        remove_folder(self.spark, self.folder)


def _batches(docs: DataFrame, n: int) -> list[Column]:
    """``n`` ranges of ids with about equal numbers of documents."""
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges, edges[1:]):
        here = F.lit(True)
        if low is not None:
            here &= F.col("id") > low
        if high is not None:
            here &= F.col("id") <= high
        out.append(here)
    return out


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``id, text_key, pos`` of each line whose key a smaller document id holds."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    lines = scratch.keep(line_hashes(docs, min_chars), "lines")
    out = []
    try:
        with LineRuns(spark, fanout) as runs:
            for here in _batches(docs, batches):
                batch = lines.where(here)
                firsts = runs.add(batch.groupBy("k1", "k2").agg(F.min("id").alias("owner"), F.max("id").alias("last")))
                # a key of an earlier batch has no owner here; a key of this batch matters if two documents hold it
                losing = firsts.where("known OR last > owner").select("k1", "k2", F.when(~F.col("known"), F.col("owner")).alias("owner"))
                lost = batch.join(losing, ["k1", "k2"]).where(F.col("owner").isNull() | (F.col("id") > F.col("owner")))
                out.append(materialize(lost.select("id", "text_key", "pos"), "line-lost"))
                runs.compact()
    finally:
        scratch.tidy()
    return reduce(DataFrame.union, out)


def _flags(pos: Column) -> Column:
    """Sorted positions as an array of booleans, true where a position stands; linear in its length."""
    before = F.concat(F.array(F.lit(-1)), F.slice(pos, 1, F.size(pos) - 1))
    return F.flatten(F.zip_with(pos, before, lambda p, q: F.concat(F.array_repeat(F.lit(False), p - q - 1), F.array(F.lit(True)))))


def _judged(docs: DataFrame, min_chars: int, batches: int, fanout: int) -> DataFrame:
    """``row`` (the whole input row), ``n_dropped`` and ``kept``, the text that is left."""
    lost = dropped_lines(docs.select("doc_id", "text"), min_chars, batches, fanout).distinct().groupBy("id", "text_key")
    lost = lost.agg(F.array_sort(F.collect_list("pos")).alias("pos"))
    lost = lost.select("id", "text_key", F.size("pos").alias("size"), _flags(F.col("pos")).alias("flags"))
    smallest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["doc_id"].cast("long"), smallest).alias("own"), text_key(docs["text"]).alias("own_key"))
    joined = rows.join(lost.hint("shuffle_hash"), (F.col("own") == F.col("id")) & (F.col("own_key") == F.col("text_key")), "left")
    left = F.filter(F.split("row.text", "\n", -1), lambda _, i: ~F.coalesce(F.get("flags", i), F.lit(False)))
    kept = F.when(F.col("flags").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    return joined.select("row", F.coalesce("size", F.lit(0)).alias("n_dropped"), kept.alias("kept"))


def dedup_documents(
    docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, min_words: int = 1
) -> DataFrame:
    """``docs`` without the lines that a smaller id holds.

    A document that loses a line and keeps fewer than ``min_words`` words goes: what is left of it
    is a fragment. One that loses nothing stays, however short. All columns stay; ``n_chars``, where the table has it, follows the text. A text that loses
    nothing is passed on as it is.
    """
    done = _judged(docs, min_chars, batches, fanout)
    words = F.size(F.regexp_extract_all("kept", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    enough = F.col("kept").rlike(r"[^\x20\x09-\x0D]") if min_words == 1 else words >= min_words
    done = done.where((F.col("n_dropped") == 0) | enough)
    chars = lambda kind: F.when(F.col("n_dropped") > 0, F.char_length("kept").cast(kind)).otherwise(F.col("row.n_chars"))
    new = {"text": lambda kind: F.col("kept"), "n_chars": chars}
    return done.select(
        *[(new[f.name](f.dataType) if f.name in new else F.col("row").getField(f.name)).alias(f.name) for f in docs.schema.fields]
    )


def line_verdicts(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` of each document."""
    done = _judged(docs.select("doc_id", "text"), min_chars, batches, fanout)
    text = F.coalesce("row.text", F.lit(""))
    return done.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.col("n_dropped").cast("long").alias("n_dropped"),
        F.coalesce("kept", F.lit("")).alias("kept_text"),
    )
