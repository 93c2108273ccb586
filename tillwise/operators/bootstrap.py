"""Bootstrap samples: how often each row is drawn with replacement, for many samples at once.

Drawing n of n rows with replacement gives a row a Poisson(1) number of copies, up to the total. The number
follows from a hash of the row's key, the sample and a seed: no row is moved, and the samples are the same
for every partitioning and every run. Where the total must be n, a little more is drawn and exactly n copies
are kept by rank selection, which leaves the multinomial distribution of drawing with replacement.

Rows that share a key get the same number; hand in a key that names a row. A null key gets the number of the
empty text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import as_col
from ..session import materialize, ship_package
from .sampling import _selected, hash_order

#: Hash values are compared with the distribution function scaled by this.
SCALE = 1 << 32


def poisson_steps(rate: float = 1.0) -> list[int]:
    """Hash values from which a row has one more copy, up to the last one that 32 bits tell apart."""
    out, term, total = [], math.exp(-rate), 0.0
    for k in range(1, 200):
        total += term
        term *= rate / k
        step = round(total * SCALE)
        if step >= SCALE:
            break
        out.append(step)
    return out


def drawn(key: str | Column, sample: Column, seed: int, rate: float = 1.0) -> Column:
    """Copies of a row in a sample."""
    name = F.concat_ws("|", F.coalesce(as_col(key).cast("string"), F.lit("")), sample.cast("string"), F.lit(str(seed)))
    mark = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")
    return sum((F.when(mark >= step, 1).otherwise(0) for step in poisson_steps(rate)[1:]), F.when(mark >= poisson_steps(rate)[0], 1).otherwise(0))


def bootstrap_counts(df: DataFrame, key: str, samples: int, seed: int = 42, rate: float = 1.0) -> DataFrame:
    """``df`` once per sample (``tree``) that draws a row, with its number of ``copies``. Narrow."""
    each = df.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return each.withColumn("copies", drawn(key, F.col("tree"), seed, rate)).where("copies > 0")


def bootstrap_arrays(df: DataFrame, key: str, samples: int, seed: int = 42, out: str = "copies") -> DataFrame:
    """``df`` with one byte a sample: the copies that :func:`bootstrap_counts` gives the row in it. Narrow, a row a row."""
    ship_package(df.sparkSession)
    steps = np.array(poisson_steps())
    ends = [f"|{t}|{seed}".encode() for t in range(samples)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = bytearray()
            for name in batch.column(batch.num_columns - 1).to_pylist():
                begun = hashlib.md5(name.encode())
                for end in ends:
                    mark = begun.copy()
                    mark.update(end)
                    marks += mark.digest()[:4]
            copies = np.searchsorted(steps, np.frombuffer(marks, ">u4").astype(np.int64), side="right").astype(np.uint8)
            rows = [r.tobytes() for r in copies.reshape(-1, samples)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.binary())], [*batch.schema.names[:-1], out])

    named = df.withColumn(out, F.coalesce(F.col(key).cast("string"), F.lit("")))
    return named.mapInArrow(run, df.withColumn(out, F.lit(b"")).schema)


def exact_bootstrap(df: DataFrame, key: str, samples: int, seed: int = 42) -> DataFrame:
    """``tree, key, copies`` with exactly as many copies a sample as ``df`` has rows. Hand in a stored table with a unique key.

    More copies are drawn than needed, by ten standard deviations of their number; the first in an order by
    hash are kept. Ranks are found by counting (:func:`sampling._selected`); no sample is sorted.
    """
    n = df.count()
    rate = 1.0 + 10.0 / math.sqrt(n) if n else 1.0
    more = bootstrap_counts(df.select(key), key, samples, seed, rate)
    copies = more.select(key, "tree", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    marked = materialize(copies.withColumn("_g", F.col("tree")), "bootstrap")
    need = materialize(marked.groupBy("_g").agg(F.least(F.count("*"), F.lit(n)).alias("_need")), "bootstrap-need")
    if not need.where(F.col("_need") < n).isEmpty():
        raise RuntimeError("fewer copies were drawn than rows are wanted; take another seed")
    name = F.concat_ws("|", F.col(key).cast("string"), F.col("tree").cast("string"), F.col("copy").cast("string"))
    kept = _selected(marked, need, [hash_order(name, seed)]).where("_first")
    return kept.groupBy("tree", key).agg(F.count("*").alias("copies"))
