"""Helpers that several operators share: shipping the package, batches of bounded size, row identity."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_stage

#: Bytes of text that an operator holds as Python or NumPy values at a time.
SLICE_BYTES = 2 << 20

#: The white space of the word rules: blank and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that tasks can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="tillwise-ship-"), "tillwise_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, "tillwise")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice has at most ``limit`` bytes in ``column``, or one row."""
    for batch in batches:
        sizes = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def texts(array: pa.Array) -> list[str | None]:
    return array.to_pylist()


def raw(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, nulls as empty."""
    return [b"" if x is None else x for x in array.cast(pa.binary()).to_pylist()]


def text_key(text: Column) -> Column:
    """64 bits of the text; with the id it names a row, equal rows being one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on ``names``."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


class Scratch:
    """Written stages of one operator, dropped when what follows from them is written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` in the shared folder and read it back."""
        schema, path = df.schema, write_stage(df, name)
        self.paths.append(path)
        return self.spark.read.schema(schema).parquet(path)

    def tidy(self, stages: int = 0) -> None:
        """Remove all stages but the last ``stages``, and let Spark drop the shuffle files of plans that are gone."""
        cut = len(self.paths) - stages
        for path in self.paths[:cut]:
            remove_folder(self.spark, path)
        self.paths = self.paths[cut:]
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()  # Spark removes shuffle files when the driver forgets their plans


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a written stage that nothing reads any more, through Hadoop's file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
