"""Intermediate tables in the shared folder, so that a lost executor never costs a stage.

A table is written once as Parquet below ``spark.checkpoint.dir`` and read again: lineage is cut,
every executor sees the files, and a result that is used twice is the same both times.
"""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from findloom.shared import shared_dir

#: Bytes of an Arrow batch; a batch of long texts must not outweigh the slices that are worked on.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches that go to Python hold at most ``BATCH_BYTES`` (or one row) from now on."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = int(re.sub("[^0-9-]", "", spark.conf.get(key)) or -1)
    if not 0 < had <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """Tables of one operator call. ``drop`` frees one early; the rest go when the driver exits."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._clean)
        bounded_batches(spark)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return it as read back."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)

    def _clean(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the JVM may be gone already at exit
            pass
