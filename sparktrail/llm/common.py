"""What the corpus operators share: tables, the shared folder, size-checked joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir, table

__all__ = ["BROADCAST_ROWS", "SPACE", "Workspace", "bucket", "join_sized", "partitions", "shared_dir", "sized", "slices", "stored", "splits", "table", "text_col"]

#: A table may be broadcast when it has been counted and holds at most so many rows.
BROADCAST_ROWS = 200_000
#: A written table may be broadcast when its files and columns are estimated at so many bytes (files are compressed).
BROADCAST_BYTES = 8 << 20
#: Bytes of an Arrow batch while a table is written, and the setting for it.
BATCH_BYTES, BATCH_CONF = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Characters of white space in every word rule here (Java and Python regular expressions agree on it).
SPACE = r"[\x20\x09-\x0D]+"


class Workspace:
    """A folder of written intermediate tables, so that lineage is cut and lost executors cost nothing.

    Tables go when `drop` is called or at the end of the session."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._fs().deleteOnExit(self._path(self.path))

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read again. Batches that go to Python meanwhile hold at most BATCH_BYTES, so memory doesn't follow the longest rows."""
        out = f"{self.path}/{name}"
        before = self.spark.conf.get(BATCH_CONF, None)
        self.spark.conf.set(BATCH_CONF, BATCH_BYTES)
        try:
            df.write.option("compression", "zstd").parquet(out)
        finally:
            self.spark.conf.unset(BATCH_CONF) if before is None else self.spark.conf.set(BATCH_CONF, before)
        return self.spark.read.schema(df.schema).parquet(out)

    def drop(self, *names: str) -> None:
        """Deletes tables, and lets shuffle files go that nothing refers to any more: the driver's collector finds them."""
        for name in names:
            self._fs().delete(self._path(f"{self.path}/{name}"), True)
        self.spark._jvm.System.gc()


def sized(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A materialised table with a hint how to join it: broadcast if its files are small, else a shuffle (AQE splits skew)."""
    return F.broadcast(table) if stored(table) <= limit else table.hint("merge")


def stored(table: DataFrame) -> int:
    """Bytes of the files of a written table."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_sized(left: DataFrame, right: DataFrame, on: str | list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a materialised `right`: broadcast if it was counted and is small, else a shuffle join (AQE splits skew)."""
    small = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_col(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about `most` bytes of text, one row at least; bounds what numpy holds at a time."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    lo = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def splits(ids: DataFrame, column: str, parts: int) -> list:
    """Up to `parts` - 1 rising split points of a whole-number column; the driver gets only these."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    row = ids.agg(F.percentile_approx(F.col(column), at, 10_000).alias("p")).first()
    return sorted(set(row.p or []))


def bucket(column: Column, points: list) -> Column:
    """How many split points lie at or below the value, by halving; null goes to bucket 0."""
    if not points:
        return F.lit(0)
    kept, steps = F.array(*[F.lit(int(p)) for p in points]), len(points).bit_length()

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        right = (at["lo"] < at["hi"]) & (F.get(kept, mid) <= column)
        return F.struct(F.when(right, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(right, at["hi"]).otherwise(F.greatest(mid, at["lo"])).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(points)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]
    return F.when(column.isNull(), 0).otherwise(found)
