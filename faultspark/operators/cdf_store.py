"""ECDFs that grow: the bucket tables of batches kept side by side, so that a batch sent again takes its own place and changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ecdf import from_histogram, histogram, levels, merge_histograms

_RECORD = "levels double, at int, inclusive boolean, keys array<string>"


class CdfStore:
    """Histograms on fixed levels, by batch, under path; a batch holds one row for each key and bucket, whatever the number of its values.

    The levels, the keys and whether a bucket holds its upper level are written at first use; an error if a store is opened with others. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, x: list[float], keys: list[str], *, inclusive: bool = True) -> None:
        self.spark, self.path, self.x, self.keys, self.inclusive = spark, path.rstrip("/"), levels(x), list(keys), inclusive
        for name in ("batch", "bucket", "w", "n"):
            if name in keys:
                raise ValueError(f"a key cannot be called {name}")
        mine = [(v, k, inclusive, self.keys) for k, v in enumerate(self.x)]
        if self._there("record"):
            found = [tuple(r) for r in spark.read.schema(_RECORD).parquet(f"{self.path}/record").orderBy("at").collect()]  # as long as the levels
            if found != mine:
                raise ValueError("the store has other levels or keys")
        else:
            spark.createDataFrame(mine, _RECORD).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/record")

    def _there(self, name: str) -> bool:
        """Whether a table was written whole."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def append(self, df: DataFrame, value: str, *, weight: str | None = None, batch: str = "batch") -> None:
        """The values of each batch that the column names, in one pass; a batch that is there already is put in the other's place, whole.

        So a batch must be sent with all its rows. Null names a batch of its own; no rows change nothing.
        """
        named = df.withColumn("_name", F.coalesce(F.concat(F.lit("b"), F.col(batch).cast("string")), F.lit("null")))
        hist = histogram(named, value, self.x, [*self.keys, "_name"], weight, self.inclusive).withColumnRenamed("_name", "batch")
        hist.repartition("batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/batches")

    def append_stream(self, df: DataFrame, batch_id: int, value: str, *, weight: str | None = None) -> None:
        """For foreachBatch: a micro-batch under its number, so one that is run again after a failure counts once."""
        self.append(df.withColumn("batch", F.lit(batch_id)), value, weight=weight)

    def batches(self) -> DataFrame:
        """keys, bucket, w, n of each batch; names as they were sent, behind a b."""
        return self.spark.read.option("basePath", f"{self.path}/batches").parquet(f"{self.path}/batches").withColumn("batch", F.col("batch").cast("string"))

    def drop_batch(self, name: str) -> None:
        """A batch taken out again."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches/batch=b{name}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def histogram(self) -> DataFrame:
        return merge_histograms(self.batches().drop("batch"))

    def cdf(self, total: str = "finite", force_endpoints: bool = False) -> DataFrame:
        """keys, x_idx, x, cdf of all batches together; see ecdf.from_histogram."""
        return from_histogram(self.histogram(), self.x, self.keys, total, force_endpoints)
