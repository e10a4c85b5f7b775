"""The fragment inbox as a stream: read once, append to a table, and only then forget the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def collect(spark: SparkSession, inbox: str, target: str, checkpoint: str, delete: bool = False) -> StreamingQuery:
    """Append the inbox's fragments (dir, path, body; no stubs) to the parquet table ``target``.

    A batch that runs again replaces its own part. With ``delete``, files go after their
    batch is written; the checkpoint keeps them from being read twice in any case.
    """
    rows = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.md").load(inbox)
    found = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")).where(~F.col("path").endswith("_template.md"))

    def put(batch: DataFrame, number: int) -> None:
        batch.where(~T.is_stub(F.col("body"))).write.mode("overwrite").parquet(f"{target}/batch={number}")
        if delete:
            path = spark._jvm.org.apache.hadoop.fs.Path
            for r in batch.select("path").toLocalIterator():  # names only, one file at a time
                p = path(r.path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)

    return found.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def books(entries: DataFrame, granularity: str = "day") -> DataFrame:
    """Running counts of a stream ``(created, ...)`` by calendar book; late entries simply count again."""
    return entries.groupBy(T.book_key(F.col("created"), granularity).alias("book")).agg(F.count("*").alias("n"))
