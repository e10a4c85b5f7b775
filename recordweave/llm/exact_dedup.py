"""Exact deduplication as a stateful stream: one keyed state row per distinct text, without expiry.

A stream reads the table; its aggregation by digest keeps, in RocksDB state on disk
(checkpointed to the shared folder), the digest, the stable id (the largest), the
number of rows and a content locator (length and file of the row with that id). No
watermark: state never expires, and a later run with the same folder goes on from
it. Hits - rows of a digest seen more than once - are then compared byte by byte
with the row that stays; rows whose bytes differ are grouped by the bytes. Where the
row that stays is in an earlier batch and not among the given rows, the digest decides.
Everything runs in the JVM. A hot digest's rows stay where they are when they learn
what the state says, and its bytes are compared in parts, each with its own copy of
the text that stays.

Null text equals empty text. Rows with equal text and equal id are one document for
`keep_id`, both are counted in `group_size` and both are kept when theirs is the
largest id. Null ids never win against an id. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, spread_join, table

#: Rows of one digest whose bytes are compared in one place.
PART_ROWS = 1000

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def update_state(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Run the stream over ``source`` up to its end; the state of every digest.

    ``source`` is a parquet path with doc_id and text, or with doc_id, digest and n_bytes.
    ``folder`` holds the stream's checkpoint and the changes of each batch, and may
    be used again after rows were added to ``source``.
    """
    given = spark.read.parquet(source)
    digested = "digest" in given.columns
    schema = given.select(*(["doc_id", "digest", "n_bytes"] if digested else ["doc_id", "text"])).schema
    before = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        text = F.coalesce("text", F.lit("")) if not digested else None
        digest, n_bytes = (F.col("digest"), F.col("n_bytes")) if digested else (F.sha2(text, 256), F.octet_length(text).cast("long"))
        state = (
            spark.readStream.schema(schema).parquet(f"{source[:-1]}[{source[-1]}]")  # as a pattern, which may be one file too
            .select(
                digest.alias("digest"), F.col("doc_id").cast("long").alias("doc_id"),
                F.struct(n_bytes.alias("n_bytes"), F.col("_metadata.file_path").alias("file")).alias("locator"),
            )
            .groupBy("digest")
            .agg(F.max(F.struct("doc_id", "locator")).alias("kept"), F.count("*").alias("group_size"))
            .select("digest", F.col("kept.doc_id").alias("keep_id"), "group_size", F.col("kept.locator").alias("locator"))
        )
        changes = f"{folder}/changes"

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")  # a batch that is run again replaces its own

        run = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # every change of a digest replaces the one before
    kinds = "digest string, keep_id long, group_size long, locator struct<n_bytes: long, file: string>, batch int"
    return spark.read.schema(kinds).parquet(changes).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.max_by("locator", "batch").alias("locator"))


def deduplicate(spark: SparkSession, docs: DataFrame, state: DataFrame) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256, by the digests in ``state``.

    A column ``row`` is carried along.
    """
    extra = [c for c in docs.columns if c == "row"]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), text.alias("text"), *extra)
    many = state.where("group_size > 1").select(F.col("digest").alias("text_sha256"), "keep_id", "group_size", F.col("group_size").alias("n"))
    total = docs.count()
    alone = spread_join(rows.select("doc_id", "text_sha256", *extra), many, "text_sha256", "n", total, "left").where("group_size IS NULL")
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", *extra)
    # rows whose digest was seen before, with their bytes: written once, as what follows reads them several times
    hits = cut(spread_join(rows, many, "text_sha256", "n", total), f"{shared_dir(spark, 'hits')}")
    # the bytes of the rows that stay, one for each digest and part of its rows; a hit must equal them
    parts = F.ceil(F.col("group_size") / PART_ROWS)
    stays = hits.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("text_sha256").agg(F.min("text").alias("stay_text"), F.max("group_size").alias("group_size"))
    stays = stays.select("text_sha256", "stay_text", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    dealt = hits.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts))
    compared = dealt.join(stays, ["text_sha256", "part"], "left").drop("part").withColumn("same", F.col("stay_text").isNull() | (F.col("text") == F.col("stay_text")))
    same = compared.where("same").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *extra)
    out = alone.unionByName(same)
    differ = compared.where("not same")
    return out if differ.isEmpty() else out.unionByName(_by_bytes(differ.drop("stay_text", "same")))


def _by_bytes(rows: DataFrame) -> DataFrame:
    """Rows whose digest met different bytes, grouped by the bytes themselves."""
    best = rows.groupBy("text_sha256", "text").agg(F.max("doc_id").alias("best"), F.count("*").alias("n"))
    return rows.drop("keep_id", "group_size").join(best, ["text_sha256", "text"]).select(
        "doc_id", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("best")).alias("kept"), "text_sha256", *(c for c in rows.columns if c == "row")
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows with equal id and text one stays."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, "exact-dedup")
    text = F.coalesce("text", F.lit(""))
    arrivals = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    arrivals.write.parquet(f"{folder}/arrivals")
    state = update_state(spark, f"{folder}/arrivals", folder)
    found = deduplicate(spark, docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), state).where("kept")
    many = found.where("group_size > 1").dropDuplicates(["doc_id", "text_sha256"])
    return found.where("group_size = 1").unionByName(many).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = f"{sf_dir.rstrip('/')}/documents.parquet"
    state = update_state(spark, source, shared_dir(spark, "exact-dedup"))
    return deduplicate(spark, table(spark, sf_dir, "documents"), state)


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
