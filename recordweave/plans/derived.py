"""Record relations derived from plain tables, for queries and benchmarks.

Each view is a deterministic projection of a driver table into the engine's logical
schema, by integer and string expressions alone, so that another engine can compute
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

_STATUS = ("Active", "Proposed", "Deferred", "Superseded", "Rejected")
_PREFIX = ("ADR", "RFC", "SPEC")
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _prefix(key: str):
    return F.element_at(F.array(*map(F.lit, _PREFIX)), (F.col(key) % 3 + 1).cast("int"))


def _code(key: str, shift=None):
    number = F.expr(f"CAST({key} div 3 AS int)")
    return T.code(_prefix(key), number if shift is None else number + shift)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("p_size") % 5 + 1).cast("int"))
    code = _code("p_partkey")
    return p.select(
        _prefix("p_partkey").alias("scheme"), F.expr("CAST(p_partkey div 3 AS int)").alias("number"), F.lit(None).cast("string").alias("tail"), code.alias("code"), F.concat(F.lit("docs/"), code, F.lit(".md")).alias("path"),
        F.col("p_name").alias("title"), F.concat(code, F.lit(": "), F.when(F.col("p_partkey") % 11 == 0, F.upper("p_name")).otherwise(F.col("p_name"))).alias("heading"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(status, F.lit(" — noted"))).otherwise(status).alias("status"), status.alias("status_word"), (status == "Active").alias("active"),
        F.array(F.lower("p_type"), F.lower("p_brand")).alias("tags"), F.when(F.col("p_partkey") % 7 > 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 1500).cast("int"))).alias("date"),
        (F.col("p_partkey") % 3 + 1).cast("int").alias("version"),
        F.when(F.col("p_partkey") % 2 == 0, F.array(F.struct((F.col("p_partkey") % 4 + 1).cast("int").alias("version"), F.lit("2024-01-01").alias("date"), F.lit("n").alias("note")))).alias("history"),
        F.array(_code("p_partkey", F.lit(1))).alias("influenced_by"), F.array(F.concat(F.lit("old-"), F.expr("CAST(p_partkey div 2 AS string)"))).alias("formerly"), F.lit("{}").alias("meta"), F.col("p_name").alias("body"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some codes resolve to nothing; a line may name a code twice, which counts once."""
    li = table(spark, sf_dir, "lineitem")
    far = F.when(F.col("l_suppkey") % 7 == 0, F.lit(5000)).otherwise(F.lit(0))
    return li.select(F.concat(F.lit("f"), (F.col("l_orderkey") % 997).cast("string")).alias("path"), F.col("l_linenumber").alias("line"), _code("l_partkey", far).alias("code")).distinct()


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = "(o_orderkey * 13 + o_custkey) % 2000"
    far = F.when(F.col("o_custkey") % 2 == 0, F.lit(0)).otherwise(F.lit(5000))
    kind = F.when(F.col("o_custkey") % 2 == 0, F.lit("inactive-ok")).otherwise(F.lit("unresolved-ok"))
    lo = F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_custkey") % 4 + 1).cast("int")).otherwise(F.lit(1))
    hi = F.when(F.col("o_orderkey") % 3 == 0, lo + 1).when(F.col("o_orderkey") % 3 == 1, (F.col("o_custkey") % 5 + 1).cast("int")).otherwise(F.lit(9999))
    rows = o.withColumn("k", F.expr(key))
    return rows.select(F.concat(F.lit("f"), (F.col("o_orderkey") % 997).cast("string")).alias("path"), kind.alias("kind"), _code("k", far).alias("code"), lo.alias("lo"), hi.alias("hi"), F.col("o_orderkey").alias("pos"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("journal"), F.format_string("%012d", "event_id").alias("path"), F.date_trunc("second", "ts").alias("created"), F.concat(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string")).alias("title"), F.coalesce("props", F.lit("")).alias("body"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's whole text; a turn without one is a stub."""
    c = table(spark, sf_dir, "conversations")
    body = F.coalesce("text", F.lit(" <!-- nothing\nto say --> "))
    return c.select(F.concat(F.lit("inbox/"), F.col("conv_id").cast("string")).alias("dir"), F.format_string("%08d", F.col("turn")).alias("path"), F.when(F.col("turn") % 3 != 2, F.col("turn") * 10).alias("committed_at"), body.alias("body"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole, unchanged text after lines of markdown: bare codes, a directive, URLs and links."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))  # whole texts: a batch must stay within a worker's memory
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id") % 600
    lines = [
        F.concat(F.lit("# note "), F.col("doc_id").cast("string")), F.concat(F.lit("per ADR-"), F.format_string("%03d", n), F.lit(" and RFC "), F.format_string("%d", n % 50), F.lit(" it works")),
        F.concat(F.lit("<!-- inactive-ok: ADR-"), F.format_string("%03d", n), F.lit(" — kept -->")), F.concat(F.lit("see https://example.test/SPEC-"), F.format_string("%03d", n), F.lit(" for SPEC-"), F.format_string("%03d", n + 1)),
        F.concat(F.lit("[doc](../part/"), (n % 300).cast("string"), F.lit(".md#top) and [other](./a/../p"), (n % 9).cast("string"), F.lit(".md) and [web](http://x.test)")),
        F.coalesce("text", F.lit("")),
    ]
    return d.select(F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.array_join(F.array(*lines), "\n").alias("text"))
