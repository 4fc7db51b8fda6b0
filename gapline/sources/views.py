"""Posting views over the driver's tables: (list_id, doc_id), distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pairs(df: DataFrame, list_id: str, doc_id: str) -> DataFrame:
    return df.select(F.expr(list_id).cast("bigint").alias("list_id"), F.expr(doc_id).cast("bigint").alias("doc_id")).distinct()


def dense(names: DataFrame) -> DataFrame:
    """names(name) with a dense id in order of name. Numbering goes by ranges: counts per leading characters first, then a rank in each."""
    head = names.select("name", F.substring("name", 1, 4).alias("h")).distinct()
    counts = head.groupBy("h").count()
    before = F.sum("count").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    at = counts.select("h", F.coalesce(before, F.lit(0)).alias("offset"))
    ranked = head.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("name")) - 1)
    return ranked.join(at, "h").select("name", (F.col("offset") + F.col("k")).cast("bigint").alias("list_id"))


def line(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(_table(spark, d, "lineitem"), "l_linenumber", "l_orderkey")


def qty(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(_table(spark, d, "lineitem"), "cast(l_quantity as bigint)", "l_orderkey")


def supp(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(_table(spark, d, "lineitem"), "l_suppkey", "l_orderkey")


def part(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(_table(spark, d, "lineitem"), "l_partkey", "l_orderkey")


def cust(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(_table(spark, d, "orders"), "o_custkey", "o_orderkey")


def event_type(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("doc_id"))
    return _pairs(rows.join(dense(rows.select("name")), "name"), "list_id", "doc_id")


def event_user(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(_table(spark, d, "events"), "user_id", "event_id")


def token(spark: SparkSession, d: str) -> DataFrame:
    """Tokens are runs of a-z of the lower-cased text."""
    rows = _table(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("name"), "doc_id")
    return _pairs(rows.join(dense(rows.select("name")), "name"), "list_id", "doc_id")


VIEWS = {"line": line, "qty": qty, "supp": supp, "part": part, "cust": cust, "event_type": event_type, "event_user": event_user, "token": token}

SQL = {
    "line": "SELECT DISTINCT l_linenumber::BIGINT AS list_id, l_orderkey AS doc_id FROM lineitem",
    "qty": "SELECT DISTINCT l_quantity::BIGINT AS list_id, l_orderkey AS doc_id FROM lineitem",
    "supp": "SELECT DISTINCT l_suppkey AS list_id, l_orderkey AS doc_id FROM lineitem",
    "part": "SELECT DISTINCT l_partkey AS list_id, l_orderkey AS doc_id FROM lineitem",
    "cust": "SELECT DISTINCT o_custkey AS list_id, o_orderkey AS doc_id FROM orders",
    "event_type": "SELECT DISTINCT (dense_rank() OVER (ORDER BY event_type) - 1)::BIGINT AS list_id, event_id AS doc_id FROM events",
    "event_user": "SELECT DISTINCT user_id AS list_id, event_id AS doc_id FROM events",
    "token": "SELECT DISTINCT (dense_rank() OVER (ORDER BY t) - 1)::BIGINT AS list_id, doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents)",
}


def line_queries(spark: SparkSession, k: int) -> DataFrame:
    """Queries of k terms over the lists of the view line."""
    return spark.range(7).select(F.col("id").alias("query_id"), F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), lambda i: (F.col("id") + i) % 7 + 1).alias("terms"))


def qty_queries(spark: SparkSession, k: int) -> DataFrame:
    """Queries of k terms over the lists of the view qty."""
    return spark.range(50).select(F.col("id").alias("query_id"), F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), lambda i: (F.col("id") * 7 + i * i * 3 + i) % 50 + 1).alias("terms"))


def queries_sql(view: str, k: int) -> str:
    n, term = {"line": (7, "(q + i) % 7 + 1"), "qty": (50, "(7 * q + 3 * i * i + i) % 50 + 1")}[view]
    return f"SELECT DISTINCT q AS query_id, {term} AS list_id FROM range({n}) a(q), range({k}) b(i)"
