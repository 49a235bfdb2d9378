"""The driver's tables seen as memberships, positions, pairs and intervals. `SQL` says the same to DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_REF = """CASE WHEN o_custkey % 6 = 0 THEN o_custkey * 10
 WHEN o_custkey % 6 = 1 THEN o_custkey * 10 + o_orderkey % 2
 WHEN o_custkey % 6 = 2 THEN (o_custkey {div} 12) * 10 + 3
 WHEN o_custkey % 6 = 3 THEN CASE WHEN o_orderkey % 5 = 0 THEN o_custkey * 10 + 5 ELSE o_custkey * 10 END
 WHEN o_custkey % 6 = 4 THEN o_custkey * 10 + 4
 ELSE (o_custkey {div} 30) * 10 + 7 END"""


def _orders(spark: SparkSession, sf: str, group: str, where: str) -> DataFrame:
    return table(spark, sf, "orders").where(where).select(F.expr(group).alias("group_id"), F.col("o_orderpriority").alias("spp"), F.col("o_orderkey").alias("gene"))


def pred(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted grouping: orders by customer."""
    return _orders(spark, sf, "o_custkey", "o_orderkey % 11 <> 0")


def ref(spark: SparkSession, sf: str) -> DataFrame:
    """Reference grouping: customers' orders split, merged and shifted."""
    return _orders(spark, sf, _REF.format(div="div"), "o_orderkey % 13 <> 0 OR o_custkey % 6 = 0")


def third(spark: SparkSession, sf: str) -> DataFrame:
    """A third method: three customers in one group."""
    return _orders(spark, sf, "o_custkey div 3", "o_orderkey % 17 <> 0")


def multi(spark: SparkSession, sf: str) -> DataFrame:
    """A grouping with multi-grouped genes: orders by supplier of their large lines, and by their small ones."""
    line = table(spark, sf, "lineitem").select("l_orderkey", F.expr("if(l_quantity >= 35, l_suppkey % 3, 3)").alias("part")).distinct()
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.expr("o_custkey * 100 + part").alias("group_id"), F.col("o_orderpriority").alias("spp"), F.col("o_orderkey").alias("gene")).distinct()


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line membership: parts of an order, species is the brand. Entries repeat."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("group_id"), F.col("p_brand").alias("spp"), F.col("l_partkey").alias("gene")
    )


def genes(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated genes with their place: start on a chromosome of their species."""
    return table(spark, sf, "orders").where("o_orderkey % 7 <> 3").select(
        F.col("o_orderpriority").alias("spp"), F.col("o_orderkey").alias("gene"), F.expr("concat('chr', o_custkey % 20)").alias("chrom"),
        F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long").alias("start"),
    )


#: DuckDB: the same views as common table expressions.
SQL = {
    "pred": "pred AS (SELECT o_custkey AS group_id, o_orderpriority AS spp, o_orderkey AS gene FROM orders WHERE o_orderkey % 11 <> 0)",
    "ref": f"ref AS (SELECT {_REF.format(div='//')} AS group_id, o_orderpriority AS spp, o_orderkey AS gene FROM orders WHERE o_orderkey % 13 <> 0 OR o_custkey % 6 = 0)",
    "third": "third AS (SELECT o_custkey // 3 AS group_id, o_orderpriority AS spp, o_orderkey AS gene FROM orders WHERE o_orderkey % 17 <> 0)",
    "multi": "multi AS (SELECT DISTINCT o_custkey * 100 + CASE WHEN l_quantity >= 35 THEN l_suppkey % 3 ELSE 3 END AS group_id, o_orderpriority AS spp, o_orderkey AS gene FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "lines": "lines AS (SELECT l_orderkey AS group_id, p_brand AS spp, l_partkey AS gene FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "genes": "genes AS (SELECT o_orderpriority AS spp, o_orderkey AS gene, 'chr' || (o_custkey % 20) AS chrom, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS start FROM orders WHERE o_orderkey % 7 <> 3)",
    "pos": "pos AS (SELECT spp, gene, chrom, start, row_number() OVER (PARTITION BY spp, chrom ORDER BY start, gene) AS idx FROM genes)",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
