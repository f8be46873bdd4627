"""Queries over deeply nested records (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellore.operators import nested
from tessellore.runtime import table


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_records").select("page_id", "oas", "category")


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return nested.variant_tables(nested.routed(nested.page_nodes(_pages(spark, sf_dir))))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All named items of the pages' documents and categories, from the subtype tables."""
    return nested.found_items(_tables(spark, sf_dir))


def p3_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supertype table: every node with its page and its parent."""
    return nested.page_nodes(_pages(spark, sf_dir))


def p3_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of leaf schemas with each field's owning response, body, parameter or component."""
    return _tables(spark, sf_dir)["leaf_schema"].filter(F.col("field").isNotNull())


def p3_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes have a parent that is in no subtype table, per subtype."""
    found = nested.orphans(_tables(spark, sf_dir)).groupBy("subtype").agg(F.count("*").alias("orphans"))
    names = spark.createDataFrame([(n,) for n in nested.SUBTYPES], "subtype string")
    return names.join(found, "subtype", "left").select("subtype", F.coalesce("orphans", F.lit(0).cast("bigint")).alias("orphans"))


QUERIES = {"p3_found": p3_found, "p3_nodes": p3_nodes, "p3_fields": p3_fields, "p3_orphans": p3_orphans}
ORACLE: dict[str, str] = {
    "p3_orphans": "SELECT unnest([" + ", ".join(f"'{n}'" for n in nested.SUBTYPES) + "]) AS subtype, CAST(0 AS BIGINT) AS orphans",
}
