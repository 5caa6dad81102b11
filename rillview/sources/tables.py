"""Base relations: projections of tables in Parquet folders, or of any DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: name -> (table, SELECT list, condition); the same SQL runs on Spark and DuckDB. div(a, 2) is written as (a - a % 2) / 2, cast.
RELATIONS: dict[str, str] = {
    "parent": "SELECT DISTINCT p_partkey AS c0, CAST((p_partkey - p_partkey % 2) / 2 AS BIGINT) AS c1 FROM part WHERE p_partkey > 0",
    "ring": "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS c0, CAST((n_nationkey * 7 + 1) % 25 AS BIGINT) AS c1 FROM nation",
    "in_region": "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS c0, CAST(n_regionkey AS BIGINT) AS c1 FROM nation",
    "region_key": "SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS c0 FROM region",
    "cust": "SELECT DISTINCT c_custkey AS c0, CAST(c_nationkey AS BIGINT) AS c1 FROM customer",
    "supp": "SELECT DISTINCT s_suppkey AS c0, CAST(s_nationkey AS BIGINT) AS c1 FROM supplier",
    "lives": "SELECT DISTINCT c_custkey AS c0, c_mktsegment AS c1, CAST(c_nationkey AS BIGINT) AS c2 FROM customer",
    "placed": "SELECT DISTINCT o_custkey AS c0, o_orderkey AS c1 FROM orders",
    "line": "SELECT DISTINCT l_orderkey AS c0, l_partkey AS c1, l_suppkey AS c2 FROM lineitem",
    "did": "SELECT DISTINCT user_id AS c0, event_type AS c1 FROM events",
    "rdf": "SELECT DISTINCT n_name AS c0, 'rdf:type' AS c1, 'Nation' AS c2 FROM nation UNION SELECT DISTINCT r_name, 'rdf:type', 'Region' FROM region UNION SELECT DISTINCT n_name, 'in', r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of RELATIONS over the Parquet tables of a folder."""
    sql = RELATIONS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f" {t} " in f"{sql} "}
    for t in sorted(frames, key=len, reverse=True):
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **frames)


def facts(spark: SparkSession, path: str, form: str = "parquet", **options: str) -> DataFrame:
    """Facts from any source that Spark reads."""
    return spark.read.format(form).options(**options).load(path)


def frontier_writer(path: str, form: str = "parquet") -> Callable[[str, DataFrame], None]:
    """A sink for frontiers: appends each relation's changes below path."""
    return lambda name, frontier: frontier.write.mode("append").format(form).save(f"{path}/{name}")
