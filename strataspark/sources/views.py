"""The driver's tables seen as observations of a geological model, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: View to (tables it reads, statement).
VIEWS = {
    "obs_points": (("lineitem",), "SELECT l_orderkey*10 + l_linenumber AS pid, l_quantity + 0.0 AS X, l_extendedprice/2000.0 AS Y, l_discount*500.0 + 0.0 AS Z, l_returnflag AS feature_name, l_tax*100.0 + 0.0 AS val FROM lineitem"),
    "obs_orient": (("part",), "SELECT p_partkey AS oid, CAST((p_partkey*37) % 360 AS DOUBLE) AS strike, CAST(p_size*1.8 AS DOUBLE) AS dip, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS polarity, p_brand AS unit FROM part"),
    "strat_units": (("nation",), "SELECT n_regionkey AS grp, n_nationkey AS pos, n_name AS unit, CAST((n_nationkey*13) % 40 + 5 AS DOUBLE) AS thickness FROM nation"),
    "unit_contacts": (("orders", "customer", "lineitem", "supplier", "nation"), "SELECT least(a.n_name,b.n_name) AS unit1, greatest(a.n_name,b.n_name) AS unit2, count(*) AS length FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey JOIN lineitem l ON l.l_orderkey=o.o_orderkey JOIN supplier s ON s.s_suppkey=l.l_suppkey JOIN nation a ON a.n_nationkey=c.c_nationkey JOIN nation b ON b.n_nationkey=s.s_nationkey WHERE a.n_nationkey<>b.n_nationkey GROUP BY least(a.n_name,b.n_name), greatest(a.n_name,b.n_name)"),
    "trace_vertices": (("orders",), "SELECT o_custkey AS trace_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS seq, CAST(o_orderkey % 1000 AS DOUBLE) AS X, o_totalprice/1000.0 AS Y FROM orders"),
    "log_records": (("events",), "SELECT event_id AS id, ts, user_id AS run_id, event_type AS stage, value AS duration_s FROM events"),
    "fault_lines": (("supplier",), "SELECT s_suppkey + 1 AS id, s_name AS name, (s_suppkey * 37) % 1000 + 0.0 AS ax, (s_suppkey * 61) % 1000 + 0.0 AS ay, (s_suppkey * 37) % 1000 + (s_suppkey * 13) % 60 - 30.5 AS bx, (s_suppkey * 61) % 1000 + (s_suppkey * 29) % 70 - 35.5 AS by_, s_nationkey AS system, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE -1.0 END AS displacement FROM supplier"),
    "map_units": (("nation",), "SELECT n_name AS unit, n_nationkey AS rank, (n_nationkey % 5) * 200.0 AS x0, CAST(floor(n_nationkey / 5) AS INT) * 200.0 AS y0, (n_nationkey % 5) * 200.0 + 200.0 AS x1, CAST(floor(n_nationkey / 5) AS INT) * 200.0 + 200.0 AS y1, n_nationkey % 7 = 3 AS intrusive FROM nation"),
    "contacts": (("lineitem", "nation"), "SELECT l_orderkey*10 + l_linenumber AS cid, l_quantity + 0.0 AS X, l_extendedprice/2000.0 AS Y, l_discount*500.0 + 0.0 AS Z, n_name AS name FROM lineitem JOIN nation ON n_nationkey = l_suppkey % 25"),
    "map_text": (("documents", "labels"), "SELECT d.doc_id AS ID, d.source AS unit, d.text AS description, q.quality, q.toxic FROM documents d LEFT JOIN labels q ON q.doc_id=d.doc_id"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables of `sf_dir`; names are bound to this statement only, not to the session."""
    tables, statement = VIEWS[name]
    frames = {t: table(spark, sf_dir, t) for t in tables}
    for t in tables:  # braces name DataFrames in the statement
        statement = statement.replace(f" {t} ", f" {{{t}}} ") if f" {t} " in statement else statement
        if statement.endswith(f" {t}"):
            statement = statement[: -len(t)] + f"{{{t}}}"
    return spark.sql(statement, **frames)


def with_views(names: str, statement: str) -> str:
    """The statement with the views it needs in front, for DuckDB."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in names.split())
    if statement.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {statement[15:]}"
    return f"WITH {ctes}, {statement[5:]}" if statement.startswith("WITH ") else f"WITH {ctes} {statement}"
