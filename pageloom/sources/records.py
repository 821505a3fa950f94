"""Plans, workloads and results as JSON lines, CSV and partitioned tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators.predicates import Leaf, Tree

WINDOWS = "window_id long, start_query_id long, end_query_id long, workload_label string, query_count long"
FAMILIES = "window_id long, candidates array<struct<candidate_id:string,layout_label:string,query_cost:double,movement_cost:double>>"


def write_rows(rows: DataFrame, path: str) -> None:
    """A JSON line a row."""
    rows.write.mode("overwrite").json(path)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema; a line that does not fit it is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_families(families: DataFrame, path: str) -> None:
    """A JSON line a window, with its candidates."""
    grouped = families.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("candidate_id", "layout_label", "query_cost", "movement_cost"))).alias("candidates"))
    write_rows(grouped, path)


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """(window_id, candidate_id, layout_label, query_cost, movement_cost)."""
    return read_rows(spark, path, FAMILIES).select("window_id", F.explode("candidates").alias("c")).select("window_id", "c.*")


def predicate_text(p: Leaf | Tree) -> str:
    """A predicate as JSON."""

    def plain(p: Leaf | Tree) -> dict:
        if isinstance(p, Leaf):
            return {"column": p.column, "kind": p.kind, "values": list(p.values)}
        return {"left": plain(p.left), "right": plain(p.right), "both": p.both}

    return json.dumps(plain(p))


def predicate_of(text: str) -> Leaf | Tree:
    def build(found: dict) -> Leaf | Tree:
        if "column" in found:
            return Leaf(found["column"], found["kind"], tuple(found["values"]))
        return Tree(build(found["left"]), build(found["right"]), found["both"])

    return build(json.loads(text))


def write_predicates(spark: SparkSession, workload: list[Leaf | Tree], path: str) -> None:
    """(query_id, predicate) as a table of JSON texts, in place of pickled objects."""
    spark.createDataFrame([(i, predicate_text(p)) for i, p in enumerate(workload)], "query_id long, predicate string").write.mode("overwrite").parquet(path)


def read_predicates(spark: SparkSession, path: str) -> list[Leaf | Tree]:
    """A workload, in order; it is as long as its list of queries."""
    return [predicate_of(r["predicate"]) for r in spark.read.parquet(path).orderBy("query_id").collect()]


def write_window_queries(queries: DataFrame, path: str) -> None:
    """(window_id, query_id, q) partitioned by window."""
    queries.repartition("window_id").write.mode("overwrite").partitionBy("window_id").parquet(path)


def write_results_csv(results: DataFrame, path: str) -> None:
    """(query_id, ids) of an experiment, with a header."""
    results.select("query_id", "ids").write.mode("overwrite").option("header", True).csv(path)


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    from pageloom.functions.text import id_list

    rows = spark.read.option("header", True).schema("query_id long, ids string").csv(path)
    return rows.select("query_id", id_list(F.col("ids")).alias("ids"))
