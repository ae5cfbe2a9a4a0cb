"""Related nodes: edges are not gathered in few tasks, and classes of functions that are met several times are there once."""

from pyspark.sql import functions as F

from spandrel.operators import related

NODES = [("f", "FUNCTION", "a.ts"), ("g", "FUNCTION", "b.ts"), ("C", "CLASS", "b.ts")]
NODE, EDGE = "id string, type string, path string", "src string, dst string, type string"


def test_edges_stay_in_as_many_parts_as_are_shuffled(spark):
    nodes = spark.createDataFrame([(f"n{i}", "FUNCTION", "p") for i in range(40)], NODE)
    edges = spark.range(400).select(F.concat(F.lit("n"), F.col("id") % 40).alias("src"), F.concat(F.lit("n"), (F.col("id") * 7 + 1) % 40).alias("dst"), F.lit("CALLS").alias("type"))
    found = related.with_ends(edges, nodes).select("*", F.spark_partition_id().alias("part")).collect()
    assert len({r.part for r in found}) == 4
    assert len({(r.src, r.dst) for r in found}) == len(found) == edges.distinct().count()


def test_classes_of_functions_met_twice(spark):
    edges = [("f", "g", "CALLS"), ("g", "f", "CALLS"), ("f", "g", "CALLS"), ("C", "g", "HAS_METHOD"), ("f", "lost", "CALLS")]
    got = sorted(tuple(r) for r in related.related(spark.createDataFrame(NODES, NODE), spark.createDataFrame(edges, EDGE), "BOTH").where("start = 'f'").select("other", "edge_type", "hop").collect())
    assert got == [("C", "HAS_METHOD", 2), ("g", "CALLS", 1), ("g", "CALLS", 1)]
