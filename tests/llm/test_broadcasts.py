"""Tables that Spark sizes too low are not gathered on the driver."""

from pyspark.sql import functions as F

from quizweave.llm import near_dups


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_signatures_are_not_broadcast(spark, tmp_path):
    signature = F.transform(F.sequence(F.lit(0), F.lit(near_dups.N - 1)), lambda i: (F.col("id") % 7 + i).cast("int"))
    spark.range(200).select(F.col("id").alias("node"), signature.alias("signature")).write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    postings = near_dups.prefix_postings(nodes, 30)
    assert "BroadcastHashJoin" not in plan_of(postings) and "SortMergeJoin" in plan_of(postings)
    assert postings.count() == 200 * (near_dups.N - 30 + 1)


def test_postings_are_not_broadcast(spark, tmp_path):
    rows = [(key, node, 5 + node % 3, 9, 1.0, 0, node % 2, 1 - node % 2, node // 2) for key in range(4) for node in range(6)]
    postings = spark.createDataFrame(rows, "key long, node long, n long, most long, weight double, band long, small int, large int, component long")
    parts = near_dups.open_parts(postings)
    for df in (near_dups.head_pairs(postings, 0), near_dups.between_components(postings, parts, 50)):
        assert "BroadcastHashJoin" not in plan_of(df) and df.count()
