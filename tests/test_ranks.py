import random

from caddis.operators.ranks import positions, value_ranks


def test_average_ranks_and_positions(spark, rows):
    rng = random.Random(3)
    values = [None, float("nan")] + [float(rng.randrange(40)) for _ in range(300)] + [7.0] * 150
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    real = sorted(v for v in values if v is not None and v == v)
    want = {v: (real.index(v) + 1 + len(real) - real[::-1].index(v)) / 2 for v in real}
    both = value_ranks(df.withColumn("w", -df.v), ["v", "w"]).collect()
    assert {r["value"]: r["rank"] for r in both if r["column"] == "v"} == want
    assert {-r["value"]: len(real) + 1 - r["rank"] for r in both if r["column"] == "w"} == want
    placed = positions(df, "v", "id").orderBy("position").collect()
    assert [r["position"] for r in placed] == list(range(1, len(values) + 1))
    order = sorted(range(2, len(values)), key=lambda i: (-values[i], i)) + [0, 1]
    assert [r["id"] for r in placed] == order


def test_empty(spark):
    df = spark.createDataFrame([], "id int, v double")
    assert value_ranks(df, ["v"]).count() == 0 and positions(df, "v", "id").count() == 0


def test_ties_and_nulls_are_split_over_tasks(spark):
    df = spark.range(40_000).selectExpr("id", "if(id % 2 = 0, null, 1.0D) AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would go to one task
    placed = positions(df, "v", "id")
    assert placed.rdd.getNumPartitions() > 2
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = {r["id"]: r["position"] for r in placed.where("id IN (1, 39999, 0, 39998)").collect()}
    assert first == {1: 1, 39999: 20_000, 0: 20_001, 39998: 40_000}


def test_a_cluster_needs_a_shared_checkpoint_folder(spark):
    import pytest

    from caddis.session import ensure_checkpoint_dir

    class Context:
        master = "spark://x"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session)


def test_small_inputs_are_dealt_out(spark, tmp_path):
    from caddis.session import filled

    path = str(tmp_path / "t")
    spark.range(100).repartition(1).write.parquet(path)
    assert filled(spark.read.parquet(path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    grouped = spark.read.parquet(path).groupBy("id").count()
    assert filled(grouped) is grouped
