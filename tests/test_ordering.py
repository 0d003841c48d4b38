"""Order statistics and running totals against numpy and pandas, with hot values."""

import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import ordering as O


@pytest.fixture(scope="module")
def skewed(spark):
    # a third of all rows hold one value
    rng = np.random.default_rng(7)
    x = np.concatenate([np.full(700, 5.0), rng.normal(0, 100, 1399)])
    y = np.round(rng.exponential(3, 2099), 1)
    pdf = pd.DataFrame({"id": range(2099), "x": x, "y": y, "g": ["hot"] * 700 + [f"g{i % 40}" for i in range(1399)]})
    return pdf, spark.createDataFrame(pdf).repartition(8).cache()


@pytest.mark.parametrize("limit", [10_000, 300, 5])
def test_quantiles_match_numpy_whatever_the_limit(skewed, limit):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.987, 1.0]
    got = O.exact_quantiles(df, ["x", "y"], probs, pick_from=limit)
    for c in ("x", "y"):
        assert got[c] == pytest.approx(list(np.quantile(pdf[c], probs)), abs=1e-12)


def test_quantiles_skip_missing_and_handle_constants(spark):
    df = spark.sql("SELECT * FROM VALUES (1D, 2D, CAST(NULL AS DOUBLE)), (NULL, 2D, NULL), (double('NaN'), 2D, NULL), (4D, 2D, NULL) t(a, b, c)")
    got = O.exact_quantiles(df, ["a", "b", "c"], [0.25, 0.5], pick_from=1)
    assert got == {"a": [1.75, 2.5], "b": [2.0, 2.0], "c": [None, None]}
    assert O.exact_quantiles(df, ["a"], [0.5], approx=True)["a"][0] in (1.0, 4.0)


def test_running_totals(skewed):
    pdf, df = skewed
    ints = df.withColumn("n", (F.col("y") * 10).cast("long"))
    got = O.running_totals(ints, {"n": "upto"}, ["-x", "id"], by=["g"]).toPandas()
    pdf = pdf.assign(n=(pdf.y * 10).round().astype("int64")).sort_values(["g", "x", "id"], ascending=[True, False, True])
    want = pdf.assign(upto=pdf.groupby("g").n.cumsum()).set_index("id").upto
    assert got.set_index("id").upto.sort_index().tolist() == want.sort_index().tolist()
    total = O.running_totals(ints, {"n": "upto"}, ["x", "id"]).agg(F.max("upto")).first()[0]
    assert total == pdf.n.sum()


def test_mid_ranks_match_pandas_with_a_hot_value(skewed):
    pdf, df = skewed
    got = O.mid_ranks(df.select("x", "y"), ["x", "y"]).toPandas()
    want = pdf[["x", "y"]].rank()
    assert sorted(zip(got.x, got.y)) == sorted(zip(want.x, want.y))


def test_ranks_of_few_values_move_no_rows(skewed):
    _, df = skewed
    plan = O.mid_ranks(df.select("x", "y"), ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_ranks_sort_no_rows_in_windows(spark, monkeypatch):
    monkeypatch.setattr(O, "LOOK_UP", 20, raising=False)
    pdf = pd.DataFrame({"x": [float(i % 90) if i % 3 else 7.0 for i in range(2000)], "y": [None if i % 4 == 0 else -i / 8 for i in range(2000)]})
    df = spark.createDataFrame(pdf).select("x", F.when(~F.isnan("y"), F.col("y")).alias("y"))
    ranked = O.mid_ranks(df, ["x", "y"])
    assert "Window" not in ranked._jdf.queryExecution().executedPlan().toString()
    want = pdf.rank()
    key = lambda row: tuple(-1.0 if pd.isna(v) else v for v in row)
    assert sorted(map(key, ranked.collect())) == sorted(map(key, zip(want.x, want.y)))


def test_rows_at_ranks(skewed):
    pdf, df = skewed
    long = df.select(F.lit("m").alias("measure"), F.col("x").alias("v"), "id")
    got = O.rows_at_ranks(long, "measure", ["v", "id"], {"m": [1, 700, 2099]})["m"]
    want = pdf.sort_values(["x", "id"]).iloc[[0, 699, 2098]]
    assert [r["id"] for r in got] == want.id.tolist()


def test_facts_join_is_a_join(skewed):
    pdf, df = skewed
    right = df.select("g").distinct().withColumn("size", F.length("g"))
    got = O.join_facts(df, right, ["g"])
    assert got.count() == len(pdf)
    assert got.filter(F.col("size") != F.length("g")).count() == 0


def test_settled_tables_go_to_the_configured_folder(spark):
    assert O.shared_dir(spark).startswith("file:" + spark.conf.get("spark.checkpoint.dir")) or O.shared_dir(
        spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    back = O.settle(spark.range(5))
    assert back.inputFiles()[0].replace("file://", "").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_work_can_be_cleared(spark):
    back = O.settle(spark.range(3))
    assert O.clear_work(spark) >= 1
    with pytest.raises(Exception, match="."):
        back.count()


@pytest.mark.parametrize("pick_from", [1, 50, 400, 100_000])
def test_quantiles_from_two_scans_equal_a_sort(spark, pick_from):
    import random

    from ledgerlight.functions.ordering import quantiles_with

    rng = random.Random(pick_from)
    columns = {
        "a": [rng.gauss(0, 5) for _ in range(3000)], "ties": [float(rng.randint(0, 3)) for _ in range(3000)],
        "one": [7.0] * 3000, "few": [None if i % 100 else float(i) for i in range(3000)], "none": [None] * 3000,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(4)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got, rest = quantiles_with(df, list(columns), probs, [F.max("a"), F.count("*")], pick_from=pick_from)
    assert tuple(rest) == (max(columns["a"]), 3000)
    for c, values in columns.items():
        values = sorted(v for v in values if v is not None)
        for p, q in zip(probs, got[c]):
            at = (len(values) - 1) * p
            want = values[int(at)] + (values[min(int(at) + 1, len(values) - 1)] - values[int(at)]) * (at - int(at)) if values else None
            assert q == pytest.approx(want) if values else q is None


def test_settle_leaves_no_shuffle_files(spark):
    def files():
        env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
        return set(re.findall(r"shuffle_\d+", env.blockManager().diskBlockManager().getAllFiles().mkString(" ")))

    conf = spark.conf.get(O.DROP_SHUFFLES, None)
    before = files()
    rows = spark.range(20_000).groupBy((F.col("id") % 700).alias("k")).count().repartition(5, "k")
    settled = O.settle(rows)
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(O.DROP_SHUFFLES, None) == conf
    assert settled.count() == rows.count() == 700
