import datetime as dt

import pytest
from pyspark.sql import functions as F

import ledgerlight as L
from ledgerlight.operators.roles import role_by_name


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame(
        [("2024-01-01", "A", 10.0, 1), ("2024-01-02", None, None, 2), ("bad", "B", 30.0, 3), (None, "B", 500.0, None)],
        "when string, category string, sales double, n int")


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_profile_columns(gaps):
    got = by_column(L.profile_columns(gaps))
    assert (got["category"].null_count, got["category"].null_rate, got["category"].unique_count) == (1, 0.25, 2)
    assert (got["n"].dtype, got["n"].row_count) == ("int", 4)
    assert by_column(L.profile_columns(gaps, approx=True))["sales"].unique_count == 3


def test_distinct_values_of_every_type(spark):
    df = spark.sql("""SELECT * FROM VALUES
      (0.0D, 'a', date'2024-01-01', timestamp'2024-01-01 00:00:00', array(1, 2), repeat('x', 500), true, 1.10),
      (-0.0D, 'A', date'2024-01-02', timestamp'2024-01-01 00:00:00.000001', array(1, 2), repeat('x', 501), true, 1.1),
      (double('NaN'), NULL, date'2024-01-02', NULL, NULL, repeat('x', 500), false, 2.25)
      t(d, s, day, at, arr, long, flag, dec)""")
    got = {c: (r.null_count, r.unique_count) for c, r in by_column(L.profile_columns(df)).items()}
    assert got == {"d": (1, 1), "s": (1, 2), "day": (0, 2), "at": (1, 2), "arr": (1, 1), "long": (0, 2), "flag": (0, 2),
                   "dec": (0, 2)}
    empty = by_column(L.profile_columns(df.limit(0)))
    assert (empty["s"].row_count, empty["s"].unique_count, empty["s"].null_rate) == (0, 0, None)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), "y"), (None, "z")], "v double, t string")
    assert by_column(L.profile_columns(df))["v"].null_count == 2
    r = L.profile_numeric(df, ["v"]).first()
    assert (r["count"], r["mean"], r.median, r.std, r.skew) == (1, 1.0, 1.0, None, None)


def test_profile_numeric_by_hand(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 3.0)], "v double")
    r = L.profile_numeric(df, ["v"]).first()
    assert (r.q1, r.median, r.q3, r.zero_rate, r.skew) == (0.75, 1.5, 2.25, 0.25, 0.0)
    assert r.std == pytest.approx((5 / 3) ** 0.5)
    three = L.profile_numeric(df.filter("v < 3"), ["v"]).first()
    assert three.skew is None


def test_profile_dates_needs_more_than_half(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "2024-01-01", dt.datetime(2024, 1, 1, 12)), ("2024-01-02", "x", dt.datetime(2024, 1, 3, 11)),
         ("2024-01-03", "y", None), ("oops", "2024-01-09", None)], "a string, b string, t timestamp")
    got = by_column(L.profile_dates(df))
    assert set(got) == {"a", "t"}
    assert (got["a"].time_span_days, got["a"].is_continuous) == (2, True)
    # the span is one day and 23 hours
    assert (got["t"].time_span_days, got["t"].distinct_days, got["t"].is_continuous) == (1, 2, True)


def test_profile_text_ties(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "b", "a", "a", "ccc", "d", "e", "f", None]], "v string")
    r = L.profile_text(df).first()
    assert [(t["value"], t["count"]) for t in r.top_values] == [("a", 2), ("b", 2), ("ccc", 1), ("d", 1), ("e", 1)]
    assert r.avg_length == pytest.approx(10 / 8)


def test_desc_overview(gaps):
    r = L.desc_overview(gaps).first()
    assert (r.row_count, r.col_count, r.numeric_col_count, r.overall_null_rate) == (4, 4, 2, 0.25)


def test_duplicates_count_all_copies(spark):
    df = spark.createDataFrame([(1, 3), (1, 3), (2, 4)], "a long, b long")
    assert L.find_duplicates(df).first().duplicate_rows == 2
    assert L.find_duplicates(df.distinct()).first().duplicate_rows == 0


def test_duplicates_with_nulls_and_hot_copies(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), ("x", None), ("y", None)] + [("hot", "hot")] * 50, "a string, b string")
    marked = L.mark_duplicates(df)
    assert marked.count() == df.count()
    assert {(r.a, r.b): r.is_duplicate for r in marked.distinct().collect()} == {
        (None, "x"): True, ("x", None): False, ("y", None): False, ("hot", "hot"): True}


def test_fills(gaps, spark):
    filled = L.fill_mode(L.fill_median(gaps, ["sales", "n"]), ["category"])
    assert [(r.category, r.sales, r.n) for r in filled.orderBy("sales", "n").collect()] == [
        ("A", 10.0, 1.0), ("B", 30.0, 2.0), ("B", 30.0, 3.0), ("B", 500.0, 2.0)]
    tie = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert sorted(r.c for r in L.fill_mode(tie, ["c"]).collect()) == ["a", "a", "b"]
    empty = spark.createDataFrame([(None, None)], "c string, m double")
    assert tuple(L.fill_mode(L.fill_median(empty, ["m"]), ["c"]).first()) == (None, None)


ROLES = {"when": "date", "category": "category", "sales": "revenue", "n": "ignore"}


def test_clean_keeps_every_row(gaps):
    got = L.clean(gaps, ROLES, mark=True)
    assert got.count() == 4
    assert {"is_duplicate", "sales_outlier"} <= set(got.columns)
    assert dict(got.dtypes)["when"] == "timestamp_ntz"
    assert got.filter("when is null").count() == 2
    assert got.filter("n is null").count() == 1


def test_cleaning_log_and_score(gaps):
    log = {(r["column"], r.action): r.affected_rows for r in L.cleaning_log(gaps, ROLES).collect()}
    # filled sales are 10, 30, 30, 500: fences -151.25 and 323.75
    assert log == {("when", "type_converted"): 4, ("sales", "filled_na"): 1, ("sales", "marked_outlier"): 1,
                   ("category", "filled_na"): 1}
    r = L.quality_score(gaps, ROLES).first()
    # four columns with 25 % missing, one with 25 % outliers
    assert (r.score, r.high_null_columns, r.high_outlier_columns, r.duplicate_rows) == (55, 4, 1, 0)


def test_unparsed_dates_are_counted_apart(gaps):
    assert [tuple(r) for r in L.unparsed_dates(gaps, ROLES).collect()] == [("when", 3, 1, pytest.approx(1 / 3))]
    assert L.unparsed_dates(gaps, {"sales": "revenue"}).count() == 0


def test_cleaning_log_names_texts_that_are_no_date(gaps):
    log = {(r["column"], r.action): r.affected_rows for r in L.cleaning_log(gaps, ROLES, unparsed=True).collect()}
    assert log == {("when", "type_converted"): 4, ("when", "unparsed_date"): 1, ("sales", "filled_na"): 1,
                   ("sales", "marked_outlier"): 1, ("category", "filled_na"): 1}
    assert L.cleaning_log(gaps, {"sales": "revenue"}, unparsed=True).filter("action = 'unparsed_date'").count() == 0


def test_score_is_clamped_and_truncates(spark):
    wide = spark.createDataFrame([tuple([None] * 12), tuple([None] * 11 + [1.0])], ", ".join(f"c{i} double" for i in range(12)))
    assert L.quality_score(wide, {"c0": "ignore"}).first().score == 0
    df = spark.createDataFrame([(i,) for i in range(98)] + [(0,)], "a int").withColumn("b", F.lit(1))
    # 2 of 99 rows are copies: 1.01 points, truncated to 1
    assert L.quality_score(df, {"a": "ignore"}).first().score == 99


@pytest.mark.parametrize("name,role", [
    ("下单日期", "date"), ("Update", "date"), ("销售额", "revenue"), ("Sales_Amount", "revenue"), ("discount", "quantity"),
    ("country", "quantity"), ("o_totalprice", "unit_price"), ("产品分类", "product_name"), ("产品ID", "product_name"),
    ("customer_name", "product_name"), ("sku", "product_name"), ("客户", "customer_name"), ("区域", "region"),
    ("渠道", "channel"), ("毛利", "profit"), ("成本", "cost"), ("品类", "category"), ("item_id", "product_id"), ("x1", None),
])
def test_role_words(spark, name, role):
    assert spark.range(1).select(role_by_name(F.lit(name)).alias("r")).first().r == role


def test_roles_fall_back_to_the_data(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "t", True), (2, "2024-02-01", "u", False)], "x1 int, made string, note string, flag boolean")
    got = {r["column"]: (r.role, r.confidence) for r in L.infer_roles(df).collect()}
    assert got == {"x1": ("metric", 0.5), "made": ("date", 0.7), "note": ("ignore", 0.3), "flag": ("ignore", 0.3)}
    assert [r["column"] for r in L.role_ambiguity(L.infer_roles(df)).collect()] == ["x1", "note", "flag"]


def test_hints_are_the_only_roles(gaps):
    got = L.infer_roles(gaps, {"n": "customer_id", "gone": "date"}).collect()
    assert [(r["column"], r.role, r.confidence) for r in got] == [("n", "customer_id", 1.0)]
    with pytest.raises(ValueError, match="unknown role"):
        L.infer_roles(gaps, {"n": "nonsense"})


def test_roles_of_a_whole_catalog(spark):
    columns = spark.createDataFrame(
        [("t1", "date", False, False), ("t1", "v", True, False), ("t2", "seen", False, True)],
        "table string, column string, is_number boolean, is_date boolean")
    got = {(r.table, r["column"]): r.role for r in L.assign_roles(columns).collect()}
    assert got == {("t1", "date"): "date", ("t1", "v"): "metric", ("t2", "seen"): "date"}


def test_quick_summary_and_samples(gaps):
    r = L.quick_summary(gaps).first()
    assert (r.row_count, r.col_count, r.has_date, r.has_numeric, r.numeric_columns) == (4, 4, False, True, 2)
    assert [x.value for x in L.sample_values(gaps, "sales", 2, ["n"]).collect()] == [500.0, 10.0]
    assert L.sample_rows(gaps, 3).count() == 3


def test_mode_compares_numbers_as_numbers(spark):
    df = spark.createDataFrame([(10, "b"), (9, "b"), (None, "a"), (None, None)], "n int, t string")
    got = L.fill_mode(df, ["n", "t"]).collect()
    assert [(r.n, r.t) for r in got] == [(10, "b"), (9, "b"), (9, "a"), (9, "b")]
    assert dict(L.fill_mode(df, ["n"]).dtypes)["n"] == "int"


def test_quick_summary_shows_rows_in_an_order(gaps):
    import json

    r = L.quick_summary(gaps, ROLES, order_by=["-sales"], samples=2).first()
    assert [json.loads(x).get("sales") for x in r.sample_rows] == [500.0, 30.0]
    assert "sample_rows" not in L.quick_summary(gaps, ROLES).columns
    assert L.quick_summary(gaps.limit(0), ROLES, order_by=["n"]).first().sample_rows == []


def test_scans_for_dates_do_not_grow_with_columns(spark, tmp_path):
    rows = [(f"{d:02d}/0{m}/2024", f"0{m}/{d:02d}/2024", "x", None) for d, m in ((1, 2), (13, 3), (30, 4))]
    for k in (1, 4):
        names = [f"{n}{i}" for i in range(k) for n in ("dm", "md", "t", "none")]
        spark.createDataFrame([r * k for r in rows], ", ".join(f"{n} string" for n in names)).write.parquet(str(tmp_path / str(k)))
    plans = []
    for k in (1, 4):
        got = L.profile_dates(spark.read.parquet(str(tmp_path / str(k))))
        assert {r["column"]: (str(r["first"])[:10], str(r["last"])[:10]) for r in got.collect()} == {
            f"{n}{i}": ("2024-02-01", "2024-04-30") for i in range(k) for n in ("dm", "md")}
        plans.append(got._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
    assert plans[0] == plans[1] <= 3


def test_stored_profile_reads_new_partitions_only(spark, tmp_path):
    import random
    import statistics

    rng = random.Random(3)
    rows = [(k, rng.gauss(10 * k, 3) if rng.random() > 0.1 else None, f"t{rng.randint(0, 4000)}", None) for k in (1, 2, 3) for _ in range(4000)]
    at, store = str(tmp_path / "table"), str(tmp_path / "store")
    write = lambda part: spark.createDataFrame(part, "k int, x double, t string, none double").write.mode("append").partitionBy("k").parquet(at)
    write([r for r in rows if r[0] < 3])
    assert L.update_profile(spark.read.parquet(at), store, "k") == 2
    # what is known is not read again: its files are no Parquet any more
    for file in (tmp_path / "table").glob("k=[12]/*.parquet"):
        file.write_bytes(b"gone")
        (file.parent / f".{file.name}.crc").unlink()
    write([r for r in rows if r[0] == 3])
    read = lambda: spark.read.schema("x double, t string, none double, k int").parquet(at)
    assert L.update_profile(read(), store, "k") == 1
    assert L.update_profile(read(), store, "k") == 0 and L.stored_parts(spark, store) == ["1", "2", "3"]
    got = by_column(L.stored_profile(spark, store))
    x = sorted(r[1] for r in rows if r[1] is not None)
    assert (got["x"].row_count, got["x"].null_count) == (12_000, 12_000 - len(x))
    assert got["x"].mean == pytest.approx(statistics.fmean(x)) and got["x"].std == pytest.approx(statistics.stdev(x))
    for p, q in ((0.25, got["x"].q1), (0.5, got["x"].median), (0.75, got["x"].q3)):
        assert abs(sum(v <= q for v in x) / len(x) - p) <= 0.01
    assert (got["x"].min, got["x"].max) == (x[0], x[-1])
    assert abs(got["t"].unique_count - len({r[2] for r in rows})) <= 0.02 * 4000 and got["t"]["mean"] is None
    assert got["none"].null_rate == 1 and got["none"].unique_count == 0 and got["none"].median is None
