import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def values(spark, rows, expression, kind="string"):
    made = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[1] for r in made.select("i", expression(F.col("x"))).orderBy("i").collect()]


def test_era_dates(spark):
    rows = ["1071220", "1140703", "930501", "0930501", "", None, "--", "abc", "1141332", " 1,071,220 ", "1071220.0", "１０７１２２０", "10712", "0001231", "1130229", "1120229"]
    day = dt.date
    assert values(spark, rows, S.era_date) == [day(2018, 12, 20), day(2025, 7, 3), day(2004, 5, 1), day(2004, 5, 1), None, None, None, None, None, day(2018, 12, 20), day(2018, 12, 20), day(2018, 12, 20), None, None, day(2024, 2, 29), None]


def test_floors(spark):
    rows = ["一層", "十層", "十一層", "二十一層", "地下一層", "一層，二層", "全", None, "見其他登記事項", "一百零五層", "零層", "3樓", "地下2層", "夾層", "第五層", "一百二十層", "　七層"]
    assert values(spark, rows, S.floor_number) == [1, 10, 11, 21, -1, 1, None, None, None, 100, None, 3, -2, None, 5, 120, 7]


def test_numbers(spark):
    rows = ["1,234.5", "　12　", "，1，0", "--", "", None, "nan", "1d", "-3", "１２", "1e3", "abc", "NaN"]
    assert values(spark, rows, S.clean_number) == [1234.5, 12.0, 10.0, None, None, None, None, None, -3.0, 12.0, 1000.0, None, None]


def test_text_and_flags(spark):
    assert values(spark, [" a ", "　", "--", "NULL", None], S.clean_text) == ["a", None, None, None, None]
    assert values(spark, ["有", "無", "", None], S.yes_no) == [1, 0, None, None]
    assert values(spark, ["親友間交易", "a", None], lambda x: S.contains_any(x, ("親友", "拍賣"))) == [True, False, False]
    bins = lambda x: S.segment(x, (0, 50, 80, 120), ("a", "b", "c", "d"))
    assert values(spark, [-1.0, 0.0, 49.9, 50.0, 80.0, 120.0, None], bins, "double") == ["missing", "a", "a", "b", "c", "d", "missing"]


def test_change_and_distance(spark):
    rows = spark.createDataFrame([(200.0, 150.0), (120.0, 100.0), (1.0, None), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in rows.select(S.change(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), pytest.approx(0.2), None, None]
    none = F.lit(None).cast("double")
    d = S.similarity_distance(none, F.lit(1.0), none, F.lit(1.0), F.lit(73), 365, none, F.lit(1.0), none, none)
    assert spark.range(1).select(d).first()[0] == pytest.approx(0.35 * 0.5 + 0.25 * 0.5 + 0.2 * 0.2 + 0.05 + 0.1)
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert zero.select(S.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_labelled_text(spark):
    out = spark.range(1).select(S.labelled_text({"a": S.two_places(F.lit(1234.5)), "b": F.lit(None).cast("string")})).first()[0]
    assert out == "a: 1234.50\nb: 缺失"


def test_expressions_do_not_grow_as_powers(spark):
    """Parts that are used several times are in the plan once: floors and dates
    written out were too large for generated code."""
    df = spark.range(1).selectExpr("'地下一層' AS x")
    for made, most in ((S.floor_number(F.col("x")), 12), (S.era_date(F.col("x")), 8)):
        plan = df.select(made.alias("y"))._jdf.queryExecution().analyzed().toString()
        assert 0 < plan.count("regexp_") <= most
