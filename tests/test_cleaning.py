import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleaning as C
from tidemark.schema import nan_to_null, require_columns

RAW = ["鄉鎮市區", "交易標的", "土地位置建物門牌", "土地移轉總面積平方公尺", "交易年月日", "移轉層次", "總樓層數", "建物型態", "主要用途", "主要建材", "建築完成年月", "建物移轉總面積平方公尺", "建物現況格局-房", "建物現況格局-廳", "建物現況格局-衛", "有無管理組織", "總價元", "單價元平方公尺", "車位類別", "車位移轉總面積平方公尺", "車位總價元", "備註", "編號", "主建物面積", "附屬建物面積", "陽台面積", "電梯", "移轉編號"]
GOOD = {"鄉鎮市區": "大安區", "交易標的": "房地(土地+建物)", "交易年月日": "1120105", "移轉層次": "五層", "總樓層數": "十層", "建物型態": "住宅大樓", "主要用途": "住家用", "建築完成年月": "1000105", "建物移轉總面積平方公尺": "80", "建物現況格局-房": "3", "總價元": "10,000,000", "單價元平方公尺": "125000", "車位類別": "", "備註": "", "電梯": "有", "有無管理組織": "無"}


def raw(spark, *changes):
    rows = [tuple({**GOOD, "編號": f"id{i}", **c}.get(k, "") for k in RAW) + (c.get("source_order", 1), i) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, ", ".join(f"`{k}` string" for k in RAW) + ", source_order int, row_order int")


def test_invalid_rows(spark):
    df = raw(spark, {}, {"鄉鎮市區": "The district"}, {"鄉鎮市區": "鄉鎮市區"}, {"交易年月日": "", "總價元": "", "單價元平方公尺": "--"}, {"交易年月日": ""})
    assert [r["編號"] for r in C.drop_invalid(df).collect()] == ["id0", "id4"]


def test_flags(spark):
    notes = ["親友間交易", "增建未登記", "裝潢費", "包含其他", "預售屋買賣", "土地及建物分件登記", None]
    rows = C.derive_features(raw(spark, *[{"備註": n} for n in notes])).orderBy("row_order").collect()
    assert [r.abnormal_transaction_flag for r in rows] == [1, 0, 0, 0, 0, 0, 0]
    assert [r.physical_condition_flag for r in rows] == [0, 1, 0, 0, 0, 0, 0]
    assert [r.renovation_flag for r in rows] == [0, 0, 1, 0, 0, 0, 0]
    assert [r.broad_note_flag for r in rows] == [0, 0, 0, 1, 0, 0, 0]
    assert [r.presale_note_flag for r in rows] == [0, 0, 0, 0, 1, 0, 0]
    assert [r.separate_registration_flag for r in rows] == [0, 0, 0, 0, 0, 1, 0]
    assert [r.strict_special_note_flag for r in rows] == [1, 1, 1, 1, 0, 0, 0]
    one = rows[0]
    assert one.building_age == pytest.approx(4383 / 365.25) and one.floor_ratio == 0.5 and one.trade_yq == "2023Q1" and one.has_elevator == 1 and one.has_management == 0
    assert one.unit_price_ping == pytest.approx(125000 * 3.305785 / 10000)


def test_parking_and_outliers(spark):
    df = raw(spark, {"車位類別": "坡道平面"}, {"車位移轉總面積平方公尺": "10"}, {"車位總價元": "1"}, {"車位類別": "無"}, {"建物移轉總面積平方公尺": "5"}, {"建物移轉總面積平方公尺": "800"}, {"建物移轉總面積平方公尺": ""}, {"建物現況格局-房": "11"}, {"建物現況格局-廳": "6", "建物現況格局-房": ""})
    rows = C.derive_features(df).orderBy("row_order").collect()
    assert [r.has_parking for r in rows[:4]] == [1, 1, 1, 0]
    assert [r.area_outlier_flag for r in rows[3:7]] == [0, 1, 1, 0]
    assert [r.layout_outlier_flag for r in rows[6:]] == [0, 1, 1]


def test_dedup_by_id_and_fallback(spark):
    rows = raw(spark, {"編號": "x", "source_order": 1121, "總價元": "1"}, {"編號": "x", "source_order": 1122, "總價元": "2"}, {"編號": "", "source_order": 1}, {"編號": "--", "source_order": 2}, {"編號": "", "總價元": "7"})
    made = C.derive_features(rows)
    key = C.record_key(F.col("編號"), [F.col(k) for k in ("district", "address_raw", "交易年月日", "total_price", "building_area_m2")])
    kept = C.keep_last(made, key, [F.col("source_order"), F.col("row_order")])
    assert sorted(r.row_order for r in kept.collect()) == [1, 3, 4]


def test_chain_audit_and_variants(spark):
    changes = [{} for _ in range(200)] + [{"交易標的": "土地"}, {"主要用途": "商業用"}, {"主要用途": ""}, {"建物型態": "店面"}, {"交易年月日": ""}, {"總價元": "0"}, {"建築完成年月": "1130101"}, {"備註": "親友"}, {"備註": "預售屋"}, {"車位總價元": "9"}]
    df = C.derive_features(raw(spark, *changes))
    audit = C.filter_audit(df, C.clean_steps()).collect()
    assert [(a.rows_before, a.rows_removed) for a in audit] == [(210, 1), (209, 1), (208, 1), (207, 1), (206, 1), (205, 0)]
    assert C.filter_chain(df, C.clean_steps()).count() == 205
    counts = {k: C.build_dataset(raw(spark, *changes), **v).count() for k, v in {"default": {}, "no_parking": {"parking": "drop"}, "presale": {"with_presale": True}, "strict": {"notes": "strict"}}.items()}
    assert counts == {"default": 203, "no_parking": 202, "presale": 204, "strict": 203}
    with pytest.raises(ValueError):
        C.model_ready_steps(notes="other")


def test_trim_keeps_the_bounds(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    assert [r.x for r in C.quantile_trim(df, "x").agg(F.min("x").alias("x")).collect()] == [1.0]
    assert C.quantile_trim(df, "x").count() == 99 and C.quantile_trim(df.filter("false"), "x").count() == 0


def test_schema_helpers(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert [r.x for r in nan_to_null(df, "x").collect()] == [None, None, 1.0]
    with pytest.raises(ValueError, match="missing columns: y, z"):
        require_columns(df, ["x", "y", "z"])
