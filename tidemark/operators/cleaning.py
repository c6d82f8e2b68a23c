"""Cleaning: invalid rows, keep-last deduplication, audited filter chains,
quantile trims and model-ready variants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.ordering import quantiles

# What the housing data calls things.
RESIDENTIAL_TYPES = ("住宅大樓", "華廈", "公寓", "套房", "透天厝")
MODEL_TYPES = ("住宅大樓", "華廈", "公寓", "套房")
OTHER_USES = ("商業用", "工業用", "辦公室", "店鋪", "廠房")
STRICT_WORDS = ("親友", "關係人", "特殊", "急買急賣", "拍賣", "瑕疵", "債權", "共有", "增建", "未登記", "包含", "其他", "畸零", "協議", "讓與", "持分", "毛胚", "裝潢", "夾層", "加蓋")
ABNORMAL_WORDS = ("親友", "關係人", "急買急賣", "拍賣", "債權", "協議", "讓與", "瑕疵", "畸零", "持分")
PHYSICAL_WORDS = ("增建", "未登記", "加蓋", "夾層", "毛胚")
RENOVATION_WORDS = ("裝潢",)
BROAD_WORDS = ("包含", "其他")
PRESALE_WORDS = ("預售屋買賣", "預售屋", "預售")
SEPARATE_WORDS = ("土地及建物分件登記", "分件登記", "分件")


@dataclass(frozen=True)
class Step:
    name: str
    keep: Column
    description: str = ""


def filter_chain(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Rows that pass every step; a null condition fails."""
    for step in steps:
        df = df.filter(F.coalesce(step.keep, F.lit(False)))
    return df


def filter_audit(df: DataFrame, steps: list[Step]) -> DataFrame:
    """(step, rows_before, rows_after, rows_removed, description): what each
    step of the chain removes, counted in one pass over ``df``."""
    passed, counts = F.lit(True), [F.count("*").alias("_0")]
    for i, step in enumerate(steps, 1):
        passed = passed & F.coalesce(step.keep, F.lit(False))
        counts.append(F.count_if(passed).alias(f"_{i}"))
    one = df.agg(*counts)
    rows = [F.struct(F.lit(i).alias("n"), F.lit(s.name).alias("step"), F.col(f"_{i - 1}").alias("rows_before"), F.col(f"_{i}").alias("rows_after"), (F.col(f"_{i - 1}") - F.col(f"_{i}")).alias("rows_removed"), F.lit(s.description).alias("description")) for i, s in enumerate(steps, 1)]
    return one.select(F.inline(F.array(*rows))).orderBy("n").drop("n")


def quantile_trim(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows between two exact, linearly interpolated quantiles, both inclusive.
    The bounds are found by counting, and are one row whatever the size."""
    bounds = quantiles(df, column, [low, high])
    return df.crossJoin(F.broadcast(bounds)).filter(F.col(column).between(F.col("q0"), F.col("q1"))).drop("q0", "q1")


def keep_last(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The last row of each key in the given order (complete, so that it is
    the same in every run); null keys are a key."""
    w = Window.partitionBy(key).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def record_key(id_col: Column, fallback: list[Column]) -> Column:
    """The id where there is one, else the fallback columns together."""
    known = S.clean_text(id_col)
    other = F.concat_ws("|", F.lit("k"), *[F.coalesce(c.cast("string"), F.lit("<NA>")) for c in fallback])
    return F.when(known.isNotNull(), F.concat(F.lit("i|"), known)).otherwise(other)


def not_flagged(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) != 1


# ---- the housing preset -------------------------------------------------------------------------------------


def drop_invalid(raw: DataFrame) -> DataFrame:
    """Rows that are headers, hold Latin words in key columns, or have neither
    date nor prices go."""
    keys = ["鄉鎮市區", "交易標的", "交易年月日", "總價元", "單價元平方公尺"]
    text = F.concat_ws(" ", *[F.coalesce(F.col(k), F.lit("")) for k in keys])
    header = (S.strip(F.col("鄉鎮市區")) == "鄉鎮市區") | (S.strip(F.col("交易年月日")) == "交易年月日")
    empty = S.era_date(F.col("交易年月日")).isNull() & S.clean_number(F.col("總價元")).isNull() & S.clean_number(F.col("單價元平方公尺")).isNull()
    return raw.filter(~(text.rlike("[A-Za-z]{3,}") | F.coalesce(header, F.lit(False)) | empty))


def derive_features(raw: DataFrame) -> DataFrame:
    """Typed columns and flags of the raw table; raw columns stay."""
    c, number = F.col, lambda name: S.clean_number(F.col(name))
    out = raw.withColumns({
        "trade_date": S.era_date(c("交易年月日")), "completion_date": S.era_date(c("建築完成年月")),
        "total_price": number("總價元"), "unit_price_m2": number("單價元平方公尺"), "building_area_m2": number("建物移轉總面積平方公尺"),
        "main_building_area_m2": number("主建物面積"), "auxiliary_area_m2": number("附屬建物面積"), "balcony_area_m2": number("陽台面積"), "land_area_m2": number("土地移轉總面積平方公尺"),
        "rooms": number("建物現況格局-房"), "living_rooms": number("建物現況格局-廳"), "bathrooms": number("建物現況格局-衛"),
        "parking_area_m2": number("車位移轉總面積平方公尺"), "parking_price": number("車位總價元"),
        "floor": S.floor_number(c("移轉層次")), "total_floor": S.floor_number(c("總樓層數")),
        "district": S.clean_text(c("鄉鎮市區")), "building_type": S.clean_text(c("建物型態")), "main_use": S.clean_text(c("主要用途")), "material": S.clean_text(c("主要建材")),
        "address_raw": S.clean_text(c("土地位置建物門牌")), "note_raw": S.clean_text(c("備註")), "id": S.clean_text(c("編號")), "transfer_id": S.clean_text(c("移轉編號")),
        "has_management": S.yes_no(c("有無管理組織")), "has_elevator": S.yes_no(c("電梯")),
    })
    parking = F.coalesce(S.strip(c("車位類別")), F.lit(""))
    notes = F.concat_ws(" ", F.coalesce("note_raw", F.lit("")), F.coalesce("備註", F.lit("")))
    flags = {"abnormal_transaction_flag": ABNORMAL_WORDS, "physical_condition_flag": PHYSICAL_WORDS, "renovation_flag": RENOVATION_WORDS, "broad_note_flag": BROAD_WORDS, "strict_special_note_flag": STRICT_WORDS, "special_note_flag": ABNORMAL_WORDS, "presale_note_flag": PRESALE_WORDS, "separate_registration_flag": SEPARATE_WORDS}
    return out.withColumns({
        "trade_year": F.year("trade_date"), "trade_month": F.month("trade_date"), "trade_quarter": F.quarter("trade_date"),
        "trade_ym": F.date_format("trade_date", "yyyy-MM"), "trade_yq": S.year_quarter(c("trade_date")),
        "building_age": S.age_years(c("completion_date"), c("trade_date")),
        "building_area_ping": c("building_area_m2") / S.M2_PER_PING, "main_building_area_ping": c("main_building_area_m2") / S.M2_PER_PING,
        "unit_price_ping": c("unit_price_m2") * S.M2_PER_PING / 10000, "total_price_wan": c("total_price") / 10000,
        "floor_ratio": S.ratio(c("floor"), c("total_floor")), "is_basement": S.flag(c("floor") < 0),
        "multi_floor": F.coalesce(c("移轉層次"), F.lit("")).rlike("[，,、]").cast("int"),
        "has_parking": S.flag(~parking.isin("無", *S.MISSING) | (F.coalesce("parking_area_m2", F.lit(0.0)) > 0) | (F.coalesce("parking_price", F.lit(0.0)) > 0)),
        "main_use_missing": c("main_use").isNull().cast("int"),
        "area_outlier_flag": S.flag((c("building_area_m2") < 10) | (c("building_area_m2") > 600)),
        "layout_outlier_flag": S.flag(F.coalesce(c("rooms") > 10, F.lit(False)) | F.coalesce(c("living_rooms") > 5, F.lit(False)) | F.coalesce(c("bathrooms") > 5, F.lit(False))),
        **{name: S.contains_any(notes, words).cast("int") for name, words in flags.items()},
    }).withColumn("building_age_missing", c("building_age").isNull().cast("int"))


def clean_steps() -> list[Step]:
    use = F.coalesce("main_use", F.lit(""))
    return [
        Step("filter_transaction_target", F.contains(F.coalesce("交易標的", F.lit("")), F.lit("房地"))),
        Step("filter_main_use", (use == "") | (use.contains("住家用") & ~S.contains_any(use, OTHER_USES))),
        Step("filter_building_type", S.contains_any(F.col("building_type"), RESIDENTIAL_TYPES)),
        Step("filter_invalid_dates", F.col("trade_date").isNotNull()),
        Step("filter_invalid_price_area", (F.col("unit_price_m2") > 0) & (F.col("total_price") > 0) & (F.col("building_area_m2") > 0) & F.col("district").isNotNull() & F.col("building_type").isNotNull()),
        Step("filter_invalid_building_age", F.col("building_age").isNull() | F.col("building_age").between(0, 100)),
    ]


def model_ready_steps(parking: str = "keep", with_presale: bool = False, notes: str = "abnormal") -> list[Step]:
    if notes not in ("abnormal", "strict") or parking not in ("keep", "drop"):
        raise ValueError("notes must be abnormal or strict, parking must be keep or drop")
    steps = [Step("filter_notes", not_flagged("abnormal_transaction_flag" if notes == "abnormal" else "strict_special_note_flag")), Step("filter_model_types", S.contains_any(F.col("building_type"), MODEL_TYPES))]
    if parking == "drop":
        steps.append(Step("filter_parking", F.coalesce("has_parking", F.lit(0)) == 0))
    if not with_presale:
        steps += [Step("filter_presale", not_flagged("presale_note_flag")), Step("filter_separate_registration", not_flagged("separate_registration_flag"))]
    return [*steps, Step("filter_area_outlier", not_flagged("area_outlier_flag")), Step("filter_layout_outlier", not_flagged("layout_outlier_flag"))]


def build_dataset(raw: DataFrame, **variant) -> DataFrame:
    """Raw rows (with source_order and row_order) to a model-ready table."""
    rows = derive_features(drop_invalid(raw))
    key = record_key(F.col("編號"), [F.col(k) for k in ("district", "address_raw", "交易年月日", "total_price", "building_area_m2")])
    rows = keep_last(rows, key, [F.col("source_order"), F.col("row_order")])
    return filter_chain(quantile_trim(filter_chain(rows, clean_steps()), "unit_price_ping"), model_ready_steps(**variant))
