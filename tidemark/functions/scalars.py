"""Scalar expressions: dirty dates, numbers, floors, flags and distances.

All are JVM expressions and none throws under ANSI mode: what cannot be read
is null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

M2_PER_PING = 3.305785
# Spellings of a missing value.
MISSING = ("", "--", "NaN", "nan", "None", "none", "NULL", "null", "<NA>")
_WIDE, _NARROW = "０１２３４５６７８９", "0123456789"


def strip(x: Column) -> Column:
    """Trim ASCII and Unicode white space, U+3000 among it."""
    return F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def clean_text(x: Column) -> Column:
    s = strip(x)
    return F.when(~s.isin(*MISSING), s)


def clean_number(x: Column) -> Column:
    """Double from text with separators and padding."""
    s = F.translate(F.translate(strip(x), ",，　 ", ""), _WIDE, _NARROW)
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``x``, which is computed once however often it is used: written
    out, expressions that use one another several times grow as powers."""
    return F.element_at(F.transform(F.array(x), use), 1)


def era_date(x: Column) -> Column:
    """Date from calendar-era digits: YYMMDD or YYYMMDD, year 1 = 1912."""

    def shorter(digits: Column) -> Column:
        return F.when((F.length(digits) > 7) & digits.startswith("0"), F.regexp_replace(digits, "^0+", "")).otherwise(digits)

    def day(digits: Column) -> Column:
        size = F.length(digits)
        year = F.when(size == 6, F.substring(digits, 1, 2)).when(size == 7, F.substring(digits, 1, 3)).try_cast("int")
        ymd = F.concat(F.lpad((year + 1911).cast("string"), 4, "0"), F.lit("-"), F.substring(digits, -4, 2), F.lit("-"), F.substring(digits, -2, 2))
        return F.when(year > 0, F.try_to_date(ymd, "yyyy-MM-dd"))

    digits = lambda s: F.regexp_replace(F.translate(F.regexp_replace(F.translate(s, ", ", ""), r"\.0+$", ""), _WIDE, _NARROW), r"[^0-9]", "")
    return let(strip(x), lambda s: F.when(~F.lower(s).isin("", "0", "--", "nan", "none", "null", "<na>"), let(let(digits(s), shorter), day)))


_NUMERALS = {"零": 0, "〇": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def numeral(x: Column) -> Column:
    """Double from digits, or from numerals with tens and hundreds; a part of
    several numerals counts as none, and a total of 0 is null."""
    values = F.create_map(*[F.lit(v) for pair in _NUMERALS.items() for v in pair])

    def worth(part: Column, absent: int) -> Column:
        return F.coalesce(F.try_element_at(values, part), F.lit(absent))

    def below_hundred(rest: Column) -> Column:
        tens = F.instr(rest, "十") > 0
        ten, one = F.regexp_extract(rest, "^([^十]*)十", 1), F.when(tens, F.regexp_extract(rest, "^[^十]*十(.*)$", 1)).otherwise(rest)
        return F.when(tens, worth(ten, 1) * 10).otherwise(0) + worth(one, 0)

    def worded(kept: Column) -> Column:
        hundreds = F.instr(kept, "百") > 0
        head = F.when(hundreds, F.regexp_extract(kept, "^([^百]*)百", 1))
        rest = F.when(hundreds, F.regexp_extract(kept, "^[^百]*百(.*)$", 1)).otherwise(kept)
        total = F.when(hundreds, worth(head, 1) * 100).otherwise(0) + let(rest, below_hundred)
        return let(total, lambda n: F.when((kept != "") & (n != 0), n.cast("double")))

    def read(text: Column) -> Column:
        digits = F.regexp_extract(F.translate(text, _WIDE, _NARROW), r"-?[0-9]+", 0)
        words = F.regexp_replace(text, "[^零〇一二兩三四五六七八九十百]", "")
        return let(digits, lambda d: F.when(d != "", d.try_cast("double")).otherwise(let(words, worded)))

    return let(x, read)


def floor_number(x: Column) -> Column:
    """Floor of a transfer text: first part of a list, negative underground."""

    def number(first: Column) -> Column:
        below = first.startswith("地下")
        text = F.when(below, F.substring(first, 3, 1 << 30)).otherwise(first)
        return let(numeral(strip(F.translate(text, "第層樓", ""))), lambda value: F.when(below, -value).otherwise(value))

    first = lambda s: strip(F.element_at(F.split(s, "[，,、]"), 1))
    return let(strip(x), lambda s: F.when((s != "") & (s != "全") & ~s.contains("見其他登記事項"), let(first(s), number)))


def yes_no(x: Column) -> Column:
    s = strip(x)
    return F.when(s == "有", 1).when(s == "無", 0)


def contains_any(x: Column, words) -> Column:
    """0/1: a substring match of any word; null counts as no text."""
    text = F.coalesce(x, F.lit(""))
    return reduce(or_, [text.contains(w) for w in words])


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def age_years(completed: Column, traded: Column) -> Column:
    return F.when(completed <= traded, F.datediff(traded, completed) / 365.25)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def change(now: Column, before: Column) -> Column:
    """now / before - 1; null unless both are known and before is positive."""
    return F.when(before > 0, now / before - 1)


def year_quarter(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def segment(x: Column, edges, labels, otherwise: str = "missing") -> Column:
    """Half-open bins [edge, next edge), the last without an end."""
    out = F.lit(otherwise)
    for low, label in zip(edges, labels):
        out = F.when(x >= low, F.lit(label)).otherwise(out)
    return out


def similarity_distance(area, other_area, age, other_age, days, window, floor, other_floor, parking, other_parking) -> Column:
    """Weighted distance of two sales; a component with a missing side is 0.5,
    and missing parking differs from anything."""
    half = F.lit(0.5)
    by_area = F.abs(other_area - area) / F.greatest(area, F.lit(1.0))
    by_area = F.when(area.isNotNull() & other_area.isNotNull(), by_area).otherwise(half)
    by_age = F.coalesce(F.abs(other_age - age) / 50.0, half)
    by_floor = F.coalesce(F.abs(other_floor - floor), half)
    by_parking = F.when(parking == other_parking, 0.0).otherwise(1.0)
    return 0.35 * by_area + 0.25 * by_age + 0.20 * (days / F.lit(float(window))) + 0.10 * by_floor + 0.10 * by_parking


def cosine(a: Column, b: Column, epsilon: float = 1e-6) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(epsilon))


def labelled_text(fields: dict[str, Column], missing: str = "缺失") -> Column:
    """One "label: value" line per field, in order."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit(missing))) for label, value in fields.items()])


def two_places(x: Column) -> Column:
    return F.format_string("%.2f", x)


def present(x: Column) -> Column:
    """有 or 無 of a number; null stays."""
    return F.when(x > 0, "有").when(x.isNotNull(), "無")


def sale_text(address: bool = False, note: bool = False, missing: str = "缺失", body: Column | None = None) -> Column:
    """A sale as sixteen labelled lines, and with address and note if asked.
    ``body`` are the sixteen lines if they are there already.
    Fixed values: the labels, units and places of the lines."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(missing))
    number = lambda name, places: F.when(F.col(name).isNotNull(), F.format_string(f"%.{places}f", F.col(name).cast("double"))).otherwise(missing)
    two, whole = (lambda name: number(name, 2)), (lambda name: number(name, 0))
    there = lambda name: F.coalesce(present(F.col(name)), F.lit(missing))
    s = F.lit
    lines = [
        ("行政區", text("district")), ("建物型態", text("building_type")), ("主要建材", text("material")), ("屋齡", F.concat(two("building_age"), s(" 年"))),
        ("建物坪數", F.concat(two("building_area_ping"), s(" 坪"))), ("主建物坪數", F.concat(two("main_building_area_ping"), s(" 坪"))),
        ("樓層", F.concat(whole("floor"), s(" / "), whole("total_floor"))), ("樓層比例", two("floor_ratio")),
        ("格局", F.concat(whole("rooms"), s(" 房 "), whole("living_rooms"), s(" 廳 "), whole("bathrooms"), s(" 衛"))),
        ("車位", there("has_parking")), ("車位面積", two("parking_area_m2")), ("管理組織", there("has_management")), ("電梯", there("has_elevator")),
        ("房屋狀態備註標記", whole("physical_condition_flag")), ("裝潢標記", whole("renovation_flag")), ("廣泛備註標記", whole("broad_note_flag")),
    ]
    lines = lines if body is None else []
    lines += [("地址", text("address_raw"))] if address else []
    lines += [("備註", text("note_raw"))] if note else []
    return F.concat_ws("\n", *([] if body is None else [body]), *[F.concat(s(f"{label}："), value) for label, value in lines])
