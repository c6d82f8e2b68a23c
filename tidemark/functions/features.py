"""What a feature's name says: regex rules, the first that matches decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Groups of feature names.
GROUP_RULES = (
    ("comp_", "comparable_sales"),
    ("^district_(median_|type_|count_|price_)", "time_aware_market"),
    ("^(district|trade_)|trade_yq", "location_time"),
    ("physical_condition_flag|renovation_flag|broad_note_flag", "note_flags"),
    ("building_|auxiliary|balcony|land_area|floor|rooms|parking|has_|is_basement|main_use_missing", "basic_housing"),
)
COMPARABLE_RULES = tuple([("_count$", "count")] + [(n, n) for n in ("weighted_mean_price", "median_price", "mean_price", "std_price", "nearest_price", "distance", "days_diff", "area_diff", "age_diff")])


def first_rule(name: Column, rules, otherwise: str = "other") -> Column:
    out = F.lit(otherwise)
    for pattern, label in reversed(rules):
        out = F.when(name.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def feature_group(name: Column) -> Column:
    return first_rule(F.regexp_replace(F.regexp_replace(name, "^num__", ""), "^cat__", ""), GROUP_RULES)


def comparable_kind(name: Column) -> Column:
    return first_rule(name, COMPARABLE_RULES)
