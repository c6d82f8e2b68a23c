"""Feature contracts: which columns a model may read."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import load_json, save_json

# Columns that give the target away, or name a row.
FORBIDDEN = ("total_price", "total_price_wan", "unit_price_m2", "unit_price_ping", "parking_price", "id", "transfer_id", "address_raw", "note_raw", "trade_date", "source_release", "source_order", "source_file", "source_folder")

# Quality flags that go where they are zero throughout, and flags that inform.
REMOVABLE_FLAGS = ("abnormal_transaction_flag", "special_note_flag", "presale_note_flag", "separate_registration_flag", "layout_outlier_flag", "area_outlier_flag")
INFORMATIVE_FLAGS = ("physical_condition_flag", "renovation_flag", "broad_note_flag", "building_age_missing", "main_use_missing", "has_parking", "has_management", "has_elevator", "is_basement", "multi_floor")


@dataclass(frozen=True)
class Contract:
    target_col: str
    numeric_features: tuple[str, ...]
    categorical_features: tuple[str, ...] = ()
    drop_cols: tuple[str, ...] = ()
    leakage_cols: tuple[str, ...] = ()
    notes: tuple[str, ...] = ()

    def problems(self, forbidden=FORBIDDEN) -> list[str]:
        features = [*self.numeric_features, *self.categorical_features]
        bad = {self.target_col, *self.leakage_cols, *self.drop_cols, *forbidden}
        return [f"{c} is not a feature" for c in features if c in bad] + [f"{c} is named twice" for c in sorted(set(features)) if features.count(c) > 1]

    def check(self) -> Contract:
        if found := self.problems():
            raise ValueError("Leakage: " + "; ".join(found))
        return self

    def extend(self, features, note: str = "") -> Contract:
        """The next version: features appended once, a note added."""
        new = tuple(f for f in features if f not in self.numeric_features)
        return replace(self, numeric_features=self.numeric_features + new, notes=self.notes + ((note,) if note else ())).check()

    def substitute(self, prefix: str, features) -> Contract:
        """Features with the prefix give way to the given ones."""
        return replace(self, numeric_features=tuple(f for f in self.numeric_features if not f.startswith(prefix))).extend(features)

    def without(self, names) -> Contract:
        gone = set(names)
        keep = lambda xs: tuple(x for x in xs if x not in gone)
        return replace(self, numeric_features=keep(self.numeric_features), categorical_features=keep(self.categorical_features))

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Contract:
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})

    def derive(self, df: DataFrame, zero_variance: list[str], removable: list[str] = REMOVABLE_FLAGS, informative: list[str] = INFORMATIVE_FLAGS) -> Contract:
        """The first contract for a table: without features that do not vary,
        quality flags that are zero throughout, leakage and dropped columns;
        informative flags that the table has are kept or added."""
        there = [c for c in removable if c in df.columns]
        sums = df.agg(*[F.max(F.abs(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)))).alias(c) for c in there]).first() if there else {}
        forbidden = {*zero_variance, *self.leakage_cols, *self.drop_cols, *FORBIDDEN, self.target_col, *(c for c in there if not sums[c])}
        good = lambda names: tuple(c for c in names if c in df.columns and c not in forbidden)
        numeric = good(self.numeric_features)
        numeric += tuple(c for c in good(informative) if c not in numeric)
        return replace(self, numeric_features=numeric, categorical_features=good(self.categorical_features)).check()

    def removed_from(self, earlier: Contract) -> tuple[str, ...]:
        """The features of the earlier contract that this one does not have,
        in their order there."""
        now = {*self.numeric_features, *self.categorical_features}
        return tuple(c for c in (*earlier.numeric_features, *earlier.categorical_features) if c not in now)


def write_contract(spark: SparkSession, contract: Contract, *paths: str) -> None:
    save_json(spark, asdict(contract), *paths)


def load_contract(spark: SparkSession, *paths: str) -> tuple[Contract, str]:
    """The contract at the first of the paths that is there, and that path."""
    value, path = load_json(spark, *paths)
    return Contract.from_json(json.dumps(value)), path
