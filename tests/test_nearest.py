"""The search for comparables by cells against all pairs."""

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import nearest as N
from tidemark.operators import trailing as R

D = dt.date(2020, 1, 1)
SALE = "sale_id string, trade_date date, district string, kind string, price double, area double, age double, floor_ratio double, has_parking int"


def rows_of(n, days, seed, groups="ab"):
    r = random.Random(seed)
    some = lambda x: None if r.random() < 0.06 else x
    return [(f"s{i:05d}", some(D + dt.timedelta(days=r.randrange(days))), r.choice(groups), None, some(r.choice([float("nan"), 7.0, r.uniform(1, 9)])), some(r.choice([0.2, 30.0, r.uniform(5, 300)])), some(float(r.randrange(40))), some(r.random()), some(r.randrange(2))) for i in range(n)]


def all_pairs(rows, window, k):
    out = {}
    half = lambda x, y, f: 0.5 if x is None or y is None else f(x, y)
    for a in rows:
        near = []
        for b in rows:
            if a[1] and b[1] and a[2:4] == b[2:4] and b[4] is not None and b[4] == b[4] and 1 <= (n := (a[1] - b[1]).days) <= window:
                apart = half(a[5], b[5], lambda x, y: abs(y - x) / max(x, 1.0)), half(a[6], b[6], lambda x, y: abs(y - x) / 50), half(a[7], b[7], lambda x, y: abs(y - x))
                distance = 0.35 * apart[0] + 0.25 * apart[1] + 0.20 * (n / window) + 0.10 * apart[2] + 0.10 * (0.0 if a[8] is not None and a[8] == b[8] else 1.0)
                near.append((round(distance, 9), -b[1].toordinal(), b[0], b))
        out[a[0]] = sorted(near, key=lambda t: t[:3])[:k]
    return out


@pytest.mark.parametrize("block", [4096, 9])
def test_lists_are_those_of_all_pairs(spark, monkeypatch, block):
    """One task for a slice, and many blocks whose lists are put together."""
    monkeypatch.setattr(N, "LARGER", 1)
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "CELL", 4)
    monkeypatch.setattr(N, "ASKING", 3)
    monkeypatch.setattr(N, "FIRST", 2)
    rows = rows_of(260, 150, 5)
    made = spark.createDataFrame(rows, SALE).repartition(3)
    want = all_pairs(rows, 60, 4)
    got = {}
    for x in R.comparable_pairs(made, ["district", "kind"], 60, 4).orderBy("sale_id", "rank").collect():
        got.setdefault(x.sale_id, []).append((x.c_sale_id, x.distance, x.days_diff))
    by_id = {r[0]: r for r in rows}
    for i, near in want.items():
        assert [x[0] for x in got.get(i, [])] == [t[2] for t in near]
        assert [x[1] for x in got.get(i, [])] == pytest.approx([t[0] for t in near], abs=2e-9)
        assert [x[2] for x in got.get(i, [])] == [(by_id[i][1] - t[3][1]).days for t in near]
    found = {x.sale_id: x for x in R.comparable_summary(made, ["district", "kind"], 60, 4).collect()}
    assert len(found) == len(rows)
    for i, near in want.items():
        x, a = found[i], by_id[i]
        prices = [t[3][4] for t in near]
        assert x.comp_count == len(near) and x.comp_median_price == (pytest.approx(median(prices)) if near else None)
        if near:
            ages = [abs(t[3][6] - a[6]) for t in near if t[3][6] is not None and a[6] is not None]
            areas = [abs(t[3][5] - a[5]) / max(a[5], 1.0) for t in near if t[3][5] is not None and a[5] is not None]
            weights = [1 / (t[0] + 1e-6) for t in near]
            assert x.comp_median_age_diff == (pytest.approx(median(ages)) if ages else None)
            assert x.comp_median_area_diff_pct == (pytest.approx(median(areas)) if areas else None)
            assert (x.comp_mean_price, x.comp_nearest_price, x.comp_nearest_distance) == (pytest.approx(np.mean(prices)), prices[0], pytest.approx(near[0][0], abs=2e-9))
            assert x.comp_std_price == pytest.approx(np.std(prices)) and x.comp_weighted_mean_price == pytest.approx(np.average(prices, weights=weights), rel=1e-4)


def test_cells_leave_most_pairs_out(spark, monkeypatch):
    """Four times the rows of a slice: the candidates that a row is held against
    do not grow with them (all pairs would be four times as many)."""
    read = []
    rows = N._Boxes.rows
    monkeypatch.setattr(N._Boxes, "rows", lambda self, cells: (read.append(len(out := rows(self, cells))), out)[1])
    each = []
    for n in (4000, 16000):
        r = np.random.default_rng(2)
        x = {"area": r.integers(20, 300, n).astype(float), "age": r.random(n) * 10, "floor_ratio": r.random(n), "has_parking": r.integers(0, 2, n).astype(float)}
        x |= {f"{c}?": np.ones(n, bool) for c in list(x)} | {"day": r.integers(0, 365, n)}
        read.clear()
        left, _, _ = N.weighted_distance(365).ranked(x, x, np.arange(n), 10)
        each.append(sum(read) / (n / N.ASKING) / n)
        assert len(np.unique(left)) > 0.97 * n
    assert each[1] < 0.5 * each[0] and each[1] < 0.3


def test_distances_are_rounded_as_decimals():
    r = random.Random(4)
    values = [r.randrange(10**10) / 1e10 + 5e-10 * (i % 2) for i in range(3000)] + [0.0, 0.1234567895, 0.0000000005, 174.9999999995, 1234567.1234567895, N.ENDLESS, N.NO_NUMBER]
    want = [float(Decimal(repr(v)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for v in values[:-2]]
    got = N._rounded(np.array(values))
    assert got[:-2].tolist() == want and np.isinf(got[-2]) and np.isnan(got[-1])


def test_sales_without_comparables(spark):
    """Counted by day: the same as the sales whose list is empty."""
    rows = rows_of(150, 900, 8, "abcdefgh")
    made = spark.createDataFrame(rows, SALE)
    found = R.without_comparables(made, ["district", "kind"], 20).first()
    assert tuple(found) == (150, sum(not near for near in all_pairs(rows, 20, 1).values())) and 20 < found.missing < 150
    assert tuple(R.without_comparables(made.limit(0), ["district", "kind"], 20).first()) == (0, 0)
    assert R.comparable_summary(made, ["district", "kind"], 20).filter(F.col("comp_median_price").isNull()).count() == found.missing
