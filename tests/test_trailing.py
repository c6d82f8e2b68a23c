import datetime as dt
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidemark.operators import nearest as N
from tidemark.operators import trailing as R

D = dt.date(2020, 1, 1)
SALE = "sale_id int, trade_date date, district string, kind string, price double, area double, age double, floor_ratio double, has_parking int"


def day(n):
    return D + dt.timedelta(days=n)


def stats(spark, rows, windows, f=R.trailing_stats):
    made = spark.createDataFrame(rows, "i int, d date, g string, v double")
    return {r[0]: tuple(r)[1:] for r in f(made, ["g"], "i", "d", "v", windows, "p").collect()}


@pytest.mark.parametrize("f", [R.trailing_stats, R.trailing_stats_window])
def test_bounds_and_groups(spark, f):
    rows = [(1, day(0), "a", 100.0), (2, day(1), "a", 200.0), (3, day(2), "a", 300.0), (4, day(2), "a", 900.0), (5, day(2), "b", 1.0), (6, day(180), "a", 5.0), (7, day(181), "a", 5.0), (8, day(1), None, 7.0), (9, day(3), None, 9.0)]
    got = stats(spark, rows, [180], f)
    assert got[1] == (None, 0) and got[2] == (100.0, 1) and got[3] == got[4] == (150.0, 2) and got[5] == (None, 0)
    assert got[6] == (250.0, 4)  # the first day is just inside
    assert got[7] == (250.0, 4)  # and now just outside: days 1, 2, 2 and 180 are in
    assert got[8] == (None, 0) and got[9] == (7.0, 1)


def test_random_against_plain(spark):
    r = random.Random(3)
    rows = [(i, day(r.randrange(900)), r.choice(["a", "b", None]), r.choice([None, float("nan"), r.uniform(1, 9)])) for i in range(400)]
    got = stats(spark, rows, [30, 200])
    for i, d, g, _ in rows:
        want = ()
        for n in (30, 200):
            past = [v for _, e, h, v in rows if h == g and 0 < (d - e).days <= n and v is not None and v == v]
            want += (median(past) if past else None, len(past))
        assert got[i] == pytest.approx(want)


def sale(i, d, price=10.0, area=100.0, age=5.0, floor=0.5, parking=1, district="a"):
    return (i, day(d), district, "k", price, area, age, floor, parking)


def test_comparables(spark):
    rows = [sale(1, 0), sale(2, 0, area=50.0), sale(3, 10), sale(4, 20, price=None), sale(5, 30), sale(6, 30, district="b"), sale(7, 400, area=None, parking=None)]
    made = spark.createDataFrame(rows, SALE)
    pairs = {(r.sale_id, r.c_sale_id): r for r in R.comparable_pairs(made, ["district", "kind"], 365, 2).collect()}
    assert set(pairs) == {(3, 1), (3, 2), (4, 1), (4, 3), (5, 1), (5, 3)}
    assert pairs[5, 3]["rank"] == 1
    got = {r.sale_id: r for r in R.comparable_summary(made, ["district", "kind"], 365, 2).collect()}
    assert got[1].comp_count == got[6].comp_count == 0 and got[1].comp_median_price is None and len(got) == 7
    weights = [1 / (pairs[3, c].distance + 1e-6) for c in (1, 2)]
    assert got[3].comp_weighted_mean_price == pytest.approx(sum(w * 10 for w in weights) / sum(weights))


def test_ties_and_missing_keys(spark):
    rows = [sale(1, 5), sale(2, 5), sale(3, 4), sale(9, 8)] + [(i, day(d), None, None, 1.0, None, None, None, None) for i, d in ((20, 1), (21, 2))]
    top = R.comparable_pairs(spark.createDataFrame(rows, SALE), ["district", "kind"], 30, 2)
    assert [r.c_sale_id for r in top.filter("sale_id = 9").orderBy("rank").collect()] == [1, 2]
    assert top.filter("sale_id = 21").first().distance == pytest.approx(0.35 * 0.5 + 0.25 * 0.5 + 0.2 / 30 + 0.05 + 0.1)


def test_vectors_and_reranking(spark):
    rows = [(i, day(i), "g", [1.0, i / 10.0], float(i) if i != 2 else None, 10.0 + i, None) for i in range(6)]
    made = spark.createDataFrame(rows, "id int, d date, g string, e array<float>, price double, area double, age double")
    pairs = R.vector_pairs(made, ["g"], "id", "d", "e", 365, 3, ["price", "area", "age"])
    assert [r.c_id for r in pairs.filter("id = 5").orderBy("rank").collect()] == [4, 3, 2]
    best = R.rerank(pairs, "id", F.when(F.col("c_id") == 3, 0.9).otherwise(0.5), 2)
    assert [r.c_id for r in best.filter("id = 5").orderBy("score_rank").collect()] == [3, 4]
    import math

    got = R.vector_summary(best, "id", "c_price", reranked=True).filter("id = 5").first()
    a, b = math.exp(0.9), math.exp(0.5)
    assert got.emb_weighted_mean_price == pytest.approx((3 * a + 4 * b) / (a + b)) and got.emb_count == 2
    plain = R.vector_summary(pairs, "id", "c_price").filter("id = 5").first()
    assert plain.emb_count == 2 and plain.emb_nearest_price == 4.0  # the null price goes after ranking


def test_blocks_and_ties_of_a_large_group(spark, monkeypatch):
    """Blocks of a few rows, many equal distances, missing values: the same top
    k as ranking all pairs."""
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "ROWS", 3)
    rows = [sale(i, 1 + i % 9) for i in range(60)]
    made = spark.createDataFrame(rows, SALE).withColumns({"area": F.when(F.col("sale_id") % 5 != 0, (F.col("sale_id") % 4).cast("double")), "age": F.when(F.col("sale_id") % 7 != 0, F.lit(3.0)), "price": F.when(F.col("sale_id") % 11 != 0, F.col("price"))})
    got = {(r.sale_id, r.c_sale_id, r["rank"]) for r in R.comparable_pairs(made, ["district", "kind"], 6, 4).collect()}
    x, y = made.alias("x"), made.alias("y")
    c = lambda n: F.col(n)
    days = F.datediff("x.trade_date", "y.trade_date")
    every = x.join(y, c("x.district").eqNullSafe(c("y.district")) & c("x.kind").eqNullSafe(c("y.kind")) & days.between(1, 6)).filter("y.price IS NOT NULL")
    from pyspark.sql import Window

    from tidemark.functions.scalars import similarity_distance

    distance = F.round(similarity_distance(c("x.area"), c("y.area"), c("x.age"), c("y.age"), days, 6, c("x.floor_ratio"), c("y.floor_ratio"), c("x.has_parking"), c("y.has_parking")), 9)
    ranked = every.select(c("x.sale_id").alias("a"), c("y.sale_id").alias("b"), distance.alias("d"), c("y.trade_date").alias("day")).withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("d", F.desc("day"), "b")))
    assert got == {(r.a, r.b, r.n) for r in ranked.filter("n <= 4").collect()} and len(got) > 150


def test_rows_without_a_date(spark):
    rows = [(1, day(1), "a", 1.0), (2, day(3), "a", 2.0), (3, None, "a", 3.0), (4, None, None, None)]
    made = spark.createDataFrame(rows, "id int, d date, g string, v double")
    got = {r.id: tuple(r)[1:] for r in R.trailing_stats(made, ["g"], "id", "d", "v", [30], "p").collect()}
    assert got == {1: (None, 0), 2: (1.0, 1), 3: (None, 0), 4: (None, 0)}


def test_pruned_blocks_miss_nothing(spark, monkeypatch):
    """Many blocks of one slice, unknown values, ids that are text."""
    monkeypatch.setattr(N, "BLOCK", 40)
    monkeypatch.setattr(N, "FIRST", 2)
    r = random.Random(6)
    some = lambda x: None if r.random() < 0.05 else x
    rows = [sale(i, r.randrange(1, 500), 10.0, some(r.uniform(10, 400)), some(float(r.randrange(60))), some(r.random()), some(r.randrange(2))) for i in range(1200)]
    made = spark.createDataFrame(rows, SALE).withColumn("sale_id", F.format_string("s%05d", F.col("sale_id"))).repartition(4)
    asked = []
    deal = N._asked
    monkeypatch.setattr(N, "_asked", lambda *a: (asked.append((out := deal(*a)).count()), out)[1])
    got = {(x.sale_id, x["rank"]): (x.c_sale_id, x.distance) for x in R.comparable_pairs(made, ["district", "kind"], 365, 5).collect()}
    sent = sum(asked)
    for i, d, _, _, _, area, age, floor, parking in rows:
        ranked = []
        for j, e, _, _, _, area2, age2, floor2, parking2 in rows:
            if 1 <= (n := (d - e).days) <= 365:
                half = lambda x, y, f: 0.5 if x is None or y is None else f
                distance = 0.35 * half(area, area2, abs((area2 or 0) - (area or 0)) / max(area or 1.0, 1.0)) + 0.25 * half(age, age2, abs((age2 or 0) - (age or 0)) / 50) + 0.2 * n / 365 + 0.1 * half(floor, floor2, abs((floor2 or 0) - (floor or 0))) + 0.1 * (0 if parking is not None and parking == parking2 else 1)
                ranked.append((round(distance, 9), -e.toordinal(), f"s{j:05d}"))
        for n, (distance, _, other) in enumerate(sorted(ranked)[:5], 1):
            assert got[f"s{i:05d}", n] == (other, pytest.approx(distance, abs=2e-9))
    blocks = 2 * 1200 / 2 / 40  # of two slices, about
    assert sent < 0.8 * 1200 * blocks


def test_copies_of_sales_ask_once(spark, monkeypatch):
    """Five copies of each sale send as many rows to blocks as one, and each
    has the comparables of its own ranking."""
    asked = []
    deal = N._asked
    monkeypatch.setattr(N, "_asked", lambda *a: (asked.append((out := deal(*a)).count()), out)[1])
    sent = []
    for copies in (1, 5):
        rows = [sale(1000 * c + i, 1 + i, area=20.0 + i % 7) for i in range(40) for c in range(copies)]
        asked.clear()
        made = spark.createDataFrame(rows, SALE)
        top = R.comparable_pairs(made, ["district", "kind"], 30, 4).collect()
        sent.append(sum(asked))
        assert len(top) == sum(min(4, copies * min(i, 30)) for i in range(40)) * copies
        assert R.comparable_summary(made, ["district", "kind"], 30, 4).count() == 40 * copies
    assert [sorted(r.c_sale_id for r in top if r.sale_id == at) for at in (3, 4003)] == [[2, 1002, 2002, 3002]] * 2
    assert sent[0] == sent[1] == 40


def test_equal_rows_send_k_each(spark, monkeypatch):
    """A hot group of equal rows leaves k pairs for each row and block, not all pairs."""
    monkeypatch.setattr(N, "BLOCK", 100)
    rows = [sale(i, 1 + i % 50) for i in range(1000)]
    pairs = N.nearest(spark.createDataFrame(rows, SALE), ["district"], "sale_id", "trade_date", 365, ["sale_id", "price", "area", "age", "floor_ratio", "has_parking"], 4, F.lit(True), N.weighted_distance(365))
    assert pairs.count() <= 1000 * 4 * 12
    top = R.comparable_pairs(spark.createDataFrame(rows, SALE), ["district", "kind"], 365, 4)
    assert {x.c_sale_id for x in top.filter("sale_id = 49").collect()} == {48, 98, 148, 198}


@pytest.mark.parametrize("block", [4096, 30])
def test_vectors_in_cells(spark, monkeypatch, block):
    """Null, zero, short and unknown vectors, equal ones, cells of many blocks."""
    import numpy as np

    monkeypatch.setattr(N, "BLOCK", block)
    r = np.random.default_rng(3)
    centres = r.normal(size=(5, 8))
    vectors = [[float(x) for x in centres[i % 5] + 0.1 * r.normal(size=8)] for i in range(300)]
    for i in range(0, 300, 17):
        vectors[i] = [None, [0.0] * 8, [1.0, 2.0], [float("nan")] * 8, [1.0] * 7 + [None], vectors[1]][i // 17 % 6]
    rows = [(i, day(i % 150), "g", v) for i, v in enumerate(vectors)]
    made = spark.createDataFrame(rows, "id int, d date, g string, e array<double>").repartition(3)
    got = {}
    for x in R.vector_pairs(made, ["g"], "id", "d", "e", 200, 4).collect():
        got.setdefault(x.id, {})[x["rank"]] = (x.c_id, x.similarity)

    def similarity(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b or np.isnan([*a, *b]).any():
            return None
        return round(float(np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-6)), 9)

    for i, d, _, v in rows:
        ranked = sorted(((s is None, -(s or 0.0), e, j) for j, e, _, w in rows if 1 <= (d - e).days <= 200 for s in [similarity(v, w)]))[:4]
        assert [got[i][n + 1][0] for n in range(len(ranked))] == [x[3] for x in ranked], i


def test_large_groups_by_counting(spark, monkeypatch):
    """Buckets of a few rows, ties, one value in half of all rows, unknown
    values, days without any: the same as the plain definition."""
    from tidemark.operators import range_medians as M

    monkeypatch.setattr(R, "LARGE", 60)
    monkeypatch.setattr(M, "BUCKET", 9)
    r = random.Random(12)
    value = lambda: r.choice([4.0, 4.0, 4.0, None, float("nan"), float("inf"), float(r.randrange(20)), r.uniform(-9, 9)])
    rows = [(i, day(r.randrange(700)), r.choice("aaaab"), value()) for i in range(900)]
    rows += [(1000 + i, day(3), None, value()) for i in range(90)] + [(2000 + i, day(90), None, 1.0) for i in range(3)] + [(3000, None, "a", 1.0)]
    got = stats(spark, rows, [30, 200])
    assert got[3000] == (None, 0, None, 0) and len(got) == len(rows)
    for i, d, g, _ in rows:
        want = ()
        for n in (30, 200) if d else ():
            past = [v for _, e, h, v in rows if e and h == g and 0 < (d - e).days <= n and v is not None and abs(v) < float("inf")]
            want += (median(past) if past else None, len(past))
        assert got[i] == pytest.approx(want) or not d
