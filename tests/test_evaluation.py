import datetime as dt
import math

import pytest

from tidemark.operators import evaluation as E
from tidemark.operators import folds as L
from tidemark.operators import profiling as P
from tidemark.operators.contract import Contract


def test_metrics(spark):
    df = spark.createDataFrame([(100.0, 110.0, "a"), (200.0, 180.0, "a"), (5.0, None, "a"), (float("nan"), 1.0, "a"), (0.0, 1.0, "b"), (0.0, 2.0, "b")], "y_true double, y_pred double, g string")
    got = {r.g: r for r in E.regression_metrics(df, "g").collect()}
    a = got["a"]
    assert (a.n, a.mae, a.mape, a.bias) == (2, 15.0, 10.0, -5.0) and a.rmse == pytest.approx(math.sqrt(250)) and a.r2 == pytest.approx(1 - 500 / 5000)
    assert got["b"].mape is None and got["b"].r2 is None


def test_segments_top_and_rollup(spark):
    df = spark.createDataFrame([(1, 10.0, 60.0), (2, 130.0, 50.0)], "id int, y_true double, y_pred double")
    assert [(r.segment, r.n) for r in E.segment_metrics(df).orderBy("segment_order").collect()] == [("0-50", 1), ("50-80", 0), ("80-120", 0), ("120+", 1)]
    assert {(r.side, r.id, r.error) for r in E.top_errors(df, 1, "id").collect()} == {("under", 2, -80.0), ("over", 1, 50.0)}
    one = spark.createDataFrame([(1, "m", 2.0)], "fold_id int, model string, mae double")
    assert tuple(E.rollup(one, ["model"], ["mae"]).first()) == ("m", 1, 2.0, None)


def test_rank_correlation(spark):
    df = spark.createDataFrame([("up", 1.0, 2.0), ("up", 2.0, 4.0), ("up", 3.0, 9.0), ("down", 1.0, 9.0), ("down", 2.0, 4.0), ("one", 1.0, 1.0)], "g string, x double, y double")
    got = {r.g: r.spearman for r in E.rank_correlation(df, "x", "y", "g").collect()}
    assert got["up"] == pytest.approx(1) and got["down"] == pytest.approx(-1) and got["one"] is None
    assert E.rank_correlation(df, "x", "y").first().n == 6
    c = spark.createDataFrame([(1, 2, 5), (2, 4, 1), (3, 6, None), (4, 8, 7)], "a int, b int, c int")
    assert [(r.left, r.right) for r in E.correlation_pairs(c, ["a", "b", "c"], 0.9).collect()] == [("a", "b")]


def test_baseline_fallback(spark):
    rows = [(1, "train", "A", "x", 100.0), (1, "train", "A", "y", 120.0), (1, "train", None, "x", 200.0), (1, "test", "A", "z", 1.0), (1, "test", "C", "x", 1.0), (1, "test", None, "x", 1.0)]
    members = spark.createDataFrame(rows, "fold_id int, split string, district string, kind string, price double")
    out = E.median_baselines(members, {"global": [], "district": ["district"], "combo": ["district", "kind"]}, "price", ["district", "kind"]).filter("split = 'test'")
    got = {(r.model_name, r.district): r.y_pred for r in out.collect()}
    assert got == {("global", "A"): 120, ("global", "C"): 120, ("global", None): 120, ("district", "A"): 110, ("district", "C"): 120, ("district", None): 200, ("combo", "A"): 110, ("combo", "C"): 120, ("combo", None): 200}


def test_compare(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, mae double")
    b = spark.createDataFrame([(2, 5.0), (3, 7.0)], "k int, mae double")
    assert {tuple(r) for r in E.compare(a, b, ["k"], ["mae"]).collect()} == {(1, 2.0, None, None), (2, 3.0, 5.0, 2.0), (3, None, 7.0, None)}


def frame(spark, start, end, step=1):
    days = [start + dt.timedelta(days=i) for i in range(0, (end - start).days + 1, step)]
    return spark.createDataFrame([(i, d, "A" if i % 2 else "B") for i, d in enumerate(days)], "id int, trade_date date, district string")


def test_folds(spark):
    df = frame(spark, dt.date(2018, 1, 1), dt.date(2024, 4, 18))
    rule = L.FoldRule(least_train=1, least_valid=1, least_test=1)
    found = L.usable_quarters(df, "trade_date", rule)
    assert (found[0], found[-1]) == (2019 * 4, 2024 * 4)  # before 2019 and the incomplete quarter are out
    folds = L.fold_counts(df, "trade_date", rule).orderBy("candidate_id").collect()
    assert (folds[0].train_start, folds[0].train_end, folds[0].valid_end, folds[0].test_end) == (dt.date(2019, 1, 1), dt.date(2021, 12, 31), dt.date(2022, 6, 30), dt.date(2022, 9, 30))
    assert [f.train_start for f in folds[:2]] == [dt.date(2019, 1, 1), dt.date(2019, 4, 1)]
    members = L.membership(df, "trade_date", rule, ["id", "trade_date"])
    by_split = {(r.fold_id, r.id): r.split for r in members.collect()}
    assert len(by_split) == members.count()  # splits of a fold are disjoint
    gated = L.fold_counts(df, "trade_date", L.FoldRule(least_train=1096, least_valid=181, least_test=92)).orderBy("candidate_id").collect()
    assert gated[0].exclusion_reason == "" and gated[1].exclusion_reason == "" and [g.fold_id for g in gated[:2]] == [1, 2]
    assert gated[2].exclusion_reason == "test_rows < 92" and gated[2].fold_id is None
    assert L.usable_quarters(frame(spark, dt.date(2026, 1, 1), dt.date(2026, 6, 30)), "trade_date", rule)[-1] == 2026 * 4 + 1
    assert L.membership(df.filter("false"), "trade_date", rule, ["id"]).count() == 0


def test_published_bounds(spark):
    """Fifteen folds, test quarters 2022Q3 to 2026Q1."""
    df = frame(spark, dt.date(2019, 1, 1), dt.date(2026, 4, 18), 2)
    folds = L.candidate_folds(df, "trade_date", L.FoldRule()).orderBy("candidate_id").collect()
    assert len(folds) == 15 and folds[0].test_start == dt.date(2022, 7, 1) and folds[-1].test_end == dt.date(2026, 3, 31)


def test_profiles(spark):
    df = spark.createDataFrame([(0, 1, None), (0, 2, "x"), (0, None, None)], "all_zero int, varies int, s string")
    assert [r["column"] for r in P.zero_variance(df, ["all_zero", "varies"]).collect()] == ["all_zero"]
    assert {(r.value, r.n) for r in P.value_counts(df, "s").collect()} == {("<NA>", 2), ("x", 1)}
    got = {r["column"]: r for r in P.profile(df, ["varies", "s"]).collect()}
    assert got["varies"].missing == 1 and got["s"].distinct == 1
    ids = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "id int")
    assert tuple(P.id_checks(ids, "id").first()) == (5, 1, 2, 3)
    bad = spark.createDataFrame([(5, 4), (5, 5)], "_day int, c_day int")
    assert P.leakage_check(bad).first().status == "FAIL"
    with pytest.raises(ValueError, match="row count"):
        P.same_row_count(df, ids)


def test_contract():
    c = Contract("unit_price_ping", ("a", "comp_b"), ("district",), leakage_cols=("total_price",))
    assert c.check() is c and Contract.from_json(c.to_json()) == c
    for bad in (Contract("y", ("y",)), Contract("y", ("a",), ("address_raw",)), Contract("y", ("a", "total_price"))):
        with pytest.raises(ValueError, match="Leakage"):
            bad.check()
    assert c.extend(["d", "a"]).numeric_features == ("a", "comp_b", "d")
    assert c.substitute("comp_", ["emb"]).numeric_features == ("a", "emb")
    assert c.without(["a"]).numeric_features == ("comp_b",)


def test_quantiles_and_ranks_by_counting(spark):
    """Ties, nulls, null keys, groups over many ranges: as numpy has them."""
    import numpy as np

    from tidemark.operators.ordering import counted_before, quantiles

    r = np.random.default_rng(5)
    rows = [(k, float(v) if r.random() > 0.1 else None) for k, n in (("a", 900), (None, 50), ("c", 1), ("b", 7)) for v in r.integers(0, 60, n)] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    held = {k: [v for kk, v in rows if kk == k and v is not None] for k in ("a", None, "b", "c")}
    shares = [0.0, 0.013, 0.5, 0.99, 1.0]
    for r in quantiles(df, "v", shares, "k").collect():
        assert list(r)[1:] == pytest.approx(np.quantile(held[r.k], shares).tolist())
    every = [v for _, v in rows if v is not None]
    assert list(quantiles(df, "v", shares).first()) == pytest.approx(np.quantile(every, shares).tolist())
    for r in counted_before(df.filter("v IS NOT NULL"), ["k"], "v").collect():
        assert (r.n, r.before) == (held[r.k].count(r.v), sum(x < r.v for x in held[r.k]))
    assert quantiles(df.filter("v > 1000"), "v", shares, "k").count() == 0


def test_positions_with_payload(spark):
    """Every row has a position of its own, whatever else is selected."""
    from pyspark.sql import functions as F

    from tidemark.operators.ordering import counted_before, positions

    n = 200_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("v"), (F.col("id") % 3).alias("k"), F.md5(F.col("id").cast("string")).alias("payload"))
    found = positions(df, ["v"])
    assert found.columns == ["v", "k", "payload", "position"]
    assert tuple(found.agg(F.count_distinct("position"), F.count_if(F.col("position") != F.col("v")), F.count_distinct("payload")).first()) == (n, 0, n)
    grouped = positions(df.withColumn("k", F.when(F.col("k") > 0, F.col("k"))), ["v"], ("k",)).groupBy("k").agg(F.count_distinct("position").alias("d"), F.min("position"), F.max("position").alias("m"), F.count("*").alias("n"))
    assert all(tuple(r)[1:] == (r.n, 0, r.n - 1, r.n) for r in grouped.collect()) and grouped.count() == 3
    before = counted_before(df, ["k"], "payload")
    assert before.groupBy("k").agg(F.count_distinct("before").alias("d"), F.count("*").alias("n")).filter("d <> n").count() == 0


def test_source_columns_are_no_features(spark):
    from tidemark.operators.contract import Contract

    df = spark.createDataFrame([(1.0, 2.0, 3)], "area double, source_order double, y int")
    first = Contract("y", ("area", "source_order"))
    derived = first.derive(df, [])
    assert derived.numeric_features == ("area",)
    assert derived.removed_from(first) == ("source_order",)


def test_metrics_without_medians_and_counted_training_rows(spark, monkeypatch):
    """No median is looked for where none is asked for, and training rows that
    are counted before they are dealt to folds give the same baselines."""
    from pyspark.sql import functions as F

    rows = [(f, s, i, "ab"[i % 2], float(i * 7 % 11)) for f in (1, 2) for s in ("train", "test") for i in range(20)]
    members = spark.createDataFrame(rows, "fold_id int, split string, id long, g string, y double")
    train = members.filter("split = 'train'").groupBy("fold_id", "g", "y").agg(F.count("*").alias("_n"))
    others = members.filter("split = 'test'")
    whole = E.median_baselines(members, {"global": [], "g": ["g"]}, "y", ["id", "g"]).filter("split = 'test'")
    counted = E.median_baselines(others, {"global": [], "g": ["g"]}, "y", ["id", "g"], train)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, whole.collect())) and counted.count() == 80
    full = {(r.model_name, c): r[c] for c in ("n", "mae", "bias") for r in E.regression_metrics(counted, "model_name").collect()}
    monkeypatch.setattr(E, "quantiles", None)
    monkeypatch.setattr(E, "written", None)
    short = E.regression_metrics(counted, "model_name", median=False)
    assert {(r.model_name, c): r[c] for c in ("n", "mae", "bias") for r in short.collect()} == pytest.approx(full) and "median_ae" not in short.columns


def test_quantiles_repeat_counts_and_not_rows(spark):
    """Groups that share rows are given counts of cells and the rows of a few
    cells; results are those of the repeated rows, with values at any scale."""
    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.operators.ordering import quantiles

    r = np.random.default_rng(3)
    values = np.concatenate([r.normal(0, 1e6, 15_000), r.random(4_000) * 1e-6, np.full(995, 7.0), [0.0, -0.0, 5e-324]])
    rows = [(int(i % 4), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "part int, v double").repartition(4)
    seen = []

    def spread(counts):
        seen.append(counts.count())
        return counts.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("part")))).drop("part")

    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {row.fold: list(row)[1:] for row in quantiles(df, "v", shares, "fold", spread=spread).collect()}
    for fold in range(4):
        own = [v for part, v in rows if part >= fold]
        assert found[fold] == pytest.approx(np.quantile(own, shares).tolist())
    assert len(seen) == 2 and sum(seen) < len(rows) / 2
    huge = spark.createDataFrame([(v,) for v in (-1e300, 1e300, 2.0, 1.0, 1.5)], "v double")
    assert list(quantiles(huge, "v", [0.25, 0.5, 0.75]).first()) == [1.0, 1.5, 2.0]
    odd = [float("-inf"), -2.0, 3.0, float("inf"), float("nan")]
    one = quantiles(spark.createDataFrame([(v,) for v in odd], "v double"), "v", [0.25, 0.5]).first()
    assert list(one) == [-2.0, 3.0]


def test_baselines_learn_from_counts_by_quarter(spark, sf_dir, monkeypatch):
    """Training sales are not repeated for each fold: what is dealt are counts."""
    from tidemark.plans import queries as Q

    dealt = []
    among = Q.L.among

    def counted(rows, bounds, day, columns):
        if day == "quarter":
            dealt.append("_cell" in rows.columns)
        return among(rows, bounds, day, columns)

    monkeypatch.setattr(Q.L, "among", counted)
    assert Q.predictions(spark, sf_dir).count() > 0
    assert dealt == [True, True]


def test_attributes_of_named_sales_only(spark, sf_dir):
    from tidemark.plans.sales import sales

    some = sales(spark, sf_dir).orderBy("sale_id").limit(7)
    ids = spark.createDataFrame([(r.sale_id,) for r in some.collect()], "sale_id long")
    assert sorted(map(tuple, sales(spark, sf_dir, ids).collect())) == sorted(map(tuple, some.collect()))


def test_rank_correlation_does_not_join_rows_with_their_ranks(spark, monkeypatch):
    """Rows of one value come once, with the sum of their other ranks; what does
    not vary has no correlation and is no error."""
    import numpy as np
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    rows = [(g, float(r.integers(0, 9)), float(r.integers(0, 40))) for g in ("a", None) for _ in range(300)]
    rows += [("flat", 1.0, float(i)) for i in range(5)] + [("one", 1.0, 2.0), ("odd", float("nan"), 1.0), ("odd", 1.0, None)]
    seen = []
    counted = E.counted_before

    def watched(df, keys, value, **more):
        out = counted(df, keys, value, **more)
        seen.append((value, out.count()))
        return out

    monkeypatch.setattr(E, "counted_before", watched)
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(4)
    for x, y in (("a", "b"), ("b", "a")):
        seen.clear()
        found = E.rank_correlation(df, x, y, "g")
        assert dict(seen) == {f"_{side}": df.filter(~F.isnan("a") & F.col("b").isNotNull()).select("g", c).distinct().count() for side, c in (("x", x), ("y", y))}
        got = {row.g: row for row in found.collect()}
        assert set(got) == {"a", None, "flat", "one"}
        assert [got["flat"].pearson, got["flat"].spearman, got["one"].pearson, got["one"].spearman] == [None] * 4
        for g in ("a", None):
            v, w = (np.array([p[i] for p in rows if p[0] == g]) for i in (1, 2))
            ranks = [np.array([(u < t).sum() + ((u == t).sum() + 1) / 2 for t in u]) for u in (v, w)]
            assert got[g].n == 300
            assert got[g].pearson == pytest.approx(np.corrcoef(v, w)[0, 1]) and got[g].spearman == pytest.approx(np.corrcoef(*ranks)[0, 1])


def test_baselines_write_training_rows_once(spark, sf_dir, monkeypatch):
    """Training rows are those of the folds' table and are not written again."""
    from tidemark.operators import ordering
    from tidemark.plans import queries as Q

    names = []
    kept = ordering.written

    def watched(df, name):
        names.append(name)
        return kept(df, name)

    monkeypatch.setattr(ordering, "written", watched)
    assert Q.predictions(spark, sf_dir).count() > 0
    assert names and "values" not in names


def test_errors_of_one_model_only(spark, sf_dir, monkeypatch):
    from tidemark.plans import queries as Q

    asked = []
    predictions = Q.predictions

    def watched(spark, sf_dir, only=None):
        asked.append(only)
        return predictions(spark, sf_dir, only)

    monkeypatch.setattr(Q, "predictions", watched)
    assert Q.error_attributes(spark, sf_dir).count() > 0
    assert asked == ["combo"]
