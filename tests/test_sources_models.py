import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as M
from tidemark.sources import files as S
from tidemark.sources import vectors as V
from tidemark.streaming.upserts import latest_by_key


def test_files_and_encodings(spark, tmp_path):
    for folder, body, code in (("112年第2季", "名, 值 ,值\n大安,1,2\n短,3\n長,1,2,3\n", "utf-8-sig"), ("本期", '名,值,值\n中正,"4,5",6\n', "cp950")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "Main.CSV").write_bytes(body.encode(code))
    (tmp_path / "@eaDir").mkdir()
    (tmp_path / "@eaDir" / "main.csv").write_text("x")
    paths = [r.path for r in S.find_files(spark, str(tmp_path), "main.csv").collect()]
    assert len(paths) == 2
    rows = S.read_text_csv(spark, paths)
    assert rows.columns[:3] == ["名", "值", "值.1"]
    assert sorted((r["名"], r["值"], r["值.1"]) for r in rows.collect()) == [("中正", "4,5", "6"), ("大安", "1", "2"), ("短", "3", "")]
    name, order = S.release(F.col("f"))
    made = spark.createDataFrame([("112年第2季",), ("本期",), ("other",)], "f string").select(name.alias("n"), order.alias("o"))
    assert [tuple(r) for r in made.collect()] == [("112Q2", 1122), ("CURRENT", 999999), ("other", 0)]


def test_layers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    S.write_layer(df, str(tmp_path / "p"), str(tmp_path / "c"))
    assert S.read_layer(spark, str(tmp_path / "p"), columns=["x", "no"]).columns == ["x"]
    with pytest.raises(ValueError):
        S.read_layer(spark, str(tmp_path / "p"), required=["z"])
    assert S.optional(spark, str(tmp_path / "none")) is None and S.optional(spark, str(tmp_path / "p")).count() == 2
    assert "| x | y |" in S.markdown(df)


def test_embedding_cache(spark, tmp_path):
    calls = str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three")], "id int, t string")
    first = V.embed_cached(df, "t", lambda: V.HashingBackend(8), calls).orderBy("id").collect()
    assert first[0].embedding == first[1].embedding != first[2].embedding
    assert spark.read.parquet(calls).count() == 2
    more = V.embed_cached(df.union(spark.createDataFrame([(4, "four")], "id int, t string")), "t", lambda: V.HashingBackend(8), calls)
    assert more.count() == 4 and spark.read.parquet(calls).count() == 3
    other = V.embed_cached(df, "t", lambda: V.HashingBackend(16), calls, "another model")
    assert {len(r.embedding) for r in other.collect()} == {16} and spark.read.parquet(calls).count() == 5


def test_vectors_of_tables(spark, tmp_path):
    """Only the same rows in the same order with the same model are found again."""
    df = spark.createDataFrame([(1, "a b", 1), (2, "c", 2), (3, None, 3)], "id int, t string, o int").repartition(3)
    name = lambda d, order=("o",), model="m": V.table_identity(d, "id", "t", list(order), model)
    same = name(df)
    assert same == name(df.repartition(2))
    others = [name(df, ("id", "o"), "n"), name(df.withColumn("o", -F.col("o"))), name(df.filter("id < 3")), name(df.withColumn("t", F.coalesce("t", F.lit("")))), name(df.withColumn("id", F.col("id") + 1))]
    assert len({same, *others}) == 6
    first = V.embed_table(df, "id", "t", ["o"], lambda: V.HashingBackend(8), str(tmp_path / "c"))
    again = V.embed_table(df, "id", "t", ["o"], lambda: V.HashingBackend(4), str(tmp_path / "c"))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    forced = V.embed_table(df, "id", "t", ["o"], lambda: V.HashingBackend(4), str(tmp_path / "c"), force=True)
    assert {r.id: r.embedding and len(r.embedding) for r in forced.collect()} == {1: 4, 2: 4, 3: None}


def test_preprocessing(spark):
    train = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "a")], "x double, c string")
    p = M.Preprocessor(["x"], ["c"]).fit(train)
    assert p.medians == {"x": 2.0} and p.modes == {"c": "a"}
    rows = [r.features.toArray() for r in p.transform(spark.createDataFrame([(None, "zz"), (3.0, None)], "x double, c string")).collect()]
    assert rows[0].tolist() == [0.0, 0.0, 0.0] and rows[1][0] == pytest.approx(1 / math.sqrt(2 / 3)) and rows[1][1:].tolist() == [1.0, 0.0]


def test_ridge_is_the_closed_form(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + r.normal(size=60)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    p = M.Preprocessor(["a", "b", "c"]).fit(df)
    model = M.ridge(p.transform(df), "y", 1.0)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-8) and model.intercept == pytest.approx(y.mean())


def test_search_and_fallback(spark):
    df = spark.createDataFrame([(float(i), float(2 * i)) for i in range(40)], "x double, y double")
    rows = M.Preprocessor(["x"]).fit(df).transform(df)
    found = M.grid_search([(rows, rows)], "y", lambda t, label, alpha: M.ridge(t, label, alpha), {"alpha": [100.0, 0.01]})
    assert [(f["rank"], f["alpha"]) for f in found] == [(1, 0.01), (2, 100.0)]

    def broken():
        raise RuntimeError("no device")

    name, model = M.first_that_fits([("gpu", broken), ("cpu", lambda: M.boosted_trees(rows, "y", maxIter=2))])
    assert name == "cpu" and M.importances(spark, model, ["x"]).first().feature == "x"


def test_latest_by_key_stream(spark, tmp_path):
    made = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "k string, o int, v string")
    made.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    q = latest_by_key(stream, "k", "o").writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("latest").collect()} == {("a", 2, "new"), ("b", 1, "only")}


def test_quoted_line_breaks_and_unknown_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('x,y\n1,"two\nlines, ""q"""\n2,z\n'.encode())
    (tmp_path / "b.csv").write_bytes(b"y,z\n5,6\n")
    got = S.read_text_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(tuple(r)[:3] for r in got.select("x", "y", "z").fillna("-").collect()) == [("-", "5", "6"), ("1", 'two\nlines, "q"', "-"), ("2", "z", "-")]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"
    (tmp_path / "c.csv").write_bytes(b"x\n\xff\xff\n")
    with pytest.raises(Exception, match="is in none of"):
        S.read_text_csv(spark, [str(tmp_path / "c.csv")]).collect()


def test_ridge_of_all_folds_against_numpy(spark):
    r = np.random.default_rng(4)
    rows = [(f, s, float(a) if r.random() > 0.1 else None, float(b), float(3 * a - b + r.normal())) for f in (1, 2) for s, n in (("train", 40), ("valid", 10), ("test", 10)) for a, b in r.normal(size=(n, 2))]
    made = spark.createDataFrame(rows, "fold_id int, split string, a double, b double, y double")
    got = M.ridge_by_fold(made, ["a", "b"], "y", [0.5, 20.0]).collect()
    assert len(got) == 80
    for fold in (1, 2):
        own = [x for x in rows if x[0] == fold]
        train = [x for x in own if x[1] == "train"]
        m = np.median([x[2] for x in train if x[2] is not None])
        fill = lambda xs: np.array([[m if x[2] is None else x[2], x[3]] for x in xs])
        mean, std, y = fill(train).mean(0), fill(train).std(0), np.array([x[4] for x in train])
        z = (fill(train) - mean) / std
        for alpha in (0.5, 20.0):
            w = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (y - y.mean()))
            rest = [x for x in own if x[1] != "train"]
            want = sorted(y.mean() + ((fill(rest) - mean) / std) @ w)
            assert sorted(g.prediction for g in got if g.fold_id == fold and g.alpha == alpha) == pytest.approx(want)


def test_sinks_gates_and_scores(spark, tmp_path):
    from tidemark.operators import evaluation as E
    from tidemark.operators import folds as L

    df = spark.createDataFrame([(1, "a")], "id int, x string")
    status = S.write_both(df, str(tmp_path / "t"), compression="none-such").collect()
    assert [(r.format, r.status, bool(r.error)) for r in status] == [("parquet", "failed", True), ("csv", "ok", False)]
    with pytest.raises(FileNotFoundError):
        S.load_json(spark, str(tmp_path / "no"))
    with pytest.raises(ValueError, match="no row for id 2"):
        L.attach(spark.createDataFrame([(1,), (2,)], "id int"), df, "id")
    rows = spark.createDataFrame([("m", "test", 0.0, 1.0), ("m", "test", 0.0, 0.0), ("m", "test", 2.0, 1.0)], "model_name string, split string, y_true double, y_pred double")
    with pytest.raises(ValueError, match="no predictions"):
        E.select_predictions(rows, "m", "valid")
    got = [r.ape for r in E.prediction_table(E.select_predictions(rows, "m", "test")).collect()]
    assert got[0] == math.inf and math.isnan(got[1]) and got[2] == 50.0
    pairs = spark.createDataFrame([("a b", "B c"), (None, "x")], "p string, q string")
    assert [r.score for r in V.score_pairs(pairs, "p", "q", V.OverlapReranker).collect()] == [pytest.approx(1 / 3), 0.0]


def test_ridge_with_categories_and_many_columns(spark):
    """One-hot levels, unknown ones, missing values and a column that does not vary, against numpy."""
    r = np.random.default_rng(11)
    names = [f"n{i}" for i in range(40)]
    rows = []
    for fold in (1, 2):
        for i in range(160):
            x = [None if r.random() < 0.05 else float(v) for v in r.normal(size=40)]
            x[7] = 3.0
            level = None if r.random() < 0.1 else "abc"[r.integers(0, 3)] if i < 120 else "abcz"[r.integers(0, 4)]
            rows.append((fold, "train" if i < 120 else "test", i, *x, level, float((x[0] or 0) * 2 + {"a": 5, "b": -4}.get(level, 0) + r.normal())))
    made = spark.createDataFrame(rows, "fold_id int, split string, id int, " + ", ".join(f"{n} double" for n in names) + ", c string, y double").repartition(4)
    got = {(g.fold_id, g.alpha, g.id): g.prediction for g in M.ridge_by_fold(made, names, "y", [0.5, 30.0], ["c"]).collect()}
    assert len(got) == 160
    for fold in (1, 2):
        own = [x for x in rows if x[0] == fold]
        train = np.array([x[1] == "train" for x in own])
        raw = np.array([x[3:43] for x in own], float)
        fill = np.where(np.isnan(raw), np.nanmedian(raw[train], axis=0), raw)
        spread = fill[train].std(0)
        z = np.where(spread > 0, (fill - fill[train].mean(0)) / np.where(spread > 0, spread, 1), 0)
        seen = [x[43] for x, t in zip(own, train, strict=True) if t and x[43]]
        mode = min(set(seen), key=lambda c: (-seen.count(c), c))
        hot = np.array([[(x[43] or mode) == c for c in "abc"] for x in own], float)
        design, y = np.column_stack([z, hot]), np.array([x[44] for x in own])
        mean = design[train].mean(0)
        for alpha in (0.5, 30.0):
            d = design[train] - mean
            w = np.linalg.solve(d.T @ d + alpha * np.eye(43), d.T @ (y[train] - y[train].mean()))
            for x, p in zip(own, y[train].mean() + (design - mean) @ w, strict=True):
                if x[1] != "train":
                    assert got[fold, alpha, x[2]] == pytest.approx(p, abs=1e-7)


def test_correlations_of_many_columns(spark):
    """Pairwise complete, with columns that do not vary or are unknown."""
    from tidemark.operators.gram import correlations

    r = np.random.default_rng(2)
    x = r.normal(size=(500, 30)) + 1e6
    x[:, 1] = x[:, 0] * 2 + r.normal(size=500)
    x[:, 5], x[:, 6] = 4.25, np.nan
    x[r.random(x.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(30)]
    made = spark.createDataFrame([[None if np.isnan(v) and i % 2 else float(v) for v in row] for i, row in enumerate(x)], ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(q.left, q.right): q.corr for q in correlations(made, names).collect()}
    assert len(got) == 30 * 29 // 2
    for (a, b), c in got.items():
        i, j = int(a[1:]), int(b[1:])
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        if {i, j} & {5, 6}:
            assert c is None
        else:
            assert c == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-7)
    assert correlations(made.limit(0), names[:3]).filter("corr IS NOT NULL").count() == 0


def test_csv_by_ranges(spark, tmp_path):
    """Ranges of a few bytes: quotes, escaped quotes and letters of several
    bytes over borders, quotes that open nothing, empty lines, a range that is
    all inside of quotes; as one reader of the whole file has it."""
    import csv
    import io
    import random

    r = random.Random(9)
    cell = lambda: r.choice(["", "x", "大安區", '甲"乙', "a,b", "line\nbreak", "two\r\nlines", 'say ""', "長" * 40, "0 1", "\n" * 90])
    texts = {}
    for name, code in (("a", "utf-8-sig"), ("b", "cp950"), ("c", "utf-8")):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator="\r\n" if name == "b" else "\n")
        writer.writerow(["k", "v", "名"])
        for i in range(120):
            writer.writerow([i, cell(), cell()][: 3 if i % 13 else 2])
            if i % 17 == 0:
                out.write("\n")
            if i % 19 == 0:
                out.write('5" pipe,6" pipe,z\nq,w,e,too many\n')
        texts[name] = ("\n" if name == "c" else "") + out.getvalue()
        (tmp_path / f"{name}.csv").write_bytes(texts[name].encode(code))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("64", "700", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = S.read_text_csv(spark, [str(tmp_path / f"{n}.csv") for n in texts]).collect()
            for name, text in texts.items():
                reader = csv.reader(io.StringIO(text, newline=""))
                head = next(x for x in reader if x)
                want = [(i, *(x + [""] * (3 - len(x)))) for i, x in enumerate(reader, 1) if x and len(x) <= len(head)]
                assert sorted((g.row_order, g.k, g.v, g["名"]) for g in got if g.source_file.endswith(f"/{name}.csv")) == want, (name, size)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
