"""Queries over files, layers, caches and contracts: what they read they first
write, from the test tables, to the session's shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars as S
from tidemark.operators import cleaning as C
from tidemark.operators import evaluation as E
from tidemark.operators import profiling as P
from tidemark.operators.contract import Contract, load_contract, write_contract
from tidemark.plans.housing import RAW, raw_housing
from tidemark.plans.queries import _BASELINES, predictions, query, read
from tidemark.plans.sales import SALES_SQL, sales
from tidemark.schema import with_missing
from tidemark.sources import files as X
from tidemark.sources import vectors as V
from tidemark.sources.scratch import put_file, scratch_path

# ---- CSV files of several encodings ---------------------------------------------------------------------------

_FOLDER = "concat(110 + r_regionkey, CASE WHEN r_regionkey = 4 THEN '本期' ELSE concat('年第', r_regionkey % 4 + 1, '季') END)"


def _folder(region: int) -> str:
    return f"{110 + region}" + ("本期" if region == 4 else f"年第{region % 4 + 1}季")


def _release_files(spark, sf_dir) -> str:
    """One CSV file for each region, of its nations: three encodings, quoted
    commas, quotes and line breaks, short and over-long records, file names in
    both cases, and files that are to be passed over."""
    root = scratch_path(spark, "releases")
    nations = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # a fixed list of 25
    for region in sorted({r.n_regionkey for r in nations}):
        lines = [" key , name,note,name"]
        for r in (r for r in nations if r.n_regionkey == region):
            k = r.n_nationkey
            note = f'"甲, ""{k}""\n乙"' if k % 2 else f"平{k}"
            lines.append(f"{k},{r.n_name}" if k % 5 == 4 else f"{k},{r.n_name},{note},x{k}" + (",more" if k % 5 == 3 else ""))
        encoding = ("utf-8-sig", "cp950", "utf-8")[region % 3]
        put_file(spark, f"{root}/{_folder(region)}/{'A_Main.CSV' if region % 2 else 'a_main.csv'}", ("\r\n".join(lines) + "\r\n").encode(encoding))
        put_file(spark, f"{root}/{_folder(region)}/@eaDir/a_main.csv", b"key\n1\n")
        put_file(spark, f"{root}/{_folder(region)}/b_main.csv", b"key\n1\n")
    return root


@query("S01_find_files", f"SELECT {_FOLDER} AS folder, CASE WHEN r_regionkey % 2 = 1 THEN 'A_Main.CSV' ELSE 'a_main.csv' END AS file FROM region")
def find_files(spark, sf_dir):
    found = X.find_files(spark, _release_files(spark, sf_dir), "a_main.csv")
    part = lambda i: F.url_decode(F.element_at(F.split("path", "/"), i))
    return found.select(part(-2).alias("folder"), part(-1).alias("file"))


def _rows(spark, sf_dir):
    paths = [r.path for r in X.find_files(spark, _release_files(spark, sf_dir), "a_main.csv").collect()]  # one for each region
    return X.read_text_csv(spark, paths)


_NOTE = "CASE WHEN n_nationkey % 5 = 4 THEN '' WHEN n_nationkey % 2 = 1 THEN concat('甲, \"', n_nationkey, '\"', chr(10), '乙') ELSE concat('平', n_nationkey) END"


@query("S02_csv_scan", f"SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, {_NOTE} AS note FROM nation WHERE n_nationkey % 5 <> 3")
def csv_scan(spark, sf_dir):
    """Every file in its own encoding; over-long records go, short ones are padded."""
    return _rows(spark, sf_dir).select("key", "name", "note")


@query("S03_release", f"SELECT {_FOLDER} AS folder, CASE WHEN r_regionkey = 4 THEN 'CURRENT' ELSE concat(110 + r_regionkey, 'Q', r_regionkey % 4 + 1) END AS release, CAST(CASE WHEN r_regionkey = 4 THEN 999999 ELSE (110 + r_regionkey) * 10 + r_regionkey % 4 + 1 END AS INTEGER) AS release_order FROM region")
def release(spark, sf_dir):
    folders = X.find_files(spark, _release_files(spark, sf_dir), "a_main.csv").select(F.url_decode(F.element_at(F.split("path", "/"), -2)).alias("folder"))
    name, order = X.release(F.col("folder"))
    return folders.select("folder", name.alias("release"), order.cast("int").alias("release_order"))


@query("S04_provenance", f"SELECT CAST(n_nationkey AS VARCHAR) AS key, {_FOLDER} AS source_folder, CASE WHEN r_regionkey % 2 = 1 THEN 'A_Main.CSV' ELSE 'a_main.csv' END AS source_file, CASE WHEN r_regionkey = 4 THEN 'CURRENT' ELSE concat(110 + r_regionkey, 'Q', r_regionkey % 4 + 1) END AS source_release, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS row_order FROM nation JOIN region ON n_regionkey = r_regionkey QUALIFY n_nationkey % 5 <> 3")
def provenance(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("source_folder", F.url_decode("source_folder"))
    name, _ = X.release(F.col("source_folder"))
    return rows.select("key", "source_folder", F.element_at(F.split("source_file", "/"), -1).alias("source_file"), name.alias("source_release"), "row_order")


@query("S05_headers", """SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE concat('x', n_nationkey) END AS "name.1", NULL::VARCHAR AS absent FROM nation WHERE n_nationkey % 5 <> 3""")
def headers(spark, sf_dir):
    """Names trimmed, a repeated one numbered, an expected column that is missing added."""
    return with_missing(_rows(spark, sf_dir), ["key", "absent"]).select("key", F.col("`name.1`"), "absent")


# ---- layers ---------------------------------------------------------------------------------------------------

_ORDER_LAYER = T.StructType().add("o_orderkey", T.LongType()).add("day", T.DateType()).add("o_totalprice", T.DoubleType()).add("absent", T.StringType())


@query("S07_typed_layer", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, o_totalprice, NULL::VARCHAR AS absent FROM orders")
def typed_layer(spark, sf_dir):
    """A CSV layer read back typed; dates that are none become null."""
    path = scratch_path(spark, "orders-csv")
    day = F.when(F.col("o_orderkey") % 7 == 0, "no date").otherwise(F.to_date("o_orderdate").cast("string"))
    read(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), "o_totalprice", "o_orderstatus").write.option("header", True).csv(path)
    return X.read_csv_layer(spark, path, _ORDER_LAYER, required=["o_orderkey", "day"])


@query("S08_pruned_scan", "SELECT o_orderkey, o_totalprice FROM orders")
def pruned_scan(spark, sf_dir):
    """Of the wanted columns those that the layer has; Parquet reads no others."""
    return X.read_layer(spark, f"{sf_dir}/orders.parquet", columns=["o_orderkey", "absent", "o_totalprice"])


@query("S09_optional_inputs", "SELECT 'nation' AS input, count(*) AS n FROM nation UNION ALL SELECT 'absent', NULL")
def optional_inputs(spark, sf_dir):
    found = {name: X.optional(spark, f"{sf_dir}/{name}.parquet") for name in ("nation", "absent")}
    return spark.createDataFrame([(name, None if df is None else df.count()) for name, df in found.items()], "input string, n long")


def _regional(spark, sf_dir, regions) -> tuple[str, ...]:
    """Nations of some regions, as names of features; nations are a fixed list."""
    rows = read(spark, sf_dir, "nation").filter(F.col("n_regionkey").isin(*regions)).orderBy("n_nationkey").collect()
    return tuple(r.n_name for r in rows)


@query("S10_config_fallback", "SELECT n_name AS feature, 'fallback' AS source FROM nation WHERE n_regionkey = 1")
def config_fallback(spark, sf_dir):
    """The first path has no contract, the second has."""
    root = scratch_path(spark, "contracts")
    write_contract(spark, Contract("target", _regional(spark, sf_dir, [1])), f"{root}/fallback")
    contract, path = load_contract(spark, f"{root}/own", f"{root}/fallback")
    return spark.createDataFrame([(f, path.rsplit("/", 1)[1]) for f in contract.numeric_features], "feature string, source string")


@query("S11_dual_sink", "SELECT 'good' AS layer, 'parquet' AS format, 'ok' AS status, count(*) AS n FROM customer UNION ALL SELECT 'good', 'csv', 'ok', count(*) FROM customer UNION ALL SELECT 'bad', 'parquet', 'failed', NULL FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'bad', 'csv', 'ok', count(*) FROM customer")
def dual_sink(spark, sf_dir):
    """Parquet as far as it can be written, CSV always, and what became of both."""
    root, rows = scratch_path(spark, "sinks"), read(spark, sf_dir, "customer")
    status = X.write_both(rows, f"{root}/good").unionByName(X.write_both(rows, f"{root}/bad", compression="none-such"))
    counts = []
    for r in status.collect():  # two rows a layer
        n = None if r.status == "failed" else (spark.read.parquet(r.path) if r.format == "parquet" else spark.read.option("header", True).csv(r.path)).count()
        counts.append((r.path.rsplit("/", 1)[1].split(".")[0], r.format, r.status, n))
    return spark.createDataFrame(counts, "layer string, format string, status string, n long")


class Letters:
    """Vectors of how often each of some letters is in a text."""

    def __init__(self, letters: str):
        self.letters = letters

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(x)) for x in self.letters] for t in texts]


_LETTERS_SQL = lambda text, letters: "concat_ws(',', " + ", ".join(f"length({text}) - length(replace({text}, '{x}', ''))" for x in letters) + ")"


@query("S12_vector_cache", f"""SELECT c_custkey, {_LETTERS_SQL('c_mktsegment', 'AEIOU')} AS first, {_LETTERS_SQL('c_mktsegment', 'ST')} AS second, {_LETTERS_SQL('c_mktsegment', 'AEIOU')} AS own, CAST(n AS BIGINT) AS cached, 2::BIGINT AS tables
 FROM customer, (SELECT 2 * count(DISTINCT c_mktsegment) AS n FROM customer)""")
def vector_cache(spark, sf_dir):
    """Two models in one cache, each with vectors of its own, for each text
    once; and vectors of whole tables, which hold for the same rows in the same
    order only: the second call finds those of the first, the third does not."""
    cache, rows = scratch_path(spark, "vectors"), read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    vector = lambda name: F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias(name)
    V.embed_cached(rows.limit(5), "c_mktsegment", lambda: Letters("AEIOU"), cache, "vowels").count()
    one = V.embed_cached(rows, "c_mktsegment", lambda: Letters("AEIOU"), cache, "vowels").select("c_custkey", vector("first"))
    two = V.embed_cached(rows, "c_mktsegment", lambda: Letters("ST"), cache, "others").select("c_custkey", vector("second"))
    tables = scratch_path(spark, "tables")
    turned = rows.withColumn("place", -F.col("c_custkey"))
    found = [V.embed_table(df, "c_custkey", "c_mktsegment", [order], lambda: Letters("AEIOU"), tables) for df, order in ((rows, "c_custkey"), (rows, "c_custkey"), (turned, "place"))]
    paths = len({df.inputFiles()[0].rsplit("/", 2)[1] for df in found})
    out = one.join(two, "c_custkey").join(found[1].select("c_custkey", vector("own")), "c_custkey")
    return out.withColumns({"cached": F.lit(spark.read.parquet(cache).count()), "tables": F.lit(paths).cast("long")})


@query("S13_json_sink", "SELECT n_name AS district, CAST(count(*) AS BIGINT) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def json_sink(spark, sf_dir):
    """A small summary written as one document and read again."""
    path = scratch_path(spark, "summary")
    counts = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").count().collect()  # nations
    X.save_json(spark, {r["n_name"]: r["count"] for r in counts}, path)
    return spark.createDataFrame(list(X.load_json(spark, path)[0].items()), "district string, customers long")


@query("S14_markdown", "SELECT '| r_regionkey | r_name |' AS line UNION ALL SELECT '|---|---|' UNION ALL SELECT concat('| ', r_regionkey, ' | ', r_name, ' |') FROM region")
def markdown(spark, sf_dir):
    lines = X.markdown(read(spark, sf_dir, "region").select("r_regionkey", "r_name")).split("\n")
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("S15_model_file", f"WITH {SALES_SQL}, m AS (SELECT avg(area) AS mx, avg(price) AS my, covar_pop(area, price) / var_pop(area) AS slope FROM sales WHERE area IS NOT NULL) SELECT sale_id, round(my + slope * (area - mx), 3) AS predicted FROM sales, m WHERE area IS NOT NULL")
def model_file(spark, sf_dir):
    """A fitted pipeline saved, loaded and applied: a line through area and price."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from tidemark.operators import models as M

    rows = sales(spark, sf_dir).select("sale_id", "area", "price").filter("area IS NOT NULL")
    path = scratch_path(spark, "model")
    assembled = VectorAssembler(inputCols=["area"], outputCol="features")
    M.save_model([assembled, LinearRegression(labelCol="price", solver="normal").fit(assembled.transform(rows))], path)
    return M.load_model(path).transform(rows).select("sale_id", F.round("prediction", 3).alias("predicted"))


_FOLD_BOUNDS = T.StructType().add("n_nationkey", T.IntegerType()).add("train_start", T.DateType()).add("train_end", T.DateType()).add("valid_start", T.DateType()).add("valid_end", T.DateType()).add("test_start", T.DateType()).add("test_end", T.DateType())
_BOUND = "DATE '2019-01-01' + CAST(n_nationkey * 91 + {n} AS INTEGER)"


@query("S16_fold_scan", "SELECT n_nationkey, " + ", ".join(f"{_BOUND.format(n=n)} AS {c}" for c, n in zip(_FOLD_BOUNDS.names[1:], (0, 1094, 1095, 1276, 1277, 1367))) + " FROM nation")
def fold_scan(spark, sf_dir):
    """Six date bounds, stored as text, read as dates."""
    path = scratch_path(spark, "folds")
    bounds = {c: F.date_add(F.lit("2019-01-01").cast("date"), F.col("n_nationkey") * 91 + n).cast("string") for c, n in zip(_FOLD_BOUNDS.names[1:], (0, 1094, 1095, 1276, 1277, 1367))}
    X.write_layer(read(spark, sf_dir, "nation").select("n_nationkey").withColumns(bounds), path, f"{path}.csv")
    return X.read_csv_layer(spark, f"{path}.csv", _FOLD_BOUNDS, required=_FOLD_BOUNDS.names)


@query("S17_result_csv", f"WITH {_BASELINES} SELECT fold_id, split, sale_id, round(y_pred, 4) AS y_pred FROM pred WHERE model_name = 'district'")
def result_csv(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    rows = predictions(spark, sf_dir).filter("model_name = 'district'").select("fold_id", "split", "sale_id", "y_pred")
    X.write_layer(rows, path, f"{path}.csv")
    schema = T.StructType().add("fold_id", T.IntegerType()).add("split", T.StringType()).add("sale_id", T.LongType()).add("y_pred", T.DoubleType())
    return X.read_csv_layer(spark, f"{path}.csv", schema).withColumn("y_pred", F.round("y_pred", 4))


@query("S18_contract_sinks", "SELECT place, n_name AS feature FROM nation, (SELECT unnest(['root', 'report']) AS place) WHERE n_regionkey = 2")
def contract_sinks(spark, sf_dir):
    """A derived contract in two places, both read again."""
    root = scratch_path(spark, "contract-sinks")
    write_contract(spark, Contract("target", _regional(spark, sf_dir, [2])), f"{root}/root", f"{root}/report")
    rows = [(place, f) for place in ("root", "report") for f in load_contract(spark, f"{root}/{place}")[0].numeric_features]
    return spark.createDataFrame(rows, "place string, feature string")


# ---- projections and filters ----------------------------------------------------------------------------------


@query("P18_prediction_table", "SELECT event_id, event_id % 5 + 1.0 AS y_true, event_id % 7 + 0.5 AS y_pred, abs(event_id % 7 + 0.5 - (event_id % 5 + 1.0)) AS abs_error, round(abs(event_id % 7 + 0.5 - (event_id % 5 + 1.0)) / (event_id % 5 + 1.0) * 100, 6) AS ape FROM events")
def prediction_table(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5 + 1.0).alias("y_true"), (F.col("event_id") % 7 + 0.5).alias("y_pred"))
    return E.prediction_table(rows).select("event_id", "y_true", "y_pred", "abs_error", F.round("ape", 6).alias("ape"))


@query("P19_half_even", "SELECT l_orderkey, l_linenumber, (n - r + CASE WHEN r > 16 OR (r = 16 AND ((n - r) // 32) % 2 = 1) THEN 32 ELSE 0 END) / 32 / 10000.0 AS rounded FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 10000 AS n, (CAST(l_quantity AS BIGINT) * 10000) % 32 AS r FROM lineitem)")
def half_even(spark, sf_dir):
    """Four places, halves to the even neighbour; quantities over 32 have many halves."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 32).alias("rounded"))
    return E.round_half_even(rows, ["rounded"], 4)


@query("F09_one_model", f"WITH {_BASELINES} SELECT fold_id, sale_id, round(y_pred, 4) AS y_pred FROM pred WHERE model_name = 'combo' AND split = 'test'")
def one_model(spark, sf_dir):
    """The predictions of one model and split; none is an error."""
    rows = E.select_predictions(predictions(spark, sf_dir), "combo", "test")
    return rows.select("fold_id", "sale_id", F.round("y_pred", 4).alias("y_pred"))


@query("F01_invalid_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 11 NOT IN (0, 1, 2)")
def invalid_rows(spark, sf_dir):
    """Repeated headers, rows of Latin words and rows without date and prices go."""
    k = F.col("編號").cast("long") % 11
    raw = raw_housing(spark, sf_dir)
    dirty = raw.withColumns({
        "鄉鎮市區": F.when(k == 0, " 鄉鎮市區").otherwise(F.col("鄉鎮市區")), "交易標的": F.when(k == 1, "transaction sign").otherwise(F.col("交易標的")),
        "交易年月日": F.when(k == 2, "1141332").otherwise(F.col("交易年月日")), "總價元": F.when(k == 2, "--").when(k == 3, "").otherwise(F.col("總價元")), "單價元平方公尺": F.when(k == 2, "").otherwise(F.col("單價元平方公尺")),
    })
    return C.drop_invalid(dirty).select(F.col("編號").alias("id"))


_FAMILIES = {"abnormal_transaction_flag": C.ABNORMAL_WORDS, "physical_condition_flag": C.PHYSICAL_WORDS, "renovation_flag": C.RENOVATION_WORDS, "broad_note_flag": C.BROAD_WORDS, "strict_special_note_flag": C.STRICT_WORDS, "special_note_flag": C.ABNORMAL_WORDS, "presale_note_flag": C.PRESALE_WORDS, "separate_registration_flag": C.SEPARATE_WORDS}
_WORDS = tuple(dict.fromkeys(w for words in _FAMILIES.values() for w in words))
_NOTE_SQL = f"CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('之', [{', '.join(repr(w) for w in _WORDS)}][o_orderkey % {len(_WORDS)} + 1], '者') END"


@query("P09_keyword_flags", f"SELECT CAST(o_orderkey AS VARCHAR) AS id, {', '.join(f'CAST({" OR ".join(f"contains(note, {w!r})" for w in words)} AS INTEGER) AS {name}' for name, words in _FAMILIES.items())} FROM (SELECT o_orderkey, {_NOTE_SQL} AS note FROM orders)")
def keyword_flags(spark, sf_dir):
    """All eight families of note flags, over notes with each of their words."""
    k = F.col("編號").cast("long")
    note = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("之"), F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (k % len(_WORDS) + 1).cast("int")), F.lit("者")))
    return C.derive_features(raw_housing(spark, sf_dir).withColumn("備註", note)).select("id", *_FAMILIES)


_AREA = "(k % 700 + 1) / 3.305785"
_LINES = [
    ("行政區", "concat('區', k % 12)"), ("建物型態", "CASE k % 6 WHEN 0 THEN '透天厝' WHEN 1 THEN '公寓' WHEN 2 THEN '缺失' ELSE '住宅大樓' END"), ("主要建材", "'缺失'"),
    ("屋齡", "concat(CASE WHEN k % 13 <> 0 THEN printf('%.2f', (k % 20) * 400 / 365.25) ELSE '缺失' END, ' 年')"), ("建物坪數", f"concat(printf('%.2f', {_AREA}), ' 坪')"), ("主建物坪數", "'缺失 坪'"),
    ("樓層", "concat(CASE WHEN k % 9 = 0 THEN '-1' WHEN k % 7 = 0 THEN '3' WHEN k % 4 = 0 THEN '缺失' ELSE '12' END, ' / ', CASE WHEN k % 3 <> 0 THEN '15' ELSE '缺失' END)"),
    ("樓層比例", "CASE WHEN k % 3 = 0 THEN '缺失' WHEN k % 9 = 0 THEN '-0.07' WHEN k % 7 = 0 THEN '0.20' WHEN k % 4 = 0 THEN '缺失' ELSE '0.80' END"),
    ("格局", "concat(k % 14, ' 房 ', k % 7, ' 廳 2 衛')"), ("車位", "CASE WHEN k % 10 = 0 OR k % 15 = 1 THEN '有' ELSE '無' END"), ("車位面積", "CASE WHEN k % 15 = 1 THEN '12.50' ELSE '0.00' END"),
    ("管理組織", "'缺失'"), ("電梯", "CASE k % 3 WHEN 0 THEN '有' WHEN 1 THEN '無' ELSE '缺失' END"), ("房屋狀態備註標記", "'0'"), ("裝潢標記", "CASE WHEN k % 17 = 2 THEN '1' ELSE '0' END"), ("廣泛備註標記", "'0'"),
    ("地址", "'缺失'"), ("備註", "CASE k % 17 WHEN 0 THEN '親友間交易' WHEN 1 THEN '預售屋' WHEN 2 THEN '裝潢費' ELSE '缺失' END"),
]
_BODY = lambda n: ", chr(10), ".join(f"'{label}：', {value}" for label, value in _LINES[:n])


@query("P16_text_serialise", f"SELECT CAST(k AS VARCHAR) AS id, concat({_BODY(16)}) AS body, concat({_BODY(18)}) AS with_options FROM (SELECT o_orderkey AS k FROM orders)")
def serialise(spark, sf_dir):
    """Sixteen labelled lines, and the same with address and note."""
    rows = C.derive_features(raw_housing(spark, sf_dir))
    rows = rows.select("id", S.sale_text().alias("body"), "address_raw", "note_raw")
    return rows.select("id", "body", S.sale_text(address=True, note=True, body=F.col("body")).alias("with_options"))


# ---- contracts and gates --------------------------------------------------------------------------------------


@query("Q01_leakage_sets", "SELECT concat(n_name, ' is not a feature') AS problem FROM nation WHERE n_regionkey IN (1, 2) AND (n_regionkey = 2 OR n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1)) UNION ALL SELECT concat(n_name, ' is named twice') FROM nation WHERE n_regionkey = 1 AND n_nationkey = (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 1)")
def leakage_sets(spark, sf_dir):
    """Leakage columns, the target and repeated names among the features."""
    one, two = _regional(spark, sf_dir, [1]), _regional(spark, sf_dir, [2])
    bad = Contract(one[0], one, (*two, one[-1]), leakage_cols=two)
    return spark.createDataFrame([(p,) for p in bad.problems()], "problem string")


@query("Q02_contract_versions", """WITH v1 AS (SELECT n_name FROM nation WHERE n_regionkey IN (0, 1)), v2 AS (SELECT n_name FROM v1 UNION SELECT n_name FROM nation WHERE n_regionkey IN (1, 2))
 SELECT 'v1' AS version, n_name AS feature FROM v1 UNION ALL SELECT 'v2', n_name FROM v2 UNION ALL SELECT 'v3', n_name FROM v2 WHERE NOT starts_with(n_name, 'I') UNION ALL SELECT 'v3', n_name FROM nation WHERE n_regionkey = 3""")
def contract_versions(spark, sf_dir):
    """Features of a contract, of it extended, and of it with a family replaced."""
    one = Contract("target", _regional(spark, sf_dir, [0, 1]), leakage_cols=("total_price",))
    two = one.extend(_regional(spark, sf_dir, [1, 2]), "more nations")
    three = two.substitute("I", _regional(spark, sf_dir, [3]))
    return spark.createDataFrame([(v, f) for v, c in (("v1", one), ("v2", two), ("v3", three)) for f in c.numeric_features], "version string, feature string")


_FLAGS = {"abnormal_transaction_flag": "k % 17 = 0", "presale_note_flag": "k < 0", "area_outlier_flag": "k % 700 > 600", "is_basement": "k % 9 = 0", "has_elevator": "k < 0", "renovation_flag": "k % 17 = 2"}
_DERIVABLE = ("area", "stands", "total_price", "abnormal_transaction_flag", "presale_note_flag", "area_outlier_flag", "has_elevator")


@query("Q04_derived_contract", f"""WITH r AS (SELECT o_totalprice AS price, o_shippriority AS area FROM (SELECT o_totalprice, o_orderkey % 50 AS o_shippriority, o_orderkey AS k FROM orders)), f AS (SELECT {', '.join(f'max(CAST({x} AS INTEGER)) AS {c}, min(CAST({x} AS INTEGER)) AS {c}_low' for c, x in _FLAGS.items())}, count(DISTINCT k % 50) AS n_area, count(DISTINCT o_orderstatus) AS n_status FROM (SELECT o_orderkey AS k, o_orderstatus FROM orders))
 SELECT feature, kind FROM (SELECT 'area' AS feature, 'numeric' AS kind, n_area > 1 AS kept FROM f UNION ALL SELECT 'o_orderstatus', 'categorical', n_status > 1 FROM f
 UNION ALL {' UNION ALL '.join(f"SELECT '{c}', 'numeric', {c} > {c}_low FROM f" for c in _FLAGS)}) WHERE kept""")
def derived_contract(spark, sf_dir):
    """Features that stand still, flags that are zero throughout and leakage go;
    informative flags come in."""
    k = F.col("o_orderkey")
    flags = {"abnormal_transaction_flag": k % 17 == 0, "presale_note_flag": k < 0, "area_outlier_flag": k % 700 > 600, "is_basement": k % 9 == 0, "has_elevator": k < 0, "renovation_flag": k % 17 == 2}
    table = read(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("price"), F.col("o_totalprice").alias("total_price"), (k % 50).alias("area"), F.lit(1).alias("stands"), "o_orderstatus", *[c.cast("int").alias(n) for n, c in flags.items()])
    still = [r["column"] for r in P.zero_variance(table, table.columns).collect()]  # at most one for each column
    found = Contract("price", _DERIVABLE, ("o_orderstatus", "absent"), leakage_cols=("total_price",)).derive(table, still)
    return spark.createDataFrame([(f, kind) for kind, names in (("numeric", found.numeric_features), ("categorical", found.categorical_features)) for f in names], "feature string, kind string")


@query("M04_reranker", "SELECT a.conv_id, a.turn, round(len(list_intersect(a.w, b.w)) / greatest(1, len(list_distinct(list_concat(a.w, b.w)))), 6) AS score FROM (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')) AS w FROM conversations) a JOIN (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')) AS w FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def reranker(spark, sf_dir):
    """Each turn and the next one, scored by a reranker backend in batches."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return V.score_pairs(turns.join(nxt, ["conv_id", "turn"]), "text", "next", V.OverlapReranker).select("conv_id", "turn", F.round("score", 6).alias("score"))
