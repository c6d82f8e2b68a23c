"""The library's queries over the test tables, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import cleaning as C
from tidemark.operators import evaluation as E
from tidemark.operators import folds as L
from tidemark.operators import profiling as P
from tidemark.operators import trailing as R
from tidemark.plans.sales import SALES_SQL, read, sales
from tidemark.sources.scratch import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names})


# ---- trailing statistics ------------------------------------------------------------------------------------

_WINDOWS = [180, 365]


def _trailing_sql(keys: str) -> str:
    frame = lambda n: f"OVER (PARTITION BY {keys} ORDER BY trade_date RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"
    cols = ", ".join(f"round(median(price) {frame(n)}, 6) AS past_median_{n}d, count(price) {frame(n)} AS past_count_{n}d" for n in _WINDOWS)
    return f"SELECT sale_id, {cols} FROM sales"


def _trailing(spark, sf_dir, keys):
    out = R.trailing_stats(sales(spark, sf_dir), keys, "sale_id", "trade_date", "price", _WINDOWS, "past")
    return rounded(out, "past_median_180d", "past_median_365d")


@query("W01_trailing_district", f"WITH {SALES_SQL} {_trailing_sql('district')}")
def trailing_district(spark, sf_dir):
    return _trailing(spark, sf_dir, ["district"])


@query("W01_trailing_district_kind", f"WITH {SALES_SQL} {_trailing_sql('district, kind')}")
def trailing_district_kind(spark, sf_dir):
    return _trailing(spark, sf_dir, ["district", "kind"])


@query("P12_price_change", f"WITH {SALES_SQL}, t AS ({_trailing_sql('district')}) SELECT sale_id, CASE WHEN past_median_365d > 0 THEN round(past_median_180d / past_median_365d - 1, 6) END AS price_change FROM t")
def price_change(spark, sf_dir):
    t = _trailing(spark, sf_dir, ["district"])
    return t.select("sale_id", F.round(S.change(F.col("past_median_180d"), F.col("past_median_365d")), 6).alias("price_change"))


# ---- scalars ------------------------------------------------------------------------------------------------


@query("X01_era_date_roundtrip", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders")
def era_roundtrip(spark, sf_dir):
    day = F.to_date("o_orderdate")
    era = F.concat((F.year(day) - 1911).cast("string"), F.date_format(day, "MMdd"))
    padded = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("　"), era, F.lit(".0"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("0"), era)).otherwise(era)
    return read(spark, sf_dir, "orders").select("o_orderkey", S.era_date(padded).alias("parsed"))


@query("X02_clean_numeric", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(round(value, 2), 2) END AS number FROM events")
def clean_numeric(spark, sf_dir):
    text = F.concat(F.lit(" "), F.format_number("value", 2), F.lit("　"))
    return read(spark, sf_dir, "events").select("event_id", F.round(S.clean_number(F.when(F.col("event_id") % 5 == 0, "--").otherwise(text)), 2).alias("number"))


_DIGITS = "一二三四五六七八九"


@query("X03_numeral_floor", "SELECT p_partkey, CAST(CASE WHEN p_size % 7 = 0 THEN -p_size ELSE p_size END AS DOUBLE) AS floor_no FROM part")
def numeral_floor(spark, sf_dir):
    n = F.col("p_size")
    ones = F.when(n % 10 > 0, F.substring(F.lit(_DIGITS), n % 10, F.lit(1))).otherwise("")
    tens = F.when(n >= 20, F.substring(F.lit(_DIGITS), F.floor(n / 10).cast("int"), F.lit(1))).otherwise("")
    text = F.concat(F.when(n % 7 == 0, "地下").otherwise(""), tens, F.when(n >= 10, "十").otherwise(""), ones, F.when(n % 2 == 0, "層，二層").otherwise("樓"))
    return read(spark, sf_dir, "part").select("p_partkey", S.floor_number(text).alias("floor_no"))


@query("P01_date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(quarter(o_orderdate) AS INTEGER) AS q, strftime(o_orderdate, '%Y-%m') AS ym, concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS yq FROM orders")
def date_parts(spark, sf_dir):
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.quarter(d).alias("q"), F.date_format(d, "yyyy-MM").alias("ym"), S.year_quarter(d).alias("yq"))


@query("P02_age", "SELECT l_orderkey, l_linenumber, CASE WHEN CAST(o_orderdate AS DATE) <= CAST(l_shipdate AS DATE) THEN round(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 365.25, 6) END AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def age(spark, sf_dir):
    joined = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", F.round(S.age_years(F.to_date("o_orderdate"), F.to_date("l_shipdate")), 6).alias("age"))


@query("P03_units", "SELECT p_partkey, round(p_size / 3.305785, 6) AS ping, round(p_retailprice * 3.305785 / 10000, 6) AS price_ping FROM part")
def units(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_size") / S.M2_PER_PING, 6).alias("ping"), F.round(F.col("p_retailprice") * S.M2_PER_PING / 10000, 6).alias("price_ping"))


@query("P14_price_segment", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 0 THEN 'missing' WHEN l_quantity < 10 THEN '0-10' WHEN l_quantity < 25 THEN '10-25' ELSE '25+' END AS segment FROM lineitem")
def price_segment(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.segment(F.col("l_quantity"), (0, 10, 25), ("0-10", "10-25", "25+")).alias("segment"))


# ---- cleaning -----------------------------------------------------------------------------------------------


def _steps():
    return [C.Step("area", F.col("area") > 50, "more than fifty"), C.Step("kind", F.col("kind") != "MACHINERY", "no machinery"), C.Step("parking", F.col("has_parking") == 0, "none urgent"), C.Step("age", F.col("age").between(2, 8), "age from 2 to 8")]


_CHAIN = ("area > 50", "kind <> 'MACHINERY'", "has_parking = 0", "age BETWEEN 2 AND 8")


@query("F02_filter_chain", f"WITH {SALES_SQL} SELECT sale_id FROM sales WHERE {' AND '.join(_CHAIN)}")
def filter_chain(spark, sf_dir):
    return C.filter_chain(sales(spark, sf_dir), _steps()).select("sale_id")


_AUDIT = " UNION ALL ".join(
    f"SELECT '{n}' AS step, count(*) FILTER ({' AND '.join(_CHAIN[:i]) or 'true'}) AS rows_before, count(*) FILTER ({' AND '.join(_CHAIN[: i + 1])}) AS rows_after, "
    f"count(*) FILTER ({' AND '.join(_CHAIN[:i]) or 'true'}) - count(*) FILTER ({' AND '.join(_CHAIN[: i + 1])}) AS rows_removed FROM sales"
    for i, n in enumerate(("area", "kind", "parking", "age"))
)


@query("A12_filter_audit", f"WITH {SALES_SQL} {_AUDIT}")
def audit(spark, sf_dir):
    return C.filter_audit(sales(spark, sf_dir), _steps()).drop("description")


@query("F03_quantile_trim", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS a, quantile_cont(o_totalprice, 0.99) AS b FROM orders) SELECT o_orderkey FROM orders, q WHERE o_totalprice BETWEEN a AND b")
def quantile_trim(spark, sf_dir):
    return C.quantile_trim(read(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey")


@query("W02_dedup_keep_last", "SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents) WHERE n = 1")
def dedup(spark, sf_dir):
    # By digest: the texts themselves do not decide where rows go.
    return C.keep_last(read(spark, sf_dir, "documents"), F.sha2("text", 256), [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "text")


@query("U01_union", "SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS segment FROM customer WHERE false UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def union(spark, sf_dir):
    from tidemark.sources.files import union_all

    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return union_all([a, b])


@query("U02_distinct_pairs", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def distinct_pairs(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus").distinct()


# ---- comparables --------------------------------------------------------------------------------------------


def _pairs_sql(window: int, k: int = 10) -> str:
    return f"""pairs AS (SELECT a.sale_id, b.sale_id AS c_sale_id, b.price AS c_price, a.area, b.area AS c_area, a.age, b.age AS c_age, a.trade_date - b.trade_date AS days_diff, b.trade_date AS c_date,
  round(0.35 * CASE WHEN a.area IS NULL OR b.area IS NULL THEN 0.5 ELSE abs(b.area - a.area) / greatest(a.area, 1.0) END + 0.25 * coalesce(abs(b.age - a.age) / 50.0, 0.5)
    + 0.20 * ((a.trade_date - b.trade_date) / {float(window)}::DOUBLE) + 0.10 * coalesce(abs(b.floor_ratio - a.floor_ratio), 0.5) + 0.10 * CASE WHEN a.has_parking = b.has_parking THEN 0.0 ELSE 1.0 END, 9) AS distance
  FROM sales a JOIN sales b ON a.district IS NOT DISTINCT FROM b.district AND a.kind IS NOT DISTINCT FROM b.kind AND b.trade_date BETWEEN a.trade_date - {window} AND a.trade_date - 1 WHERE b.price IS NOT NULL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sale_id ORDER BY distance, c_date DESC, c_sale_id) AS rank FROM pairs) WHERE rank <= {k})"""


_SUMMARY = """, stats AS (SELECT sale_id, count(*) AS comp_count, median(c_price) AS comp_median_price, avg(c_price) AS comp_mean_price,
  sum(c_price / (distance + 1e-6)) / sum(1 / (distance + 1e-6)) AS comp_weighted_mean_price, stddev_pop(c_price) AS comp_std_price, min(c_price) FILTER (rank = 1) AS comp_nearest_price,
  min(distance) AS comp_nearest_distance, median(distance) AS comp_median_distance, median(days_diff) AS comp_median_days_diff,
  median(CASE WHEN area IS NOT NULL AND c_area IS NOT NULL THEN abs(c_area - area) / greatest(area, 1.0) END) AS comp_median_area_diff_pct, median(abs(c_age - age)) AS comp_median_age_diff FROM top GROUP BY 1)
SELECT sales.sale_id, coalesce(comp_count, 0) AS comp_count, round(comp_median_price, 4) AS comp_median_price, round(comp_mean_price, 6) AS comp_mean_price, round(comp_weighted_mean_price, 3) AS comp_weighted_mean_price,
  round(comp_std_price, 3) AS comp_std_price, comp_nearest_price, round(comp_nearest_distance, 6) AS comp_nearest_distance, round(comp_median_distance, 6) AS comp_median_distance, comp_median_days_diff,
  round(comp_median_area_diff_pct, 6) AS comp_median_area_diff_pct, round(comp_median_age_diff, 8) AS comp_median_age_diff FROM sales LEFT JOIN stats USING (sale_id)"""


def _summary(spark, sf_dir, window):
    out = R.comparable_summary(sales(spark, sf_dir), ["district", "kind"], window)
    out = rounded(rounded(out, "comp_mean_price"), "comp_median_price", places=4)
    out = rounded(out, "comp_weighted_mean_price", "comp_std_price", places=3)
    return rounded(rounded(out, "comp_nearest_distance", "comp_median_distance", "comp_median_area_diff_pct"), "comp_median_age_diff", places=8)


@query("J02_comparable_365", f"WITH {SALES_SQL}, {_pairs_sql(365)} {_SUMMARY}")
def comparable_365(spark, sf_dir):
    return _summary(spark, sf_dir, 365)


@query("J02_comparable_730", f"WITH {SALES_SQL}, {_pairs_sql(730)} {_SUMMARY}")
def comparable_730(spark, sf_dir):
    return _summary(spark, sf_dir, 730)


@query("T02_topk_pairs", f"WITH {SALES_SQL}, {_pairs_sql(365, 3)} SELECT sale_id, c_sale_id, rank, round(distance, 6) AS distance FROM top")
def topk_pairs(spark, sf_dir):
    top = R.comparable_pairs(sales(spark, sf_dir), ["district", "kind"], 365, 3, also=())
    return top.select("sale_id", "c_sale_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query("Q05_leakage", f"""WITH {SALES_SQL}, {_pairs_sql(365)}, both_ways AS (SELECT 'as found' AS pairs_of, sale_id, c_sale_id FROM top UNION ALL SELECT 'turned around', c_sale_id, sale_id FROM top),
 judged AS (SELECT pairs_of, b.trade_date AS other, a.trade_date AS own FROM both_ways JOIN sales a USING (sale_id) JOIN sales b ON b.sale_id = both_ways.c_sale_id)
 SELECT pairs_of, count(*) AS pairs, count(*) FILTER (other >= own) AS violations, CASE WHEN count(*) FILTER (other >= own) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM judged GROUP BY 1""")
def leakage(spark, sf_dir):
    """The pairs joined to the sales' own dates again, and judged by these; the
    same pairs turned around are all violations."""
    rows = written(sales(spark, sf_dir), "sales")  # read for the pairs and for both joins
    top = R.comparable_pairs(rows, ["district", "kind"], 365, also=()).select("sale_id", "c_sale_id")
    top = written(top, "pairs")  # read twice
    turned = top.select(F.col("c_sale_id").alias("sale_id"), F.col("sale_id").alias("c_sale_id"), F.lit("turned around").alias("pairs_of"))
    own = rows.select("sale_id", F.col("trade_date").alias("own_day"))
    other = rows.select(F.col("sale_id").alias("c_sale_id"), F.col("trade_date").alias("other_day"))
    both = top.withColumn("pairs_of", F.lit("as found")).unionByName(turned)
    return P.leakage_check(both.join(own, "sale_id").join(other, "c_sale_id"), "own_day", "other_day", "pairs_of")


# ---- vectors ------------------------------------------------------------------------------------------------

_VECTOR_SQL = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, DATE '2020-01-01' + CAST(vec_id AS INTEGER) AS day, (vec_id * 37 % 101)::DOUBLE AS price, CASE WHEN vec_id % 7 <> 0 THEN (vec_id * 13 % 47)::DOUBLE END AS area, CASE WHEN vec_id % 5 <> 0 THEN (vec_id * 11 % 31)::DOUBLE END AS age FROM embeddings),
pairs AS (SELECT a.vec_id, b.vec_id AS c_vec_id, b.price AS c_price, a.area, b.area AS c_area, a.age, b.age AS c_age, a.day - b.day AS days_diff, b.day AS c_day,
  round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / greatest(sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x))), 1e-6), 9) AS similarity
  FROM v a JOIN v b ON a.label = b.label AND b.day BETWEEN a.day - 200 AND a.day - 1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, c_day, c_vec_id) AS rank FROM pairs) WHERE rank <= 10)"""


def _vectors(spark, sf_dir):
    k = F.col("vec_id")
    v = read(spark, sf_dir, "embeddings").withColumns({"day": F.expr("date_add(DATE '2020-01-01', CAST(vec_id AS INT))"), "price": (k * 37 % 101).cast("double"), "area": F.when(k % 7 != 0, (k * 13 % 47).cast("double")), "age": F.when(k % 5 != 0, (k * 11 % 31).cast("double"))})
    return R.vector_pairs(v, ["label"], "vec_id", "day", "embedding", 200, 10, ["price", "area", "age"])


@query("J03_cosine_topk", f"WITH {_VECTOR_SQL} SELECT vec_id, c_vec_id, rank, round(similarity, 6) AS similarity FROM top")
def cosine_topk(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", "c_vec_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


def _fourteen_sql(source: str, weight: str, first: str, score: str) -> str:
    scores = "round(avg(score), 6) AS emb_mean_reranker_score, round(max(score), 6) AS emb_max_reranker_score" if score else "NULL::DOUBLE AS emb_mean_reranker_score, NULL::DOUBLE AS emb_max_reranker_score"
    return f"""SELECT vec_id, count(*) AS emb_count, median(c_price) AS emb_median_price, round(avg(c_price), 6) AS emb_mean_price,
 round(sum({weight} * c_price) / sum({weight}), 5) AS emb_weighted_mean_price, round(stddev_pop(c_price), 6) AS emb_std_price, min(c_price) FILTER ({first} = 1) AS emb_nearest_price,
 round(max(similarity), 6) AS emb_max_similarity, round(avg(similarity), 6) AS emb_mean_similarity, round(median(similarity), 6) AS emb_median_similarity, {scores}, median(days_diff) AS emb_median_days_diff,
 round(median(CASE WHEN area IS NOT NULL AND c_area IS NOT NULL THEN abs(c_area - area) / greatest(area, 1.0) END), 6) AS emb_median_area_diff_pct, median(abs(c_age - age)) AS emb_median_age_diff FROM {source} GROUP BY 1"""


def _fourteen(pairs, reranked):
    out = R.vector_summary(pairs, "vec_id", "c_price", reranked)
    return rounded(rounded(out, "emb_mean_price", "emb_std_price", "emb_max_similarity", "emb_mean_similarity", "emb_median_similarity", "emb_mean_reranker_score", "emb_max_reranker_score", "emb_median_area_diff_pct"), "emb_weighted_mean_price", places=5)


@query("A21_vector_summary", f"WITH {_VECTOR_SQL} {_fourteen_sql('top', '(greatest(similarity, 0) + 1e-6)', 'rank', '')}")
def vector_summary(spark, sf_dir):
    """Fourteen statistics, weighted by similarity."""
    return _fourteen(_vectors(spark, sf_dir), False)


_RERANKED_SQL = """s AS (SELECT *, (50 - abs(c_price - 50)) / 10 AS score FROM top), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, rank) AS score_rank FROM s) WHERE score_rank <= 5), m AS (SELECT *, exp(score - max(score) OVER (PARTITION BY vec_id)) AS weight FROM r)"""


@query("A21_reranked_summary", f"WITH {_VECTOR_SQL}, {_RERANKED_SQL} {_fourteen_sql('m', 'weight', 'score_rank', 'score')}")
def reranked_summary(spark, sf_dir):
    """The same of the five best by another score, weighted by its softmax."""
    return _fourteen(R.rerank(_vectors(spark, sf_dir), "vec_id", (50 - F.abs(F.col("c_price") - 50)) / 10, 5), True)


@query("W07_softmax", f"""WITH {_VECTOR_SQL}, s AS (SELECT *, -abs(c_price - 50) / 10 AS score FROM top), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, rank) AS score_rank FROM s) WHERE score_rank <= 5)
 SELECT vec_id, c_vec_id, round(exp(score - max(score) OVER (PARTITION BY vec_id)) / sum(exp(score - m)) OVER (PARTITION BY vec_id), 6) AS weight FROM (SELECT *, max(score) OVER (PARTITION BY vec_id) AS m FROM r)""")
def softmax(spark, sf_dir):
    best = R.rerank(_vectors(spark, sf_dir), "vec_id", -F.abs(F.col("c_price") - 50) / 10, 5)
    return best.select("vec_id", "c_vec_id", F.round(R.softmax("score", "_g", "_slice", "vec_id"), 6).alias("weight"))


# ---- folds and baselines ------------------------------------------------------------------------------------

RULE = L.FoldRule(first_day="1995-01-01", least_train=100, least_valid=50, least_test=20)
_FOLD_SQL = """lim AS (SELECT min(trade_date) AS lo, max(trade_date) AS hi FROM sales WHERE trade_date >= DATE '1995-01-01'),
qs AS (SELECT date_trunc('quarter', lo)::DATE AS q0, CASE WHEN hi < (date_trunc('quarter', hi) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE THEN (date_trunc('quarter', hi) - INTERVAL 3 MONTH)::DATE ELSE date_trunc('quarter', hi)::DATE END AS q1 FROM lim),
cand AS (SELECT row_number() OVER (ORDER BY s) AS candidate_id, s::DATE AS train_start, (s + INTERVAL 3 YEAR - INTERVAL 1 DAY)::DATE AS train_end, (s + INTERVAL 3 YEAR)::DATE AS valid_start, (s + INTERVAL 42 MONTH - INTERVAL 1 DAY)::DATE AS valid_end,
  (s + INTERVAL 42 MONTH)::DATE AS test_start, (s + INTERVAL 45 MONTH - INTERVAL 1 DAY)::DATE AS test_end FROM (SELECT unnest(generate_series(q0::TIMESTAMP, (q1 - INTERVAL 42 MONTH)::TIMESTAMP, INTERVAL 3 MONTH)) AS s FROM qs)),
cnt AS (SELECT cand.*, (SELECT count(*) FROM sales WHERE trade_date BETWEEN train_start AND train_end) AS train_rows, (SELECT count(*) FROM sales WHERE trade_date BETWEEN valid_start AND valid_end) AS valid_rows,
  (SELECT count(*) FROM sales WHERE trade_date BETWEEN test_start AND test_end) AS test_rows FROM cand),
gate AS (SELECT *, concat_ws('; ', CASE WHEN train_rows < {train} THEN 'train_rows < {train}' END, CASE WHEN valid_rows < {valid} THEN 'valid_rows < {valid}' END, CASE WHEN test_rows < {test} THEN 'test_rows < {test}' END) AS exclusion_reason FROM cnt),
folds AS (SELECT *, CASE WHEN exclusion_reason = '' THEN CAST(count(*) FILTER (exclusion_reason = '') OVER (ORDER BY candidate_id) AS INTEGER) END AS fold_id FROM gate)"""
_FOLDS = f"{SALES_SQL}, {_FOLD_SQL.format(train=100, valid=50, test=20)}"
_MEMBERS = f"""{_FOLDS}, members AS (SELECT fold_id, split, sale_id, district, kind, price, trade_date FROM sales JOIN (
  SELECT fold_id, 'train' AS split, train_start AS lo, train_end AS hi FROM folds UNION ALL SELECT fold_id, 'valid', valid_start, valid_end FROM folds UNION ALL SELECT fold_id, 'test', test_start, test_end FROM folds) b
  ON trade_date BETWEEN lo AND hi WHERE fold_id IS NOT NULL)"""
_BASELINES = f"""{_MEMBERS}, m0 AS (SELECT fold_id, median(price) AS m FROM members WHERE split = 'train' GROUP BY 1), m1 AS (SELECT fold_id, district, median(price) AS m FROM members WHERE split = 'train' GROUP BY 1, 2),
m2 AS (SELECT fold_id, district, kind, median(price) AS m FROM members WHERE split = 'train' GROUP BY 1, 2, 3),
pred AS (SELECT fold_id, split, sale_id, district, kind, trade_date, price AS y_true, u.model_name, CASE u.model_name WHEN 'global' THEN m0.m WHEN 'district' THEN coalesce(m1.m, m0.m) ELSE coalesce(m2.m, m1.m, m0.m) END AS y_pred
  FROM members JOIN m0 USING (fold_id) LEFT JOIN m1 USING (fold_id, district) LEFT JOIN m2 USING (fold_id, district, kind), (SELECT unnest(['global', 'district', 'combo']) AS model_name) u WHERE split <> 'train')"""


def _members(spark, sf_dir):
    return L.membership(sales(spark, sf_dir), "trade_date", RULE, ["sale_id", "district", "kind", "price", "trade_date"])


def predictions(spark, sf_dir, only=None):
    levels = {"global": [], "district": ["district"], "combo": ["district", "kind"]}
    levels = {only: levels[only]} if only else levels
    columns = ["sale_id", "district", "kind", "price", "trade_date"]
    rows, bounds = L.dealt(sales(spark, sf_dir), "trade_date", RULE, columns)
    # Folds begin and end with quarters, so rows are counted by quarter before they are repeated for each fold.
    train = rows.select(F.trunc("trade_date", "quarter").alias("quarter"), "district", "kind", "price", F.lit(1).alias("_n"))
    learning = bounds.filter("split = 'train'")
    deal = lambda counts: L.among(counts, learning, "quarter", [c for c in counts.columns if c != "quarter"]).drop("split")
    others = L.among(rows, bounds.filter("split <> 'train'"), "trade_date", columns)
    return E.median_baselines(others, levels, "price", [c for c in columns if c != "price"], train, deal)


@query("F12_quarters", f"WITH {_FOLDS} SELECT CAST(year(q) AS INTEGER) AS y, CAST(quarter(q) AS INTEGER) AS q FROM (SELECT unnest(generate_series(q0::TIMESTAMP, q1::TIMESTAMP, INTERVAL 3 MONTH)) AS q FROM qs)")
def quarters(spark, sf_dir):
    found = L.usable_quarters(sales(spark, sf_dir), "trade_date", RULE)
    return spark.createDataFrame([(q // 4, q % 4 + 1) for q in found], "y int, q int")


@query("A04_period_histogram", f"WITH {SALES_SQL} SELECT CAST(year(trade_date) AS INTEGER) AS y, CAST(quarter(trade_date) AS INTEGER) AS q, count(*) AS n FROM sales GROUP BY 1, 2")
def histogram(spark, sf_dir):
    return sales(spark, sf_dir).groupBy(F.year("trade_date").alias("y"), F.quarter("trade_date").alias("q")).agg(F.count("*").alias("n"))


@query("Q07_fold_gate", f"WITH {SALES_SQL}, {_FOLD_SQL.format(train=1000, valid=1100, test=540)} SELECT CAST(candidate_id AS INTEGER) AS candidate_id, fold_id, train_start, train_end, valid_start, valid_end, test_start, test_end, train_rows, valid_rows, test_rows, exclusion_reason FROM folds")
def fold_gate(spark, sf_dir):
    return L.fold_counts(sales(spark, sf_dir), "trade_date", L.FoldRule(first_day="1995-01-01", least_train=1000, least_valid=1100, least_test=540))


@query("J05_folds", f"WITH {_MEMBERS} SELECT fold_id, split, sale_id FROM members")
def fold_members(spark, sf_dir):
    return _members(spark, sf_dir).select("fold_id", "split", "sale_id")


@query("F13_low_districts", f"WITH {_MEMBERS} SELECT fold_id, district, count(*) AS n FROM members WHERE split = 'test' GROUP BY 1, 2 HAVING count(*) < 30")
def low_districts(spark, sf_dir):
    return L.low_count_groups(_members(spark, sf_dir), "district")


def _baseline(name):
    def run(spark, sf_dir):
        rows = predictions(spark, sf_dir, name)
        return rows.select("fold_id", "split", "sale_id", F.round("y_pred", 4).alias("y_pred"))

    return run


for _model in ("global", "district", "combo"):
    query("J09_fallback" if _model == "combo" else f"M10_{_model}", f"WITH {_BASELINES} SELECT fold_id, split, sale_id, round(y_pred, 4) AS y_pred FROM pred WHERE model_name = '{_model}'")(_baseline(_model))


# ---- evaluation ---------------------------------------------------------------------------------------------


def _metrics_sql(keys: str, source: str = "pred") -> str:
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}count(*) AS n, round(avg(abs(y_pred - y_true)), 6) AS mae, round(sqrt(avg((y_pred - y_true) ^ 2)), 6) AS rmse, round(avg(abs((y_pred - y_true) / y_true) * 100), 6) AS mape, round(median(abs(y_pred - y_true)), 6) AS median_ae,
 round(1 - sum((y_pred - y_true) ^ 2) / (var_pop(y_true) * count(*)), 6) AS r2, round(avg(y_pred - y_true), 6) AS bias FROM {source} {by}"""


_METRICS = ("mae", "rmse", "mape", "median_ae", "bias")


def _metrics(df, *keys):
    return rounded(rounded(E.regression_metrics(df, *keys), *_METRICS, places=6), "r2")


@query("A10_metrics", f"WITH {_BASELINES} {_metrics_sql('model_name, split, fold_id')}")
def metrics(spark, sf_dir):
    return _metrics(predictions(spark, sf_dir), "model_name", "split", "fold_id")


@query("A11_rollup", f"WITH {_BASELINES}, f AS (SELECT model_name, split, fold_id, avg(abs(y_pred - y_true)) AS mae FROM pred GROUP BY ALL) SELECT model_name, split, count(DISTINCT fold_id) AS folds, round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_std FROM f GROUP BY 1, 2")
def rollup(spark, sf_dir):
    return rounded(E.rollup(E.regression_metrics(predictions(spark, sf_dir), "model_name", "split", "fold_id", median=False), ["model_name", "split"], ["mae"]), "mae_mean", "mae_std", places=6)


@query("A13_weighted", f"WITH {_BASELINES}, f AS (SELECT model_name, fold_id, avg(abs(y_pred - y_true)) AS mae, count(*) AS n FROM pred GROUP BY ALL) SELECT model_name, round(sum(mae * n) / sum(n), 6) AS mae FROM f GROUP BY 1")
def weighted(spark, sf_dir):
    by_fold = E.regression_metrics(predictions(spark, sf_dir), "model_name", "fold_id", median=False)
    return by_fold.groupBy("model_name").agg(F.round(E.weighted_mean("mae", "n"), 6).alias("mae"))


_SEGMENT = "CASE WHEN y_true / 2000 < 0 THEN 'missing' WHEN y_true / 2000 < 50 THEN '0-50' WHEN y_true / 2000 < 80 THEN '50-80' WHEN y_true / 2000 < 120 THEN '80-120' ELSE '120+' END"


@query("A14_segments", f"WITH {_BASELINES}, s AS (SELECT *, {_SEGMENT} AS segment FROM pred), m AS ({_metrics_sql('segment', 's')}) SELECT CAST(o AS INTEGER) AS segment_order, segment, coalesce(n, 0) AS n, mae, rmse, mape, median_ae, r2, bias FROM (SELECT unnest(['0-50', '50-80', '80-120', '120+']) AS segment, unnest([0, 1, 2, 3]) AS o) LEFT JOIN m USING (segment)")
def segments(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("v", F.col("y_true") / 2000)
    return rounded(rounded(E.segment_metrics(rows, "v"), *_METRICS, places=6), "r2")


@query("A15_by_group", f"WITH {_BASELINES} {_metrics_sql('district, model_name')}")
def by_group(spark, sf_dir):
    return _metrics(predictions(spark, sf_dir), "district", "model_name")


@query("A16_ic", f"""WITH {_BASELINES}, r AS (SELECT *, rank() OVER (PARTITION BY model_name ORDER BY y_true) + (count(*) OVER (PARTITION BY model_name, y_true) - 1) / 2 AS rx, rank() OVER (PARTITION BY model_name ORDER BY y_pred) + (count(*) OVER (PARTITION BY model_name, y_pred) - 1) / 2 AS ry FROM pred WHERE split = 'test')
 SELECT model_name, count(*) AS n, round(corr(y_true, y_pred), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""")
def ic(spark, sf_dir):
    return rounded(E.rank_correlation(predictions(spark, sf_dir).filter("split = 'test'"), "y_true", "y_pred", "model_name"), "pearson", "spearman")


@query("A17_corr", f"WITH {SALES_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS corr FROM sales" for a, b in (("price", "area"), ("price", "age"), ("price", "floor_ratio"), ("area", "age"), ("area", "floor_ratio"), ("age", "floor_ratio"))))
def corr(spark, sf_dir):
    return rounded(E.correlation_pairs(sales(spark, sf_dir), ["price", "area", "age", "floor_ratio"]), "corr")


@query("A18_share", "SELECT n_name, round(total, 2) AS total, round(total / sum(total) OVER (), 6) AS share, CAST(rank() OVER (ORDER BY total DESC) AS INTEGER) AS rank FROM (SELECT n_name, sum(c_acctbal) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)")
def share(spark, sf_dir):
    joined = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(rounded(E.shares(joined, "n_name", "c_acctbal"), "share"), "total", places=2)


@query("A19_pivot", f"WITH {_BASELINES} SELECT district, round(avg(abs(y_pred - y_true)) FILTER (model_name = 'global'), 6) AS \"global\", round(avg(abs(y_pred - y_true)) FILTER (model_name = 'district'), 6) AS district_model, round(avg(abs(y_pred - y_true)) FILTER (model_name = 'combo'), 6) AS combo FROM pred GROUP BY 1")
def pivot(spark, sf_dir):
    rows = E.with_errors(predictions(spark, sf_dir)).withColumn("m", F.when(F.col("model_name") == "district", "district_model").otherwise(F.col("model_name")))
    return rounded(rows.groupBy("district").pivot("m", ["global", "district_model", "combo"]).agg(F.avg("abs_error")), "global", "district_model", "combo", places=6)


@query("J08_compare", f"WITH {_BASELINES}, f AS (SELECT model_name, split, fold_id, avg(abs(y_pred - y_true)) AS mae FROM pred GROUP BY ALL), a AS (SELECT split, fold_id, mae FROM f WHERE model_name = 'global'), b AS (SELECT split, fold_id, mae FROM f WHERE model_name = 'combo' AND fold_id > 2) SELECT split, fold_id, round(a.mae, 6) AS mae_1, round(b.mae, 6) AS mae_2, round(b.mae - a.mae, 6) AS mae_delta FROM a FULL JOIN b USING (split, fold_id)")
def compare(spark, sf_dir):
    # Written: two of the models are taken from it.
    m = written(E.regression_metrics(predictions(spark, sf_dir), "model_name", "split", "fold_id", median=False), "metrics")
    out = E.compare(m.filter("model_name = 'global'"), m.filter("model_name = 'combo' AND fold_id > 2"), ["split", "fold_id"], ["mae"])
    return rounded(out, "mae_1", "mae_2", "mae_delta", places=6)


@query("T03_top_errors", f"""WITH {_BASELINES}, p AS (SELECT *, y_pred - y_true AS error FROM pred WHERE split = 'test'), r AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY error, sale_id) AS low, row_number() OVER (PARTITION BY model_name ORDER BY error DESC, sale_id) AS high FROM p)
 SELECT model_name, 'under' AS side, sale_id, round(error, 6) AS error FROM r WHERE low <= 50 UNION ALL SELECT model_name, 'over', sale_id, round(error, 6) FROM r WHERE high <= 50""")
def top_errors(spark, sf_dir):
    """Over the test rows of all folds, for each model."""
    rows = predictions(spark, sf_dir).filter("split = 'test'")
    return E.top_errors(rows, 50, "sale_id", "model_name").select("model_name", "side", "sale_id", F.round("error", 6).alias("error"))


# ---- profiles -----------------------------------------------------------------------------------------------


@query("A03_value_counts", "SELECT coalesce(lang, '<NA>') AS value, count(*) AS n FROM documents GROUP BY 1")
def value_counts(spark, sf_dir):
    return P.value_counts(read(spark, sf_dir, "documents"), "lang")


@query("W08_levels", "SELECT event_type AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS level FROM events GROUP BY 1")
def levels(spark, sf_dir):
    return P.levels(read(spark, sf_dir, "events"), "event_type")


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("A05_describe", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, max({c})::DOUBLE AS max FROM lineitem" for c in _NUMBERS))
def describe(spark, sf_dir):
    return rounded(P.describe(read(spark, sf_dir, "lineitem"), list(_NUMBERS)), "mean", "std", "p25", "p50", "p75", places=4)


_SALES_COLUMNS = ("district", "kind", "price", "area", "age", "floor_ratio", "has_parking")


@query("A06_profile", f"WITH {SALES_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*), 6) AS missing_ratio, count(DISTINCT {c}) AS \"distinct\" FROM sales" for c in _SALES_COLUMNS))
def profile(spark, sf_dir):
    return rounded(P.profile(sales(spark, sf_dir), list(_SALES_COLUMNS)), "missing_ratio")


_STILL = {"one": "1", "none": "NULL", "o_orderstatus": "o_orderstatus", "o_totalprice": "o_totalprice", "first": "CASE WHEN o_orderkey % 2 = 0 THEN 'x' END", "late": "CASE WHEN o_orderkey > 0 THEN o_orderpriority END"}


@query("A07_zero_variance", " UNION ALL ".join(f"SELECT '{c}' AS \"column\" FROM orders HAVING count(DISTINCT {x}) <= 1" for c, x in _STILL.items()))
def zero_variance(spark, sf_dir):
    """Constant, empty, half empty and varying columns."""
    rows = read(spark, sf_dir, "orders").withColumns({"one": F.lit(1), "none": F.lit(None).cast("int"), "first": F.when(F.col("o_orderkey") % 2 == 0, "x"), "late": F.when(F.col("o_orderkey") > 0, F.col("o_orderpriority"))})
    return P.zero_variance(rows, list(_STILL))


@query("A08_feature_report", f"WITH {SALES_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*), 6) AS missing_ratio, min({c})::DOUBLE AS min, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, max({c})::DOUBLE AS max FROM sales" for c in ("price", "area", "age", "floor_ratio")))
def feature_report(spark, sf_dir):
    return rounded(rounded(P.feature_report(sales(spark, sf_dir), ["price", "area", "age", "floor_ratio"]), "missing_ratio"), "mean", "median", places=4)


@query("A22_id_checks", "WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT sum(n)::BIGINT AS rows, 0::BIGINT AS missing_ids, sum(n - 1)::BIGINT AS extra_rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicated_rows FROM c")
def id_checks(spark, sf_dir):
    return P.id_checks(read(spark, sf_dir, "lineitem"), "l_orderkey")


@query("J06_members_to_features", f"WITH {_MEMBERS}, ids AS (SELECT fold_id, split, sale_id FROM members UNION ALL SELECT 0, 'absent', -1) SELECT fold_id, split, count(sales.sale_id) AS n, round(sum(area), 2) AS area, count(*) - count(sales.sale_id) AS missing FROM ids LEFT JOIN sales USING (sale_id) GROUP BY 1, 2")
def members_to_features(spark, sf_dir):
    """Features of the members of each fold, and how many ids have none: an
    id that the sales lack is found and named an error."""
    ids = _members(spark, sf_dir).select("fold_id", "split", "sale_id")
    found = L.attach(ids, sales(spark, sf_dir), "sale_id")  # raises where an id is missing
    lost = spark.createDataFrame([(0, "absent", -1)], "fold_id int, split string, sale_id long")
    missing = L.missing_ids(lost, sales(spark, sf_dir), "sale_id").groupBy("fold_id", "split").agg(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("area"), F.count("*").alias("missing"))
    return found.groupBy("fold_id", "split").agg(F.count("*").alias("n"), F.round(F.sum("area"), 2).alias("area"), F.lit(0).cast("long").alias("missing")).unionByName(missing)


@query("T05_sample", "SELECT o_orderkey FROM orders ORDER BY md5(concat(o_orderkey, '|42')), o_orderkey LIMIT 200")
def sample(spark, sf_dir):
    return P.sample(read(spark, sf_dir, "orders").select("o_orderkey"), 200, "o_orderkey")


def _ridge_sql(alphas: str, members: str = "members", n: str = "") -> str:
    """Ridge on area and age in closed form, by fold and penalty; ``n`` sets
    the names of two uses apart."""
    return f"""md{n} AS (SELECT fold_id, median(area) AS a0, median(age) AS g0 FROM {members} m JOIN sales USING (sale_id) WHERE split = 'train' GROUP BY 1),
 x{n} AS (SELECT fold_id, split, sale_id, m.price AS y, coalesce(area, a0) AS a, coalesce(age, g0) AS g FROM {members} m JOIN sales USING (sale_id) JOIN md{n} USING (fold_id)),
 st{n} AS (SELECT fold_id, avg(a) AS ma, stddev_pop(a) AS sa, avg(g) AS mg, stddev_pop(g) AS sg, avg(y) AS my, count(*) AS n FROM x{n} WHERE split = 'train' GROUP BY 1),
 z{n} AS (SELECT fold_id, split, sale_id, y, my, n, (a - ma) / sa AS a, (g - mg) / sg AS g FROM x{n} JOIN st{n} USING (fold_id)),
 c{n} AS (SELECT fold_id, sum(a * g) AS ag, sum(a * (y - my)) AS ay, sum(g * (y - my)) AS gy, max(n) AS n FROM z{n} WHERE split = 'train' GROUP BY 1),
 w{n} AS (SELECT fold_id, alpha, ((n + alpha) * ay - ag * gy) / ((n + alpha) * (n + alpha) - ag * ag) AS wa, ((n + alpha) * gy - ag * ay) / ((n + alpha) * (n + alpha) - ag * ag) AS wg FROM c{n}, ({alphas}) AS alphas),
 fitted{n} AS (SELECT fold_id, split, sale_id, alpha, y, my + wa * a + wg * g AS p FROM z{n} JOIN w{n} USING (fold_id) WHERE split <> 'train')"""


_ALPHAS = [0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 60.0, 100.0, 200.0, 400.0, 800.0, 1500.0, 3000.0, 6000.0, 12000.0, 25000.0]


def _ridge_members(spark, sf_dir):
    return L.membership(sales(spark, sf_dir), "trade_date", RULE, ["sale_id", "price", "area", "age"])


@query("M07_ridge", f"WITH {_MEMBERS}, {_ridge_sql('SELECT 1.0 AS alpha')} SELECT fold_id, split, sale_id, y AS y_true, round(p, 3) AS y_pred FROM fitted")
def ridge(spark, sf_dir):
    """Ridge on area and age, fitted on the training rows of every accepted
    fold: predictions of the other rows."""
    from tidemark.operators import models as M

    out = M.ridge_by_fold(_ridge_members(spark, sf_dir), ["area", "age"], "price", [1.0])
    return out.select("fold_id", "split", "sale_id", F.col("price").alias("y_true"), F.round("prediction", 3).alias("y_pred"))


_GRID_SQL = f"""{_MEMBERS}, {_ridge_sql(f"SELECT CAST(unnest({_ALPHAS}) AS DOUBLE) AS alpha")}, e AS (SELECT fold_id, alpha, avg(abs(p - y)) AS mae FROM fitted WHERE split = 'valid' GROUP BY 1, 2), grid AS (SELECT alpha, avg(mae) AS mae FROM e GROUP BY 1)"""


@query("M09_grid_search", f"WITH {_GRID_SQL} SELECT alpha, round(mae, 3) AS mean_mae, CAST(row_number() OVER (ORDER BY mae, alpha) AS INTEGER) AS rank FROM grid")
def grid_search(spark, sf_dir):
    """Sixteen ridge penalties, ranked by their mean error over all folds."""
    from tidemark.operators import models as M

    return rounded(M.ridge_grid(_ridge_members(spark, sf_dir), ["area", "age"], "price", _ALPHAS), "mean_mae", places=3)


_AGAIN_SQL = "again AS (SELECT fold_id, CASE WHEN split = 'valid' THEN 'train' ELSE split END AS split, sale_id, price FROM members)"


@query("M09_refit", f"WITH {_GRID_SQL}, {_AGAIN_SQL}, {_ridge_sql('SELECT alpha FROM grid ORDER BY mae, alpha LIMIT 1', 'again', '_2')} SELECT fold_id, round(avg(abs(p - y)), 3) AS mae FROM fitted_2 WHERE split = 'test' GROUP BY 1")
def refit(spark, sf_dir):
    """The best penalty fitted again on training and validation rows: its test
    error by fold."""
    from tidemark.operators import models as M

    members = _ridge_members(spark, sf_dir)
    best = M.ridge_grid(members, ["area", "age"], "price", _ALPHAS).filter("rank = 1").first()["alpha"]
    again = members.withColumn("split", F.when(F.col("split") == "valid", "train").otherwise(F.col("split")))
    out = M.ridge_by_fold(again, ["area", "age"], "price", [best]).filter("split = 'test'")
    return out.groupBy("fold_id").agg(F.round(F.avg(F.abs(F.col("prediction") - F.col("price"))), 3).alias("mae"))


# ---- trees of all folds -------------------------------------------------------------------------------------

_NUMERIC, _CATEGORIES = ["area", "age", "floor_ratio", "has_parking"], ["district", "kind"]


def _tree_members(spark, sf_dir):
    return L.membership(sales(spark, sf_dir), "trade_date", RULE, ["sale_id", "price", *_NUMERIC, *_CATEGORIES])


def _boosted(spark, sf_dir):
    from tidemark.operators import boosting as B

    return B.fit(_tree_members(spark, sf_dir), _NUMERIC, _CATEGORIES, "price", [B.Boosting(trees=4, leaves=15, rate=0.3, columns=0.8)], ["sale_id"])


@query("M08_tree")
def tree(spark, sf_dir):
    """Leaf-wise boosted trees of every accepted fold: predictions of its test rows."""
    out = _boosted(spark, sf_dir).predictions("test")
    return out.select("fold_id", "sale_id", "y_true", F.round("y_pred", 4).alias("y_pred"))


def _grid_points():
    from itertools import product

    from tidemark.operators.boosting import Boosting

    return [Boosting(trees=3, leaves=leaves, least_rows=least, rate=rate, columns=columns) for leaves, least, rate, columns in product((7, 15), (10, 40), (0.1, 0.4), (0.8, 1.0))]


@query("M09_tree_grid")
def tree_grid(spark, sf_dir):
    """Sixteen settings of trees, fitted in every fold together and ranked by
    their mean validation error."""
    from tidemark.operators import boosting as B

    fitted = B.fit(_tree_members(spark, sf_dir), _NUMERIC, _CATEGORIES, "price", _grid_points(), ["sale_id"])
    return rounded(B.grid(fitted), "mean_mae", places=3)


@query("M09_tree_refit")
def tree_refit(spark, sf_dir):
    """The best of the settings fitted again on training and validation rows:
    its test error by fold."""
    from tidemark.operators import boosting as B

    members, points = _tree_members(spark, sf_dir), _grid_points()
    best = B.grid(B.fit(members, _NUMERIC, _CATEGORIES, "price", points, ["sale_id"])).filter("rank = 1").first()["point"]
    again = members.withColumn("split", F.when(F.col("split") == "valid", "train").otherwise(F.col("split")))
    out = B.fit(again, _NUMERIC, _CATEGORIES, "price", [points[best]], ["sale_id"]).predictions("test")
    return out.groupBy("fold_id").agg(F.round(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))), 3).alias("mae"))


@query("M11_importances")
def importances(spark, sf_dir):
    """Mean gain and splits of each feature over the trees of all folds."""
    return _boosted(spark, sf_dir).importances().groupBy("feature").agg(F.round(F.avg("gain"), 3).alias("gain"), F.round(F.avg("splits"), 6).alias("splits"))


@query("M11_attributions")
def attributions(spark, sf_dir):
    """What each feature adds to each prediction of the test rows; features
    that add nothing to a row are left out."""
    fitted = _boosted(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in fitted.lay.features()])
    long = fitted.attributions("test").select("fold_id", "sale_id", F.round("base", 4).alias("base"), F.posexplode("shap").alias("i", "v")).filter("v <> 0")
    return long.select("fold_id", "sale_id", "base", names[F.col("i")].alias("feature"), F.round("v", 4).alias("shap"))


@query("A23_mean_abs_attribution")
def mean_attribution(spark, sf_dir):
    """Mean absolute attribution of each feature over the test rows of all folds."""
    return rounded(_boosted(spark, sf_dir).mean_attributions("test"), "mean_abs_shap", places=4)


_LEVELS_SQL = " UNION ALL ".join(f"SELECT fold_id, '{c}' AS col, {c} AS level, count(*) AS n FROM members WHERE split = 'train' AND {c} IS NOT NULL GROUP BY 1, 3" for c in ("district", "odd"))


@query("M06_prepared", f"""WITH {_MEMBERS.replace('sale_id, district, kind, price', "sale_id, district, CASE WHEN sale_id % 7 <> 0 THEN CASE WHEN split <> 'train' AND sale_id % 5 = 0 THEN 'new' ELSE kind END END AS odd, area, age, has_parking")},
 md AS (SELECT fold_id, median(area) AS m0, median(age) AS m1, median(has_parking) AS m2 FROM members WHERE split = 'train' GROUP BY 1),
 x AS (SELECT m.*, coalesce(area, m0)::DOUBLE AS f0, coalesce(age, m1)::DOUBLE AS f1, coalesce(has_parking, m2)::DOUBLE AS f2 FROM members m JOIN md USING (fold_id)),
 sc AS (SELECT fold_id, avg(f0) AS a0, stddev_pop(f0) AS s0, avg(f1) AS a1, stddev_pop(f1) AS s1, avg(f2) AS a2, stddev_pop(f2) AS s2 FROM x WHERE split = 'train' GROUP BY 1),
 lv AS ({_LEVELS_SQL}), codes AS (SELECT *, row_number() OVER (PARTITION BY fold_id, col ORDER BY level) - 1 AS code, row_number() OVER (PARTITION BY fold_id, col ORDER BY n DESC, level) AS top FROM lv)
 SELECT x.fold_id, split, sale_id, round((f0 - a0) / s0, 6) AS z_area, round((f1 - a1) / s1, 6) AS z_age, round((f2 - a2) / s2, 6) AS z_has_parking, CAST(d.code AS INTEGER) AS code_district, CAST(k.code AS INTEGER) AS code_odd
 FROM x JOIN sc USING (fold_id) JOIN codes t ON t.fold_id = x.fold_id AND t.col = 'odd' AND t.top = 1 LEFT JOIN codes d ON d.fold_id = x.fold_id AND d.col = 'district' AND d.level = x.district LEFT JOIN codes k ON k.fold_id = x.fold_id AND k.col = 'odd' AND k.level = coalesce(x.odd, t.level)""")
def prepared(spark, sf_dir):
    """Training medians, scales, most frequent levels and codes of all folds,
    applied to all members; a category with nulls and levels that training lacks."""
    from tidemark.operators import models as M

    rows = _tree_members(spark, sf_dir).withColumn("odd", F.when(F.col("sale_id") % 7 != 0, F.when((F.col("split") != "train") & (F.col("sale_id") % 5 == 0), "new").otherwise(F.col("kind"))))
    out = M.prepared_by_fold(rows, ["area", "age", "has_parking"], ["district", "odd"])
    return rounded(out.select("fold_id", "split", "sale_id", "z_area", "z_age", "z_has_parking", "code_district", "code_odd"), "z_area", "z_age", "z_has_parking")


# ---- residuals, feature names, joins to attributes ----------------------------------------------------------


@query("P13_residuals", f"WITH {_BASELINES} SELECT fold_id, split, sale_id, model_name, round(y_pred - y_true, 4) AS error, round(abs(y_pred - y_true), 4) AS abs_error, round(abs((y_pred - y_true) / y_true) * 100, 4) AS ape FROM pred")
def residuals(spark, sf_dir):
    rows = E.with_errors(predictions(spark, sf_dir))
    return rows.select("fold_id", "split", "sale_id", "model_name", *[F.round(c, 4).alias(c) for c in ("error", "abs_error", "ape")])


@query("P15_feature_groups", """SELECT p_partkey, name, CASE WHEN contains(name, 'comp_') THEN 'comparable_sales' WHEN name LIKE 'district^_median^_%' ESCAPE '^' THEN 'time_aware_market' WHEN name LIKE 'district%' OR name LIKE 'trade^_%' ESCAPE '^' THEN 'location_time' WHEN contains(name, 'renovation_flag') THEN 'note_flags' WHEN contains(name, 'floor') OR contains(name, 'parking') THEN 'basic_housing' ELSE 'other' END AS feature_group,
 CASE WHEN name LIKE '%^_count' ESCAPE '^' THEN 'count' WHEN contains(name, 'median_price') THEN 'median_price' ELSE 'other' END AS kind
 FROM (SELECT p_partkey, ['comp_180d_median_price', 'comp_365d_count', 'district_median_180d', 'district', 'trade_year', 'renovation_flag', 'floor_ratio', 'has_parking', 'emb_count'][p_partkey % 9 + 1] AS name FROM part)""")
def feature_groups(spark, sf_dir):
    from tidemark.functions import features as N

    names = F.array(*[F.lit(n) for n in ("comp_180d_median_price", "comp_365d_count", "district_median_180d", "district", "trade_year", "renovation_flag", "floor_ratio", "has_parking", "emb_count")])
    rows = read(spark, sf_dir, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 9 + 1).cast("int")).alias("name"))
    return rows.withColumns({"feature_group": N.feature_group(F.col("name")), "kind": N.comparable_kind(F.col("name"))})


@query("A09_flag_ratio", f"WITH {SALES_SQL} SELECT district, sum(has_parking)::BIGINT AS flagged, round(avg(has_parking), 6) AS ratio FROM sales GROUP BY 1")
def flag_ratio(spark, sf_dir):
    return sales(spark, sf_dir).groupBy("district").agg(F.sum("has_parking").alias("flagged"), F.round(F.avg("has_parking"), 6).alias("ratio"))


@query("A23_mean_abs", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(abs({c})), 6) AS mean_abs FROM lineitem" for c in _NUMBERS))
def mean_abs(spark, sf_dir):
    one = read(spark, sf_dir, "lineitem").agg(*[F.round(F.avg(F.abs(c)), 6).alias(c) for c in _NUMBERS])
    return one.unpivot([], list(_NUMBERS), "feature", "mean_abs")


@query("X15_text_hash", "SELECT conv_id, sha256(string_agg(coalesce(text, ''), chr(1) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def text_hash(spark, sf_dir):
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t"))))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(turns, lambda x: x["t"]), "\x01"), 256).alias("digest"))


@query("J10_error_attributes", f"""WITH {_BASELINES}, p AS (SELECT sale_id, y_pred - y_true AS error FROM pred WHERE split = 'test' AND model_name = 'combo' ORDER BY error, sale_id LIMIT 50)
 SELECT p.sale_id, round(error, 4) AS error, area, age FROM p LEFT JOIN sales USING (sale_id)""")
def error_attributes(spark, sf_dir):
    """The attributes of the worst errors of one model over all folds."""
    rows = predictions(spark, sf_dir, "combo").filter("split = 'test'")
    # Written: fifty rows, read for their attributes and for the join.
    worst = written(E.top_errors(rows, 50, "sale_id").filter("side = 'under'").select("sale_id", F.round("error", 4).alias("error")), "worst")
    # Attributes of the named sales only, one row each, then the left join.
    own = C.keep_last(sales(spark, sf_dir, worst.select("sale_id")), F.col("sale_id"), [F.col("trade_date")])
    return worst.join(own.select("sale_id", "area", "age"), "sale_id", "left")


@query("J12_ranked_models", f"WITH {_BASELINES}, f AS (SELECT model_name, split, fold_id, avg(abs(y_pred - y_true)) AS mae FROM pred GROUP BY ALL), m AS (SELECT model_name, split, avg(mae) AS mae FROM f GROUP BY 1, 2), r AS (SELECT model_name, CAST(row_number() OVER (ORDER BY mae, model_name) AS INTEGER) AS rank FROM m WHERE split = 'valid') SELECT model_name, split, round(mae, 6) AS mae, rank FROM m LEFT JOIN r USING (model_name)")
def ranked_models(spark, sf_dir):
    from pyspark.sql import Window

    by_fold = E.regression_metrics(predictions(spark, sf_dir), "model_name", "split", "fold_id", median=False)
    means = written(by_fold.groupBy("model_name", "split").agg(F.avg("mae").alias("mae")), "means")  # read for the ranks too
    ranks = means.filter("split = 'valid'").withColumn("rank", F.row_number().over(Window.orderBy("mae", "model_name"))).select("model_name", "rank")
    return means.join(ranks, "model_name", "left").withColumn("mae", F.round("mae", 6))


@query("F10_finite_pairs", "SELECT event_id FROM events WHERE value IS NOT NULL AND event_id % 4 <> 0 AND event_id % 4 <> 1")
def finite_pairs(spark, sf_dir):
    from tidemark.schema import nan_to_null

    v = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).when(F.col("event_id") % 4 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    return nan_to_null(read(spark, sf_dir, "events").withColumn("v", v), "v").filter("v IS NOT NULL").select("event_id")
