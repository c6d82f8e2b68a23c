"""The queries of this subpackage: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.conversation_repair import repair_report
from tidemark.llm.decontaminate import Winnowing, contamination
from tidemark.llm.jaccard_join import Threshold, near_duplicates
from tidemark.llm import license_scan, secret_scan
from tidemark.llm.metric_join import Near, near_vectors
from tidemark.llm.mixing import sampling_plan
from tidemark.llm.prefix_trie import prefix_trie
from tidemark.llm.quality import Rules, judge
from tidemark.llm.sharding import shard
from tidemark.llm.storage import read
from tidemark.llm.substring_dedup import FLOORS, repeated_passages
from tidemark.llm.suffix_dedup import shared_passages
from tidemark.llm.suffix_tree_lm import score_texts

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of any length, and lines and sentences of thirteen words or
    more, that stand earlier in the corpus. Shorter lines repeat in half of all
    documents by chance."""
    return repeated_passages(read(spark, sf_dir, "documents"), FLOORS)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, by sentence rules."""
    found = license_scan.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("licenses", ",").alias("licenses"), "n_unknown")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that stand earlier in the corpus."""
    return shared_passages(read(spark, sf_dir, "documents"), least_words=50, k=20)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 1, 2, 3 in turn, at most three copies."""
    plan = sampling_plan(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op5_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of nearly equal bytes."""
    rows = shard(read(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return rows.select("doc_id", "size", F.crc32("text").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten words."""
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), Winnowing(window=10, k=5))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, similarity of 0.85 or more."""
    return near_duplicates(read(spark, sf_dir, "documents"), Threshold(k=4, num=85, den=100))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules, then the calibrated probability of a good text."""
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), Rules())


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix tree of up to two words of context over add-one unigrams."""
    return score_texts(read(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: plain patterns and assigned literals."""
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "lexed")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, each behind the opening of its block."""
    return prefix_trie(read(spark, sf_dir, "conversations"))


def op12_conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and least repairs of all conversations, damaged first."""
    return repair_report(read(spark, sf_dir, "conversations"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a cosine of 0.9 or more, and their groups."""
    return near_vectors(read(spark, sf_dir, "embeddings"), Near(at_least=0.9))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_substring_dedup, op2_license_scan, op3_suffix_array_dedup, op4_source_mixing, op5_histogram_sharding, op6_benchmark_decontamination, op7_ngram_jaccard_join, op8_quality_rules, op9_lm_scoring, op10_secret_scan, op11_conversation_prefix_trie, op12_conversation_structure_repair, op13_embedding_near_dedup)}
ORACLES: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op6_benchmark_decontamination"] = rf"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
item_windows AS (
  SELECT DISTINCT id AS item_id, least(len(ws), 10) AS n, array_to_string(ws[p : p + least(len(ws), 10) - 1], ' ') AS win
  FROM w, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS t(p) WHERE kind = 'b' AND len(ws) > 0),
doc_windows AS (
  SELECT id AS doc_id, p, n, array_to_string(ws[p : p + n - 1], ' ') AS win
  FROM w, (SELECT DISTINCT n FROM item_windows) AS lengths, unnest(range(1, len(ws) - n + 2)) AS t(p) WHERE kind = 'd' AND len(ws) >= n),
hits AS (SELECT doc_id, p, d.n, item_id FROM doc_windows d JOIN item_windows USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM hits), unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words ON words.doc_id = w.id LEFT JOIN items ON items.doc_id = w.id WHERE kind = 'd'
"""

_WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"

_SEPARATORS = "' ', chr(9), chr(10), chr(11), chr(12), chr(13)"

ORACLES["op1_substring_dedup"] = f"""
WITH chars AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), '')) AS ch, unnest(range(len(string_split(coalesce(text, ''), '')))) AS pos FROM documents),
marked AS (SELECT doc_id, pos, ch, ch NOT IN ({_SEPARATORS}) AS inside, sum(CAST(ch = chr(10) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS line FROM chars WHERE ch <> ''),
begun AS (SELECT *, inside AND NOT coalesce(lag(inside) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM marked),
numbered AS (SELECT *, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS word FROM begun),
words AS (SELECT doc_id, word, min(pos) AS w_start, max(pos) + 1 AS w_end, max(line) AS line, translate(string_agg(ch, '' ORDER BY pos), '{_UPPER}', '{_LOWER}') AS w FROM numbered WHERE inside GROUP BY doc_id, word),
gaps AS (SELECT *, line - lag(line) OVER (PARTITION BY doc_id ORDER BY word) AS gap, right(lag(w) OVER (PARTITION BY doc_id ORDER BY word), 1) IN ('.', '!', '?') AS stopped FROM words),
kinds AS (SELECT *, 'line' AS kind, gap >= 1 AS cut, {FLOORS["line"]} AS least FROM gaps UNION ALL SELECT *, 'paragraph', gap >= 2, {FLOORS["paragraph"]} FROM gaps UNION ALL SELECT *, 'sentence', gap >= 1 OR stopped, {FLOORS["sentence"]} FROM gaps),
parted AS (SELECT *, sum(CAST(coalesce(cut, false) AS INTEGER)) OVER (PARTITION BY doc_id, kind ORDER BY word ROWS UNBOUNDED PRECEDING) AS unit FROM kinds),
units AS (SELECT DISTINCT doc_id, u_start, u_end, name FROM (SELECT doc_id, kind, unit, min(w_start) AS u_start, max(w_end) AS u_end, string_agg(w, ' ' ORDER BY word) AS name, count(*) AS n, max(least) AS least FROM parted GROUP BY doc_id, kind, unit) WHERE n >= least),
ranked AS (SELECT *, first_value(doc_id) OVER (PARTITION BY name ORDER BY doc_id, u_start) AS kept_doc_id, first_value(u_start) OVER (PARTITION BY name ORDER BY doc_id, u_start) AS kept_start, count(*) OVER (PARTITION BY name) AS n_occurrences FROM units)
SELECT doc_id, u_start AS start, u_end AS "end", kept_doc_id, kept_start, n_occurrences FROM ranked WHERE NOT (doc_id = kept_doc_id AND u_start = kept_start)
"""

ORACLES["op4_source_mixing"] = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len({_WORDS_SQL}) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, CAST((k - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS every FROM totals),
filled AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM weighed),
leveled AS (SELECT *, (every - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled),
water AS (SELECT level AS top FROM leveled WHERE level * weight <= cap ORDER BY place LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN (SELECT count(*) FROM water) = 0 THEN cap ELSE least(cap, (SELECT top FROM water) * weight) END AS target FROM leveled),
ranked AS (SELECT doc_id, s.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate, row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id NULLS LAST) - 1 AS rank
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
offsets AS (SELECT source, i, CAST(CAST(concat('0x', substr(md5(concat(CASE WHEN source IS NULL THEN '0' ELSE '1' END, coalesce(source, ''), '|17|', i)), 1, 7)) AS BIGINT) AS DOUBLE) / 268435456.0 AS o FROM totals, (SELECT unnest(range(16)) AS i)),
tried AS (SELECT r.source, i, o, abs(sum(size * (floor(rate * (rank + 1) + o) - floor(rate * rank + o))) - max(target)) AS miss FROM ranked r JOIN offsets f ON r.source IS NOT DISTINCT FROM f.source GROUP BY 1, 2, 3),
best AS (SELECT source, o FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY miss, i) AS n FROM tried) WHERE n = 1)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate * (rank + 1) + o) - floor(rate * rank + o)) AS BIGINT) AS taken, CAST(floor(rate * (rank + 1) + o) - floor(rate * rank + o) AS BIGINT) AS copies
FROM ranked r JOIN best b ON r.source IS NOT DISTINCT FROM b.source
"""

ORACLES["op7_ngram_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 3], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS t(p) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reached.doc_id, y FROM reached JOIN edges ON x = other),
least_ids AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d JOIN least_ids USING (doc_id) LEFT JOIN n USING (doc_id)
"""

ORACLES["op13_embedding_near_dedup"] = """
WITH RECURSIVE sound AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reached AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, y FROM reached r JOIN links ON x = other),
least_ids AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY 1),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least_ids LEFT JOIN counts ON x = vec_id
"""
