"""Quality rules: hashed n-gram logistic regression, calibrated, with fixed
thresholds, beside plain counts of a text.

Features are the relative frequencies of hashed words, word pairs, and
character 3- and 5-grams of the whole text. The regression is fitted on a
bounded sample of labelled rows (``sample`` of them at most, chosen by the
hash of their doc_id); a part of the sample is held out, and the scores are
calibrated to probabilities on it by a logistic curve. Every text is then
scored in Arrow batches. A text is kept if the base rules pass and its
probability of good quality reaches ``threshold``, which is below one half to
favour keeping.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from tidemark.llm import text as T

_U = np.uint64
BITS = 14
FAMILIES = 4  # words, word pairs, character 3-grams, character 5-grams
_WIDTH = FAMILIES << BITS
PIECES = 4
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE_SET = np.zeros(256, dtype=bool)
_SPACE_SET[list(T.SPACES)] = True


@dataclass(frozen=True)
class Rules:
    """``least_words``: fewer fail. ``most_repeated``: a larger share of words
    in repeated three-word windows fails, in hundredths."""

    least_words: int = 50
    most_repeated: int = 50
    threshold: float = 0.25
    sample: int = 4000
    held_out: float = 0.25
    penalty: float = 0.01
    rounds: int = 30


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(block: T.Block) -> tuple[np.ndarray, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = T.tokens(block, T.WORDS)
    inside = ~_SPACE_SET[block.data] & ((block.data & 0xC0) != 0x80)
    duplicates = np.zeros(len(block), dtype=np.int64)
    for i in range(len(block)):
        lines = [x for x in block.text(i).split(b"\n") if x.strip()]
        duplicates[i] = len(lines) - len(set(lines))
    values, first = T.grams(words.hashes, words.bounds, 3)
    change = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    if len(values):
        _, inverse, count = np.unique(values ^ T.mix(words.document[first].astype(_U) + _U(77)), return_inverse=True, return_counts=True)
        again = first[count[inverse] > 1]
        np.add.at(change, again, 1)
        np.add.at(change, again + 3, -1)
    repeated = np.cumsum(change[:-1]) > 0
    return np.diff(words.bounds), _sums(inside, block.offsets), _sums(_SYMBOL[block.data], block.offsets), duplicates, _sums(repeated, words.bounds)


def features(block: T.Block):
    """For each family: (feature numbers, the documents they are in)."""
    words = T.tokens(block, T.WORDS)
    yield (words.hashes >> _U(64 - BITS)).astype(np.int64), words.document
    values, first = T.grams(words.hashes, words.bounds, 2)
    yield (values >> _U(64 - BITS)).astype(np.int64) + (1 << BITS), words.document[first]
    starts = np.flatnonzero((block.data & 0xC0) != 0x80)
    bounds = np.searchsorted(starts, block.offsets)
    points = np.zeros(len(starts), dtype=_U)
    width = np.diff(np.append(starts, len(block.data)))
    for j in range(4):
        has = width > j
        points[has] = points[has] * _U(256) + block.data[starts[has] + j]
    document = np.repeat(np.arange(len(block)), np.diff(bounds))
    points = T.mix(points)
    for family, k in ((2, 3), (3, 5)):
        values, first = T.grams(points, bounds, k)
        yield (values >> _U(64 - BITS)).astype(np.int64) + (family << BITS), document[first]


_VECTOR = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
_EXAMPLE = StructType([StructField("label", DoubleType()), StructField("held", BooleanType()), StructField("features", VectorUDT())])


def _examples(batches):
    """The sparse feature vector of each labelled text."""
    for batch in batches:
        kept = {c: batch.column(batch.schema.get_field_index(c)) for c in ("label", "held")}
        for block in T.blocks(batch.column(batch.schema.get_field_index("text"))):
            numbers, documents, values = [], [], []
            for feature, document in features(block):
                code, count = np.unique(document * _WIDTH + feature, return_counts=True)
                d = code // _WIDTH
                size = np.bincount(document, minlength=len(block))
                numbers.append(code % _WIDTH)
                documents.append(d)
                values.append(count / size[d])
            numbers, documents, values = (np.concatenate(x) for x in (numbers, documents, values))
            order = np.lexsort((numbers, documents))
            at = pa.array(np.searchsorted(documents[order], np.arange(len(block) + 1)).astype(np.int32))
            vectors = pa.StructArray.from_arrays([
                pa.array(np.zeros(len(block), np.int8)), pa.array(np.full(len(block), _WIDTH, np.int32)),
                pa.ListArray.from_arrays(at, pa.array(numbers[order].astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(values[order])),
            ], fields=list(_VECTOR))
            yield pa.RecordBatch.from_arrays([*(c.slice(block.first, len(block)) for c in kept.values()), vectors], ["label", "held", "features"])


def _fit(examples: DataFrame, rules: Rules) -> tuple[np.ndarray, float]:
    """Weights and bias of the regression on (label, features). Spark sums the
    gradients of the partitions; the driver holds the weights and no texts."""
    sizes = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    n = sum(sizes.values())
    balanced = examples.withColumn("balance", F.when(F.col("label") > 0, F.lit(0.5 * n / sizes[1.0])).otherwise(F.lit(0.5 * n / sizes[0.0])))
    model = LogisticRegression(weightCol="balance", regParam=rules.penalty, maxIter=rules.rounds).fit(balanced.select("label", "balance", "features"))
    return model.coefficients.toArray(), float(model.intercept)


def _calibrate(score: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from scores to probabilities,
    with labels drawn in by their counts so that it stays finite."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(float(np.std(score)), 1e-9)
    x = np.stack([score / scale, np.ones(len(score))])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, x @ (p - target))
    return float(theta[0] / scale), float(theta[1])


def _sample(docs: DataFrame, labels: DataFrame, rules: Rules) -> DataFrame:
    """(label, held, features) of at most ``sample`` labelled texts; ``held``
    marks the part for calibration."""
    named = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("label"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # ``sample`` rows at most
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(max(2, round(1 / rules.held_out)))) == 0
    # The sample is bounded, and so are its pieces: each sends one gradient a round.
    return texts.select("label", held.alias("held"), "text").coalesce(PIECES).mapInArrow(_examples, _EXAMPLE)


def train(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> tuple[np.ndarray, float] | None:
    """(weights, bias) whose logistic curve is the calibrated probability, or
    None if the labels do not name both a good and a bad text."""
    sample = _sample(docs, labels, rules).persist()
    try:
        sizes = {(r["label"], r["held"]): r["count"] for r in sample.groupBy("label", "held").count().collect()}
        if len({label for label, _ in sizes}) < 2:
            return None
        apart = len(sizes) == 4  # both kinds on both sides
        weights, bias = _fit(sample.filter("NOT held") if apart else sample, rules)
        sent = sample.sparkSession.sparkContext.broadcast(weights)

        def scores(batches):
            for batch in batches:
                vectors = batch.column(batch.schema.get_field_index("features"))
                at, flat = vectors.field("indices").offsets.to_numpy(), vectors.field("values").flatten().to_numpy()
                numbers = vectors.field("indices").flatten().to_numpy()
                total = np.concatenate([[0.0], np.cumsum(flat * sent.value[numbers])])
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("label")), pa.array(total[at[1:] - at[0]] - total[at[:-1] - at[0]])], ["label", "score"])

        held = (sample.filter("held") if apart else sample).select("label", "features").mapInArrow(scores, "label double, score double").toArrow()  # two numbers for each of ``sample`` rows
    finally:
        sample.unpersist()
    slope, shift = _calibrate(np.asarray(held["score"]) + bias, np.asarray(held["label"]))
    return weights * slope, bias * slope + shift


def probabilities(block: T.Block, model: tuple[np.ndarray, float]) -> np.ndarray:
    weights, bias = model
    score = np.full(len(block), float(bias))
    for feature, document in features(block):
        size = np.bincount(document, minlength=len(block))
        score += np.bincount(document, weights=weights[feature], minlength=len(block)) / np.maximum(size, 1)
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(block: T.Block, model, rules: Rules):
    counts = base_counts(block)
    failed = (counts[0] < rules.least_words) | (100 * counts[4] > rules.most_repeated * counts[0])
    p = probabilities(block, model) if model is not None else np.full(len(block), np.nan)
    return counts, failed, p, ~failed & (np.isnan(p) | (p >= rules.threshold))


def judge(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, p_good, kept.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality (1 good, 0
    bad; other and null values are left out; of several for one doc_id the
    lowest holds). A null text counts as empty. Without both kinds of labelled
    texts there is no model: p_good is null and the base rules decide alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rules))

    def run(batches):
        for batch in batches:
            for block in T.blocks(batch.column(batch.schema.get_field_index("text"))):
                counts, failed, p, kept = _judge(block, sent.value, rules)
                ids = batch.column(batch.schema.get_field_index("doc_id")).slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(p, mask=np.isnan(p)), pa.array(kept)], ["doc_id", *_COUNTS, "base_failed", "p_good", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, p_good double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. A null
    or empty text has no words and goes; repeated rows stay or go together."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rules))

    def run(batches):
        for batch in batches:
            for block in T.blocks(batch.column(batch.schema.get_field_index("text"))):
                yield batch.slice(block.first, len(block)).filter(pa.array(_judge(block, sent.value, rules)[3]))

    return docs.mapInArrow(run, docs.schema)
