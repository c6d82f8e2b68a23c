import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.quality import Rules, _calibrate, _fit, _sample, judge, keep_good


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, again = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            again += x in seen
            seen.add(x)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated), failed


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_counts_and_accuracy(spark, documents, odd, labels, same):
    for docs in (odd, documents):
        got = judge(docs, labels).collect()
        same([tuple(r)[:7] for r in got], [(r.doc_id, *counts(r.text)) for r in docs.collect()])
        assert all(not (r.kept and r.base_failed) for r in got)
    good = {r.doc_id: r.quality for r in labels.collect()}
    # Texts that the base rules pass, labelled at a larger scale, none of which the model saw.
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = Rules(sample=200)
    seen = {r.doc_id for r in marks.orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(200).collect()}
    good = {r.doc_id: r.quality for r in marks.collect() if r.doc_id not in seen}
    rows = [r for r in judge(docs, marks, rules).collect() if r.doc_id in good and not r.base_failed]
    kept = [r.kept for r in rows if good[r.doc_id] == 1]
    assert len(kept) > 50 and sum(kept) >= 0.95 * len(kept)
    bad = [r.kept for r in rows if good[r.doc_id] == 0]
    assert sum(bad) <= 0.2 * len(bad)


def test_filter_and_missing_labels(odd, none, labels, same):
    marks = labels.limit(0)
    got = judge(odd, marks).collect()
    assert all(r.p_good is None and r.kept != r.base_failed for r in got)
    kept = keep_good(odd, marks)
    assert kept.columns == odd.columns
    same([(r.doc_id,) for r in kept.collect()], [(r.doc_id,) for r in got if r.kept])
    assert judge(none, labels).count() == 0 and keep_good(none, labels).count() == 0


def test_the_fit_is_the_least_of_its_loss(documents, labels):
    """At the weights that Spark found the slope of the balanced, penalised
    loss, put down here in plain numpy, is flat."""
    rules = Rules(penalty=0.05, rounds=500)
    sample = _sample(documents, labels, rules)
    weights, bias = _fit(sample, rules)
    rows = sample.collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([r.label for r in rows])
    assert len(rows) > 20 and 0 < y.sum() < len(y)
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    balance /= balance.sum()
    mean = balance @ x
    # Weighted deviations, unbiased as frequency weights are in Spark's summaries.
    raw = np.where(y > 0, 0.5 / (y.mean()), 0.5 / (1 - y.mean()))
    deviation = np.sqrt(np.maximum((raw @ (x - mean) ** 2) / (raw.sum() - (raw @ raw) / raw.sum()), 0))
    error = balance * (1 / (1 + np.exp(-(x @ weights + bias))) - y)
    used = deviation > 0
    slope = (error @ x)[used] / deviation[used] + rules.penalty * (weights * deviation)[used]
    start = np.abs((balance * (0.5 - y)) @ x)[used] / deviation[used]
    assert np.abs(slope).max() < 0.01 * start.max() and abs(error.sum()) < 1e-3


def test_calibration_by_search():
    r = np.random.default_rng(3)
    score = r.normal(0, 4, 300)
    y = (r.random(300) < 1 / (1 + np.exp(-(0.7 * score - 0.4)))).astype(float)
    slope, shift = _calibrate(score, y)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    loss = lambda a, b: -(target * np.log(1 / (1 + np.exp(-(a * score + b)))) + (1 - target) * np.log(1 - 1 / (1 + np.exp(-(a * score + b))))).sum()
    least = loss(slope, shift)
    assert all(least <= loss(slope + da, shift + db) + 1e-9 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))
