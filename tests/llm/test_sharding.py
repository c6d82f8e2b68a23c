from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.sharding import shard


@pytest.mark.parametrize("table,shards,piece", [("odd", 4, 1 << 30), ("documents", 16, 1 << 30), ("documents", 5, 9000), ("same_text", 4, 1 << 30)])
def test_law(table, shards, piece, request, spark):
    if table == "same_text":
        docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit("one text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit(1).alias("slot"))
    else:
        docs = request.getfixturevalue(table)
    rows = shard(docs, shards, slice_bytes=piece).collect()
    names = [c for c in docs.columns if c != "slot"]
    key = lambda r: tuple((r[c] is not None, str(r[c])) for c in names)
    assert sorted(key(r) for r in rows) == sorted(key(r) for r in docs.collect())
    total = sum(r["size"] for r in rows)
    by, texts = defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["size"] == (len(r["text"].encode()) if r["text"] is not None else 0) + 1
        by[r["shard"]].append(r)
        texts[r["text"]].add(r["shard"])
    largest = max(r["size"] for r in rows)
    for s in range(shards):
        own = by.get(s, [])
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= 2 * largest + 0.03 * total / shards
    held = defaultdict(int)
    for r in rows:
        held[r["text"]] += r["size"]
    slices = max(1, -(-total // (shards * piece)))
    assert all(held[t] > 0.01 * total / shards / slices for t, own in texts.items() if len(own) > 1)
    assert sum(len(x) > 1 for x in texts.values()) < shards


def test_empty_and_single(none, odd):
    assert shard(none).count() == 0
    assert {r.shard for r in shard(odd, 1).collect()} == {0}


def test_few_passes(spark):
    """All cuts are settled together: passes do not grow with the cuts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spark.sparkContext.setJobGroup("sharding", "")
    try:
        rows = shard(docs, 16).select("shard", "size", "text").collect()
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("sharding"))
        spark.sparkContext._jsc.clearJobGroup()
    assert jobs < 40
    total, texts = defaultdict(int), defaultdict(set)
    for r in rows:
        total[r.shard] += r.size
        texts[r.text].add(r.shard)
    assert max(total.values()) - min(total.values()) <= 2 * max(r.size for r in rows)
    assert all(len(x) == 1 for x in texts.values())


def test_a_text_of_many_rows_goes_by_doc_id(spark):
    """Half of all bytes in one text, with null, negative and repeated ids."""
    docs = spark.range(900).select(F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 3 == 0, F.col("id") % 50 - 2**62).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same text").otherwise(F.concat(F.lit("another tex"), F.col("id") % 10)).alias("text"))
    rows = shard(docs, 7, slice_bytes=700).collect()
    by, pairs = defaultdict(list), defaultdict(set)
    for r in rows:
        by[r.shard].append(r)
        pairs[r.text, r.doc_id].add(r.shard)
    assert len(rows) == 900 and all(len(x) == 1 for x in pairs.values())
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        keys = [(r.text, r.doc_id is not None, r.doc_id or 0) for r in sorted(own, key=lambda r: r.slot)]
        for text in {k[0] for k in keys}:
            held = [k for k in keys if k[0] == text]
            assert held == sorted(held)
    sizes = [sum(r.size for r in own) for own in by.values()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 2 * 100 * 13
