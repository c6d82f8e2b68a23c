from collections import Counter

import corpus_pipeline
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_mixing import size, targets
from tests.llm.test_quality import counts
from tidemark.llm.mixing import sampling_plan
from tidemark.llm.quality import judge


def test_stage_by_stage(spark, sf_dir, documents):
    docs, sizes = documents, []
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        out = stage(spark, docs, sf_dir).cache()
        after = Counter((r.doc_id, r.text, r.source) for r in out.collect())
        assert out.columns[:5] == documents.columns and (name == "sharding" or out.columns == documents.columns)
        if name == "quality_rules":
            said = {r.doc_id: r.kept for r in judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
            want = Counter(r for r in before if said[r[0]])
            assert not any(counts(r[1])[5] for r in want)
        elif name == "ngram_jaccard_join":
            least = {d: c for d, _, c in groups([r[:2] for r in before], 5, 80, 100)}
            want = Counter(r for r in before if least[r[0]] == r[0])
        elif name == "benchmark_decontamination":
            hit = {r[0]: r[2] for r in windows([r[:2] for r in before], items)}
            want = Counter(r for r in before if not hit[r[0]])
        elif name == "source_mixing":
            copies = {r.doc_id: r.copies for r in sampling_plan(docs).collect()}
            want = +Counter({r: copies[r[0]] for r in before})
            words = Counter()
            for r in before:
                words[r[2]] += size(r[1])
            taken = Counter()
            for r, n in after.items():
                taken[r[2]] += n * size(r[1])
            largest = max(size(r[1]) for r in before)
            assert all(abs(taken[s] - t) <= 2 * largest for s, t in targets(words).items())
        else:
            want = Counter(before)
            assert {r.shard for r in out.collect()} == set(range(16))
        assert after == want, name
        sizes.append(sum(after.values()))
        docs = out
    assert 0 < sizes[2] <= sizes[1] < sizes[0] < len(documents.collect())
    rows = corpus_pipeline.run(spark, sf_dir)
    key = lambda r: (r.doc_id, r.text, r.shard, r.slot)
    assert sorted(map(key, rows.collect())) == sorted(map(key, docs.collect()))


def test_odd_and_empty_tables(spark, sf_dir, tmp_path, odd, none):
    """Nulls, empty texts, repeated rows, further columns that clash with the
    operators' own names: every stage keeps whole rows, and none of nothing."""
    for name, docs in (("odd", odd.withColumnsRenamed({"n": "slot", "cls": "_key"})), ("none", none)):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0 if name == "none" else 1000).write.parquet(f"{folder}/{table}.parquet")
        rows = corpus_pipeline.run(spark, folder)
        assert rows.columns == [*[c for c in docs.columns if c != "slot"], "shard", "slot", "size"]
        got = rows.collect()
        if name == "none":
            assert got == []
            continue
        own = Counter((r.doc_id, r.text, r.source, r._key) for r in docs.collect())
        assert got and {(r.doc_id, r.text, r.source, r._key) for r in got} <= set(own)
        assert all(len((r.text or "").split()) >= 50 for r in got)
        texts = {(r.text or "").lower() for r in got}
        assert len({t[:200] for t in texts}) == len(texts)
