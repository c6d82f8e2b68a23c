import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm.mixing import mix, sampling_plan, source_targets


def targets(sizes, weights=(1, 2, 3), most=3):
    """Shares again and again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets(spark, same):
    for sizes in ({"b": 10, "a": 500, None: 3, "Z": 0, "ü": 90}, {"a": 1, "b": 1, "c": 1000}, {"a": 5}, {"a": 10, "b": 20, "c": 30, "d": 10, "e": 20, "f": 30}, {"a": 1, "b": 2, "c": 3, "d": 600}):
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        same([(r.source, r.target) for r in source_targets(frame).collect()], list(targets(sizes).items()))


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_plan(table, request, same):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += size(t)
    plan = sampling_plan(docs).collect()
    want = targets(sizes)
    same([(r.doc_id, r.source, r.size, r.source_size, r.target) for r in plan], [(d, s, size(t), sizes[s], want[s]) for d, s, t in rows], places=3)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in plan:
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + 1) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in want)
    same([tuple(r) for r in sampling_plan(docs.repartition(7)).collect()], [tuple(r) for r in plan])
    mixed = Counter((r.doc_id, r.source, r.text) for r in mix(docs).collect())
    assert mix(docs).columns == docs.columns
    per = Counter()
    for (d, s, t), n in mixed.items():
        per[d, s, size(t)] += n
    planned = Counter()
    for r in plan:
        planned[r.doc_id, r.source, r.size] += r.copies
    assert +planned == per


def test_empty(none):
    assert sampling_plan(none).count() == 0 and mix(none).count() == 0
