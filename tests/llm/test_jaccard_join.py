import re

import pytest

from tidemark.llm.jaccard_join import Threshold, keep_one_per_group, near_duplicates


def brute(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("rule", [Threshold(4, 85, 100), Threshold(), Threshold(2, 3, 5)])
def test_against_all_pairs(odd, documents, same, rule):
    for docs in (odd, documents.filter("n_chars < 3000")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        same([tuple(r) for r in near_duplicates(docs, rule).collect()], brute(rows, rule.k, rule.num, rule.den))


def test_a_large_group_of_variants(spark, same):
    """Variants of one text that link through it only, and some that do not."""
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        text = list(base)
        for j in range(i % 6):
            text[(i * 7 + j * 29) % 150] = f"edit{i}x{j}"
        rows.append((1000 - i, " ".join(text)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Threshold(4, 85, 100))
    same([tuple(r) for r in got.collect()], brute(rows, 4, 85, 100))


def test_keep_one(odd, none):
    kept = keep_one_per_group(odd)
    assert kept.columns == odd.columns
    groups = {(r.doc_id, r.component_id) for r in near_duplicates(odd).collect()}
    gone = {d for d, c in groups if d is not None and c is not None and c != d}
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in groups} - gone
    assert near_duplicates(none).count() == 0 and keep_one_per_group(none).count() == 0


def test_keep_one_counts_rows(spark):
    """One row of each group, whatever its doc_ids; other texts stay."""
    say = lambda w: " ".join(f"{w}{i}" for i in range(60))
    a, b, c, d, e = map(say, "abcde")
    rows = [
        (1, a, "x"), (1, a, "y"), (1, a + " tail", "z"), (2, a, "x"), (None, a, "x"),  # the least doc_id repeats
        (2, b, "x"), (3, b, "x"),  # doc_id 2 is a copy of 1 as well
        (2, c, "x"), (2, None, "x"), (2, None, "x"),  # like nothing else, beside a copy
        (None, d, "x"), (None, d, "x"), (None, d + " tail", "x"),  # a group without any doc_id
        (None, e, "x"), (None, "", "x"), (4, None, "x"),
    ]
    made = spark.createDataFrame(rows, "doc_id int, text string, fate string").repartition(3)
    kept = keep_one_per_group(made)
    assert kept.schema == made.schema
    kept = [tuple(r) for r in kept.collect()]
    of = lambda w: [r for r in kept if r[1] and r[1].startswith(f"{w}0")]
    assert [len(of(w)) for w in "abcde"] == [1, 1, 1, 1, 1]
    assert of("a")[0][0] == 1 and of("b") == [(2, b, "x")] and of("c") == [(2, c, "x")] and of("d")[0][0] is None
    assert sorted(map(str, (r for r in kept if not r[1]))) == sorted(map(str, [(2, None, "x"), (2, None, "x"), (None, "", "x"), (4, None, "x")]))


def test_bands_share_one():
    rule = Threshold(4, 85, 100)
    for n in range(1, 700):
        own = {b for b, _ in rule.bands(n)}
        for m in range(-(-85 * n // 100), n + 1):
            shared = own & {b for b, _ in rule.bands(m)}
            assert shared and all(top >= n for b, top in rule.bands(m) if b in shared)


def test_several_components_around_a_centre(spark, same, monkeypatch):
    """Families that share buckets with one centre and not with each other, in
    blocks of a few classes, under one doc_id, without any, and with many."""
    from tidemark.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for family in range(5):
        own = list(base)
        for j in range(5):
            own[(family * 23 + j * 4) % 120] = f"f{family}x{j}"
        for i in range(7):
            text = list(own)
            for j in range(i % 3):
                text[(i * 31 + j * 17 + family) % 120] = f"e{family}{i}{j}"
            texts.append(" ".join(text))
    for ids in (list(range(len(texts))), [7] * len(texts), [None] * len(texts), [i % 3 if i % 2 else None for i in range(len(texts))]):
        rows = list(zip(ids, texts))
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Threshold(4, 85, 100))
        same([tuple(r) for r in got.collect()], brute(rows, 4, 85, 100))
