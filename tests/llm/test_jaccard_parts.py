"""Texts of classes around a centre: sent once, or some blocks at a time."""

import random

import pytest

from tidemark.llm import jaccard_join as J


def variants(n):
    """Texts of which neighbours link, with labels in two halves."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words[r.randrange(60)] = f"v{i}"
        rows.append((100 + i, " ".join(words)))
    return rows


def linked(rows, k, num, den, label):
    sets = {c: {tuple(t.split()[i : i + k]) for i in range(61 - k)} for c, t in rows}
    return {(a, b) for a in sets for b in sets if a < b and label(a) != label(b) and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("block", "sent", "parts"), [(256, 1 << 29, 1), (4, 1 << 29, 1), (4, 3000, 5), (256, 1, 1)])
def test_parts_find_the_links_of_all(spark, monkeypatch, block, sent, parts):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "SENT", sent)
    monkeypatch.setattr(J, "SENT_TIMES", 0 if sent == 3000 else 2)
    rows, rule = variants(24), J.Threshold(3, 60, 100)
    label = lambda c: 100 if c < 115 else 115
    texts = spark.createDataFrame(rows, "cls long, text string")
    rest = spark.createDataFrame([(7, c, label(c)) for c, _ in rows], "centre long, cls long, label long")
    written, rows_in = [], spark.sparkContext.accumulator(0)
    write, compare = J.materialise, J._compare
    monkeypatch.setattr(J, "materialise", lambda df: (written.append(df.columns), write(df))[1])

    def counted(rule):
        run = compare(rule)

        def task(table):
            rows_in.add(len(table))
            return run(table)

        return task

    monkeypatch.setattr(J, "_compare", counted)
    found = {(min(r), max(r)) for r in J._across_labels(rest, texts, rule).select("a", "b").collect()}
    every = linked(rows, 3, 60, 100, label)
    assert len(every) > 1 and found <= every and found
    assert written.count(["a", "b"]) >= parts
    if block == 256:
        assert rows_in.value == 24  # none is sent a second time to be held against the others
    # What links of both halves leave connected: the two labels are one.
    assert len(found) >= 1 and {label(a) for a, _ in found} == {100} and {label(b) for _, b in found} == {115}
