import hashlib
import re

import pytest

from tidemark.llm.decontaminate import Winnowing, contamination, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, n=10):
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(name) if name is not None else "")
    lengths = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w, hit, names = words(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    names |= own
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    return out


def flat(rows):
    out = []
    for r in rows:
        assert sum(s.end_word - s.first_word for s in r.spans) == r.n_hit
        out.append((r.doc_id, r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def items(spark, odd, sf_dir):
    own = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = [r.text for r in odd.collect() if r.text]
    more = [" ".join(words(t)[3:17]) for t in texts[10:20]] + [" ".join(words(t)[:4]) for t in texts[20:23]] + ["one two three", None, "", "!!", "one"]
    return [*own, *[(1000 + i, t) for i, t in enumerate(more)], (None, more[0]), (1000, more[1])]


@pytest.mark.parametrize("bound", [1 << 30, 0])
def test_against_brute_force(spark, odd, documents, items, same, bound):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for docs in (odd, documents.select("doc_id", "text")):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        same(flat(contamination(docs, benchmark, local_bytes=bound).collect()), brute(rows, items))
        clean = drop_contaminated(docs, benchmark, local_bytes=bound)
        assert clean.columns == docs.columns
        same([(r.doc_id, r.text) for r in clean.collect()], [row for row, x in zip(rows, brute(rows, items)) if not x[2]])


def test_short_rule_and_empty_tables(spark, odd, none, items, same):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    same(flat(contamination(odd, benchmark, Winnowing(4, 2)).collect()), brute(rows, items, 4))
    for bound in (1 << 30, 0):
        assert contamination(none, benchmark, local_bytes=bound).count() == 0
    assert {r.n_hit for r in contamination(odd, benchmark.limit(0)).collect()} == {0}
    assert drop_contaminated(odd, benchmark.limit(0)).count() == odd.count()
