import re

import pytest

from tidemark.llm.suffix_dedup import deduplicate, shared_passages, splits


def words(text):
    return [(m[0].lower() if m[0].isascii() else "".join(c.lower() if c.isascii() else c for c in m[0]), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]


def repeated_places(rows, least):
    """Words of each text that lie in a passage of ``least`` words which
    occurs elsewhere, too."""
    where = {}
    rows = sorted(set(rows), key=str)
    split = [words(t) for _, t in rows]
    for i, w in enumerate(split):
        for j in range(len(w) - least + 1):
            where.setdefault(tuple(x[0] for x in w[j : j + least]), []).append((i, j))
    hit = {}
    for v in where.values():
        if len(v) > 1:
            for i, j in v:
                hit.setdefault(i, set()).update(range(j, j + least))
    return rows, split, hit


def test_matches(odd, documents, none):
    for docs in (odd, documents):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        rows, split, hit = repeated_places(rows, 50)
        by_id = {}
        for i, (d, _) in enumerate(rows):
            by_id.setdefault(d, []).append(i)
        covered = {}
        for r in shared_passages(docs).collect():
            assert r.n_words >= 50
            texts = []
            for d, s, e in ((r.doc_id, r.start, r.end), (r.other_doc_id, r.other_start, r.other_end)):
                fits = [i for i in by_id[d] if any(x[1] == s for x in split[i]) and any(x[2] == e for x in split[i])]
                texts.append({tuple(x[0] for x in split[i] if s <= x[1] and x[2] <= e) for i in fits})
                for i in fits:
                    covered.setdefault(i, set()).update(j for j, x in enumerate(split[i]) if s <= x[1] and x[2] <= e)
            assert texts[0] & texts[1]
        for i, own in hit.items():
            assert own <= covered.get(i, set()), (rows[i][0], len(own), len(covered.get(i, ())))
    assert shared_passages(none).count() == 0 and deduplicate(none).count() == 0


def test_one_copy_stays(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"start{i} a{i} {passage} end{i} b{i}") for i in range(6)] + [(9, passage + " mid " + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in deduplicate(docs).collect()}
    assert out[0] == rows[0][1] and sum(t.count("p0 p1 p2") for t in out.values()) == 1
    assert out[9].split() == ["mid"]


def test_texts_that_share_a_doc_id(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(1, f"a {passage} b"), (2, f"c {passage} d"), (2, "another text " + " ".join(f"q{i}" for i in range(90))), (None, f"e {passage} f"), (3, passage), (3, passage), (4, "few words"), (4, "few words")]
    out = deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out.collect())
    want = [rows[0], (2, "c  d"), rows[2], (None, "e  f"), (3, ""), (3, ""), rows[6], rows[7]]
    assert got == sorted((d is None, d or 0, t) for d, t in want)


def test_keys_meet():
    for k, least in ((20, 50), (20, 20), (20, 21), (7, 30), (1, 50)):
        for before in range(least - k + 1):
            after = least - k - before
            assert any(x <= before and y <= after for x, y in splits(k, least)), (k, least, before)


@pytest.mark.parametrize("shared", [50, 51, 57, 70])
def test_passages_behind_widely_shared_words(spark, shared):
    """Each passage is in two texts; its parts of 20 to 40 words are in many
    others, with other words around them, so that neighbours mislead."""
    rows, wanted, n = [], {}, 0
    for p in range(12):
        passage = [f"p{p}w{i}" for i in range(shared)]
        for i in range(40):
            size = 20 + (i * 7 + p) % 21
            at = (i * 11) % (shared - size + 1)
            rows.append((n, " ".join([f"a{n}x{j}" for j in range(30)] + passage[at : at + size] + [f"b{n}x{j}" for j in range(30)])))
            n += 1
        for i in range(2):
            rows.append((n, " ".join([f"a{n}x{j}" for j in range(10)] + passage + [f"b{n}x{j}" for j in range(10)])))
            n += 1
        wanted[n - 1] = n - 2
    got = shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {(r.doc_id, r.other_doc_id, r.n_words) for r in got} == {(b, a, shared) for b, a in wanted.items()}


@pytest.mark.parametrize("before", range(5))
def test_pairs_around_boilerplate(spark, before):
    """Passages of 51 words whose middle 47 words many earlier texts have."""
    rows, wanted = [], []
    for p in range(10):
        middle = [f"p{p}w{i}" for i in range(47)]
        rows += [(len(rows) + i, " ".join([f"a{p}x{i}y{j}" for j in range(9)] + middle + [f"b{p}x{i}y{j}" for j in range(9)])) for i in range(60)]
    for p in range(100):
        passage = [f"l{p}w{j}" for j in range(before)] + [f"p{p % 10}w{i}" for i in range(47)] + [f"r{p}w{j}" for j in range(4 - before)]
        for _ in range(2):
            rows.append((len(rows), " ".join([f"c{len(rows)}x{j}" for j in range(40)] + passage + [f"d{len(rows)}x{j}" for j in range(40)])))
        wanted.append((len(rows) - 1, len(rows) - 2, 51))
    got = shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id, r.other_doc_id, r.n_words) for r in got) == wanted


def test_contexts_reach_as_far_as_passages(spark):
    """Texts that agree in 29 words on each side of the k words and no more."""
    rows = []
    for i in range(30):
        base = [f"w{j}" for j in range(120)]
        base[(i * 7) % 40], base[80 + (i * 3) % 40] = f"x{i // 2}", f"y{i // 3}"
        rows.append((i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    split, hit = repeated_places(rows, 50)[1:]
    covered = {}
    for r in shared_passages(docs).collect():
        for d, s, e in ((r.doc_id, r.start, r.end), (r.other_doc_id, r.other_start, r.other_end)):
            i = [x[0] for x in sorted(rows, key=str)].index(d)
            covered.setdefault(i, set()).update(j for j, x in enumerate(split[i]) if s <= x[1] and x[2] <= e)
    assert covered == hit


def test_a_passage_of_more_copies_than_a_range(spark):
    """Copies fill several ranges of the order; every one of them is found, the
    passage with a single retained suffix too."""
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [f"x{i} y{i} {passage if i % 3 else ' '.join(f'q{i}z{j}' for j in range(50))} u{i} v{i}" for i in range(600)]
    got = shared_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)).collect()
    assert sorted((r.doc_id, r.other_doc_id, r.n_words) for r in got) == [(i, 1, 50) for i in range(2, 600) if i % 3]
