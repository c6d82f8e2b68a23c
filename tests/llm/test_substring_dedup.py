import re

import pytest
import xxhash

from tidemark.llm.substring_dedup import deduplicate, repeated_passages, repeated_units


def plain(rows, unit, least):
    seen, out = {}, set()
    found = []
    for d, text in set(rows):
        pieces = []
        words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        for i, (s, e) in enumerate(words):
            pieces.append((s, e))
            gap = text[e : words[i + 1][0]].count("\n") if i + 1 < len(words) else 9
            if gap >= (2 if unit == "paragraph" else 1) or (unit == "sentence" and text[e - 1] in ".!?"):
                if len(pieces) >= least:
                    name = " ".join("".join(c.lower() if c.isascii() else c for c in text[a:b]) for a, b in pieces)
                    found.append((d is None, d, pieces[0][0], pieces[-1][1], name, text_hash(text)))
                pieces = []
    for none, d, s, e, name, th in sorted(found, key=lambda x: (x[0], x[1] or 0, x[2], x[5])):
        if name in seen and seen[name] != (d, s, th):
            out.add((d, th, s, e, *seen[name][:2]))
        seen.setdefault(name, (d, s, th))
    return [(d, s, e, *kept) for d, _, s, e, *kept in out]


def text_hash(text):
    """Spark's xxhash64 of a text."""
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("unit,least", [("sentence", 8), ("line", 3), ("paragraph", 1)])
def test_against_plain(odd, documents, same, unit, least):
    for docs in (odd, documents):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        same([tuple(r)[:5] for r in repeated_units(docs, unit, least).collect()], plain(rows, unit, least))


def test_texts_without_repeats(spark, odd, none, documents):
    out = deduplicate(documents)
    assert out.columns == documents.columns and out.count() == documents.count()
    assert deduplicate(odd).columns == odd.columns and deduplicate(odd).count() == odd.count()
    assert repeated_units(none).count() == 0 and deduplicate(none).count() == 0
    rows = [(1, "Alpha beta gämma delta one two three four.\nkeep a"), (2, "x ü ALPHA beta gämma  delta one two three four. Keep b"), (3, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in deduplicate(made).collect()} == {1: rows[0][1], 2: rows[1][1], 3: None}
    assert {r.doc_id: r.text for r in deduplicate(spark.createDataFrame([rows[0], (2, "x ü. ALPHA beta gämma  delta one two three four. Keep b"), rows[2]], "doc_id long, text string")).collect()}[2] == "x ü.  Keep b"


def test_lines_of_any_length(spark):
    """Short lines, lines of short sentences and whole paragraphs are passages
    too, beside the sentences inside lines, and none is counted twice."""
    line, long_one = "The and, anea. Eriner thanea.", "one two three four five six seven eight."
    rows = [(1, f"a\n{line}\n\nb {long_one[4:]}"), (2, f"c\n{line}\nd. {long_one}"), (3, f"{line}\n\n{long_one}\ne"), (4, f"e\n\n{long_one} e"), (5, "x y\nz"), (6, "w\n\nx  Y\nz\n")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = sorted((r.doc_id, text[r.doc_id][r.start : r.end], r.kept_doc_id, r.kept_start, r.n_occurrences) for r in repeated_passages(made, {"line": 1, "paragraph": 1, "sentence": 8}).collect())
    assert got == [
        (2, line, 1, 2, 3), (3, line, 1, 2, 3), (3, long_one, 2, 35, 3), (4, "e", 3, 72, 2), (4, long_one, 2, 35, 3), (4, f"{long_one} e", 3, 31, 2),
        (6, "x  Y", 5, 0, 2), (6, "x  Y\nz", 5, 0, 2), (6, "z", 5, 4, 2),
    ]


def test_the_query_removes_lines_and_paragraphs(spark, tmp_path):
    from tidemark.llm.queries import op1_substring_dedup

    line = "a line. of short ones. that has. thirteen words. or more. in all of. it"
    rows = [(1, f"Short line\nothers\n{line}\n\nshort paragraph"), (2, f"none\nshort  line\n{line.upper()}\n\nShort paragraph\n"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in op1_substring_dedup(spark, str(tmp_path)).collect())
    assert [(r[0], rows[1][1][r[1] : r[2]], *r[3:]) for r in got] == [(2, line.upper(), 1, 18, 2), (2, "Short paragraph", 1, 91, 2)]


def test_texts_that_share_a_doc_id(spark):
    """Cuts hold for one text of a doc_id, null doc_ids too; of repeated rows one stays."""
    unit = "one two three four five six seven nine."
    rows = [
        (1, f"{unit} First."), (2, f"{unit} Tail of the second text."), (2, "Completely other text that nobody else in the table has, kept in full."),
        (2, f"{unit} Tail of the second text."), (None, f"x. {unit} y"), (None, "other, without an id"), (5, "short"), (5, "short"), (6, None), (6, None), (7, "  "), (7, "  "),
    ]
    made = spark.createDataFrame([(d, t, i, "th") for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int, _th string")
    out = deduplicate(made)
    assert out.columns == made.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None) for r in out.collect())
    want = [(1, rows[0][1]), (2, " Tail of the second text."), (2, rows[2][1]), (2, ""), (None, "x.  y"), (None, rows[5][1]), (5, "short"), (5, ""), (6, None), (6, None), (7, "  "), (7, "  ")]
    assert got == sorted((d is None, d or 0, t or "", t is None) for d, t in want)
    assert sorted(r.row for r in out.collect()) == list(range(len(rows)))
