"""Substring deduplication by hashing lines or paragraphs.

A text is cut into units: lines, paragraphs (between empty lines), or the
sentences of lines. A unit is normalised (A-Z lowered, white space made single
spaces) and named by a 128-bit digest. Digests are grouped over all documents;
the occurrence that ranks first, by doc_id and then place, is kept, and all
others are removed. Removed spans keep their offsets in the original text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as T
from tidemark.llm.storage import columns_free, materialise

_U = np.uint64
UNITS = ("sentence", "line", "paragraph")
#: Paragraphs of any length; lines and sentences from thirteen words on, as short ones repeat by chance.
FLOORS = {"line": 13, "paragraph": 1, "sentence": 13}
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True
#: The same words with other values, for the second half of the digest.
_SECOND = T.Alphabet(T.WORDS_FOLDED.member, T.mix(T.WORDS_FOLDED.value + _U(0x5851F42D)))


def units(block: T.Block, floors: dict[str, int]):
    """(document, start, end in code points, digest halves) of the units of
    each given kind with at least so many words; a span that is a unit of
    several kinds comes once."""
    words = T.tokens(block, T.WORDS_FOLDED)
    n = len(words.hashes)
    document = words.document
    if n == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, _U), np.empty(0, _U)
    breaks = np.concatenate([[0], np.cumsum(block.data == 10)])
    gap = breaks[words.starts[1:]] - breaks[words.ends[:-1]]
    firsts, sizes = [], []
    for unit, least_words in floors.items():
        last = np.ones(n, dtype=bool)
        last[:-1] = (document[1:] != document[:-1]) | (gap >= (2 if unit == "paragraph" else 1))
        if unit == "sentence":
            last |= _STOP[block.data[words.ends - 1]]
        first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
        size = np.diff(np.append(first, n))
        firsts.append(first[size >= least_words])
        sizes.append(size[size >= least_words])
    first, size = np.unique(np.stack([np.concatenate(firsts), np.concatenate(sizes)]), axis=1) if len(floors) > 1 else (firsts[0], sizes[0])
    if len(first) == 0:
        return first, first, first, np.empty(0, _U), np.empty(0, _U)
    at = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)
    where = np.repeat(first, size) + place
    place = place.astype(_U)
    one = np.add.reduceat(T.mix(words.hashes[where] + place * _U(0x9E3779B97F4A7C15)), at[:-1])
    two = np.add.reduceat(T.mix(T.tokens(block, _SECOND).hashes[where] ^ T.mix(place + _U(0x1234567))), at[:-1]) + size.astype(_U)
    points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    owner = document[first]
    base = points[block.offsets[owner]]
    return owner, points[words.starts[first]] - base, points[words.ends[first + size - 1]] - base, one, two


def repeated_units(docs: DataFrame, unit: str = "sentence", least_words: int = 8) -> DataFrame:
    """``repeated_passages`` of one kind of unit."""
    return repeated_passages(docs, {unit: least_words})


def repeated_passages(docs: DataFrame, floors: dict[str, int] = FLOORS) -> DataFrame:
    """One row per removed occurrence: doc_id, start, end (code points, end
    exclusive), kept_doc_id, kept_start, n_occurrences.

    ``floors``: the kinds of units, each with the fewest words that a unit of
    it has. Units of the same words are one passage, of whatever kind they are;
    spans of different kinds may lie inside each other. ``docs`` needs doc_id
    and text. A null doc_id ranks last; texts that share a doc_id rank by place
    and then by their hash. Rows that agree in doc_id and text are one
    occurrence and get one row. Null, empty and wordless texts have no units
    and no rows.
    """
    return _repeated(docs, floors).drop("th")


def _repeated(docs: DataFrame, floors: dict[str, int]) -> DataFrame:
    """``repeated_passages`` with th, the hash of the text, for ``remove_spans``."""
    if not floors or any(unit not in UNITS for unit in floors):
        raise ValueError(f"units must be among {UNITS}")

    def run(batches):
        for batch in batches:
            names = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "th")]
            for block in T.blocks(batch.column(batch.schema.get_field_index("text"))):
                owner, start, end, one, two = units(block, floors)
                yield pa.RecordBatch.from_arrays([*(c.slice(block.first, len(block)).take(pa.array(owner)) for c in names), pa.array(start), pa.array(end), T.as_long(one), T.as_long(two)], ["doc_id", "th", "start", "end", "d1", "d2"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    found = materialise(rows.mapInArrow(run, "doc_id long, th long, start long, end long, d1 long, d2 long"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("th").alias("t"))
    # Counted and ranked before the shuffle: a digest that is in many documents sends one row from each task.
    # Written, so that the join deals both sides out anew and can split the rows of such a digest.
    groups = materialise(found.groupBy("d1", "d2").agg(F.count("*").alias("n_occurrences"), F.min(rank).alias("kept")).filter("n_occurrences > 1"))
    removed = found.join(groups, ["d1", "d2"]).filter("NOT (doc_id <=> kept.d AND start = kept.s AND th = kept.t)")
    return removed.select("doc_id", "th", "start", "end", F.col("kept.d").alias("kept_doc_id"), F.col("kept.s").alias("kept_start"), "n_occurrences").distinct()


def _cut(column: str, cuts: str):
    """Rows with the spans in ``cuts`` taken out of ``column``."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts, spans = batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index(cuts))
            for i, own in enumerate(spans.to_pylist()):
                if own and texts[i] is not None:
                    pieces, done = [], 0
                    for span in own:  # ascending
                        pieces.append(texts[i][done : max(done, span["s"])])
                        done = max(done, span["e"])
                    texts[i] = "".join([*pieces, texts[i][done:]])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return run


def remove_spans(docs: DataFrame, spans: DataFrame, least_words: int = 1) -> DataFrame:
    """``docs`` without the given spans of their texts.

    ``spans``: doc_id, th (``xxhash64`` of the text), start, end in code
    points; rows of ``docs`` with that doc_id (null too) and that text are cut,
    other texts of the same doc_id stay. Of rows that agree in doc_id and text
    one is cut so; the others are repeats as a whole, and where their text has
    ``least_words`` words or more they are left with an empty text. All columns
    and the number of rows stay.
    """
    id_, th, cuts, whose, what, row, first, words = columns_free(docs, "id", "th", "cuts", "whose", "what", "row", "first", "words")
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), th: F.xxhash64("text")})
    same = lambda a, b: a[id_].eqNullSafe(b[whose]) & (a[th] == b[what])
    # Written, so that each join deals both sides out anew and can split a document that is there many times.
    by_doc = spans.groupBy(F.col("doc_id").alias(whose), F.col("th").alias(what)).agg(F.sort_array(F.collect_set(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias(cuts))
    by_doc = materialise(by_doc)
    repeats = materialise(keyed.filter("text IS NOT NULL").groupBy(F.col(id_).alias(whose), F.col(th).alias(what)).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    numbered = materialise(keyed.join(repeats, same(keyed, repeats), "left_semi").withColumn(row, F.monotonically_increasing_id()))
    firsts = materialise(numbered.groupBy(F.col(id_).alias(whose), F.col(th).alias(what)).agg(F.min(row).alias(first)))
    matched = numbered.join(firsts, same(numbered, firsts)).drop(whose, what)
    n_words = F.size(F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    others = matched.filter(F.col(row) != F.col(first)).withColumn("text", F.when(n_words < least_words, F.col("text")).otherwise(F.lit("")))
    once = keyed.join(repeats, same(keyed, repeats), "left_anti").unionByName(matched.filter(F.col(row) == F.col(first)).select(keyed.columns))
    cut = once.join(by_doc, same(once, by_doc), "left").select(*docs.columns, cuts)
    cut = cut.mapInArrow(_cut("text", cuts), cut.schema)
    return cut.select(docs.columns).unionByName(others.select(docs.columns))


def deduplicate(docs: DataFrame, unit: str = "sentence", least_words: int = 8) -> DataFrame:
    """``docs`` with the repeated units cut out of their texts. Null texts stay
    null, all columns and the number of rows stay, and the earliest occurrence
    of a unit stays where it is."""
    return remove_spans(docs, _repeated(docs, {unit: least_words}))
