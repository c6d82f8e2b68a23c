"""Deduplication of long shared passages by sparse suffix arrays.

Suffixes of the texts, in words, are retained where a window of ``k`` words is
a minimiser: its hash is the least of a run of neighbouring windows. The run is
so long that every passage of ``least_words`` words has a retained suffix at
the same place of each copy. Suffixes whose first ``k`` words occur once are
dropped.

What stands around the ``k`` words decides which suffixes are compared. A
passage may reach far to the left of them or far to the right, so each suffix
has ``SPLITS`` keys: hashes of the ``k`` words with some words before and some
after them. Wherever the ``k`` words lie in a shared passage of ``least_words``
words, both copies agree in one of the keys. Suffixes that agree in all words
that such a passage can have are one context and held against its first; the
first ones of the contexts are held, in sorted order, against their neighbours,
and, where two agree in a key, against each other. Where more than two do, what
they share may end before ``least_words`` words, so that they are keyed again by
each whole window of so many words and held against the earliest of the same
window. A match is extended word by word to the left and to the right on the
whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import text as T
from tidemark.llm.storage import materialise
from tidemark.llm.substring_dedup import remove_spans

_U = np.uint64
SPLITS = 4
_KEYS = tuple(f"h{i}" for i in range(SPLITS))
_SUFFIX = "g1 long, ctx long, " + ", ".join(f"{h} long" for h in _KEYS) + ", doc long, th long, pos long"
_PAIR = "doc_a long, th_a long, a long, doc_b long, th_b long, b long"


def splits(k: int, least_words: int) -> list[tuple[int, int]]:
    """(words before, words after) the k words of each key: if two suffixes
    agree in x words before and in least_words - k - x after, they agree in
    what one of these asks for."""
    asked = max(0, least_words - k - _step(k, least_words) + 1)
    return [(before, asked - before) for before in (min(i * _step(k, least_words), asked) for i in range(SPLITS))]


def _step(k: int, least_words: int) -> int:
    """How many windows of ``least_words`` words each key stands for."""
    return -(-(least_words - k + 1) // SPLITS)


def minimisers(words: T.Tokens, k: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the k-word windows that are least in a run."""
    values, first = T.grams(words.hashes, words.bounds, k)
    m = len(values) - run + 1
    keep = np.zeros(len(values), dtype=bool)
    if m > 0:
        room = np.repeat(words.bounds[1:], np.diff(words.bounds))[first] - first - k + 1
        least, width = values.copy(), 1
        while width < run:  # least of ever longer runs
            step = min(width, run - width)
            least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
            width += step
        whole = room[:m] >= run
        for j in range(run):
            keep[j : j + m] |= whole & (values[j : j + m] == least[:m])
    return values[keep], first[keep]


_INVERSE = _U(pow(int(T._WORD_BASE), -1, 1 << 64))


class _Around:
    """Hashes of stretches of words around given words, from running sums:
    each costs the same, however long. What is outside a text counts as no word."""

    def __init__(self, words: T.Tokens):
        n = len(words.hashes)
        self.words = words
        self.power = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, T._WORD_BASE)]), dtype=_U)
        inverse = np.cumprod(np.full(n, _INVERSE), dtype=_U)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(words.hashes * inverse, dtype=_U)])

    def __call__(self, first: np.ndarray, before: int, length: int) -> np.ndarray:
        document = self.words.document[first]
        low = np.maximum(first - before, self.words.bounds[document])
        high = np.minimum(first - before + length, self.words.bounds[document + 1])
        value = (self.sums[high] - self.sums[low]) * self.power[high]
        shape = (first - low).astype(_U) << _U(32) | (high - first).astype(_U)
        return T.mix(T.mix(value + _U(before + 1)) ^ T.mix(shape))


def _suffixes(k: int, least_words: int):
    keys = splits(k, least_words)

    def go(batches):
        for batch in batches:
            part = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc", "th", "text")}
            for block in T.blocks(part["text"]):
                words = T.tokens(block, T.WORDS_FOLDED)
                values, first = minimisers(words, k, least_words - k + 1)
                document = words.document[first]
                ids = [part[c].slice(block.first, len(block)).take(pa.array(document)) for c in ("doc", "th")]
                around, room = _Around(words), least_words - k
                hashes = [T.as_long(around(first, x, x + k + y)) for x, y in [(room, room), *keys]]
                yield pa.RecordBatch.from_arrays([T.as_long(values), *hashes, *ids, pa.array(first - words.bounds[document])], ["g1", "ctx", *_KEYS, "doc", "th", "pos"])

    return go


def _windows(k: int, least_words: int):
    """Hashes of the windows of ``least_words`` words around the suffixes that
    are asked for, for the keys that are."""
    room, step = least_words - k, _step(k, least_words)

    def go(batches):
        for batch in batches:
            part = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc", "th", "text", "asked")}
            for block in T.blocks(part["text"]):
                words = T.tokens(block, T.WORDS_FOLDED)
                around = _Around(words)
                asked = part["asked"].slice(block.first, len(block))
                of = np.repeat(np.arange(len(block)), np.asarray(asked.value_lengths()))
                pos, split = (np.asarray(asked.flatten().field(c)) for c in ("pos", "split"))
                first = words.bounds[of] + pos
                for i, (x, _) in enumerate(splits(k, least_words)):
                    for before in range(x, min(x + step, room + 1)):
                        mine = np.flatnonzero((split == i) & (pos >= before) & (first - before + least_words <= words.bounds[of + 1]))
                        ids = [part[c].slice(block.first, len(block)).take(pa.array(of[mine])) for c in ("doc", "th")]
                        yield pa.RecordBatch.from_arrays([T.as_long(around(first[mine], before, least_words)), *ids, pa.array(pos[mine])], ["h", "doc", "th", "pos"])

    return go


def _neighbours(batches):
    """Pairs of contexts that are next to each other in sorted order and have
    the same first words; the earlier occurrence comes first."""
    last = None
    for batch in batches:
        column = lambda c: np.asarray(batch.column(batch.schema.get_field_index(c)))  # noqa: E731,B023
        rows = np.stack([column(c) for c in ("g1", "doc", "th", "pos")], axis=1)
        if last is not None:
            rows = np.concatenate([last, rows])
        last = rows[-1:]
        near = rows[1:, 0] == rows[:-1, 0]
        x, y = rows[:-1, 1:][near], rows[1:, 1:][near]
        swap = (x[:, 0] > y[:, 0]) | ((x[:, 0] == y[:, 0]) & ((x[:, 1] > y[:, 1]) | ((x[:, 1] == y[:, 1]) & (x[:, 2] > y[:, 2]))))
        x[swap], y[swap] = y[swap], x[swap].copy()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*x.T.copy(), *y.T.copy())], ["doc_a", "th_a", "a", "doc_b", "th_b", "b"])


def _compared(rows: DataFrame, repeated: DataFrame, n: int, least_words: int, k: int) -> DataFrame:
    """Pairs of suffixes whose texts are to be compared, from suffixes whose
    first words occur more than once."""
    place = F.struct("doc", "th", "pos")
    pair = lambda a, b: [F.col(f"{x}.{c}").alias(y) for x, own in ((a, ("doc_a", "th_a", "a")), (b, ("doc_b", "th_b", "b"))) for c, y in zip(("doc", "th", "pos"), own)]
    named = repeated.withColumn("own", place)
    # Written, so that each join deals both sides out anew and can split a passage that is everywhere.
    contexts = materialise(named.groupBy("ctx").agg(F.min("own").alias("f"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("g1", *_KEYS)]))
    same = named.select("ctx", "own").join(contexts.filter("n > 1").select("ctx", "f"), "ctx").filter("own <> f").select(*pair("f", "own"))
    by_key = contexts.select(F.posexplode(F.array(*_KEYS)).alias("split", "h"), F.col("f").alias("own"))
    earliest = materialise(by_key.groupBy("h").agg(F.min("own").alias("f"), F.count("*").alias("n")).filter("n > 1"))
    alike = materialise(by_key.join(earliest, "h"))
    two = alike.filter("n = 2 AND own <> f").select(*pair("f", "own"))
    asked = alike.filter("n > 2").groupBy("own.doc", "own.th").agg(F.collect_set(F.struct("own.pos", "split")).alias("asked"))
    windows = materialise(rows.join(asked, ["doc", "th"]).mapInArrow(_windows(k, least_words), "h long, doc long, th long, pos long").select("h", place.alias("own")))
    least = windows.groupBy("h").agg(F.min("own").alias("f"), F.max("own").alias("l")).filter("f <> l").drop("l")
    more = windows.join(least, "h").filter("own <> f").select(*pair("f", "own"))
    order = ["g1", *_KEYS, "doc", "th", "pos"]
    ranged = contexts.select("g1", *_KEYS, "f.*").repartitionByRange(n, *order).sortWithinPartitions(*order)
    return same.unionByName(two).unionByName(more).unionByName(ranged.mapInArrow(_neighbours, _PAIR))


@dataclass(frozen=True)
class _Text:
    """Words of one text, with their places in code points."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _texts(column) -> Iterator[_Text]:
    for block in T.blocks(column):
        words = T.tokens(block, T.WORDS_FOLDED)
        points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
        for i in range(len(block)):
            own = slice(words.bounds[i], words.bounds[i + 1])
            base = points[block.offsets[i]]
            yield _Text(words.hashes[own], points[words.starts[own]] - base, points[words.ends[own]] - base)


def _run(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading elements agree; looks further only as far as needed."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        differ = np.flatnonzero(x[at : min(n, at + step)] != y[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 4
    return n


def _extend(least_words: int):
    def run(batches):
        name, x = None, None
        for batch in batches:
            part = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_a", "th_a", "doc_b", "th_b", "text_a", "text_b")}
            hits = batch.column(batch.schema.get_field_index("hits"))
            names = list(zip(part["doc_a"].to_pylist(), part["th_a"].to_pylist()))
            docs = list(zip(part["doc_b"].to_pylist(), part["th_b"].to_pylist()))
            out = []
            for i, y in enumerate(_texts(part["text_b"])):
                if names[i] != name:
                    name, x = names[i], next(_texts(part["text_a"].slice(i, 1)))
                done: dict[int, int] = {}
                for a, b in sorted((h["a"], h["b"]) for h in hits[i].as_py()):
                    if a < done.get(a - b, 0):
                        continue
                    left = _run(x.hashes[:a][::-1], y.hashes[:b][::-1])
                    right = _run(x.hashes[a:], y.hashes[b:])
                    done[a - b] = a + right
                    if left + right >= least_words:
                        out.append((name[0], x.starts[a - left], x.ends[a + right - 1], *docs[i], y.starts[b - left], y.ends[b + right - 1], left + right))
            columns = list(zip(*out)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(map(int, c)), pa.int64()) for c in columns], ["doc_a", "start_a", "end_a", "doc_b", "th_b", "start_b", "end_b", "n_words"])

    return run


_NULL = 2**63 - 1


def shared_passages(docs: DataFrame, least_words: int = 50, k: int = 20) -> DataFrame:
    """One row per match: doc_id, start, end, other_doc_id, other_start,
    other_end (code points, ends exclusive), n_words; the other one ranks
    first, by doc_id (null last) and place. Of passages with many copies each is
    matched with its earlier neighbours in the order of suffixes, so all copies
    but the first are named and rows grow with the copies.

    ``docs`` needs doc_id and text. Rows that agree in doc_id and text count
    once. Texts of fewer than ``least_words`` words, and null texts, have no
    matches. A passage may repeat within one text.
    """
    return _shared(docs, least_words, k).drop("th")


def _shared(docs: DataFrame, least_words: int, k: int) -> DataFrame:
    """``shared_passages`` with th, the hash of the text, for ``remove_spans``."""
    if not 0 < k <= least_words:
        raise ValueError("need 0 < k <= least_words")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), F.xxhash64("text").alias("th"), "text")
    suffixes = rows.mapInArrow(_suffixes(k, least_words), _SUFFIX)
    # Written, so that the join deals both sides out anew and can split a passage that is everywhere.
    often = materialise(suffixes.groupBy("g1").agg(F.count("*").alias("n")).filter("n > 1").select("g1"))
    pairs = _compared(rows, materialise(suffixes.join(often, "g1")), n, least_words, k)
    by_pair = materialise(pairs.groupBy("doc_a", "th_a", "doc_b", "th_b").agg(F.collect_set(F.struct("a", "b")).alias("hits")))
    wanted = by_pair.select(F.col("doc_a").alias("doc"), F.col("th_a").alias("th")).union(by_pair.select("doc_b", "th_b")).distinct()
    texts = materialise(rows.join(wanted, ["doc", "th"]).select("doc", "th", "text"))
    one = texts.select(F.col("doc").alias("doc_b"), F.col("th").alias("th_b"), F.col("text").alias("text_b"))
    two = texts.select(F.col("doc").alias("doc_a"), F.col("th").alias("th_a"), F.col("text").alias("text_a"))
    both = by_pair.join(one, ["doc_b", "th_b"]).join(two, ["doc_a", "th_a"]).select("doc_a", "th_a", "doc_b", "th_b", "hits", "text_a", "text_b")
    found = both.mapInArrow(_extend(least_words), "doc_a long, start_a long, end_a long, doc_b long, th_b long, start_b long, end_b long, n_words long")
    # Of the matches of a document, those that lie within another say nothing more. Its matches are no more than its words.
    wide = Window.partitionBy("doc_b", "th_b").orderBy("start_b", F.desc("end_b"), "doc_a", "start_a").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_far", F.max("end_b").over(wide)).filter("_far IS NULL OR end_b > _far")
    null = lambda c: F.when(F.col(c) != _NULL, F.col(c))
    return found.select(null("doc_b").alias("doc_id"), F.col("th_b").alias("th"), F.col("start_b").alias("start"), F.col("end_b").alias("end"), null("doc_a").alias("other_doc_id"), F.col("start_a").alias("other_start"), F.col("end_a").alias("other_end"), "n_words")


def deduplicate(docs: DataFrame, least_words: int = 50, k: int = 20) -> DataFrame:
    """``docs`` with every copy but the first of a shared passage cut out. Null
    texts stay null; all columns and the number of rows stay."""
    return remove_spans(docs, _shared(docs, least_words, k).select("doc_id", "th", "start", "end"), least_words)
