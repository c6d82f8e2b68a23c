"""Benchmark decontamination by winnowing.

A document word is hit when it lies in an occurrence of ``window`` consecutive
words of a benchmark item; an item of fewer words, but not none, is one window
of its own length. Fingerprints are the minimum ``k``-gram hashes of sliding
runs of ``window - k + 1`` k-grams, so every shared span of ``window`` words
has a fingerprint in common (for a shorter item, k is its length and every
k-gram is a fingerprint). Fingerprints that documents and benchmark share are
extended to the windows that contain them, which are held against the item's
windows; a span is the union of its windows.

A benchmark of up to ``local_bytes`` of text is indexed once and sent to every
task, and documents are not shuffled. Beyond that the fingerprints, and then
the windows, are joined as tables.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as T
from tidemark.llm.storage import materialise

_U = np.uint64
LOCAL_BYTES = 16 << 20


@dataclass(frozen=True)
class Winnowing:
    window: int = 10
    k: int = 5

    def __post_init__(self):
        if not 0 < self.k <= self.window:
            raise ValueError("need 0 < k <= window")

    def shape(self, length: int) -> tuple[int, int]:
        """(k, k-grams in a sliding run) for windows of ``length`` words."""
        return (self.k, self.window - self.k + 1) if length == self.window else (length, 1)


def fingerprints(words: T.Tokens, k: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected k-grams: hashes and the place of their first word."""
    values, first = T.grams(words.hashes, words.bounds, k)
    if run == 1 or len(values) == 0:
        return values, first
    room = np.repeat(words.bounds[1:], np.diff(words.bounds))[first] - first - k + 1  # k-grams from here to the document's end
    m = len(values) - run + 1
    keep = np.zeros(len(values), dtype=bool)
    if m > 0:
        least = values[:m].copy()
        for j in range(1, run):
            np.minimum(least, values[j : j + m], out=least)
        whole = room[:m] >= run
        for j in range(run):
            keep[j : j + m] |= whole & (values[j : j + m] == least)
    return values[keep], first[keep]


def window_hashes(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    acc = np.zeros(len(starts), dtype=_U)
    for j in range(length):
        acc = acc * T._WORD_BASE + hashes[starts + j]
    return T.mix(acc + _U(length))


def around(words: T.Tokens, places: np.ndarray, length: int, run: int) -> np.ndarray:
    """Starts of the windows of ``length`` words with a k-gram at ``places``."""
    if len(places) == 0:
        return places
    document = np.searchsorted(words.bounds, places, "right") - 1
    starts = places[:, None] - np.arange(run)
    good = (starts >= words.bounds[document][:, None]) & (starts + length <= words.bounds[document + 1][:, None])
    return np.unique(starts[good])


def _contained(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x in ``sorted_values``, or -1."""
    if len(sorted_values) == 0:
        return np.full(len(x), -1)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return np.where(sorted_values[at] == x, at, -1)


def index(items: list[tuple[str, str]], rule: Winnowing) -> dict:
    """Fingerprints and windows of benchmark items, by window length."""
    found = defaultdict(lambda: ([], [], []))
    if not items:
        return {}
    for block in T.blocks(pa.array([t for _, t in items], pa.string())):
        words = T.tokens(block, T.ALNUM_FOLDED)
        sizes = np.diff(words.bounds)
        for length in {min(int(n), rule.window) for n in sizes if n}:
            own = sizes >= length if length == rule.window else sizes == length
            k, run = rule.shape(length)
            values, first = fingerprints(words, k, run)
            document = words.document
            found[length][0].append(values[own[document[first]]])
            starts = T.grams(words.hashes, words.bounds, length)[1]
            starts = starts[own[document[starts]]]
            found[length][1].append(window_hashes(words.hashes, starts, length))
            found[length][2].append(document[starts] + block.first)
    out = {}
    for length, (values, windows, owner) in found.items():
        windows, owner = np.concatenate(windows), np.concatenate(owner)
        order = np.lexsort((owner, windows))
        windows, owner = windows[order], owner[order]
        unique, at = np.unique(windows, return_index=True)
        out[length] = (np.unique(np.concatenate(values)), unique, np.append(at, len(windows)), owner)
    return out


def _merged(hit: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return T.runs(hit, bounds)


def find(block: T.Block, by_length: dict, rule: Winnowing) -> tuple[np.ndarray, np.ndarray, list, list]:
    """(words, hit words, spans of hit words, item numbers) by document."""
    words = T.tokens(block, T.ALNUM_FOLDED)
    n = len(words.hashes)
    change = np.zeros(n + 1, dtype=np.int64)
    owners = defaultdict(set)
    for length, (prints, windows, at, owner) in by_length.items():
        k, run = rule.shape(length)
        values, first = fingerprints(words, k, run)
        starts = around(words, first[_contained(prints, values) >= 0], length, run)
        place = _contained(windows, window_hashes(words.hashes, starts, length))
        starts, place = starts[place >= 0], place[place >= 0]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
        document = np.searchsorted(words.bounds, starts, "right") - 1
        for d, p in set(zip(document.tolist(), place.tolist())):
            owners[d].update(owner[at[p] : at[p + 1]].tolist())
    hit = np.cumsum(change[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    starts, ends = _merged(hit, words.bounds)
    spans = [[] for _ in range(len(block))]
    for d, s, e in zip((np.searchsorted(words.bounds, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist()):
        spans[d].append({"first_word": s - int(words.bounds[d]), "end_word": e - int(words.bounds[d])})
    return np.diff(words.bounds), total[words.bounds[1:]] - total[words.bounds[:-1]], spans, [sorted(owners[d]) if d in owners else [] for d in range(len(block))]


_FOUND = "n_words long, n_hit long, spans array<struct<first_word: long, end_word: long>>, item_ids array<string>"


def _found_arrays(block, names, by_length, rule):
    n_words, n_hit, spans, owners = find(block, by_length, rule)
    ids = [sorted({names[i] for i in own}) for own in owners]
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))
    return [pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array(spans, kind), pa.array(ids, pa.list_(pa.string()))]


def _local(docs: DataFrame, items: list[tuple[str, str]], rule: Winnowing, only_clean: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(([name for name, _ in items], index(items, rule)))

    def run(batches):
        names, by_length = sent.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for block in T.blocks(text):
                part = batch.slice(block.first, len(block))
                found = _found_arrays(block, names, by_length, rule)
                if only_clean:
                    yield part.filter(pa.array(np.asarray(found[1]) == 0))
                else:
                    yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), *found], ["doc_id", "n_words", "n_hit", "spans", "item_ids"])

    if only_clean:
        return docs.mapInArrow(run, docs.schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {_FOUND}")


def _emit_prints(rule: Winnowing, lengths: list[int]):
    def run(batches):
        for batch in batches:
            for block in T.blocks(batch.column(batch.schema.get_field_index("text"))):
                words = T.tokens(block, T.ALNUM_FOLDED)
                keys = batch.column(batch.schema.get_field_index("key")).slice(block.first, len(block))
                for length in lengths:
                    values, first = fingerprints(words, *rule.shape(length))
                    document = words.document[first]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(document)), pa.array(np.full(len(first), length)), pa.array(first - words.bounds[document]), T.as_long(values)], ["key", "length", "place", "print"])

    return run


def _emit_items(rule: Winnowing):
    def run(batches):
        for batch in batches:
            items = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for length, (prints, windows, at, owner) in index(items, rule).items():
                names = [items[i][0] for i in owner]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(prints), length)), T.as_long(prints), pa.nulls(len(prints), pa.int64()), pa.nulls(len(prints), pa.string())], ["length", "print", "win", "item_id"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(owner), length)), pa.nulls(len(owner), pa.int64()), T.as_long(np.repeat(windows, np.diff(at))), pa.array(names, pa.string())], ["length", "print", "win", "item_id"])

    return run


def _emit_windows(rule: Winnowing):
    def run(batches):
        for batch in batches:
            hits = batch.column(batch.schema.get_field_index("hits")).to_pylist()
            for block in T.blocks(batch.column(batch.schema.get_field_index("text"))):
                words = T.tokens(block, T.ALNUM_FOLDED)
                keys = batch.column(batch.schema.get_field_index("key")).slice(block.first, len(block))
                by_length = defaultdict(list)
                for d in range(len(block)):
                    for h in hits[block.first + d]:
                        by_length[h["length"]].append(int(words.bounds[d]) + h["place"])
                for length, places in by_length.items():
                    starts = around(words, np.array(places), length, rule.shape(length)[1])
                    document = np.searchsorted(words.bounds, starts, "right") - 1
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(document)), pa.array(np.full(len(starts), length)), pa.array(starts - words.bounds[document]), T.as_long(window_hashes(words.hashes, starts, length))], ["key", "length", "first_word", "win"])

    return run


def _joined(docs: DataFrame, benchmark: DataFrame, rule: Winnowing) -> DataFrame:
    """(key, spans, item_ids) of documents with hits, key = hash of the text."""
    texts = docs.filter("text IS NOT NULL").select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])
    items = materialise(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").mapInArrow(_emit_items(rule), "length long, print long, win long, item_id string"))
    lengths = [r[0] for r in items.select("length").distinct().collect()]  # at most ``window`` values
    prints = items.filter("print IS NOT NULL").select("length", "print").distinct()
    hits = texts.mapInArrow(_emit_prints(rule, lengths), "key string, length long, place long, print long").join(prints, ["length", "print"], "left_semi")
    by_text = hits.groupBy("key").agg(F.collect_set(F.struct("length", "place")).alias("hits"))
    windows = texts.join(by_text, "key").mapInArrow(_emit_windows(rule), "key string, length long, first_word long, win long")
    found = materialise(windows.join(items.filter("win IS NOT NULL").select("length", "win", "item_id"), ["length", "win"]))
    ids = found.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    at = found.select("key", "first_word", (F.col("first_word") + F.col("length")).alias("end_word")).distinct()
    spans = at.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first_word", "end_word"))).alias("windows"))
    merge = """aggregate(windows, cast(array() as array<struct<first_word: bigint, end_word: bigint>>), (acc, x) ->
        if(size(acc) > 0 AND element_at(acc, -1).end_word >= x.first_word,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('first_word', element_at(acc, -1).first_word, 'end_word', greatest(element_at(acc, -1).end_word, x.end_word)))),
           concat(acc, array(x))))"""
    return spans.withColumn("spans", F.expr(merge)).join(ids, "key").select("key", "spans", "item_ids")


def _benchmark_items(benchmark: DataFrame, local_bytes: int) -> list[tuple[str, str]] | None:
    """The items, if their texts are within the bound."""
    size = benchmark.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size > local_bytes:
        return None
    return [(r[0], r[1]) for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, rule: Winnowing = Winnowing(), local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, spans of hit words
    and the sorted item_ids that have an occurring window.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other
    columns are not read. A null text has no words, a null item_id counts as
    an empty string, items with one id count as one item, and a benchmark
    without words hits nothing. Texts are read whole.
    """
    items = _benchmark_items(benchmark, local_bytes)
    if items is not None:
        return _local(docs, items, rule, only_clean=False)
    found = _joined(docs, benchmark, rule)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count_words, "doc_id long, key string, n_words long")
    out = rows.join(found, "key", "left")
    empty = "cast(array() as array<struct<first_word: bigint, end_word: bigint>>)"
    return out.select("doc_id", "n_words", F.expr("coalesce(aggregate(spans, 0L, (a, x) -> a + x.end_word - x.first_word), 0L)").alias("n_hit"), F.expr(f"coalesce(spans, {empty})").alias("spans"), F.expr("coalesce(item_ids, cast(array() as array<string>))").alias("item_ids"))


def _count_words(batches):
    import hashlib

    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        for block in T.blocks(column):
            words = T.tokens(block, T.ALNUM_FOLDED)
            there = column.slice(block.first, len(block)).is_valid().to_pylist()
            keys = [hashlib.sha256(block.text(i)).hexdigest() if there[i] else None for i in range(len(block))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).slice(block.first, len(block)), pa.array(keys, pa.string()), pa.array(np.diff(words.bounds).astype(np.int64))], ["doc_id", "key", "n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rule: Winnowing = Winnowing(), local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """``docs`` without the documents that have a hit word; columns stay, and
    so do null and empty texts, which have no words. Repeated rows stay or go
    together; a benchmark without words drops nothing."""
    items = _benchmark_items(benchmark, local_bytes)
    if items is not None:
        return _local(docs, items, rule, only_clean=True)
    bad = _joined(docs, benchmark, rule).select("key")
    return docs.join(bad, F.sha2(docs["text"], 256) == bad["key"], "left_anti")
