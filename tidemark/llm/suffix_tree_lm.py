"""Scoring texts with a probabilistic suffix tree of words.

Tokens of a text are its words (A-Z lowered), then one end. A context is the
words before a token, up to ``depth`` of them. Its next-token distribution is
smoothed toward that of its suffix, the context without its first word:

    P(w | s) = (n(s, w) + pseudo * P(w | suffix of s)) / (n(s) + pseudo)

and without any context it is the add-one distribution, which is the baseline
as well. A context is a state of the tree if its suffix is one, if it was seen
``least`` times, and if its distribution diverges from that of its suffix: the
log likelihood gained over its training tokens, each left out of the counts
that predict it, reaches ``min_gain``. A token is scored by the longest state
that its history ends with.

All training tokens are counted, no count is bounded, and no table is sent to
every task. Texts are packed in chunks. Each chunk asks for the counts of its
distinct n-grams, by ranges of their hashes, and gets them back: words, then
pairs behind words that were seen often enough, and so on; and it sends what it
knows of the gain of its contexts and gets back which of them are states.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as T
from tidemark.llm.storage import materialise
from tidemark.sources.scratch import scratch_path

_U = np.uint64
_END = T.mix(np.array([0x656E64], dtype=_U))
#: Bytes of text in a chunk, and for each range of hashes.
CHUNK_BYTES = 8 << 20
#: Kinds of questions: counts of n-grams behind d words, and from here on gains of contexts of d words.
STATES = 1000
#: Gains are summed as whole numbers of this part of a nat.
GRAIN = 10_000
#: Spark's bound on the buckets of a table.
MOST_BUCKETS = 100_000


@dataclass(frozen=True)
class Tree:
    depth: int = 2
    least: int = 2
    min_gain: float = 6.0
    pseudo: float = 8.0

    def __post_init__(self):
        if self.depth < 0 or self.least < 2 or self.min_gain <= 0 or self.pseudo <= 0:
            raise ValueError("need depth >= 0, least >= 2, min_gain > 0 and pseudo > 0")


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending order of the values, where a new value starts in it, and the
    number of each value."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(values), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


# ---- chunks of texts ----------------------------------------------------------------------------------------

_CHUNK = "part long, rows int, doc_ids binary, nulls binary, held binary, bounds binary, hashes binary, ids binary"


def _pack(array: np.ndarray) -> bytes:
    """Compressed, all first bytes of the numbers before all second ones."""
    array = np.ascontiguousarray(array)
    planes = array.view(np.uint8).reshape(len(array), array.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(blob: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _chunk(part: int, rows: list) -> pa.RecordBatch:
    """One row: the texts as numbers of their distinct words."""
    doc_ids, held = pa.concat_arrays([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    hashes, sizes = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
    distinct, ids = np.unique(hashes, return_inverse=True)
    blobs = [np.asarray(doc_ids.fill_null(0)), np.asarray(doc_ids.is_null().cast(pa.int8())), held.astype(np.int8), np.append(0, np.cumsum(sizes)), distinct, ids.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(held)], pa.int32()), *(pa.array([_pack(b)], pa.binary()) for b in blobs)], [c.split()[0] for c in _CHUNK.split(", ")])


def _chunks(size: int):
    def run(batches):
        rows, held_bytes, name = [], 0, None
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731,B023
            for block in T.blocks(column("text")):
                words = T.tokens(block, T.WORDS_FOLDED)
                n = len(block)
                # An end behind the words of each text.
                place = np.arange(len(words.hashes)) + words.document
                hashes = np.full(len(words.hashes) + n, _END[0], dtype=_U)
                hashes[place] = words.hashes
                own = slice(block.first, block.first + n)
                if name is None:
                    name = column("row")[block.first].as_py()
                rows.append((column("doc_id").slice(own.start, n), np.asarray(column("held").slice(own.start, n)), hashes, np.diff(words.bounds) + 1))
                held_bytes += len(block.data)
                if held_bytes >= size:
                    yield _chunk(name, rows)
                    rows, held_bytes, name = [], 0, None
        if rows:
            yield _chunk(name, rows)

    return run


# ---- asking for counts and states ---------------------------------------------------------------------------


def _coded(keys: np.ndarray) -> bytes:
    """Ascending keys as their gaps."""
    return _pack(np.diff(keys, prepend=_U(0)))


def _decoded(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, _U))


_ASKED = "kind int, counter int, part long, keys binary, vals binary"
_ANSWERED = "part long, kind int, counter int, vals binary, seen long, total long"


def _asks(part: int, kind: int, keys: np.ndarray, values: np.ndarray, counters: int, bits: int):
    """Rows that carry ascending keys and a number for each to the counters."""
    edges = np.array([-(-(c << bits) // counters) for c in range(1, counters)], dtype=_U)
    ends = np.append(np.searchsorted(keys, edges), len(keys))
    begins = np.append(0, ends[:-1])
    for c in np.flatnonzero(ends > begins):
        own = slice(begins[c], ends[c])
        yield kind, int(c), part, _coded(keys[own]), _smallest(values[own])


def _answer(threshold: int):
    """What all chunks know of each key, back to each chunk that asked: the sum
    of their numbers, or for gains whether it reaches the threshold."""

    def run(table: pa.Table) -> pa.Table:
        keys = [_decoded(x.as_py()) for x in table["keys"]]
        values = np.concatenate([_widened(x.as_py()) for x in table["vals"]])
        at = np.cumsum([0] + [len(k) for k in keys])
        order, starts, number = _numbered(np.concatenate(keys))
        total = np.add.reduceat(values[order], starts) if len(starts) else np.empty(0, np.int64)
        kind = table["kind"][0].as_py()
        result = (total >= threshold).astype(np.int8) if kind >= STATES else total
        blobs = [_smallest(result[number[at[i] : at[i + 1]]]) for i in range(len(keys))]
        n = len(keys) + 1  # and one row of sums, for no chunk
        return pa.table({
            "part": pa.array([*table["part"].to_pylist(), None], pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "counter": pa.array([table["counter"][0].as_py()] * n, pa.int32()),
            "vals": pa.array([*blobs, b""], pa.binary()), "seen": pa.array([0] * (n - 1) + [int(np.count_nonzero(total > 0))], pa.int64()), "total": pa.array([0] * (n - 1) + [int(total.sum())], pa.int64()),
        })

    return run


def _smallest(values: np.ndarray) -> bytes:
    """In the narrowest of one, four and eight bytes, which stands in front."""
    low, top = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    kind = next(k for k in (np.int8, np.int32, np.int64) if np.iinfo(k).min <= low and top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + _pack(values.astype(kind))


def _widened(blob: bytes) -> np.ndarray:
    return _unpack(blob[1:], {1: np.int8, 4: np.int32, 8: np.int64}[blob[0]]).astype(np.int64)


# ---- what a chunk makes of the answers ----------------------------------------------------------------------


@dataclass(frozen=True)
class Known:
    """Sums over all training tokens, once they are known."""

    tokens: int = 0
    distinct: int = 0


def _grouped(answers: pa.Table) -> dict[int, np.ndarray]:
    """The answers of each kind, in the order of the keys."""
    found: dict[int, list] = {}
    for kind, counter, blob in zip(answers["kind"].to_pylist(), answers["counter"].to_pylist(), answers["vals"].to_pylist()):
        found.setdefault(kind, []).append((counter, blob))
    return {kind: np.concatenate([_widened(b) for _, b in sorted(rows)]) for kind, rows in found.items()}


def _walk(chunk: dict, answers: dict[int, np.ndarray], tree: Tree, known: Known, bits: int):
    """Goes down the tree level by level, as far as the answers reach. Yields
    (kind, ascending keys, number of each) to ask for, and at the end (None,
    counts of the tokens, their probabilities). What is asked for depends on
    counts alone, so that answers fit whenever they are looked at."""
    shift = _U(64 - bits)
    ids, words, bounds = chunk["ids"], chunk["hashes"], chunk["bounds"]
    age = np.arange(len(ids)) - np.repeat(bounds[:-1], np.diff(bounds))
    learned = np.repeat(chunk["held"] == 0, np.diff(bounds))
    if 0 not in answers:
        yield 0, words, np.bincount(ids[learned], minlength=len(words))
        return
    count = answers[0][ids]  # of the n-gram that ends at a token
    above = (count + 1.0) / (known.tokens + known.distinct + 1.0)  # the token's probability so far
    gram, grams = ids.astype(np.int64), words  # number of the n-gram that ends at a token, or -1; hashes by number
    in_tree, waiting = np.ones(len(ids), dtype=bool), False  # whether the words before a token are a state so far
    for d in range(1, tree.depth + 1):
        seen, context = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), -1, dtype=np.int64)
        seen[1:], context[1:] = count[:-1], gram[:-1]  # of the d words before a token
        at = np.flatnonzero((age >= d) & (context >= 0) & (seen >= tree.least))
        n_next = np.zeros(len(at), dtype=np.int64)
        open_ = np.flatnonzero(count[at] >= 1)  # n(s, w) is at most n(suffix of s, w)
        asked = at[open_]
        order, starts, number = _numbered(context[asked] * len(words) + ids[asked])
        one = asked[order[starts]]  # one token for each of the n-grams
        hashes = T.mix(grams[context[one]] * T._WORD_BASE + words[ids[one]] + _U(d))
        by_hash = np.argsort(hashes)
        if len(one) and d not in answers:
            yield d, hashes[by_hash] >> shift, np.bincount(number[learned[asked]], minlength=len(one))[by_hash]
            return
        own = np.zeros(len(one), dtype=np.int64)
        own[by_hash] = answers.get(d, own)
        n_next[open_] = own[number]
        there = np.zeros(len(grams), dtype=bool)
        there[context[at]] = True
        contexts, place = np.flatnonzero(there), (np.cumsum(there) - 1)[context[at]]
        by_hash = np.argsort(grams[contexts])
        waiting = len(contexts) > 0 and STATES + d not in answers
        if waiting:
            # A token that is learned from is left out of the counts that predict it; only states have extensions.
            some = np.flatnonzero(learned[at] & in_tree[at])
            gain = np.log(((n_next[some] - 1) / above[at[some]] + tree.pseudo) / (seen[at[some]] - 1 + tree.pseudo))
            total = np.bincount(place[some], weights=gain, minlength=len(contexts))
            yield STATES + d, grams[contexts][by_hash] >> shift, np.round(total[by_hash] * GRAIN).astype(np.int64)
        else:
            state = np.zeros(len(contexts), dtype=bool)
            state[by_hash] = answers.get(STATES + d, state) > 0
            used = state[place] & in_tree[at]
            in_tree = np.zeros(len(ids), dtype=bool)
            in_tree[at] = used
            above = above.copy()
            above[at[used]] = (n_next[used] + tree.pseudo * above[at[used]]) / (seen[at[used]] + tree.pseudo)
        count, gram = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), -1, dtype=np.int64)
        count[at], gram[asked], grams = n_next, number, hashes
    if not waiting:
        yield None, answers[0][ids], above


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double"


def _opened(chunk: pa.Table) -> dict:
    kinds = {"doc_ids": np.int64, "nulls": np.int8, "held": np.int8, "bounds": np.int64, "hashes": _U, "ids": np.int32}
    return {name: _unpack(chunk[name][0].as_py(), kind) for name, kind in kinds.items()}


def _step(tree: Tree, known: Known, counters: int, bits: int):
    """What a chunk asks for next."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if chunk.num_rows:
            part = chunk["part"][0].as_py()
            for kind, keys, numbers in _walk(_opened(chunk), _grouped(answers), tree, known, bits):
                if kind is not None:
                    rows.extend(_asks(part, kind, keys, numbers, counters, bits if kind else 64))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({c.split()[0]: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(zip(_ASKED.split(", "), kinds))})

    return run


def _first_step(tree: Tree, counters: int, bits: int):
    step = _step(tree, Known(), counters, bits)

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                yield from step(pa.Table.from_batches([batch.slice(i, 1)]), _NO_ANSWERS).to_batches()

    return run


_NO_ANSWERS = pa.table({"kind": pa.array([], pa.int32()), "counter": pa.array([], pa.int32()), "vals": pa.array([], pa.binary())})


def _scores(tree: Tree, known: Known, bits: int):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in _SCORED.split(", ")]
        if not chunk.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))})
        own = _opened(chunk)
        (_, counts, p), = _walk(own, _grouped(answers), tree, known, bits)
        by_text = lambda x: np.add.reduceat(x, own["bounds"][:-1])
        return pa.table({
            "doc_id": pa.array(own["doc_ids"], mask=own["nulls"] > 0), "held_out": pa.array(own["held"] > 0), "n_tokens": pa.array(np.diff(own["bounds"])),
            "n_known": pa.array(by_text((counts > 0).astype(np.int64))), "log_counts": pa.array(by_text(np.log10(counts + 1.0))), "score": pa.array(by_text(np.log10(p))),
        })

    return run


def score_texts(docs: DataFrame, held_out: str = "crc32(cast(doc_id AS string)) % 7 = 2", tree: Tree = Tree(), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score. Only doc_id and text are read.

    Rows for which the SQL condition ``held_out`` is true are scored and not
    learned from; where it is null (a null doc_id) the row is learned from. A
    null or wordless text is the end alone. With nothing to learn from, no
    token is known and both scores are 0. An empty table has no rows.
    A word's number is a 64-bit hash; longer n-grams are numbered with so many
    bits that at any size about one in a million shares its number.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n = max(1, -(-size // chunk_bytes))
    bits = min(64, 20 + max(1, size).bit_length())
    # A bucketed table: what is joined to the chunks by their number moves, and the chunks do not.
    table = f"chunks_{uuid.uuid4().hex}"
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_chunks(chunk_bytes), _CHUNK)
    numbered.write.bucketBy(min(n, MOST_BUCKETS), "part").option("path", scratch_path(spark, "chunks")).saveAsTable(table)
    chunks = spark.table(table)
    answer = lambda asked: materialise(asked.groupBy("kind", "counter").applyInArrow(_answer(round(tree.min_gain * GRAIN)), _ANSWERED))
    answers = answer(chunks.mapInArrow(_first_step(tree, n, bits), _ASKED))
    sums = answers.filter("part IS NULL").agg(F.sum("total"), F.sum("seen")).first()
    known = Known(sums[0] or 0, sums[1] or 0)
    met = lambda: chunks.groupBy("part").cogroup(answers.filter("part IS NOT NULL").select("part", "kind", "counter", "vals").groupBy("part"))
    for _ in range(tree.depth + 1 if tree.depth else 0):
        answers = answers.unionByName(answer(met().applyInArrow(_step(tree, known, n, bits), _ASKED)))
    scored = materialise(met().applyInArrow(_scores(tree, known, bits), _SCORED))
    spark.sql(f"DROP TABLE {table}")
    base = F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(known.tokens + known.distinct + 1.0)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
