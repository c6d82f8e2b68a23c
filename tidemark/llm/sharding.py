"""Sharding by histogram sort.

Rows are ordered by the hash of their text and then by doc_id, and cut into
shards of nearly equal bytes. The cuts are found by counting: the bytes of the
rows are summed by evenly spaced ranges of keys, the range that a cut falls in
is divided again, and so on for all unsettled cuts at once, until the count at
a boundary is within tolerance. Equal texts have one key and stay in one shard,
unless no boundary beside them is within tolerance: such a key is divided by
doc_id. Then all rows are exchanged once, to slices of shards: ranges of keys
of about ``slice_bytes``, with keys that hold more divided by ranges of doc_id.
Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import columns_free, materialise

_LOW, _HIGH = -(2**63), 2**63 - 1
#: A range is divided into so many.
PROBES = 1024


def byte_size(text: str):
    """UTF-8 bytes of a text column plus 1; a null text has none."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def _counted(rows: DataFrame, column: str, *by: Column) -> list:
    """Bytes, and the least and largest value of ``column``, of each cell."""
    cells = rows.groupBy(*[c.alias(f"c{i}") for i, c in enumerate(by)])
    return cells.agg(F.sum("size").alias("bytes"), F.min(column).alias("low"), F.max(column).alias("high")).collect()  # PROBES for each unsettled cut at most


def _nearest(cells: list, below: int, wanted: int, slack: int):
    """Where a cut at ``wanted`` bytes goes in cells in ascending order:
    (cell after it, whether that is settled, bytes below the cell). A cut is
    before its cell; settled if within ``slack`` or the cell is one value."""
    for i, cell in enumerate(cells):
        after = below + cell["bytes"]
        if after > wanted or i == len(cells) - 1:
            if min(wanted - below, after - wanted) <= slack:
                return (i if wanted - below <= after - wanted else i + 1), True, below
            return i, False, below
        below = after
    return 0, True, below


def _by_tie(keys: DataFrame, cuts: dict[int, tuple[int, int, int, int]], slack: int) -> dict[int, tuple[int, int]]:
    """Cuts inside a key: {cut: (key, least tie, largest tie, bytes wanted of
    the key)} to {cut: (key, tie)}."""
    out, state = {}, {i: (k, low, high, 0, want) for i, (k, low, high, want) in cuts.items()}
    while state:
        ranges = sorted({(k, low, high) for k, low, high, _, _ in state.values()})
        inside, cell = F.lit(False), F.lit(None).cast("decimal(20,0)")
        for k, low, high in ranges:
            here = (F.col("key") == k) & F.col("tie").between(low, high)
            width = max(1, -(-(high - low + 1) // PROBES))
            inside, cell = inside | here, F.when(here, F.expr(f"(cast(tie as decimal(20,0)) - {low}BD) div {width}BD").cast("decimal(20,0)")).otherwise(cell)
        which = F.coalesce(*[F.when((F.col("key") == k) & F.col("tie").between(low, high), F.lit(n)) for n, (k, low, high) in enumerate(ranges)])
        found: dict[int, list] = {}
        for r in sorted(_counted(keys.filter(inside), "tie", which, cell), key=lambda r: r["low"]):
            found.setdefault(r["c0"], []).append(r)
        going = {}
        for i, (k, low, high, below, want) in state.items():
            cells = found[ranges.index((k, low, high))]
            at, settled, under = _nearest(cells, below, want, slack)
            if settled or cells[at]["low"] == cells[at]["high"]:
                if not settled and under + cells[at]["bytes"] - want < want - under:
                    at += 1
                out[i] = (k, cells[at]["low"]) if at < len(cells) else (k, cells[-1]["high"] + 1)
            else:
                going[i] = (k, cells[at]["low"], cells[at]["high"], under, want)
        state = going
    return out


def splitters(keys: DataFrame, parts: int, tolerance: float) -> list[tuple[int, int]]:
    """``parts - 1`` ascending (key, tie) cuts of rows with key, tie and size
    (long): a row is after a cut if its (key, tie) is not below it. Bytes below
    each differ from an even cut by ``tolerance`` of a part at most, or by less
    than what the rows of one (key, tie) hold. One pass over the keys settles
    all cuts by ten more bits of their keys."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [(_HIGH, _HIGH)] * (parts - 1)
    slack = int(tolerance * total / parts)
    state = {i: (None, 0, total * i // parts) for i in range(1, parts)}  # cut: (cell of the last pass, bytes below it, bytes wanted)
    out, heavy, shift = {}, {}, 64
    while state:
        before, shift = shift, max(0, shift - int(math.log2(PROBES)))
        prefixes = sorted({p for p, _, _ in state.values() if p is not None})
        upper = F.shiftright("key", before) if before < 64 else F.lit(0)
        rows = keys.filter(upper.isin(prefixes)) if prefixes else keys
        found: dict = {}
        for r in sorted(_counted(rows, "key", upper, F.shiftright("key", shift)), key=lambda r: r["c1"]):
            found.setdefault(r["c0"] if prefixes else None, []).append(r)
        going = {}
        for i, (prefix, below, want) in state.items():
            cells = found[prefix]
            at, settled, under = _nearest(cells, below, want, slack)
            if settled:
                out[i] = (cells[at]["low"], _LOW) if at < len(cells) else (cells[-1]["high"] + 1, _LOW)
            elif cells[at]["low"] == cells[at]["high"]:
                heavy[i] = (cells[at]["low"], want - under)
            else:
                going[i] = (cells[at]["c1"], under, want)
        state = going
    if heavy:
        ends = {r["key"]: (r["low"], r["high"]) for r in keys.filter(F.col("key").isin(sorted({k for k, _ in heavy.values()}))).groupBy("key").agg(F.min("tie").alias("low"), F.max("tie").alias("high")).collect()}  # a key for each cut at most
        out |= _by_tie(keys, {i: (k, *ends[k], want) for i, (k, want) in heavy.items()}, slack)
    # A cut past the last key or tie has all rows (of its key) before it.
    done = [(k + 1, _LOW) if t > _HIGH and k < _HIGH else (min(k, _HIGH), min(t, _HIGH)) for k, t in (out[i] for i in range(1, parts))]
    return sorted(done)


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.01, slice_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with shard (0 to ``shards - 1``), slot (gapless from 0 in each
    shard) and size, stored in the order of slots slice by slice.

    ``docs`` needs doc_id and text; a null text has no bytes and its own key;
    a null doc_id comes first among equal texts. Equal texts are in one shard
    where a cut beside them is within ``tolerance`` of a shard; rows that agree
    in text and doc_id always are. An empty table gives no rows. Columns named
    shard, slot or size are replaced.
    """
    key, tie, part, sub, size, own, n, whose, low, wide, last = columns_free(docs, "key", "tie", "part", "sub", "size", "own", "n", "whose", "low", "wide", "last")
    docs = docs.drop("shard", "slot", "size")
    columns = {key: F.xxhash64("text"), tie: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)), size: byte_size("text")}
    keys = materialise(docs.select(columns[key].alias("key"), columns[tie].alias("tie"), columns[size].alias("size")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    cuts = splitters(keys, shards, tolerance)
    bits = max(0, math.ceil(math.log2(max(1, total / slice_bytes))))
    # Keys that fill more than a few slices: as many as the table has slices at most, in the worst case.
    large = keys.groupBy(F.col("key").alias(whose)).agg(F.sum("size").alias("_b"), F.min("tie").alias(low), F.max("tie").alias("_t"))
    pieces = F.ceil(F.col("_b") / F.lit(float(slice_bytes)))
    large = materialise(large.filter(F.col("_b") > 4 * slice_bytes).select(whose, low, ((F.col("_t").cast("double") - F.col(low).cast("double") + 1) / pieces).alias(wide), (pieces - 1).alias(last)))

    def placed(rows: DataFrame, k: str, t: str) -> DataFrame:
        """With shard, part of the keys, and part of a large key."""
        at = sum(((F.col(k) > x) | ((F.col(k) == x) & (F.col(t) >= y))).cast("int") for x, y in cuts) if cuts else F.lit(0)
        piece = F.least(F.col(last), F.floor((F.col(t).cast("double") - F.col(low).cast("double")) / F.col(wide)))
        rows = rows.join(F.broadcast(large), F.col(k) == F.col(whose), "left")
        return rows.withColumns({own: at, part: F.shiftright(F.col(k), 64 - bits) if bits else F.lit(0).cast("long"), sub: F.coalesce(piece, F.lit(0))}).drop(whose, low, wide, last)

    counts = placed(keys, "key", "tie").groupBy(own, part, sub).agg(F.count("*").alias(n))
    ahead = F.coalesce(F.sum(n).over(Window.partitionBy(own).orderBy(part, sub).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialise(counts.select(own, part, sub, ahead.alias(n)))  # one row for each slice
    order = Window.partitionBy(own, part, sub).orderBy(key, tie)
    rows = placed(docs.withColumns(columns), key, tie).withColumn("slot", F.row_number().over(order) - 1).join(offsets, [own, part, sub])
    return rows.select(*docs.columns, F.col(own).alias("shard"), (F.col("slot") + F.col(n)).cast("long").alias("slot"), F.col(size).alias("size"))
