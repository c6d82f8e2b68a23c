"""The k nearest earlier rows of a group within a window, over pairs of blocks.

Rows are dealt by group and slice of time as wide as the window, and where
such a slice is large, into blocks of like rows. Blocks have summaries: ranges
of days and of what the score is made of. From two summaries follows the least
score that any of their rows can have. First each row is compared with the few
blocks that can be nearest, which bounds its k-th score; then only with blocks
that can still have a better one. Scores are matrices of two blocks, some rows
at a time; k rows at most leave a task for each row that asks, and a window
over these ranks them. No task holds a large group's slice, and what is not near
is not read.

By weighted distance (``nearest_lists``) blocks are larger, and inside a task
they are cut into cells of a few like rows: cells that ask look only at cells
that can still have something nearer. The k nearest leave the task ranked, one
row for each row that asks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordering import positions
from tidemark.schema import group_key
from tidemark.sources.scratch import written

#: Rows of a block, rows that ask at a time, blocks that bound the k-th score.
BLOCK, ROWS, FIRST = 4096, 256, 3
#: Scores this close may be ranked otherwise by Spark, scores this close are equal.
MARGIN, TIE = 1e-7, 1e-12
#: A score behind all others, of pairs that have none.
WORST = 1e6
#: Blocks of lists are so many times larger: their tasks do not compare all pairs.
LARGER = 16
#: Candidates of a cell, rows of a cell that asks, cells that bound the k-th distance, cells that ask at a time.
CELL, ASKING, NEAR, TOGETHER = 32, 64, 8, 64
#: Distances that are infinite and that are not numbers, behind all others.
ENDLESS, NO_NUMBER = 1e308, 1.7e308


@dataclass(frozen=True)
class Metric:
    """``score(asking, candidates, at_least)`` gets dicts of columns as numpy
    arrays, null as NaN with a mask in ``<name>?``, and returns asking x
    candidates. ``tiles`` adds ``_block`` to rows of one group and slice,
    ``summary`` are aggregates over a block, and ``least`` is the least score
    between the summaries ``a`` and ``c``. ``ranked(asking, candidates, ids, k)``
    finds the k nearest by cells, if the metric knows cells."""

    score: Callable[[dict, dict], np.ndarray]
    tiles: Callable[[DataFrame, str], DataFrame]
    summary: dict[str, Column]
    least: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]
    latest_first: bool
    ranked: Callable[[dict, dict, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None


#: Rows with their lists to other rows, and the schema of these.
Finish = tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], T.StructType]


def sliced(df: DataFrame, day: str, width: int) -> DataFrame:
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    return df.withColumn("_day", number).withColumn("_own", F.floor(number / width).cast("int"))


def _arrays(table: pa.Table, columns: list[str], prefix: str = "") -> dict[str, np.ndarray]:
    """Numbers and vectors as numpy arrays, and where they are known; vectors
    end in zeros, their lengths are in ``<name>#``, and those with unknown
    parts are unknown."""
    out = {}
    for c in columns:
        column = table[prefix + c].combine_chunks()
        known = np.asarray(column.is_valid())
        if pa.types.is_list(column.type):
            sizes = np.where(known, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(int)
            rows = np.zeros((len(column), int(sizes.max(initial=0))))
            rows[np.arange(rows.shape[1]) < sizes[:, None]] = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            known = known & ~np.isnan(rows).any(axis=1)
            out[c], out[c + "#"] = np.where(known[:, None], rows, 0.0), sizes
        elif pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
            out[c] = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        else:
            continue
        out[c + "?"] = known
    return out


def _best(values: np.ndarray, days: np.ndarray, ids: np.ndarray, k: int, latest_first: bool) -> np.ndarray:
    """Which candidates may be among the k of least score: all that are surely
    nearer than the k-th, and of those about as near the first k of each score."""
    inside = np.flatnonzero(np.isfinite(values))
    if len(inside) <= k:
        return inside
    worst = np.partition(values[inside], k - 1)[k - 1]
    near = inside[values[inside] <= worst + MARGIN]
    if len(near) <= k:
        return near
    order = near[np.lexsort((ids[near], -days[near] if latest_first else days[near], np.round(values[near] / TIE)))]
    steps = np.diff(values[order]) > TIE
    starts = np.concatenate([[0], np.flatnonzero(steps) + 1])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < k]


def _asked(asking: DataFrame, pairs: DataFrame, columns: list[str], id_col: str, bound: DataFrame | None) -> DataFrame:
    """Each row that asks, once for each block that it asks."""
    here = asking.select("_g", F.col("_own").alias("a_own"), F.col("_block").alias("a_block"), "_day", *columns).join(pairs, ["_g", "a_own", "a_block"])
    if bound is not None:
        # Only a block that can have something nearer than the row's k-th so far.
        rows = bound.select("_g", F.col("_own").alias("a_own"), id_col, "_kth")
        here = here.join(rows, ["_g", "a_own", id_col], "left").filter("_kth IS NULL OR _least <= _kth").drop("_kth")
    return here.drop("_least")


def _places(column: pa.ChunkedArray) -> np.ndarray:
    """The place of each value in ascending order, null first."""
    out = np.empty(len(column), np.int64)
    out[np.asarray(pc.sort_indices(column, null_placement="at_start"))] = np.arange(len(column))
    return out


def _visit(asking: DataFrame, candidates: DataFrame, pairs: DataFrame, columns: list[str], id_col: str, window: int, k: int, metric: Metric, bound: DataFrame | None, wanted: list[str] | None = None, finish: Finish | None = None) -> DataFrame:
    """The rows near each other of pairs of blocks (_g, a_own, a_block, c_own,
    c_block): at first the few blocks that a block asks in one task, then each
    pair in its own. With ``wanted`` a row for each row that asks, in whose
    ``near`` are these columns of the nearest, in order; or what ``finish``
    makes of them."""
    name = ["_g", "a_own", "a_block", "c_own", "c_block"]
    here = _asked(asking, pairs if bound is not None else pairs.groupBy(*name[:3]).agg(F.min("_least").alias("_least")), columns, id_col, bound)
    there = candidates.select(F.col("_g"), F.col("_own").alias("c_own"), F.col("_block").alias("c_block"), F.col("_day").alias("c_day"), *[F.col(c).alias(f"c_{c}") for c in columns])
    there = there.join(here.select(*name).distinct() if bound is not None else pairs.select(*name), ["_g", "c_own", "c_block"])
    there = there.withColumnsRenamed({c: f"_{c}" for c in name})
    name = name if bound is not None else name[:3]
    schema = T.StructType([here.schema["_g"], T.StructField("_slice", T.IntegerType()), here.schema["_day"], *[here.schema[c] for c in columns], there.schema["c_day"], *[there.schema[f"c_{c}"] for c in columns], T.StructField("_score", T.DoubleType())])

    score, latest_first, ranked = metric.score, metric.latest_first, metric.ranked  # a metric's columns stay on the driver
    grouped = here.groupBy(*name).cogroup(there.groupBy(*[f"_{c}" for c in name]))

    if wanted is not None:
        one = [T.StructField("distance", T.DoubleType()), there.schema["c_day"], *[there.schema[f"c_{c}"] for c in wanted]]
        lists = T.StructType([*schema.fields[: 3 + len(columns)], T.StructField("near", T.ArrayType(T.StructType(one)))])

        def listed(ours: pa.Table, theirs: pa.Table) -> pa.Table:
            days, past = (np.asarray(t.combine_chunks()).astype(np.int64) for t in (ours["_day"], theirs["c_day"]))
            left, right, distance = ranked(_arrays(ours, columns) | {"day": days}, _arrays(theirs, columns, "c_") | {"day": past}, _places(theirs[f"c_{id_col}"]), k)
            there = theirs.select([f.name for f in one[1:]]).take(pa.array(right))
            near = pa.StructArray.from_arrays([pa.array(distance), *[c.combine_chunks() for c in there.columns]], names=[f.name for f in one])
            ends = np.concatenate([[0], np.cumsum(np.bincount(left, minlength=len(ours)))]).astype(np.int32)
            cells = {"_g": ours["_g"], "_slice": ours["a_own"], "_day": ours["_day"]} | {c: ours[c] for c in columns}
            table = pa.table(cells | {"near": pa.ListArray.from_arrays(pa.array(ends), near)})
            return pa.Table.from_batches(finish[0](iter(table.combine_chunks().to_batches()))) if finish else table

        return grouped.applyInArrow(listed, finish[1] if finish else lists)

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.sort_by("c_day")
        days, past = np.asarray(ours["_day"].combine_chunks()), np.asarray(theirs["c_day"].combine_chunks())
        ids = _places(theirs[f"c_{id_col}"])
        order = np.argsort(days, kind="stable")
        mine, others = _arrays(ours, columns), _arrays(theirs, columns, "c_")
        left, right, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for at in range(0, len(order), ROWS):
            own = order[at : at + ROWS]
            low, high = np.searchsorted(past, days[own[0]] - window), np.searchsorted(past, days[own[-1]])
            if high <= low:
                continue
            values = score({c: v[own] for c, v in mine.items()} | {"day": days[own]}, {c: v[low:high] for c, v in others.items()} | {"day": past[low:high]})
            apart = days[own][:, None] - past[None, low:high]
            values = np.where((apart >= 1) & (apart <= window), np.nan_to_num(values, nan=WORST, posinf=WORST), np.inf)
            for i, row in zip(own, values, strict=True):
                found = _best(row, past[low:high], ids[low:high], k, latest_first)
                left.append(np.full(len(found), i)), right.append(found + low), scores.append(row[found])
        one, two = ours.take(pa.array(np.concatenate(left))), theirs.take(pa.array(np.concatenate(right)))
        cells = {"_g": one["_g"], "_slice": one["a_own"], "_day": one["_day"]} | {c: one[c] for c in columns} | {"c_day": two["c_day"]} | {f"c_{c}": two[f"c_{c}"] for c in columns} | {"_score": pa.array(np.concatenate(scores))}
        return pa.table(cells)

    return grouped.applyInArrow(run, schema)


def _paired(df: DataFrame, keys: list[str], id_col: str, day: str, window: int, columns: list[str], usable: Column, metric: Metric, asks: Column | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that ask, the candidates, and the pairs of their blocks."""
    rows = sliced(df.withColumn("_g", group_key(*keys)), day, window).filter("_day IS NOT NULL").select("_g", "_own", "_day", *columns, usable.alias("_usable"), (F.lit(True) if asks is None else asks).alias("_asks"))
    rows = metric.tiles(written(rows, "nearest"), id_col)
    known = {"n": F.count("*"), "usable": F.count_if("_usable"), "asks": F.count_if("_asks"), "first": F.min("_day"), "last": F.max("_day")} | metric.summary
    blocks = rows.groupBy("_g", "_own", "_block").agg(*[c.alias(n) for n, c in known.items()])
    a = blocks.filter("asks > 0").select("_g", F.col("_own").alias("a_own"), F.col("_block").alias("a_block"), F.struct(*known).alias("a"), F.col("_own").alias("_slice"))
    c = blocks.filter("usable > 0").select("_g", F.col("_own").alias("c_own"), F.col("_block").alias("c_block"), F.struct(*known).alias("c"), F.explode(F.array("_own", F.col("_own") + 1)).alias("_slice"))
    pairs = a.join(c, ["_g", "_slice"]).filter((F.col("c.first") < F.col("a.last")) & (F.col("c.last") >= F.col("a.first") - window))
    pairs = pairs.withColumn("_least", metric.least(lambda n: F.col(f"a.{n}"), lambda n: F.col(f"c.{n}")) - MARGIN)
    order = Window.partitionBy("_g", "a_own", "a_block").orderBy("_least", F.desc("c_own"), "c_block")
    pairs = written(pairs.withColumn("_order", F.row_number().over(order)).select("_g", "a_own", "a_block", "c_own", "c_block", "_least", "_order"), "pairs")
    return rows.filter("_asks"), rows.filter("_usable"), pairs


def _going_on(rows: DataFrame, further: DataFrame, bound: DataFrame, id_col: str) -> DataFrame:
    """The pairs of blocks in which one of the rows that ask goes on."""
    most = rows.select("_g", "_own", "_block", id_col).join(bound, ["_g", "_own", id_col], "left").groupBy("_g", F.col("_own").alias("a_own"), F.col("_block").alias("a_block")).agg(F.max(F.coalesce("_kth", F.lit(float("inf")))).alias("_most"))
    return further.join(most, ["_g", "a_own", "a_block"]).filter("_least <= _most").drop("_most")


def nearest(df: DataFrame, keys: list[str], id_col: str, day: str, window: int, columns: list[str], k: int, usable: Column, metric: Metric, asks: Column | None = None) -> DataFrame:
    """Pairs of rows (``columns`` as they are, and _g, _slice, _day) with usable
    rows of their group in the window before them (``c_`` columns, days_diff):
    all that may be among the k of least score, and little more. Rows without
    a day ask for nothing and are no candidates; ``asks`` names the rows that
    ask if not all do."""
    rows, candidates, pairs = _paired(df, keys, id_col, day, window, columns, usable, metric, asks)
    found = _visit(rows, candidates, pairs.filter(F.col("_order") <= FIRST).drop("_order"), columns, id_col, window, k, metric, None)
    further = pairs.filter(F.col("_order") > FIRST).drop("_order")
    if not further.isEmpty():
        found = written(found, "found")
        rank = Window.partitionBy("_g", "_slice", id_col).orderBy("_score")
        bound = found.select("_g", "_slice", id_col, "_score", F.row_number().over(rank).alias("_n")).filter(F.col("_n") == k).select("_g", F.col("_slice").alias("_own"), id_col, (F.col("_score") + MARGIN).alias("_kth"))
        bound = written(bound, "bounds")
        found = found.unionByName(_visit(rows, candidates, _going_on(rows, further, bound, id_col), columns, id_col, window, k, metric, bound))
    return found.drop("_score").withColumn("days_diff", F.col("_day") - F.col("c_day"))


def nearest_lists(df: DataFrame, keys: list[str], id_col: str, day: str, window: int, columns: list[str], k: int, usable: Column, metric: Metric, asks: Column, wanted: list[str], finish: Finish | None = None) -> DataFrame:
    """The rows that ask (``columns``, and _g, _slice, _day), each with ``near``:
    its k nearest usable rows (distance, c_day and the ``wanted`` ``c_`` columns,
    the id among them), by distance, latest and smallest id; or what ``finish``
    makes of these rows. Rows that have no candidates may be missing."""
    rows, candidates, pairs = _paired(df, keys, id_col, day, window, columns, usable, metric, asks)
    first, further = pairs.filter(F.col("_order") <= FIRST).drop("_order"), pairs.filter(F.col("_order") > FIRST).drop("_order")
    if further.isEmpty():
        return _visit(rows, candidates, first, columns, id_col, window, k, metric, None, wanted, finish)
    found = written(_visit(rows, candidates, first, columns, id_col, window, k, metric, None, wanted), "found")
    bound = found.filter(F.size("near") == k).select("_g", F.col("_slice").alias("_own"), id_col, (F.element_at("near", k)["distance"] + MARGIN).alias("_kth"))
    bound = written(bound, "bounds")
    more = _visit(rows, candidates, _going_on(rows, further, bound, id_col), columns, id_col, window, k, metric, bound, wanted)
    # Lists of a row from several tasks: by distance, latest and smallest id again.
    fields = [f.name for f in found.schema["near"].dataType.elementType.fields]
    ahead = lambda x: F.struct(x["distance"].alias("a"), (-x["c_day"]).alias("b"), x[f"c_{id_col}"].alias("c"), x.alias("x"))
    every = F.array_sort(F.transform(F.flatten(F.collect_list("near")), ahead))
    near = F.transform(F.slice(every, 1, k), lambda s: F.struct(*[s["x"][f].alias(f) for f in fields]))
    rest = [c for c in columns if c != id_col]
    found = found.unionByName(more).groupBy("_g", "_slice", id_col).agg(F.first("_day").alias("_day"), *[F.first(c).alias(c) for c in rest], near.alias("near")).select(*found.columns)
    return found.mapInArrow(*finish) if finish else found


# ---- by weighted distance -----------------------------------------------------------------------------------


def _large(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of slices that are one block, and the others with the slice's rows."""
    sizes = written(rows.groupBy("_g", "_own").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > block), "sizes")
    if sizes.isEmpty():
        return rows.withColumn("_block", F.lit(0).cast("long")), None
    return rows.join(sizes, ["_g", "_own"], "left_anti").withColumn("_block", F.lit(0).cast("long")), rows.join(sizes, ["_g", "_own"])


def area_age_tiles(rows: DataFrame, id_col: str) -> DataFrame:
    """Strips of like area, each cut into blocks of like age: about as many
    strips as a strip has blocks."""
    block = BLOCK * LARGER
    small, large = _large(rows, block)
    if large is None:
        return small
    strips = F.ceil(F.sqrt(F.col("_rows") / block)).cast("int")
    placed = positions(large, ["area", "age", id_col], ("_g", "_own")).withColumn("_strip", F.floor(F.col("position") * strips / F.col("_rows")).cast("int")).drop("position")
    placed = positions(placed, ["age", "area", id_col], ("_g", "_own", "_strip"))
    high = F.floor(F.col("position") / block).cast("int")
    # A strip has rows / strips of the slice, and as many blocks as they fill.
    return written(small.unionByName(placed.withColumn("_block", F.col("_strip").cast("long") * (F.ceil(F.col("_rows") / strips / block) + 1) + high).select(*small.columns)), "nearest")


def _between(a: Callable, c: Callable, name: str) -> Column:
    return F.greatest(c(f"{name}_low") - a(f"{name}_high"), a(f"{name}_low") - c(f"{name}_high"), F.lit(0.0))


def _cells(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points (a column each) and the starts of cells of at most
    ``size``: halves, each cut where it extends most."""
    n = points.shape[1]
    order, starts = np.arange(n), np.zeros(min(n, 1), np.int64)
    while n and (sizes := np.diff(np.append(starts, n))).max() > size:
        own = points[:, order]
        low = np.minimum.reduceat(own, starts, axis=1)
        extent = np.maximum.reduceat(own, starts, axis=1) - low
        by, each, cell = extent.argmax(axis=0), np.arange(len(starts)), np.repeat(np.arange(len(starts)), sizes)
        at = (own[by[cell], np.arange(n)] - low[by, each][cell]) / np.maximum(extent[by, each], 1e-300)[cell]
        order = order[np.argsort(cell + 0.5 * at, kind="stable")]
        starts = np.sort(np.concatenate([starts, (starts + sizes // 2)[sizes > size]]))
    return order, starts


def _rounded(x: np.ndarray) -> np.ndarray:
    """Nine decimal places as Spark rounds them: halves of the shortest decimal go up."""
    scaled = np.minimum(x, 1e290) * 1e9
    out = np.floor(scaled + 0.5) / 1e9
    near = np.abs(scaled - np.floor(scaled) - 0.5) < np.maximum(1e-3, np.abs(scaled) * 1e-15)
    for i in np.flatnonzero(near & (np.abs(x) < ENDLESS)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP)) if abs(x[i]) < 1e9 else x[i]
    return np.where(x >= NO_NUMBER, np.nan, np.where(x >= ENDLESS, np.inf, out))


#: What the distance is made of: weights, and by what differences are divided (of the area: by the area).
_PARTS = {"area": (0.35, 1.0), "age": (0.25, 50.0), "floor_ratio": (0.10, 1.0)}


@dataclass
class _Boxes:
    """Rows of cells, and what values they have: ranges, and whether any is unknown."""

    order: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    low: dict[str, np.ndarray]
    high: dict[str, np.ndarray]
    lacks: dict[str, np.ndarray]

    @staticmethod
    def of(x: dict, size: int, window: int) -> _Boxes:
        known = {c: x[c + "?"] & np.isfinite(x[c]) for c in (*_PARTS, "has_parking")} | {"day": np.ones(len(x["day"]), bool)}
        near = {"area": lambda v: 0.35 * np.log(np.maximum(v, 1.0)), "day": lambda v: 0.20 * v / window, "has_parking": lambda v: 0.10 * v}
        points = np.zeros((len(known), len(x["day"])))
        for row, (c, sure) in zip(points, known.items(), strict=True):
            weight, per = _PARTS.get(c, (0.0, 1.0))
            row[sure] = near.get(c, lambda v, f=weight / per: f * v)(x[c][sure].astype(float))
            row[~sure] = row[sure].min(initial=0.0) - 1.0  # the unknown in cells of their own
        order, starts = _cells(points, size)
        out = _Boxes(order, starts, np.append(starts[1:], len(order)), {}, {}, {})
        for c, sure in known.items():
            v, sure = x[c][order].astype(float), sure[order]
            out.low[c] = np.minimum.reduceat(np.where(sure, v, np.inf), starts)
            out.high[c] = np.maximum.reduceat(np.where(sure, v, -np.inf), starts)
            out.lacks[c] = np.logical_or.reduceat(~sure, starts)
        return out

    def rows(self, cells: np.ndarray) -> np.ndarray:
        """Places in the order of the rows of some cells."""
        sizes = self.ends[cells] - self.starts[cells]
        return np.arange(sizes.sum()) + np.repeat(self.starts[cells] - np.cumsum(sizes) + sizes, sizes)


def _least_distances(a: _Boxes, cells: slice, c: _Boxes, window: int) -> np.ndarray:
    """What rows of cells are apart at least; infinite where none can be a candidate."""
    of = lambda v: v[cells][:, None]
    gap = lambda n: np.maximum(np.maximum(c.low[n] - of(a.high[n]), of(a.low[n]) - c.high[n]), 0.0)
    out = 0.20 * np.maximum(of(a.low["day"]) - c.high["day"], 1.0) / window
    for n, (weight, per) in _PARTS.items():
        apart = gap(n) / (np.maximum(of(a.high[n]), 1.0) if n == "area" else per)
        out += weight * np.where(of(a.lacks[n]) | c.lacks[n], np.minimum(apart, 0.5), apart)
    out += np.where(gap("has_parking") > 0, 0.10, 0.0)
    return np.where((c.low["day"] < of(a.high["day"])) & (c.high["day"] >= of(a.low["day"]) - window), out - MARGIN, np.inf)


def weighted_distance(window: int) -> Metric:
    """The distance of ``scalars.similarity_distance``, latest first of ties."""

    def score(x: dict, y: dict) -> np.ndarray:
        def part(c: str, per: np.ndarray | float) -> np.ndarray:
            out = y[c][None, :] - x[c][:, None]
            np.abs(out, out=out)
            out /= per
            if not (x[c + "?"].all() and y[c + "?"].all()):
                out[~(x[c + "?"][:, None] & y[c + "?"][None, :])] = 0.5
            out *= _PARTS[c][0]
            return out

        out = part("area", np.maximum(np.nan_to_num(x["area"], nan=1.0, posinf=np.inf), 1.0)[:, None])
        out += part("age", 50.0)
        out += 0.20 * ((x["day"][:, None] - y["day"][None, :]) / float(window))
        out += part("floor_ratio", 1.0)
        same = x["has_parking"][:, None] == y["has_parking"][None, :]
        if not (x["has_parking?"].all() and y["has_parking?"].all()):
            same &= x["has_parking?"][:, None] & y["has_parking?"][None, :]
        out += np.where(same, 0.0, 0.10)
        return out

    def scaled(v: dict) -> dict[str, np.ndarray]:
        """What ``about`` adds up: differences of the values, weighted."""
        return {c: v[c] if c == "area" else v[c] * (weight / per) for c, (weight, per) in _PARTS.items()} | {"day": v["day"].astype(float)} | {c: v[c] for c in v if c.endswith("?") or c == "has_parking"}

    def about(x: dict, y: dict) -> np.ndarray:
        """The distances but for rounding, infinite where there is no pair."""
        out = x["day"][:, None] - y["day"][None, :]
        never = (out < 1) | (out > window)
        out *= 0.20 / window
        for c, (weight, _) in _PARTS.items():
            apart = x[c][:, None] - y[c][None, :]
            np.abs(apart, out=apart)
            if c == "area":
                apart *= x["per"][:, None]
            if not (x[c + "?"].all() and y[c + "?"].all()):
                apart[~(x[c + "?"][:, None] & y[c + "?"][None, :])] = 0.5 * weight
            out += apart
        other = x["has_parking"][:, None] != y["has_parking"][None, :]  # the unknown are no numbers, and differ
        out += other * 0.10
        if not np.isfinite(out).all():
            out = np.where(np.isnan(out), NO_NUMBER, np.minimum(out, ENDLESS))
        out[never] = np.inf
        return out

    def exactly(x: dict, y: dict) -> np.ndarray:
        """The distances of pairs, added up as Spark does."""
        both = lambda c: x[c + "?"] & y[c + "?"]
        area = np.where(both("area"), np.abs(y["area"] - x["area"]) / np.maximum(np.nan_to_num(x["area"], nan=1.0, posinf=np.inf), 1.0), 0.5)
        age, floor = np.where(both("age"), np.abs(y["age"] - x["age"]) / 50.0, 0.5), np.where(both("floor_ratio"), np.abs(y["floor_ratio"] - x["floor_ratio"]), 0.5)
        parking = np.where(both("has_parking") & (x["has_parking"] == y["has_parking"]), 0.0, 1.0)
        return 0.35 * area + 0.25 * age + 0.20 * ((x["day"] - y["day"]) / float(window)) + 0.10 * floor + 0.10 * parking

    def ranked(x: dict, y: dict, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row that asks, candidate, distance) of the k nearest of each, in order."""
        asking, there = _Boxes.of(x, ASKING, window), _Boxes.of(y, CELL, window)
        mine, theirs = ({c: v[boxes.order] for c, v in scaled(z).items()} for z, boxes in ((x, asking), (y, there)))
        mine["per"] = 0.35 / np.maximum(np.nan_to_num(mine["area"], nan=1.0, posinf=np.inf), 1.0)
        # Sums of large numbers are less exact.
        margin = MARGIN * (1.0 + max((float(np.abs(v["area"][np.isfinite(v["area"])]).max(initial=0.0)) for v in (mine, theirs)), default=0.0) * 1e-6)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(asking.starts), TOGETHER):
            for i, bounds in enumerate(_least_distances(asking, slice(at, at + TOGETHER), there, window), at):
                may = np.flatnonzero(np.isfinite(bounds))
                may = may[np.argsort(bounds[may], kind="stable")]
                bounds, done, step = bounds[may], 0, NEAR
                own = np.arange(asking.starts[i], asking.ends[i])
                best = np.full((len(own), k), np.inf)
                active, kept = np.arange(len(own)), []
                while done < len(may) and len(active := active[best[active, k - 1] + margin >= bounds[done]]):
                    # As far as one of them may still find something nearer, a step at a time.
                    last = min(done + step, int(np.searchsorted(bounds, best[active, k - 1].max() + margin, "right")))
                    places = there.rows(may[done:last])
                    values = about({c: v[own[active]] for c, v in mine.items()}, {c: v[places] for c, v in theirs.items()})
                    every = np.concatenate([best[active], values], axis=1)
                    every.partition(k - 1, axis=1)
                    best[active, : k - 1], best[active, k - 1] = every[:, : k - 1], every[:, k - 1]
                    row, j = np.nonzero(values <= np.minimum(every[:, k - 1], NO_NUMBER)[:, None] + margin)
                    kept.append((active[row], places[j], values[row, j]))
                    done, step = last, 2 * step
                if kept:
                    row, place, value = (np.concatenate(v) for v in zip(*kept, strict=True))
                    near = value <= best[row, k - 1] + margin
                    found.append((own[row[near]], place[near]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        left, right = asking.order[np.concatenate([f[0] for f in found])], there.order[np.concatenate([f[1] for f in found])]
        distance = exactly({c: v[left] for c, v in x.items()}, {c: v[right] for c, v in y.items()})
        distance = _rounded(np.where(np.isnan(distance), NO_NUMBER, np.minimum(distance, ENDLESS)))
        order = np.lexsort((ids[right], -y["day"][right], distance, left))
        left, right, distance = left[order], right[order], distance[order]
        ahead = np.concatenate([[0], np.cumsum(np.bincount(left))])
        keep = np.arange(len(left)) - ahead[left] < k
        return left[keep], right[keep], distance[keep]

    numbers = ("area", "age", "floor_ratio")
    sound = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    summary = {f"{c}_{side}": f(sound(c)) for c in numbers for side, f in (("low", F.min), ("high", F.max))} | {f"{c}_lacks": F.count_if(sound(c).isNull()) > 0 for c in numbers}

    def least(a: Callable, c: Callable) -> Column:
        """Of unknown values only what they add for certain."""
        term = lambda n, per: F.when(a(f"{n}_lacks") | c(f"{n}_lacks"), F.least(F.lit(0.5), F.coalesce(_between(a, c, n) / per, F.lit(0.5)))).otherwise(_between(a, c, n) / per)
        days = F.greatest(a("first") - c("last"), F.lit(1)) / F.lit(float(window))
        return 0.35 * term("area", F.greatest(a("area_high"), F.lit(1.0))) + 0.25 * term("age", F.lit(50.0)) + 0.20 * days + 0.10 * term("floor_ratio", F.lit(1.0))

    return Metric(score, area_age_tiles, summary, least, latest_first=True, ranked=ranked)


# ---- by cosine ----------------------------------------------------------------------------------------------

#: Pivots of a slice at most.
PIVOTS = 512


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def cosine(vector: str) -> Metric:
    """Cosines, largest first, earliest first of ties; rows without a vector,
    with a vector of another length or with unknown parts come last."""

    def score(x: dict, y: dict) -> np.ndarray:
        a, b = x[vector], y[vector]
        width = min(a.shape[1], b.shape[1])  # of equal lengths nothing but zeros is cut off
        a, b = a[:, :width], b[:, :width]
        both = x[vector + "?"][:, None] & y[vector + "?"][None, :] & (x[vector + "#"][:, None] == y[vector + "#"][None, :])
        return np.where(both, -(a @ b.T) / np.maximum(np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :], 1e-6), WORST)

    def tiles(rows: DataFrame, id_col: str) -> DataFrame:
        """Cells of the nearest of some pivots, in blocks; (_pivot, _turn): the
        pivot and the angle to it, null where the vector is of no use."""
        double = F.transform(F.col(vector), lambda v: v.cast("double"))
        none = {"_pivot": F.lit(None).cast("array<double>"), "_turn": F.lit(None).cast("double")}
        small, large = _large(rows, BLOCK)
        small = small.withColumns(none)
        if large is None:
            return small
        by_hash = Window.partitionBy("_g", "_own").orderBy(F.xxhash64(id_col), id_col)
        drawn = large.filter(F.col(vector).isNotNull()).withColumn("_n", F.row_number().over(by_hash)).filter((F.col("_n") <= PIVOTS) & (F.col("_n") <= F.ceil(F.col("_rows") / BLOCK)))
        pivots = written(drawn.select("_g", "_own", F.col("_n").alias("_cell"), double.alias("_pivot"), F.ceil(F.col("_rows") / BLOCK).alias("_parts")), "pivots")
        dealt = large.withColumn("_part", F.pmod(F.xxhash64(id_col), F.ceil(F.col("_rows") / BLOCK)))
        sent = pivots.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        sent = sent.select(*[F.col(c).alias(f"p{c}") for c in ("_g", "_own", "_part", "_cell", "_pivot")])
        schema = T.StructType([*[large.schema[c] for c in large.columns if c != "_rows"], T.StructField("_cell", T.IntegerType()), T.StructField("_pivot", T.ArrayType(T.DoubleType())), T.StructField("_turn", T.DoubleType())])

        def assign(ours: pa.Table, theirs: pa.Table) -> pa.Table:
            mine = _arrays(ours, [vector])
            cells, turns, given = np.full(len(ours), -1), np.full(len(ours), np.nan), [None] * len(ours)
            points = [p for p in theirs["p_pivot"].to_pylist() if None not in p and np.isfinite(p).all() and any(p)]
            width = max(map(len, points), default=0)
            points = [p for p in points if len(p) == width]
            useful = np.flatnonzero(mine[vector + "?"] & (mine[vector + "#"] == width) & (np.linalg.norm(mine[vector], axis=1) > 1e-6)) if points else []
            if len(useful):
                close = _units(mine[vector][useful][:, :width]) @ _units(np.array(points)).T
                cells[useful], turns[useful] = close.argmax(axis=1), np.arccos(np.clip(close.max(axis=1), -1, 1))
                for i, j in zip(useful, close.argmax(axis=1), strict=True):
                    given[i] = points[j]
            out = ours.select([c for c in schema.names if c not in ("_cell", "_pivot", "_turn")])
            return out.append_column("_cell", pa.array(cells, pa.int32())).append_column("_pivot", pa.array(given, pa.list_(pa.float64()))).append_column("_turn", pa.array(np.where(np.isnan(turns), None, turns).tolist(), pa.float64()))

        placed = written(dealt.groupBy("_g", "_own", "_part").cogroup(sent.groupBy("p_g", "p_own", "p_part")).applyInArrow(assign, schema), "cells")
        full = placed.groupBy("_g", "_own", "_cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
        placed = placed.join(full, ["_g", "_own", "_cell"])
        # Blocks of a cell that is too large are told apart by bits of a hash.
        number = F.pmod(F.xxhash64(F.lit(5), id_col), F.col("_blocks")).cast("int")
        return written(small.unionByName(placed.withColumn("_block", F.shiftleft(F.col("_cell").cast("long"), 32) + number).select(*small.columns)), "nearest")

    summary = {"pivot": F.first("_pivot", ignorenulls=True), "turn": F.max("_turn"), "lacks": F.count_if(F.col("_turn").isNull()) > 0}

    def least(a: Callable, c: Callable) -> Column:
        dot = F.aggregate(F.zip_with(a("pivot"), c("pivot"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        angle = F.acos(F.greatest(F.least(dot / (size(a("pivot")) * size(c("pivot"))), F.lit(1.0)), F.lit(-1.0)))
        near = F.greatest(angle - a("turn") - c("turn"), F.lit(0.0))
        bound = -F.cos(F.least(near, F.lit(float(np.pi))))
        return F.when(a("lacks") | c("lacks"), F.lit(-1.0)).otherwise(F.coalesce(bound, F.lit(-1.0)))

    return Metric(score, tiles, summary, least, latest_first=False)
