"""Exact range join of vectors by angle, and the groups of near vectors.

Equal vectors are one class with a count. Pivots, taken from a bounded sample,
deal the classes to cells: a ball holds what lies within half the angle of a
pivot amid many vectors, so by the triangle inequality all of it is linked and
nothing in it is compared; all else belongs to the nearest of some further
pivots. A vector also visits each cell that may hold a vector linked with it:
a ball whose pivot is within one and a half times the angle, and an earlier
cell whose border plane is not farther than the radius and whose farthest
member does not rule it out. Each pair that can be linked meets in one cell.

Cells are compared in pairs of blocks of some thousand rows, as products of
matrices. What leaves a task is a count and an edge for each vector, never a
list of pairs. Without structure in the vectors no pivot excludes anything,
and the work grows with the square of the number of classes, as for any exact
join; memory and rows sent by each task do not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.storage import materialise

_SLACK = 1e-9
_STRIP = 512


@dataclass(frozen=True)
class Near:
    """Which vectors are linked, and how the work is cut.

    ``sample``: classes that pivots are taken from; ``dense``: members of the
    sample in the ball of a pivot for it to be one; ``block``: rows of a block,
    and about the rows of a cell as long as the sample has pivots enough."""

    at_least: float = 0.9
    sample: int = 2048
    dense: int = 8
    block: int = 8192

    @property
    def angle(self) -> float:
        return math.acos(self.at_least)

    @property
    def radius(self) -> float:
        return math.sqrt(2 - 2 * self.at_least)


@dataclass
class Pivots:
    """Unit vectors of one length: centres of balls and of other cells, and
    how far the farthest member of each of these is (known later)."""

    balls: np.ndarray
    cells: np.ndarray
    reach: np.ndarray = field(default_factory=lambda: np.zeros(0))


def unit_vectors(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the vectors of each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths())
    starts = np.cumsum(sizes) - sizes
    flat = column.flatten().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        yield places, unit_vectors(flat[starts[places][:, None] + np.arange(size)])


def choose_pivots(sample: list[list[float]], n_classes: int, rule: Near) -> dict[int, Pivots]:
    """Pivots by length of vector. Centres of balls are those with most members
    that no earlier ball has; other cells are as many as blocks are filled."""
    found = {}
    for size in {len(v) for v in sample}:
        units = unit_vectors(np.array([v for v in sample if len(v) == size]))
        near = units @ units.T >= math.cos(rule.angle / 2)
        left, balls = np.ones(len(units), bool), []
        while (gains := near[:, left].sum(axis=1)).max(initial=0) >= rule.dense:
            balls.append(int(gains.argmax()))
            left &= ~near[balls[-1]]
        n_cells = max(1, math.ceil(n_classes * len(units) / len(sample) / rule.block))
        rest = np.flatnonzero(left)
        found[size] = Pivots(units[balls], units[rest if len(rest) else [0]][:n_cells])
    return found


_PLACED = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("size", pa.int32()), ("ball", pa.int32()), ("cell", pa.int32()), ("away", pa.float64())])


def _place(batches: Iterator[pa.RecordBatch], pivots: dict[int, Pivots], rule: Near) -> Iterator[pa.RecordBatch]:
    """Each class with its ball (-1: none), the cell it would have and how far its centre is."""
    for batch in batches:
        out = {c: np.zeros(len(batch), np.float64 if c == "away" else np.int32) for c in ("size", "ball", "cell", "away")}
        for places, units in _by_length(batch["v"]):
            out["size"][places], out["ball"][places] = units.shape[1], -1
            if (known := pivots.get(units.shape[1])) is None:
                continue
            if len(known.balls):
                close = units @ known.balls.T
                best = close.argmax(axis=1)
                out["ball"][places] = np.where(close.max(axis=1) >= math.cos(rule.angle / 2) + _SLACK, best, -1)
            close = units @ known.cells.T
            out["cell"][places], out["away"][places] = close.argmax(axis=1), np.sqrt(np.maximum(0, 2 - 2 * close.max(axis=1)))
        yield pa.RecordBatch.from_arrays([batch["cid"], batch["n"], *[pa.array(out[c]) for c in ("size", "ball", "cell", "away")], batch["v"]], [*_PLACED.names, "v"])


def _visit(batches: Iterator[pa.RecordBatch], pivots: dict[int, Pivots], rule: Near) -> Iterator[pa.RecordBatch]:
    """(size, ball?, cell, own?, cid, n, v): each class in its cell, and in those that it visits."""
    for batch in batches:
        sizes, balls, cells = (np.asarray(batch[c]) for c in ("size", "ball", "cell"))
        rows, kinds, where = [np.arange(len(batch))], [balls >= 0], [np.where(balls >= 0, balls, cells)]
        for places, units in _by_length(batch["v"]):
            if (known := pivots.get(units.shape[1])) is None:
                continue
            ball, cell = balls[places], cells[places]
            if len(known.balls):
                # Members of a ball visit earlier ones, others all.
                meets = units @ known.balls.T >= math.cos(min(math.pi, 1.5 * rule.angle)) - _SLACK
                meets &= (ball[:, None] < 0) | (np.arange(len(known.balls)) < ball[:, None])
                i, j = np.nonzero(meets)
                rows.append(places[i]), kinds.append(np.ones(len(i), bool)), where.append(j)
            close = units @ known.cells.T
            gaps = np.sqrt(np.maximum(0, 2 - 2 * known.cells @ known.cells.T))
            meets = close[np.arange(len(cell)), cell][:, None] - close <= rule.radius * gaps[cell] + _SLACK
            meets &= np.sqrt(np.maximum(0, 2 - 2 * close)) <= known.reach + rule.radius + _SLACK
            meets &= (ball[:, None] < 0) & (np.arange(len(known.cells)) < cell[:, None])
            i, j = np.nonzero(meets)
            rows.append(places[i]), kinds.append(np.zeros(len(i), bool)), where.append(j)
        own = np.arange(sum(map(len, rows))) < len(batch)
        take = np.concatenate(rows)
        columns = [pa.array(sizes[take]), pa.array(np.concatenate(kinds)), pa.array(np.concatenate(where).astype(np.int32)), pa.array(own)]
        taken = pa.Table.from_batches([batch.select(["cid", "n", "v"])]).take(pa.array(take)).combine_chunks()
        for part in pa.table([*columns, taken["cid"], taken["n"], taken["v"]], ["size", "is_ball", "cell", "own", "cid", "n", "v"]).to_batches(max_chunksize=10_000):
            yield part


_FOUND = "cid long, links long, head long"
_FOUND_ARROW = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("head", pa.int64())])


def compare_blocks(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, at_least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of two blocks (or of one with itself), one after the other:
    how many rows they are linked with, and the first row of their component."""
    a = len(left)
    links, labels = np.zeros(a + len(right), np.int64), np.arange(a + len(right))
    if same:
        labels[a:] = labels[:a]
    for at in range(0, a, _STRIP):
        hits = left[at : at + _STRIP] @ right.T >= at_least
        if same:
            hits[np.arange(len(hits)), at + np.arange(len(hits))] = False
        found = np.flatnonzero(hits.any(axis=1))
        if not len(found):
            continue
        links[at + found] += hits[found] @ n_right
        if not same:
            links[a:] += n_left[at + found] @ hits[found]
        for i in found:
            met = np.unique(np.append(labels[a:][hits[i]], labels[at + i]))
            if len(met) > 1:
                labels[np.isin(labels, met)] = met[0]
    return (links[:a], labels[:a]) if same else (links, labels)


def _compare(at_least: float):
    def task(table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"].combine_chunks())
        (_, units), *_ = _by_length(table["v"])
        cid, n = np.asarray(table["cid"].combine_chunks()), np.asarray(table["n"].combine_chunks())
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        same = bool((side == 0).all())
        links, labels = compare_blocks(units[left], units[right], n[left], n[right], at_least, same)
        order = left if same else np.concatenate([left, right])
        linked = np.flatnonzero(links)
        return pa.table([cid[order][linked], links[linked], cid[order][labels[linked]]], schema=_FOUND_ARROW)

    return task


def _links(placed: DataFrame, pivots: dict[int, Pivots], rule: Near) -> DataFrame:
    """(cid, links, head) of classes that meet in cells: a count and an edge for each block."""
    kind = dict(placed.dtypes)["v"]
    sides = placed.mapInArrow(lambda batches: _visit(batches, pivots, rule), f"size int, is_ball boolean, cell int, own boolean, cid long, n long, v {kind}")
    blocks = lambda own: F.greatest(F.ceil(F.count_if(own) / F.lit(rule.block)), F.lit(1)).cast("int")
    counts = materialise(sides.groupBy("size", "is_ball", "cell").agg(blocks(F.col("own")).alias("n_own"), blocks(~F.col("own")).alias("n_visit"), F.count_if(~F.col("own")).alias("visitors")))
    sides = sides.join(counts, ["size", "is_ball", "cell"])
    block = F.pmod(F.xxhash64("cid"), F.when(F.col("own"), F.col("n_own")).otherwise(F.col("n_visit"))).cast("int").alias("block")
    sides = sides.select("*", block)
    # Of each cell: every two own blocks (no two of a ball), and every own block with every block of visitors.
    task = lambda visit, x, y, side: F.struct(F.lit(visit).alias("visit"), x.alias("x"), y.alias("y"), side.alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    zero, b = F.lit(0), F.col("block")
    pairs = F.when(F.col("is_ball"), F.array().cast("array<struct<visit:boolean,x:int,y:int,side:int>>")).otherwise(F.transform(upto(F.col("n_own")), lambda o: task(False, F.least(b, o), F.greatest(b, o), F.signum(o - b).cast("int") * -1)))
    visits = F.when(F.col("visitors") == 0, F.array().cast("array<struct<visit:boolean,x:int,y:int,side:int>>")).otherwise(F.transform(upto(F.col("n_visit")), lambda o: task(True, b, o, zero - 1)))
    asked = F.when(F.col("own"), F.concat(pairs, visits)).otherwise(F.transform(upto(F.col("n_own")), lambda o: task(True, o, b, zero + 1)))
    tasks = sides.withColumn("task", F.explode(asked)).select("size", "is_ball", "cell", "task.*", "cid", "n", "v")
    return tasks.groupBy("size", "is_ball", "cell", "visit", "x", "y").applyInArrow(_compare(rule.at_least), _FOUND)


def near_vectors(embeddings: DataFrame, rule: Near | None = None) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links (other rows whose
    cosine is ``at_least`` or more), component_id (smallest vec_id that links
    reach, itself included), kept (vec_id is component_id).

    Needs vec_id and embedding; further columns are ignored. Vectors that are
    null, empty or zero or hold null or non-finite components link with
    nothing, and so do vectors of different lengths. Rows that repeat are
    vectors of their own and linked. A null vec_id is the smallest of a
    component only where all are null. An empty table gives no rows.
    """
    rule = rule or Near()
    single = dict(embeddings.dtypes)["embedding"] == "array<float>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("embedding") if single else F.col("embedding").cast("array<double>")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    sound = F.coalesce(finite, F.lit(False))
    rows = rows.withColumns({"h1": F.when(sound, F.xxhash64("v")), "h2": F.when(sound, F.xxhash64(F.lit(1), "v"))})
    classes = rows.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()))
    sample = classes.select("v").orderBy(F.xxhash64("v", F.lit(2))).limit(rule.sample).collect()
    pivots = choose_pivots([r.v for r in sample], classes.count(), rule)
    kind = dict(classes.dtypes)["v"]
    placed = materialise(classes.select("cid", "n", "v").mapInArrow(lambda batches: _place(batches, pivots, rule), f"cid long, n long, size int, ball int, cell int, away double, v {kind}"))
    for known in pivots.values():
        known.reach = np.zeros(len(known.cells))
    for r in placed.filter("ball < 0").filter(F.col("size").isin(list(pivots))).groupBy("size", "cell").agg(F.max("away").alias("away")).collect():  # one row for each pivot
        pivots[r["size"]].reach[r.cell] = r.away
    met = materialise(_links(placed, pivots, rule))
    balls = placed.filter("ball >= 0").groupBy("size", "ball").agg(F.sum("n").alias("total"), F.min("cid").alias("head"))
    inside = placed.filter("ball >= 0").select("size", "ball", "cid", "n").join(balls, ["size", "ball"]).select("cid", (F.col("total") - F.col("n")).alias("links"), "head")
    met = met.unionByName(inside)
    labels = connected_components(met.select(F.col("cid").alias("a"), F.col("head").alias("b"))).withColumnsRenamed({"node": "cid"})
    groups = classes.select("h1", "h2", "cid", "n", "least").join(labels, "cid", "left").join(met.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
    groups = groups.select("h1", "h2", "least", F.coalesce("label", "cid").alias("label"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    smallest = groups.groupBy("label").agg(F.min("least").alias("component"))
    groups = groups.join(smallest, "label").select("h1", "h2", "n_links", "component")
    out = rows.drop("v").join(groups, ["h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def keep_one_per_group(embeddings: DataFrame, rule: Near | None = None) -> DataFrame:
    """The rows of ``embeddings`` that stand for their group, all columns kept."""
    kept = near_vectors(embeddings, rule).filter("kept").select("vec_id").distinct()
    return embeddings.join(kept, embeddings["vec_id"].cast("long").eqNullSafe(kept["vec_id"]), "left_semi")
