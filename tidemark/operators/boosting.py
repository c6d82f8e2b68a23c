"""Boosted trees grown leaf by leaf on histograms, for all folds and points of a
grid at once, and their exact attributions.

Values are put into bins once. A pass sums gradients by model, leaf, feature
and bin within each task, adds the sums up by shuffle, and brings one split for
each leaf to the driver. As in any leaf-wise growth the leaf of most gain is
split next; but a pass takes in the children of all splits that the gains known
so far would make, and the order is replayed once their gains are known. A tree
so costs about as many passes as it is deep, whatever its leaves, folds and
points, and is the tree that one split at a time would give.

Training rows of a fold that have the same codes can never be told apart: they
are one cell, with their number and the sum of their labels. Cells stand in
blocks, column by column, and go down a tree as lists of places, so that a pass
reads each code once for each level. Other rows are scored when asked for.

Only trees are on the driver, and medians, levels and borders of bins. Cells
keep their predictions in a written table, renewed every few trees.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

from tidemark.operators.ordering import counted_before, quantiles
from tidemark.sources.scratch import written

MISSING = 0xFFFF
#: Levels of a category, and so bins of a column, at most.
MOST_LEVELS = 4096
#: Trees that are applied again in each pass before predictions are written.
RENEW = 8
#: Columns whose histograms are added up together.
COLUMNS = 16
#: Cells of a block.
CELLS = 32_768
#: Features of a path whose patterns are all laid out beforehand.
PATTERNS = 10


@dataclass(frozen=True)
class Boosting:
    """A point of the grid. ``columns``: share of columns that a tree may use."""

    trees: int = 100
    leaves: int = 31
    rate: float = 0.1
    least_rows: int = 20
    l2: float = 0.0
    columns: float = 1.0
    seed: int = 42

    def usable(self, tree: int, n: int) -> np.ndarray:
        out = np.zeros(n, bool)
        out[np.random.default_rng((self.seed, tree)).permutation(n)[: max(1, round(self.columns * n))]] = True
        return out


@dataclass
class Tree:
    """A node a place. ``column`` is -1 for leaves; numbers go left up to
    ``bin``, and of categories all levels but ``bin`` go left."""

    column: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: int) -> int:
        for name, x in (("column", -1), ("bin", -1), ("left", -1), ("right", -1), ("value", value), ("cover", cover), ("gain", 0.0)):
            getattr(self, name).append(x)
        return len(self.column) - 1

    def reached(self, x: np.ndarray, n_numeric: int, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """The wanted leaves (all if none are named) and the places of the rows
        in each; ``x`` has a row for each column."""
        parents = {child: at for at, c in enumerate(self.column) if c >= 0 for child in (self.left[at], self.right[at])}
        ways = None if wanted is None else set(wanted)
        for at in wanted or ():
            while at in parents:
                ways.add(at := parents[at])
        stack = [(0, np.arange(x.shape[1]))]
        while stack:
            at, rows = stack.pop()
            if ways is not None and at not in ways or not len(rows):
                continue
            c, b = self.column[at], self.bin[at]
            if c < 0:
                yield at, rows
                continue
            v = x[c].take(rows)
            goes = v <= b if c < n_numeric else v != b
            stack += [(self.left[at], rows[goes]), (self.right[at], rows[~goes])]

    def predict(self, x: np.ndarray, n_numeric: int) -> np.ndarray:
        out = np.zeros(x.shape[1])
        for at, rows in self.reached(x, n_numeric):
            out[rows] = self.value[at]
        return out


@dataclass
class Layout:
    """What a column's codes mean: upper borders of the bins of numbers, levels of categories."""

    numeric: list[str]
    categorical: list[str]
    borders: list[np.ndarray]
    levels: list[list[str]]
    fill: dict[int, np.ndarray]  # codes for missing values, by fold

    def sizes(self) -> np.ndarray:
        return np.array([*map(len, self.borders), *map(len, self.levels)], np.int64)

    def feature(self, column: int, cut: int) -> str:
        k = len(self.numeric)
        return self.numeric[column] if column < k else f"{self.categorical[column - k]}_{self.levels[column - k][cut]}"

    def features(self) -> list[str]:
        """Names as after one-hot coding: numbers, then each level of each category."""
        return [*self.numeric, *[f"{c}_{level}" for c, levels in zip(self.categorical, self.levels, strict=True) for level in levels]]

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.full((len(batch), len(self.numeric) + len(self.categorical)), MISSING, np.uint16)
        for i, (name, borders) in enumerate(zip(self.numeric, self.borders, strict=True)):
            values = batch[name].cast(pa.float64()).to_numpy(zero_copy_only=False)
            known = ~np.isnan(values)
            out[known, i] = np.minimum(np.searchsorted(borders, values[known]), max(len(borders) - 1, 0))
        for i, (name, levels) in enumerate(zip(self.categorical, self.levels, strict=True), len(self.numeric)):
            place = {level: j for j, level in enumerate(levels)}
            coded = batch[name].dictionary_encode()
            known = np.array([place.get(v, MISSING - 1) for v in coded.dictionary.to_pylist()] + [MISSING], np.uint16)
            out[:, i] = known[coded.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)]
        return out


def layout(members: DataFrame, numeric: list[str], categorical: list[str], bins: int) -> tuple[Layout, dict[int, dict[str, float]]]:
    """Medians and most frequent levels by fold, borders and levels over all
    training rows; and the medians themselves. Bins of numbers hold about as
    many training rows each."""
    train = members.filter("split = 'train'")
    borders = [np.zeros(0) for _ in numeric]
    medians: dict[int, dict[str, float]] = {}
    if numeric:
        long = train.select("fold_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in numeric])).alias("f")).select("fold_id", "f.*").filter("v IS NOT NULL AND NOT isnan(v)")
        # Counted once: medians and borders are both taken from the counts.
        counts = written(long.groupBy("fold_id", "column", "v").agg(F.count("*").alias("n")), "counts")
        for r in quantiles(counts, "v", [0.5], "fold_id", "column", weight="n").collect():  # folds times columns
            medians.setdefault(r["fold_id"], {})[r["column"]] = r["q0"]
        values = counted_before(counts, ["column"], "v", "n")
        cut = values.groupBy("column", F.floor(F.col("before") * bins / F.col("total")).alias("bin")).agg(F.max("v").alias("border"))
        for r in cut.orderBy("column", "bin").collect():  # columns times bins
            i = numeric.index(r["column"])
            borders[i] = np.append(borders[i], r["border"])
    levels: list[list[str]] = [[] for _ in categorical]
    modes: dict[int, dict[str, str]] = {}
    if categorical:
        long = train.select("fold_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in categorical])).alias("f")).select("fold_id", "f.*").filter("level IS NOT NULL")
        counts = written(long.groupBy("fold_id", "column", "level").agg(F.count("*").alias("n")), "levels")
        for r in counts.select("column", "level").distinct().orderBy("column", "level").limit(MOST_LEVELS * len(categorical) + 1).collect():
            levels[categorical.index(r["column"])].append(r["level"])
        if any(len(x) > MOST_LEVELS for x in levels):
            raise ValueError(f"a category has more than {MOST_LEVELS} levels")
        for r in counts.groupBy("fold_id", "column").agg(F.min(F.struct(-F.col("n"), "level")).alias("top")).collect():  # folds times columns
            modes.setdefault(r["fold_id"], {})[r["column"]] = r["top"]["level"]
    out = Layout(list(numeric), list(categorical), borders, levels, {})
    for r in members.select("fold_id").distinct().collect():  # folds
        one = {c: [medians.get(r[0], {}).get(c, 0.0)] for c in numeric} | {c: [modes.get(r[0], {}).get(c)] for c in categorical}
        table = pa.table({c: pa.array(v, pa.float64() if c in numeric else pa.string()) for c, v in one.items()})
        codes = out.codes(table.to_batches()[0])[0] if one else np.zeros(0, np.uint16)
        out.fill[r[0]] = np.where(codes == MISSING, MISSING - 1, codes)
    return out, medians


def _codes(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch["_x"].cast(pa.binary())
    if not len(column) or not width:
        return np.zeros((len(column), width), np.uint16)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint16).reshape(len(column), width)


def _by_fold(batch: pa.RecordBatch, lay: Layout) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(fold, places, codes with missing values filled, a row for each column).
    Codes that were not learned are one behind the last of their column."""
    sizes = lay.sizes()
    folds, x = np.asarray(batch["fold_id"]), _codes(batch, len(sizes))
    for fold in np.unique(folds):
        at = np.flatnonzero(folds == fold)
        own = x[at]
        filled = np.minimum(np.where(own == MISSING, lay.fill[int(fold)], own), sizes).astype(np.uint16)
        yield int(fold), at, np.ascontiguousarray(filled.T)


def _prepared(batches: Iterator[pa.RecordBatch], lay: Layout, keep: list[str], label: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = lay.codes(batch)
        ends = np.arange(len(batch) + 1, dtype=np.int32) * (2 * x.shape[1])
        packed = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])
        columns = [batch[c] for c in ("fold_id", "split", *keep)] + [batch[label].cast(pa.float64()), packed]
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


Models = dict[tuple[int, int], list[Tree]]

#: Of a block the codes, column by column, and of its cells the rows, the sums
#: of labels and the predictions of each point (none before the first renewal).
_BLOCK = "fold_id int, cells int, x binary, n binary, y binary, p binary"
_BLOCK_ARROW = pa.schema([("fold_id", pa.int32()), ("cells", pa.int32()), *[(c, pa.binary()) for c in "xnyp"]])


def _blocks(batches: Iterator[pa.RecordBatch], lay: Layout) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple]] = {}

    def out(fold: int) -> pa.RecordBatch:
        x, n, y = (np.concatenate(v, axis=-1) for v in zip(*held.pop(fold), strict=True))
        return pa.RecordBatch.from_pylist([{"fold_id": fold, "cells": len(n), "x": x.tobytes(), "n": n.tobytes(), "y": y.tobytes(), "p": b""}], _BLOCK_ARROW)

    for batch in batches:
        n, y = np.asarray(batch["_n"]).astype(float), np.asarray(batch["_s"])
        for fold, at, x in _by_fold(batch, lay):
            held.setdefault(fold, []).append((x, n[at], y[at]))
            if sum(len(v[1]) for v in held[fold]) >= CELLS:
                yield out(fold)
    for fold in list(held):
        yield out(fold)


def _opened(batches: Iterator[pa.RecordBatch], lay: Layout, starts: dict[int, float], points: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks as they are stored, and as arrays: codes, rows, labels, predictions."""
    for batch in batches:
        for row in batch.to_pylist():
            x = np.frombuffer(row["x"], np.uint16).reshape(len(lay.sizes()), row["cells"])
            n, y = np.frombuffer(row["n"]), np.frombuffer(row["y"])
            p = np.frombuffer(row["p"]).reshape(points, -1) if row["p"] else np.full((points, len(n)), starts[row["fold_id"]])
            yield row, x, n, y, p


def _renewed(batches: Iterator[pa.RecordBatch], lay: Layout, pending: Models, starts: dict[int, float], points: int) -> Iterator[pa.RecordBatch]:
    """Blocks with the pending trees applied."""
    for row, x, _, _, p in _opened(batches, lay, starts, points):
        p = p + np.stack([sum((tree.predict(x, len(lay.numeric)) for tree in pending.get((row["fold_id"], j), ())), np.zeros(x.shape[1])) for j in range(points)])
        yield pa.RecordBatch.from_pylist([row | {"p": p.tobytes()}], _BLOCK_ARROW)


def _scored(batches: Iterator[pa.RecordBatch], lay: Layout, trees: Models, starts: dict[int, float], points: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with the predictions of all points."""
    for batch in batches:
        p = np.zeros((len(batch), points))
        for fold, at, x in _by_fold(batch, lay):
            for j in range(points):
                p[at, j] = starts.get(fold, 0.0) + sum((tree.predict(x, len(lay.numeric)) for tree in trees.get((fold, j), ())), np.zeros(len(at)))
        ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * points)
        columns = [*[c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "_x"], pa.ListArray.from_arrays(ends, pa.array(p.ravel()))]
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_HISTOGRAM = "model int, node int, block int, part int, g binary, n binary"
_HISTOGRAM_ARROW = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("g", pa.binary()), ("n", pa.binary())])


def _histograms(batches: Iterator[pa.RecordBatch], lay: Layout, pending: Models, growing: dict, folds: list[int], starts: dict[int, float], points: int) -> Iterator[pa.RecordBatch]:
    """Sums of gradients and rows by model, node, column and bin. ``growing``
    has for each model the tree so far and the places of its leaves that are
    asked for."""
    from pyspark import TaskContext

    sizes = lay.sizes()
    # Codes of levels that were not learned have a bin of their own at the end of each column.
    spans = np.concatenate([[0], np.cumsum(sizes + 1)])
    held: dict[tuple[int, int], dict[int, np.ndarray]] = {}
    part = TaskContext.get().partitionId()

    def out() -> pa.RecordBatch:
        rows = []
        for (fold, j), nodes in held.items():
            for node, (g, n) in nodes.items():
                for block, c in enumerate(range(0, len(sizes), COLUMNS)):
                    span = slice(spans[c], spans[min(c + COLUMNS, len(sizes))])
                    rows.append((folds.index(fold) * points + j, node, block, part, g[span].tobytes(), n[span].tobytes()))
        held.clear()
        return pa.RecordBatch.from_pylist([dict(zip(_HISTOGRAM_ARROW.names, r, strict=True)) for r in rows], _HISTOGRAM_ARROW)

    for row, x, n, y, p in _opened(batches, lay, starts, points):
        fold = row["fold_id"]
        for j in range(points):
            if (fold, j) not in growing:
                continue
            tree, nodes = growing[fold, j]
            own = p[j]
            for done in pending.get((fold, j), ()):
                own = own + done.predict(x, len(lay.numeric))
            g = n * own - y
            for node, at in tree.reached(x, len(lay.numeric), nodes):
                total = held.setdefault((fold, j), {}).setdefault(node, np.zeros((2, spans[-1])))
                own_g, own_n = g[at], n[at]
                for c, size in enumerate(sizes):
                    codes = x[c].take(at).astype(np.intp)
                    total[0, spans[c] : spans[c + 1]] += np.bincount(codes, own_g, size + 1)
                    total[1, spans[c] : spans[c + 1]] += np.bincount(codes, own_n, size + 1)
        if sum(t.size for nodes in held.values() for t in nodes.values()) > 8_000_000:
            yield out()
    yield out()


_SPLIT = "model int, node int, column int, bin int, gain double, g_left double, n_left double, g double, n double"
_SPLIT_ARROW = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("column", pa.int32()), ("bin", pa.int32()), *[(c, pa.float64()) for c in ("gain", "g_left", "n_left", "g", "n")]])


def best_split(g: np.ndarray, n: np.ndarray, numeric: bool, rule: Boosting) -> tuple[float, int, float, float]:
    """(gain, bin, sum and rows to the left) of one column's bins, the last of
    which has codes that were not learned; gain 0 where nothing may be split."""
    whole_g, whole_n = g.sum(), n.sum()
    left_g, left_n = (np.cumsum(g[:-1]), np.cumsum(n[:-1])) if numeric else (whole_g - g[:-1], whole_n - n[:-1])
    right_g, right_n = whole_g - left_g, whole_n - left_n
    may = (left_n >= max(rule.least_rows, 1)) & (right_n >= max(rule.least_rows, 1))
    if not may.any():
        return 0.0, -1, 0.0, 0.0
    score = lambda a, b: np.divide(a * a, b + rule.l2, out=np.zeros(len(a)), where=b > 0)
    gain = np.where(may, score(left_g, left_n) + score(right_g, right_n) - whole_g * whole_g / (whole_n + rule.l2), 0.0)
    # Gains that differ by rounding are ties, which the first bin wins.
    best = int(np.argmax(gain >= gain.max() * (1 - 1e-9)))
    return float(gain[best]), best, float(left_g[best]), float(left_n[best])


def _splits(lay: Layout, points: list[Boosting], tree: int):
    sizes = lay.sizes()

    def task(table: pa.Table) -> pa.Table:
        model, node, block = (table[c][0].as_py() for c in ("model", "node", "block"))
        rule = points[model % len(points)]
        order = np.argsort(np.asarray(table["part"].combine_chunks()), kind="stable")
        stack = lambda c: np.stack([np.frombuffer(table[c][int(i)].as_py()) for i in order]).sum(axis=0)
        g, n = stack("g"), stack("n")
        usable = rule.usable(tree, len(sizes))
        at, best = 0, (0.0, -1, -1, 0.0, 0.0)
        for c in range(block * COLUMNS, min((block + 1) * COLUMNS, len(sizes))):
            span = slice(at, at + sizes[c] + 1)
            at = span.stop
            gain, cut, g_left, n_left = best_split(g[span], n[span], c < len(lay.numeric), rule) if usable[c] else (0.0, -1, 0.0, 0.0)
            if gain > best[0] * (1 + 1e-9):
                best = (gain, c, cut, g_left, n_left)
        first = slice(0, sizes[block * COLUMNS] + 1)  # any column has all rows
        row = (model, node, best[1], best[2], best[0], best[3], best[4], g[first].sum(), n[first].sum())
        return pa.Table.from_pylist([dict(zip(_SPLIT_ARROW.names, row, strict=True))], _SPLIT_ARROW)

    return task


def replay(known: dict[str, tuple], rule: Boosting) -> tuple[Tree, list[str], dict[str, int]]:
    """The tree that the known splits give by most gain first, the nodes whose
    gains it still needs, and the places of all nodes. Nodes are paths of l and
    r; a split is (gain, column, bin, g_left, n_left, g, n)."""
    tree, places, ahead, unknown, sure = Tree(), {}, {}, [], True
    value = lambda g, n: -rule.rate * g / (n + rule.l2) if n > 0 else 0.0

    def add(path: str, g: float, n: float) -> None:
        places[path] = tree.add(value(g, n), int(n))
        if path not in known:
            unknown.append(path)
        elif known[path][0] > 0:
            ahead[path] = known[path]

    if "" not in known:
        tree.add(0.0, 0)
        return tree, [""], {"": 0}
    add("", *known[""][5:])
    made = 1
    while ahead and made < rule.leaves:
        sure &= not unknown
        path = max(ahead, key=lambda p: (ahead[p][0], -places[p]))
        gain, column, cut, g_left, n_left, g, n = ahead.pop(path)
        at = places[path]
        tree.column[at], tree.bin[at], tree.gain[at] = column, cut, gain
        add(path + "l", g_left, n_left)
        add(path + "r", g - g_left, n - n_left)
        tree.left[at], tree.right[at] = places[path + "l"], places[path + "r"]
        made += 1
    # Children of a last split need no gains.
    if sure and made >= rule.leaves:
        unknown = []
    return tree, unknown, places


@dataclass
class Fitted:
    """Trees by (fold, point), and all rows with their predictions."""

    rows: DataFrame  # fold_id, split, kept columns, _y, _x
    blocks: DataFrame  # the cells of the training rows
    lay: Layout
    points: list[Boosting]
    starts: dict[int, float]
    trees: Models
    keep: list[str]
    passes: int

    def predictions(self, split: str | None = None) -> DataFrame:
        """fold_id, split, kept columns, point, y_true, y_pred; of one split only if it is named."""
        rows = self.rows if split is None else self.rows.filter(F.col("split") == split)
        schema = StructType([f for f in rows.schema if f.name != "_x"] + [StructField("_p", ArrayType(DoubleType()))])
        task = partial(_scored, lay=self.lay, trees=self.trees, starts=self.starts, points=len(self.points), schema=to_arrow_schema(schema))
        return rows.mapInArrow(task, schema).select("fold_id", "split", *self.keep, F.col("_y").alias("y_true"), F.posexplode("_p").alias("point", "y_pred"))

    def importances(self) -> DataFrame:
        """fold_id, point, feature (as after one-hot coding), gain, splits; all
        features, those that no tree uses with zeros."""
        found: dict[tuple, list] = {(f, j, name): [0.0, 0] for f, j in self.trees for name in self.lay.features()}
        for (fold, j), trees in self.trees.items():
            for t in trees:
                for c, b, gain in zip(t.column, t.bin, t.gain, strict=True):
                    if c >= 0:
                        cell = found[fold, j, self.lay.feature(c, b)]
                        cell[0] += gain
                        cell[1] += 1
        return self.rows.sparkSession.createDataFrame([(*k, float(g), n) for k, (g, n) in found.items()], "fold_id int, point int, feature string, gain double, splits int")

    def attributions(self, split: str = "test", point: int = 0) -> DataFrame:
        """fold_id, kept columns, base (the expected prediction), y_pred and
        shap: what each of ``lay.features()`` adds to it, by the shares of
        training rows that go either way where a feature is not known."""
        schema = StructType([self.rows.schema[c] for c in ("fold_id", *self.keep)] + [StructField("base", DoubleType()), StructField("y_pred", DoubleType()), StructField("shap", ArrayType(DoubleType()))])
        trees = {fold: t for (fold, j), t in self.trees.items() if j == point}
        task = partial(_attributed, lay=self.lay, trees=trees, starts=self.starts, keep=self.keep, schema=to_arrow_schema(schema))
        return self.rows.filter(F.col("split") == split).mapInArrow(task, schema)

    def mean_attributions(self, split: str = "test", point: int = 0) -> DataFrame:
        """feature, mean_abs_shap over all rows of the split."""
        names = F.array(*[F.lit(n) for n in self.lay.features()])
        long = self.attributions(split, point).select(F.posexplode("shap").alias("i", "v"))
        return long.groupBy("i").agg(F.avg(F.abs("v")).alias("mean_abs_shap")).select(names[F.col("i")].alias("feature"), "mean_abs_shap")


def fit(members: DataFrame, numeric: list[str], categorical: list[str], label: str, points: list[Boosting], keep: list[str], bins: int = 255) -> Fitted:
    """Models of every fold and point, learned from the rows of ``members``
    (fold_id, split, columns) whose split is train.

    Missing numbers take the fold's training median, missing levels its most
    frequent one (the smallest of ties); levels that training lacks are none of
    the learned ones. Rows without a label are left out.
    """
    for p in points:
        if p.leaves < 1 or p.trees < 0 or not 0 < p.columns <= 1:
            raise ValueError(f"not a setting: {p}")
    members = members.withColumns({"fold_id": F.col("fold_id").cast("int"), label: F.col(label).cast("double")}).filter(F.col(label).isNotNull() & ~F.isnan(label))
    numbers = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numeric}
    # Written: medians, levels, borders and codes are each read from it.
    members = written(members.withColumns(numbers).select("fold_id", "split", *dict.fromkeys([*keep, *numeric, *categorical, label])), "members")
    lay, _ = layout(members, numeric, categorical, bins)
    starts = {r["fold_id"]: r["y"] for r in members.filter("split = 'train'").groupBy("fold_id").agg(F.avg(label).alias("y")).collect()}  # folds
    folds = sorted(starts)
    slim = members.select("fold_id", F.col("split").cast("string").alias("split"), *keep, *[F.col(c).cast("double").alias(f"_n_{c}") for c in numeric], *[F.col(c).cast("string").alias(f"_c_{c}") for c in categorical], F.col(label).alias("_y"))
    named = Layout([f"_n_{c}" for c in numeric], [f"_c_{c}" for c in categorical], lay.borders, lay.levels, {})
    schema = StructType([StructField("fold_id", IntegerType()), StructField("split", StringType()), *[slim.schema[c] for c in keep], StructField("_y", DoubleType()), StructField("_x", BinaryType())])
    rows = written(slim.mapInArrow(partial(_prepared, lay=named, keep=keep, label="_y", schema=to_arrow_schema(schema)), schema), "boosting")
    cells = rows.filter("split = 'train'").groupBy("fold_id", "_x").agg(F.count("*").alias("_n"), F.sum("_y").alias("_s"))
    blocks = written(cells.mapInArrow(partial(_blocks, lay=lay), _BLOCK), "cells")
    trees: Models = {(f, j): [] for f in folds for j in range(len(points))}
    pending: Models = {}
    passes = 0
    for t in range(max((p.trees for p in points), default=0)):
        known: dict[tuple[int, int], dict[str, tuple]] = {m: {} for m in trees if t < points[m[1]].trees}
        grown = {m: replay(k, points[m[1]]) for m, k in known.items()}
        while asked := {m: g for m, g in grown.items() if g[1]}:
            growing = {m: (tree, [places[p] for p in unknown]) for m, (tree, unknown, places) in asked.items()}
            found = blocks.mapInArrow(partial(_histograms, lay=lay, pending=pending, growing=growing, folds=folds, starts=starts, points=len(points)), _HISTOGRAM)
            paths = {m: {places[p]: p for p in unknown} for m, (_, unknown, places) in asked.items()}
            best: dict[tuple, tuple] = {}
            for r in found.groupBy("model", "node", "block").applyInArrow(_splits(lay, points, t), _SPLIT).collect():  # splits, not rows
                m = (folds[r["model"] // len(points)], r["model"] % len(points))
                split = (r["gain"], r["column"], r["bin"], r["g_left"], r["n_left"], r["g"], r["n"])
                old = best.get(key := (m, paths[m][r["node"]]))
                if old is None or split[0] > old[0] * (1 + 1e-9) or (split[0] >= old[0] * (1 - 1e-9) and split[1] < old[1] and split[0] > 0):
                    best[key] = split
            for m, (_, unknown, _) in asked.items():
                for p in unknown:
                    known[m][p] = best.get((m, p), (0.0, -1, -1, 0.0, 0.0, 0.0, 0.0))
                grown[m] = replay(known[m], points[m[1]])
            passes += 1
        for m, (tree, _, _) in grown.items():
            trees[m].append(tree)
            pending.setdefault(m, []).append(tree)
        if any(len(x) >= RENEW for x in pending.values()):
            blocks, pending = written(blocks.mapInArrow(partial(_renewed, lay=lay, pending=pending, starts=starts, points=len(points)), _BLOCK), "cells"), {}
    return Fitted(rows, blocks, lay, points, starts, trees, keep, passes)


def grid(fitted: Fitted, split: str = "valid") -> DataFrame:
    """point, its parameters, mean_mae and rank: points of the grid by their
    error in the split, averaged over folds, best first, the earlier of ties."""
    spark = fitted.rows.sparkSession
    by_fold = fitted.predictions(split).groupBy("point", "fold_id").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"))
    means = by_fold.groupBy("point").agg(F.avg("mae").alias("mean_mae"))
    points = spark.createDataFrame([(i, p.trees, p.leaves, float(p.rate), p.least_rows, float(p.columns)) for i, p in enumerate(fitted.points)], "point int, trees int, leaves int, rate double, least_rows int, columns double")
    return points.join(means, "point").withColumn("rank", F.row_number().over(Window.orderBy("mean_mae", "point")))  # one row for each point


# ---- attributions -------------------------------------------------------------------------------------------


def leaf_shares(shares: np.ndarray, known: np.ndarray) -> np.ndarray:
    """What a leaf of value 1 adds for each of the d features on its path: the
    Shapley values of a product game in which a feature that is in counts 1 or
    0 (``known``, patterns x d) and one that is out counts its ``shares``."""
    d = len(shares)
    weights = np.ones(d)  # s! (d - s - 1)! / d!
    for s in range(1, d):
        weights[s] = weights[s - 1] * s / (d - s)
    weights /= d
    out = np.zeros(known.shape)
    for j in range(d):
        # Coefficient s: all ways for s of the others to be in.
        ways = np.zeros((len(known), d))
        ways[:, 0] = 1
        for i in range(d):
            if i != j:
                ways[:, 1:] = ways[:, 1:] * shares[i] + ways[:, :-1] * known[:, i, None]
                ways[:, 0] *= shares[i]
        out[:, j] = (known[:, j] - shares[j]) * (ways @ weights)
    return out


def tree_attributions(tree: Tree, x: np.ndarray, n_numeric: int, place) -> tuple[dict[int, np.ndarray], float]:
    """Attributions of one tree by place of the feature, and its expected value;
    ``x`` has a row for each column."""
    found: dict[int, np.ndarray] = {}
    expected = 0.0
    stack: list[tuple[int, dict]] = [(0, {})]  # node, and by feature: share of rows, rows that pass
    while stack:
        at, path = stack.pop()
        c, b = tree.column[at], tree.bin[at]
        if c >= 0:
            feature, left = place(c, b), (x[c] <= b) if c < n_numeric else (x[c] != b)
            for child, passes in ((tree.left[at], left), (tree.right[at], ~left)):
                share, before = path.get(feature, (1.0, True))
                stack.append((child, path | {feature: (share * tree.cover[child] / tree.cover[at], before & passes)}))
            continue
        value, d = tree.value[at], len(path)
        expected += value * float(np.prod([s for s, _ in path.values()]))
        if not path or value == 0:
            continue
        shares = np.array([s for s, _ in path.values()])
        # A row's pattern is a number, a bit for each feature that it passes.
        number = np.zeros(x.shape[1], np.int64)
        for k, (_, passes) in enumerate(path.values()):
            number |= passes.astype(np.int64) << k
        patterns, which = (np.arange(1 << d), number) if d <= PATTERNS else np.unique(number, return_inverse=True)
        adds = value * leaf_shares(shares, (patterns[:, None] >> np.arange(d) & 1).astype(float))
        for k, feature in enumerate(path):
            found.setdefault(feature, np.zeros(x.shape[1]))
            found[feature] += adds[:, k][which]
    return found, expected


def _attributed(batches: Iterator[pa.RecordBatch], lay: Layout, trees: dict[int, list[Tree]], starts: dict[int, float], keep: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    k, sizes = len(lay.numeric), lay.sizes()
    first = np.concatenate([[k], k + np.cumsum(sizes[k:])]).astype(int)
    place = lambda c, b: c if c < k else int(first[c - k]) + b
    width = len(lay.features())
    for batch in batches:
        if not len(batch):
            continue
        out, base, p = np.zeros((len(batch), width)), np.zeros(len(batch)), np.zeros(len(batch))
        for fold, at, x in _by_fold(batch, lay):
            base[at] = p[at] = starts.get(fold, 0.0)
            for tree in trees.get(fold, ()):
                adds, expected = tree_attributions(tree, x, k, place)
                base[at] += expected
                p[at] += tree.predict(x, k)
                for feature, v in adds.items():
                    out[at, feature] += v
        ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * width)
        columns = [batch[c] for c in ("fold_id", *keep)] + [pa.array(base), pa.array(p), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))]
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
