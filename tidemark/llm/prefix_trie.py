"""Prefix trie of conversations: which openings they share, and what sharing saves.

A conversation is a path of turns (role, text) from the root. A path's name is
the exclusive-or of 128-bit hashes of its (depth, turn) pairs, so that names of
all prefixes come from running aggregates and texts are not carried along.
Members of a node are counted before they are shuffled: a conversation that is
copied a million times is one path of nodes.

Nodes are dealt by the digest of their first turn; each task builds tries as
dictionaries of pointers and folds them up in iterative postorder. A first
turn with more than ``most_nodes`` nodes is cut: as many depths as fit stay
together and what lies deeper is dealt again by its next turn, until all
parts fit. Parts are folded from the deepest up, and hand the totals of their
top nodes to the part above.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.digests import ordered_sha256
from tidemark.llm.mixing import word_count
from tidemark.llm.storage import materialise
from tidemark.operators.ordering import positions

#: Opening turns are taken from the first conversation of each block of so many.
BLOCK = 20
#: Conversation ids of one node that are joined in one string.
IDS = 1 << 16

_FOLDED = "k1 long, k2 long, up1 long, up2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def turn_digest() -> Column:
    return F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) of every conversation, and the rows (conv_id, depth, digest,
    words) of each after its opening was taken from its block's first one.

    Turns that share a number are ordered by role, then digest of the text;
    rows without conv_id belong to no conversation.
    """
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slim = turns.select("conv_id", "turn", "role", turn_digest().alias("digest"), word_count("text").alias("words"))
    own = materialise(positions(slim, ["turn", "role", "digest"], ("conv_id",)).select("conv_id", "position", "digest", "words"))
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    asked = convs.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % 4).alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    asked = materialise(asked.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").fillna(0, ["n_base"]))
    firsts = own.filter("position < 3").select(F.col("conv_id").alias("base"), "position", "digest", "words")
    opening = asked.select("conv_id", "base", "h").join(firsts, "base").filter("position < h").select("conv_id", (F.col("position") + 1).alias("depth"), "digest", "words")
    rest = own.join(asked.select("conv_id", "h", "n_base"), "conv_id").filter("position >= h").select("conv_id", (F.col("position") - F.col("h") + F.least("h", "n_base") + 1).alias("depth"), "digest", "words")
    return asked.select("conv_id", "n"), opening.unionByName(rest)


def _named(rows: DataFrame) -> DataFrame:
    """Rows with the names (k1, k2) of the prefixes they end, (p1, p2) of those
    before, and (t1, t2) of their first turn. A conversation's names are running
    exclusive-ors within slices of 4096 turns, on top of the slices before."""
    rows = rows.withColumns({"a": F.xxhash64("digest", "depth"), "b": F.xxhash64("depth", "digest", F.lit(1)), "slice": F.shiftright("depth", 12)}).drop("digest")
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("conv_id", "slice").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.max(F.when(F.col("depth") == 1, F.struct("a", "b"))).alias("first"))
    sofar = [F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"_{c}") for c in "ab"]
    top = F.max("first").over(Window.partitionBy("conv_id"))
    slices = slices.select("conv_id", "slice", *sofar, top["a"].alias("t1"), top["b"].alias("t2"))
    running = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.withColumns({"x": F.bit_xor("a").over(running), "y": F.bit_xor("b").over(running)}).join(slices, ["conv_id", "slice"])
    k1, k2 = F.col("x").bitwiseXOR(F.col("_a")), F.col("y").bitwiseXOR(F.col("_b"))
    return named.select("conv_id", "depth", "words", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("a")).alias("p1"), k2.bitwiseXOR(F.col("b")).alias("p2"), "t1", "t2")


def _cut(nodes: DataFrame, paths: DataFrame, most_nodes: int) -> list[DataFrame]:
    """The nodes in layers of parts, the topmost first. (t1, t2) names a part
    by its top node; no part of several depths has more than ``most_nodes``."""
    layers = []
    while True:
        by_depth = nodes.groupBy("t1", "t2", "depth").agg(F.count("*").alias("c"))
        whole = by_depth.groupBy("t1", "t2").agg(F.sum("c").alias("total"), F.min("depth").alias("top")).filter(F.col("total") > most_nodes)
        fits = F.sum("c").over(Window.partitionBy("t1", "t2").orderBy("depth"))
        cuts = by_depth.join(whole, ["t1", "t2"]).withColumn("within", (fits <= most_nodes) | (F.col("depth") == F.col("top")))
        cuts = materialise(cuts.filter("NOT within").groupBy("t1", "t2").agg(F.min("depth").alias("cut")))
        if cuts.isEmpty():
            return [*layers, nodes]
        marked = nodes.join(cuts, ["t1", "t2"], "left")
        layers.append(materialise(marked.filter("cut IS NULL OR depth < cut").drop("cut")))
        # What lies deeper is named by the prefix that its smallest member has at the cut.
        deep = marked.filter("depth >= cut").drop("t1", "t2")
        heads = paths.select("conv_id", F.col("depth").alias("cut"), F.col("k1").alias("t1"), F.col("k2").alias("t2"))
        nodes = materialise(deep.join(heads, ["conv_id", "cut"]).drop("cut"))


def _fold(part: pd.DataFrame) -> pd.DataFrame:
    """Tries of one bucket: children, leaves and savings of each node."""
    part = part.sort_values("depth", kind="stable", ignore_index=True)
    keys = list(zip(part.k1, part.k2, strict=True))
    at = {key: i for i, key in enumerate(keys)}
    up = [at.get(key, -1) for key in zip(part.p1, part.p2, strict=True)]
    children: list[list[int]] = [[] for _ in keys]
    stack = []
    for i, parent in enumerate(up):
        (children[parent] if parent >= 0 else stack).append(i)
    n_children, leaves, saved = (part[c].tolist() for c in ("below", "leaves", "saved"))
    own, seen = ((part.n_convs - 1) * part.words).tolist(), bytearray(len(keys))
    while stack:
        i = stack[-1]
        if not seen[i]:
            seen[i] = 1
            stack.extend(children[i])
            continue
        stack.pop()
        n_children[i] += len(children[i])
        leaves[i] = leaves[i] + sum(leaves[c] for c in children[i]) if n_children[i] else 1
        saved[i] += own[i] + sum(saved[c] for c in children[i])
    parent = part.conv_id.to_numpy()[np.maximum(up, 0)] if len(keys) else []
    out = part[["k1", "k2", "p1", "p2", "conv_id", "depth"]].rename(columns={"p1": "up1", "p2": "up2"})
    return out.assign(parent_conv_id=pd.array(parent, "Int64"), n_convs=part.n_convs, n_children=n_children, n_leaves=leaves, saved_tokens=saved).assign(parent_conv_id=lambda d: d.parent_conv_id.mask(np.array(up, int) < 0))


def prefix_trie(conversations: DataFrame, most_nodes: int = 20_000) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    ``conversations`` needs conv_id, turn, role and text; further columns are
    ignored. Null roles and texts count as empty, null turns come first, turns
    that share a number are ordered by role and then by digest of the text,
    repeated rows are turns of their own, negative ids have the remainder of
    their sign, as in SQL. Rows with a null conv_id belong to
    no conversation. An empty table has no trie, not even a root.
    """
    convs, rows = rebuilt(conversations)
    paths = materialise(_named(rows))
    nodes = paths.groupBy("k1", "k2").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in ("depth", "words", "p1", "p2", "t1", "t2")])
    layers = _cut(materialise(nodes), paths.select("conv_id", "depth", "k1", "k2"), most_nodes)
    folded, totals = [], None
    for level, layer in reversed(list(enumerate(layers))):
        buckets = max(1, layer.count() * 2 // most_nodes)
        given = {c: F.lit(0).cast("long") for c in ("below", "leaves", "saved")}
        if totals is None:
            layer = layer.withColumns(given)
        else:
            layer = layer.join(totals, ["k1", "k2"], "left").fillna(0, list(given))
        done = materialise(layer.withColumn("bucket", F.pmod(F.xxhash64("t1", "t2"), F.lit(buckets))).groupBy("bucket").applyInPandas(_fold, _FOLDED))
        folded.append(done)
        if level:
            tops = done.filter("parent_conv_id IS NULL").groupBy("up1", "up2")
            totals = tops.agg(F.count("*").alias("below"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).withColumnsRenamed({"up1": "k1", "up2": "k2"})
    every = folded[0]
    for more in folded[1:]:
        every = every.unionByName(more)
    if len(folded) > 1:
        names = every.select(F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("above"))
        tops = every.filter("parent_conv_id IS NULL AND depth > 1").select("k1", "k2", "up1", "up2").join(names, ["up1", "up2"]).select("k1", "k2", "above")
        every = every.join(tops, ["k1", "k2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    zero = F.lit(0).cast("long")
    least, n = convs.agg(F.min("conv_id"), F.count("*")).first()
    every = every.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least).cast("long")).otherwise(F.col("parent_conv_id")))
    # The root is the only node without a name.
    root = folded[-1].filter("depth = 1").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    root = root.filter(F.lit(n > 0)).withColumns({"k1": zero, "k2": zero, "conv_id": F.lit(least).cast("long"), "depth": zero, "parent_conv_id": F.lit(None).cast("long"), "n_convs": F.lit(n).cast("long")})
    every = every.drop("up1", "up2", "above").unionByName(root)
    return every.join(_ended(convs, paths), ["k1", "k2"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def _ended(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes where conversations end. Ids are
    joined by stretches of ids first, so that few rows of a node meet."""
    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("last"))
    zero = F.lit(0).cast("long")
    ends = convs.select("conv_id").join(last, "conv_id", "left").select("conv_id", F.coalesce("last.k1", zero).alias("k1"), F.coalesce("last.k2", zero).alias("k2"))
    stretch = F.floor(F.col("conv_id") / F.lit(IDS)).cast("long")
    joined = ends.groupBy("k1", "k2", stretch.alias("stretch")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece"))
    return ordered_sha256(joined, ["k1", "k2"], ["stretch"], ",").withColumnRenamed("sha256", "ends_sha256")
