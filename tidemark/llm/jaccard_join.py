"""N-gram Jaccard join by PartEnum signatures.

The set of a document is its distinct ``k``-word shingles. Two sets link when
``den * |A & B| >= num * |A | B|``. Sizes are cut into overlapping bands, such
that two linked sets have a band in common; in a band a bound on the symmetric
difference follows from its largest size. The shingle domain is partitioned
into ``n1`` first-level parts of ``n2`` second-level parts, and a set's
signatures are its projections on all subsets of ``n2 - k2`` second-level
parts of each first-level part: sets within the bound share at least one.

Around this, all of it exact:

* sets that are equal form one class and are represented once;
* a set whose shingles are, in too large a part, held by no other class can
  link with none and needs no signatures (a content-selected quarter of the
  shingle domain is counted for this);
* in a bucket of more than two classes, the most central class (fewest
  shingles of its own) is compared with the others. Of the classes of all
  buckets with one such centre, those outside its largest component are then
  held against all, in blocks. Links within a component add nothing to it, and
  no table of a group's pairs is made.

Every candidate pair is checked on the shingles of its whole texts. A shingle
is a 64-bit hash of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm import text as T
from tidemark.llm.components import connected_components
from tidemark.llm.storage import columns_free, materialise

_U = np.uint64
#: One in so many shingle values, chosen by the value, is counted in the first bound.
SAMPLED = 4
#: Classes of a centre that are held against as many others at a time.
BLOCK = 256
#: Bytes of texts that are sent to blocks at a time: so many, or so many times all texts.
SENT, SENT_TIMES = 1 << 29, 2


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of ``num / den`` or more on ``k``-word shingles."""

    k: int = 5
    num: int = 80
    den: int = 100
    n2: int = 4
    k2: int = 1

    def __post_init__(self):
        if not (0 < self.num <= self.den and self.k > 0 and 0 <= self.k2 < self.n2):
            raise ValueError("need 0 < num <= den, k > 0 and 0 <= k2 < n2")

    def bands(self, n: int) -> list[tuple[int, int]]:
        """(band, largest size in it) of the bands that a set of ``n`` is in."""
        out, start, band = [], 1, 0
        while start <= n:
            end = start * self.den * self.den // (self.num * self.num)  # sizes start..end have it as their own band
            top = max(end * self.den // self.num, end)
            if n <= top:
                out.append((band, top))
            start, band = end + 1, band + 1
        return out

    def difference(self, top: int) -> int:
        """Largest symmetric difference of linked sets of ``top`` at most."""
        return (self.den - self.num) * 2 * top // (self.den + self.num)


def shingles(block: T.Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a block, with its number in the
    block, and the size of each document's set."""
    words = T.tokens(block, T.WORDS_FOLDED)
    values, first = T.grams(words.hashes, words.bounds, k, whole_if_short=True)
    document = words.document[first] if len(first) else first
    keep = T.distinct_within(values, document)
    values, document = values[keep], document[keep]
    return values, document, np.bincount(document, minlength=len(block)) if len(document) else np.zeros(len(block), np.int64)


def _classes(values: np.ndarray, document: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty set."""
    name = T.mix(T.sums_by_document(T.mix(values), document, len(sizes)) + sizes.astype(_U))
    return np.where(sizes > 0, name, _U(0))


def signatures(own: np.ndarray, rule: Threshold) -> np.ndarray:
    """Signatures of one set over all its bands."""
    out = []
    subsets = np.array(list(combinations(range(rule.n2), rule.n2 - rule.k2)))
    for band, top in rule.bands(len(own)):
        k = rule.difference(top)
        n1 = -(-(k + 1) // (rule.k2 + 1))
        dealt = T.mix(own + T.seeded(1, 2 * band + 1))
        cell = (dealt % _U(n1 * rule.n2)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        sums = T.sums_by_document(T.mix(own[order] ^ _U(0x5DEECE66D)), cell[order], n1 * rule.n2).reshape(n1, rule.n2)
        acc = T.mix(np.arange(n1, dtype=_U) + T.seeded(1, band))[:, None] + np.arange(len(subsets), dtype=_U)[None, :]
        for j in range(subsets.shape[1]):
            acc = T.mix(acc + sums[:, subsets[:, j]])
        out.append(acc.ravel())
    return np.concatenate(out) if out else np.empty(0, _U)


def _each(batches, column: str):
    for batch in batches:
        for block in T.blocks(batch.column(batch.schema.get_field_index(column))):
            yield batch, block


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in _each(batches, "text"):
            values, document, sizes = shingles(block, k)
            named = [batch.column(batch.schema.get_field_index(c)).slice(block.first, len(block)) for c in ("doc_id", "th")]
            yield pa.RecordBatch.from_arrays([*named, pa.array(sizes.astype(np.int64)), T.as_long(_classes(values, document, sizes))], ["doc_id", "th", "n", "cls"])

    return run


def _explode(k: int, modulus: int):
    def run(batches):
        for _, block in _each(batches, "text"):
            values, document, sizes = shingles(block, k)
            names = _classes(values, document, sizes)
            if modulus > 1:
                keep = values % _U(modulus) == 0
                values, document = values[keep], document[keep]
            yield pa.RecordBatch.from_arrays([T.as_long(values), T.as_long(names[document])], ["h", "cls"])

    return run


def _sign(rule: Threshold):
    def run(batches):
        for batch, block in _each(batches, "text"):
            values, document, sizes = shingles(block, rule.k)
            at = np.concatenate([[0], np.cumsum(sizes)])
            each = [signatures(values[at[i] : at[i + 1]], rule) for i in range(len(block))]
            count = np.array([len(x) for x in each])
            repeat = lambda a: np.repeat(a, count)
            yield pa.RecordBatch.from_arrays([T.as_long(np.concatenate(each) if each else np.empty(0, _U)), T.as_long(repeat(_classes(values, document, sizes))), pa.array(repeat(sizes.astype(np.int64)))], ["sig", "cls", "n"])

    return run


def _keep_named(k: int):
    """Texts whose set has the name that the row gives."""

    def run(batches):
        for batch, block in _each(batches, "text"):
            values, document, sizes = shingles(block, k)
            part = batch.slice(block.first, len(block))
            same = _classes(values, document, sizes).view(np.int64) == np.asarray(part.column(part.schema.get_field_index("cls")))
            yield part.filter(pa.array(same))

    return run


def _verify(rule: Threshold):
    def run(batches):
        last_name, last = None, None
        for batch in batches:
            a = np.asarray(batch.column(batch.schema.get_field_index("a")))
            right = batch.column(batch.schema.get_field_index("text_b"))
            left = batch.column(batch.schema.get_field_index("text_a"))
            linked = np.zeros(len(batch), dtype=bool)
            for block in T.blocks(right):
                values, _, sizes = shingles(block, rule.k)
                at = np.concatenate([[0], np.cumsum(sizes)])
                for i in range(len(block)):
                    row = block.first + i
                    if last_name != a[row]:
                        one = next(T.blocks(left.slice(row, 1)))
                        last_name, last = a[row], np.sort(shingles(one, rule.k)[0])
                    own = values[at[i] : at[i + 1]]
                    place = np.searchsorted(last, own)
                    place[place == len(last)] = 0
                    both = int(np.count_nonzero(last[place] == own)) if len(last) else 0
                    linked[row] = both > 0 and rule.den * both >= rule.num * (len(own) + len(last) - both)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def _linked(pairs: DataFrame, texts: DataFrame, rule: Threshold) -> DataFrame:
    """Those of the pairs (a, b) of classes that link."""
    one = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    two = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    rows = pairs.join(one, "b").join(two, "a").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(_verify(rule), "a long, b long")


def _possible(a: str, b: str, rule: Threshold) -> str:
    """SQL: sizes n and own shingles u of two classes leave a link possible."""
    both = f"least({a}.n - {a}.u, {b}.n - {b}.u)"
    return f"{rule.den} * {both} >= {rule.num} * ({a}.n + {b}.n - {both})"


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _own_counts(shingle_rows: DataFrame) -> DataFrame:
    """(cls, u): for each class, how many of the given shingles no other has."""
    alone = shingle_rows.groupBy("h").agg(F.min("cls").alias("cls"), F.max("cls").alias("other")).filter("cls = other")
    return alone.groupBy("cls").agg(F.count("*").alias("u"))


def _compare(rule: Threshold):
    """Links between differently labelled classes of a block of those apart and
    a block of all (rows are in the one, the other, or both); of links that
    close a circle, none is needed."""

    def run(table: pa.Table) -> pa.Table:
        names, labels, apart, among = (np.asarray(table[c].combine_chunks()) for c in ("cls", "label", "apart", "among"))
        one, two = np.flatnonzero(apart), np.flatnonzero(among)
        values, document, sizes, base = [], [], [], 0
        for block in T.blocks(table["text"]):
            v, d, n = shingles(block, rule.k)
            values.append(v)
            document.append(d + base)
            sizes.append(n)
            base += len(block)
        values, document, sizes = np.concatenate(values), np.concatenate(document), np.concatenate(sizes)
        _, column, count = np.unique(values, return_inverse=True, return_counts=True)
        shared = count > 1
        place = (np.cumsum(shared) - 1)[column]
        document, place = document[shared[column]], place[shared[column]]
        order = np.argsort(place, kind="stable")
        document, place = document[order], place[order]
        both = np.zeros((len(one), len(two)), dtype=np.float32)
        for low in range(0, int(shared.sum()), 2048):
            part = slice(*np.searchsorted(place, [low, low + 2048]))
            has = np.zeros((len(names), 2048), dtype=np.float32)
            has[document[part], place[part] - low] = 1
            both += has[one] @ has[two].T
        linked = rule.den * both >= rule.num * (sizes[one][:, None] + sizes[two][None, :] - both)
        linked &= (both > 0) & (labels[one][:, None] != labels[two][None, :])
        root = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        edges = []
        for x, y in zip(*np.nonzero(linked)):
            p, q = find(labels[one[x]]), find(labels[two[y]])
            if p != q:
                root[max(p, q)] = min(p, q)
                edges.append((names[one[x]], names[two[y]]))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def _across_labels(rest: DataFrame, texts: DataFrame, rule: Threshold) -> DataFrame:
    """Links (a, b) between classes of one centre that have different labels.

    Those outside the label that most classes of a centre have are apart; each
    such link has one of them. Both those apart and all are cut into blocks of
    about ``BLOCK``; a block of either is compared in a task, so no task holds
    a large group and no table holds its pairs. Where both are one block, a
    class is sent once. Texts are sent to some blocks at a time, so that what
    lies on disk does not grow with the blocks that a text is sent to."""
    # Written, so that each join deals both sides out anew and can split a large group.
    bytes_ = texts.select("cls", F.octet_length("text").cast("long").alias("bytes"))
    sizes = materialise(rest.join(bytes_, "cls").groupBy("centre", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    top = F.struct("n", "label")
    mains = sizes.groupBy("centre").agg(F.max_by("label", top).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("bytes").alias("bytes"), (F.sum("bytes") - F.max_by("bytes", top)).alias("further"))
    mains = materialise(mains.select("centre", "main", blocks(F.col("n")).alias("nb"), blocks(F.col("n") - F.col("most")).alias("nm"), "bytes", "further"))
    sent = mains.agg(F.sum(F.when(F.col("nb") > 1, F.col("bytes") * F.col("nm") + F.col("further") * F.col("nb")).otherwise(F.col("bytes")))).first()[0] or 0
    parts = -(-sent // max(SENT, SENT_TIMES * (bytes_.agg(F.sum("bytes")).first()[0] or 0))) or 1
    named = rest.join(mains, "centre")
    own = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    away = F.col("label") != F.col("main")
    every = named.withColumns({"i": own("nb"), "apart": away & (F.col("nb") == 1), "among": F.lit(True)}).withColumn("j", each("nm"))
    apart = named.filter(away & (F.col("nb") > 1)).withColumns({"j": own("nm"), "apart": F.lit(True), "among": F.lit(False)}).withColumn("i", each("nb"))
    dealt = every.unionByName(apart).select("centre", "i", "j", "apart", "among", "cls", "label")
    found = []
    for part in range(parts):
        some = dealt.filter(F.pmod(F.xxhash64("centre", "i", "j"), F.lit(parts)) == part)
        found.append(materialise(some.join(texts, "cls").groupBy("centre", "i", "j").applyInArrow(_compare(rule), "a long, b long").distinct()))
    return reduce(DataFrame.unionByName, found).distinct()


def _labelled(docs: DataFrame, rule: Threshold) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls) of each row, and (cls, label, least_id) of each class:
    classes of one component have one label."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    described = materialise(rows.mapInArrow(_describe(rule.k), "doc_id long, th long, n long, cls long"))
    # The doc_id and text of a class by which its text is found again: no other text has both.
    key = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.col("th").alias("t"))
    classes = described.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.min(key).alias("key"), F.first("n").alias("n"))
    alone = _own_counts(rows.mapInArrow(_explode(rule.k, SAMPLED), "h long, cls long"))
    # With u of n shingles its own, a class has at most n - u in common with a set of at least as many.
    # Written, so that the shuffles of the shingles are gone before texts are shuffled.
    open_ = materialise(classes.join(alone, "cls", "left").filter(f"{rule.den} * (n - coalesce(u, 0)) >= {rule.num} * n").select("cls", F.col("key.id").alias("id"), F.col("key.t").alias("th")))
    keyed = rows.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)))).join(open_, ["id", "th"]).select("cls", "text")
    texts = materialise(keyed.mapInArrow(_keep_named(rule.k), "cls long, text string").dropDuplicates(["cls"]))
    signed = materialise(texts.mapInArrow(_sign(rule), "sig long, cls long, n long"))
    buckets = materialise(signed.groupBy("sig").agg(F.count("*").alias("m"), F.min("cls").alias("a"), F.max("cls").alias("b"), F.min("n").alias("low"), F.max("n").alias("high")).filter("m > 1"))
    pairs = buckets.filter(f"m = 2 AND {rule.den} * low >= {rule.num} * high").select("a", "b")

    large = materialise(signed.join(buckets.filter("m > 2").select("sig"), "sig"))
    within = large.select("cls").distinct()
    own = _own_counts(texts.join(within, "cls", "left_semi").mapInArrow(_explode(rule.k, 1), "h long, cls long"))
    counted = large.select("cls", "n").distinct().join(own, "cls", "left").select("cls", F.coalesce("u", F.lit(0)).alias("u"))
    members = materialise(large.join(counted, "cls").filter(f"{rule.den} * (n - u) >= {rule.num} * n").select("sig", "cls", "n", "u"))
    centres = members.groupBy("sig").agg(F.min(F.struct("u", "n", "cls")).alias("c")).select("sig", "c.*")
    stars = members.alias("x").join(centres.alias("c"), "sig").filter("x.cls <> c.cls").filter(_possible("x", "c", rule)).select(F.col("c.cls").alias("a"), F.col("x.cls").alias("b"))
    first = materialise(_linked(_ordered(pairs.unionByName(stars)), texts, rule))

    labels = connected_components(first)
    # Buckets with one centre are taken together: two classes that share a bucket share its centre.
    around = members.join(centres.select("sig", F.col("cls").alias("centre")), "sig").select("centre", "cls").distinct()
    named = materialise(around.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")))
    # Written, so that the join knows its size, or else deals both sides out anew and can split a large centre.
    mixed = materialise(named.groupBy("centre").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).filter("l1 <> l2").select("centre"))
    second = materialise(_across_labels(materialise(named.join(mixed, "centre")), texts, rule))
    final = connected_components(first.unionByName(second))

    labelled = classes.join(final.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    return described, labelled


def near_duplicates(docs: DataFrame, rule: Threshold = Threshold()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    ``docs`` needs doc_id (long) and text; other columns are not read.
    component_id is the smallest doc_id that links reach, itself included.
    A null or wordless text has an empty set and links with nothing. Repeated
    rows each get a row; a null doc_id is never the smallest, and a component
    without any other has a null component_id. Texts are compared whole, of
    any length.
    """
    described, labelled = _labelled(docs, rule)
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(least, "label").select("cls", "component_id")
    return described.join(named, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _named(k: int, column: str):
    """Rows with the name of their text's set as one more column."""

    def run(batches):
        for batch, block in _each(batches, "text"):
            values, document, sizes = shingles(block, k)
            part = batch.slice(block.first, len(block))
            yield pa.RecordBatch.from_arrays([*part.columns, T.as_long(_classes(values, document, sizes))], [*part.schema.names, column])

    return run


def keep_one_per_group(docs: DataFrame, rule: Threshold = Threshold()) -> DataFrame:
    """``docs`` less the near copies: of each component exactly one row stays,
    one with the smallest doc_id (null last) and then the smallest name of its
    set and text. Rows with an empty set stay, and so do other texts that share
    the doc_id of a removed one."""
    described, labelled = _labelled(docs, rule)
    # Written, so that each join deals both sides out anew and can split a large class or component.
    sized = described.groupBy("doc_id", "cls").agg(F.count("*").alias("m"))
    keyed = materialise(sized.join(materialise(labelled.select("cls", "label")), "cls", "left"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("cls").alias("c"))
    groups = materialise(keyed.filter("label IS NOT NULL").groupBy("label").agg(F.min(rank).alias("top"), F.sum("m").alias("total")).filter("total > 1"))
    is_top = "((doc_id IS NULL) = top.none AND coalesce(doc_id, 0) = top.d AND cls = top.c)"
    fate = f"CASE WHEN top IS NULL OR {is_top} AND m = 1 THEN 'stays' WHEN {is_top} THEN 'one' ELSE 'goes' END"
    fates = materialise(keyed.join(groups, "label", "left").selectExpr("doc_id AS id", "cls AS c", f"{fate} AS fate"))
    # Where all rows of a doc_id have one fate, the doc_id decides; elsewhere the class is needed too.
    by_id = materialise(fates.groupBy("id").agg(F.min("fate").alias("low"), F.max("fate").alias("high")).filter("high <> 'stays' OR low <> 'stays'"))
    key, sole = columns_free(docs, "key", "sole")
    keyed_docs = docs.withColumn(key, F.col("doc_id").cast("long"))
    clear = keyed_docs.join(by_id, keyed_docs[key].eqNullSafe(by_id["id"]), "left_anti").select(docs.columns)
    mixed = by_id.filter("NOT (low = 'goes' AND high = 'goes')").select("id")
    some = docs.join(mixed, docs["doc_id"].cast("long").eqNullSafe(mixed["id"]), "left_semi")
    class_, whose, what = columns_free(some, "cls", "id", "fate")
    schema = StructType([*docs.schema.fields, StructField(class_, LongType())])
    named = some.mapInArrow(_named(rule.k, class_), schema)
    decided = fates.filter("fate <> 'stays'").select(F.col("id").alias(whose), F.col("c").alias(key), F.col("fate").alias(what))
    match = named["doc_id"].cast("long").eqNullSafe(decided[whose]) & (named[class_] == decided[key])
    judged = materialise(named.join(decided, match, "left").filter(F.coalesce(F.col(what), F.lit("stays")) != "goes"))
    stay = judged.filter(F.col(what).isNull()).select(docs.columns)
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = judged.filter(F.col(what).isNotNull()).groupBy(F.col(whose), F.col(class_)).agg(F.min_by(row, F.struct("text", F.to_json(row))).alias(sole)).select(f"{sole}.*")
    return clear.unionByName(stay).unionByName(one)
