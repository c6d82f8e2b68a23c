"""Repair of conversations: the cheapest edits that make roles legal.

Edits keep, rerole, delete or insert turns until the initials of the roles
read ``(s?(ua)+)?``. States of that grammar are bits; for each cost in turn a
layer holds, for every place between two turns, the set of states from which
the rest can be repaired at that cost or less, computed from the layers below.
The first layer whose start holds the start state gives the cost, and the bits
give the least audit: from a state each edit leads to one state, so the first
edit in order of letters that still fits the cost is the right one.

Conversations are cut into segments of 64 turns. Shorter ones are solved in
one row. Of longer ones each segment gives the costs between all states, which
are multiplied along the conversation; with the cost of the rest known at its
end, each segment is then traced from all states, and the pieces that meet are
kept. No task holds a conversation's turns or texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.digests import ordered_sha256
from tidemark.llm.storage import materialise
from tidemark.operators.ordering import positions

#: Turns of a segment, as a power of two: layers of a segment grow with its turns.
BITS = 6
SEGMENT = 1 << BITS
#: States: nothing yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn with this initial leads; None where it may not stand.
STEP = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "x": (None,) * 4}
#: Where a user or assistant that fits leads.
FIT = (USER, USER, ASSISTANT, USER)
#: Cost of what has to be inserted at the end.
END = (0, 10, 5, 0)
LETTERS = "suax"
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
SEPARATORS = " \t\n\x0b\x0c\r"


def _before(step: tuple) -> bytes:
    """For each set of states, those that a step leads into it."""
    return bytes(sum(1 << q for q in range(4) if step[q] is not None and states >> step[q] & 1) for states in range(16))


_KEEP = [_before(STEP[letter]) for letter in LETTERS]
_FIT = _before(FIT)


def cost_layers(codes: bytes, ends: tuple[int, ...], wanted: int) -> list[bytearray]:
    """Layers by cost until all ``wanted`` states (bits) are at the start. A
    code has the letter of a turn in two bits, whether its text is cut off in
    the next, and whether it has to go in the fourth; ``ends`` has the cost of
    what follows by state, -1 where there is no way."""
    n = len(codes)
    layers, none = [], bytes(n + 1)
    while not layers or layers[-1][0] & wanted != wanted:
        c = len(layers)
        one, two, five, six = (layers[c - w] if c >= w else none for w in (REROLE, DELETE, INSERT, REROLE + CUT_OFF))
        now = bytearray(n + 1)
        now[n] = sum(1 << q for q in range(4) if 0 <= ends[q] <= c)
        for i in range(n - 1, -1, -1):
            code = codes[i]
            states = two[i + 1] | _FIT[five[i]]
            if code < 4:
                states |= _KEEP[code][now[i + 1]] | _FIT[one[i + 1]]
            elif code < 8:
                states |= _KEEP[code - 4][five[i + 1]] | _FIT[six[i + 1]]
            now[i] = states
        layers.append(now)
    return layers


def trace(codes: bytes, layers: list[bytearray], state: int) -> tuple[list[str], int]:
    """The least edits of each turn from a state, and the state they lead to.
    D deletes, K keeps; u and a insert before the turn, U and A rerole it."""
    c = next(c for c, layer in enumerate(layers) if layer[0] >> state & 1)
    at = lambda cost, i, q: q is not None and cost >= 0 and layers[cost][i] >> q & 1
    edits = []
    for i, code in enumerate(codes):
        made, extra = "", CUT_OFF if code & 4 else 0
        while True:
            fit = FIT[state]
            letter = "u" if fit == USER else "a"
            if at(c - DELETE, i + 1, state):
                made, c = made + "D", c - DELETE
            elif at(c - INSERT, i, fit):
                made, c, state = made + letter, c - INSERT, fit
                continue
            elif code < 8 and at(c - extra, i + 1, STEP[LETTERS[code & 3]][state]):
                made, c, state = made + "K", c - extra, STEP[LETTERS[code & 3]][state]
            else:
                made, c, state = made + letter.upper(), c - extra - REROLE, fit
            break
        edits.append(made)
    return edits, state


_TAIL = ("", "ua", "a", "")
_SOLVED = "c string, seg long, entry int, exit int, cost long, edits array<string>"
_SOLVED_ARROW = pa.schema([("c", pa.string()), ("seg", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("edits", pa.list_(pa.string()))])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one segment, from start to end."""
    known: dict[bytes, tuple] = {}
    for batch in batches:
        out = []
        for c, codes in zip(batch["c"].to_pylist(), batch["codes"].to_pylist(), strict=True):
            codes = codes.encode().translate(_CODES)
            if len(known) > 10_000:
                known.clear()
            if codes not in known:
                layers = cost_layers(codes, END, 1 << START)
                edits, last = trace(codes, layers, START)
                known[codes] = (last, len(layers) - 1, [*edits, _TAIL[last]])
            last, cost, edits = known[codes]
            out.append((c, 0, START, last, cost, edits))
        yield pa.RecordBatch.from_pylist([dict(zip(_SOLVED_ARROW.names, row, strict=True)) for row in out], _SOLVED_ARROW)


_CODES = bytes((b - 97) % 16 for b in range(256))
_COSTS_ARROW = pa.schema([("c", pa.string()), ("seg", pa.int64()), ("costs", pa.list_(pa.int64()))])


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each segment the least cost from state to state, -1 for none. Nothing
    leads back to the start or to a system turn, so these two need no layers."""
    for batch in batches:
        out = []
        for c, seg, codes in zip(*[batch[x].to_pylist() for x in ("c", "seg", "codes")], strict=True):
            codes, costs = codes.encode().translate(_CODES), [-1] * 16
            gone = DELETE * len(codes)
            costs[5 * START] = costs[5 * SYSTEM] = gone
            if system := [CUT_OFF if code & 4 else 0 for code in codes if code < 8 and LETTERS[code & 3] == "s"]:
                costs[4 * START + SYSTEM] = gone - DELETE + min(system)
            for last in (USER, ASSISTANT):
                layers = cost_layers(codes, tuple(0 if q == last else -1 for q in range(4)), 15)
                for q in range(4):
                    costs[4 * q + last] = next(k for k, layer in enumerate(layers) if layer[0] >> q & 1)
            out.append({"c": c, "seg": seg, "costs": costs})
        yield pa.RecordBatch.from_pylist(out, _COSTS_ARROW)


def _rest(part: pd.DataFrame) -> pd.DataFrame:
    """The cost of what follows each segment of a conversation, by state."""
    part = part.sort_values("seg", ascending=False)
    after, out = list(END), []
    for c, seg, costs in zip(part.c, part.seg, part.costs, strict=True):
        out.append((c, seg, after))
        after = [min(costs[4 * q + r] + after[r] for r in range(4) if costs[4 * q + r] >= 0) for q in range(4)]
    return pd.DataFrame(out, columns=["c", "seg", "after"]).assign(total=after[START])


def _trace_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each segment from every state."""
    for batch in batches:
        out = []
        for c, seg, codes, after, total, final in zip(*[batch[x].to_pylist() for x in ("c", "seg", "codes", "after", "total", "final")], strict=True):
            codes, least = codes.encode().translate(_CODES), min(after)
            layers = cost_layers(codes, tuple(x - least for x in after), 15)
            for entry in range(4):
                edits, last = trace(codes, layers, entry)
                out.append((c, seg, entry, last, total, [*edits, _TAIL[last]] if final else edits))
        yield pa.RecordBatch.from_pylist([dict(zip(_SOLVED_ARROW.names, row, strict=True)) for row in out], _SOLVED_ARROW)


def _visited(part: pd.DataFrame) -> pd.DataFrame:
    """The state in which a conversation comes to each of its segments."""
    leads = dict(zip(zip(part.seg, part.entry, strict=True), part.exit, strict=True))
    state, out = START, []
    for seg in sorted(set(part.seg)):
        out.append((part.c.iloc[0], seg, state))
        state = leads[seg, state]
    return pd.DataFrame(out, columns=["c", "seg", "entry"])


def least_repairs(segments: DataFrame) -> DataFrame:
    """(c, seg, cost of the conversation, edits by turn) of segments (c, seg,
    codes); the last segment of a conversation has one string more, of what is
    inserted at its end."""
    # Little data and much work: as many tasks as the session asks for, whatever their bytes.
    segments = segments.select("c", "seg", "codes").repartition(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c", "seg")
    whole = (F.col("seg") == 0) & (F.length("codes") < SEGMENT)
    short = segments.filter(whole).select("c", "codes").mapInArrow(_solve, _SOLVED).select("c", "seg", "cost", "edits")
    long = segments.filter(~whole).select("c", "seg", "codes")
    costs = long.mapInArrow(_between, "c string, seg long, costs array<long>")
    after = costs.groupBy("c").applyInPandas(_rest, "c string, seg long, after array<long>, total long")
    final = F.col("seg") == F.max("seg").over(Window.partitionBy("c"))
    traced = materialise(long.join(after, ["c", "seg"]).withColumn("final", final).mapInArrow(_trace_all, _SOLVED))
    visited = traced.select("c", "seg", "entry", "exit").groupBy("c").applyInPandas(_visited, "c string, seg long, entry int")
    return short.unionByName(traced.join(visited, ["c", "seg", "entry"]).select("c", "seg", "cost", "edits"))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 deals to each
    row: it goes, or loses its text, its stops or its role, or comes twice.
    Null roles and texts are one space."""
    name = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"))
    dealt = rows.withColumn("dealt", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).filter("dealt <> 0")
    text = F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    dealt = dealt.select("conv_id", "turn", F.when(F.col("dealt") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("dealt") == 3).alias("twice"))
    return dealt.withColumn("copy", F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("twice", "copy")


def _digest() -> Column:
    return F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)


def repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports (c, gaps, blank, duplicate, truncated, illegal, cost, audit) and
    repaired turns (c, position, lines) of conversations.

    ``rows`` has conv_id, turn, role and text, without null roles and texts; c
    is conv_id as text, empty for null. Turns are taken by number (null first),
    then role, then digest of the text."""
    named = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    stripped = F.rtrim(F.col("text"), F.lit(SEPARATORS))
    slim = rows.select(named.alias("c"), "turn", "role", _digest().alias("digest"), (stripped == "").alias("blank"), F.right(stripped, F.lit(1)).isin(".", "!", "?").alias("ended"))
    slim = slim.withColumn("letter", F.substring("role", 1, 1))
    placed = positions(slim, ["turn", "role", "digest"], ("c",)).drop("role")
    placed = materialise(placed)
    firsts = placed.groupBy("c", "digest").agg(F.min("position").alias("first"))
    placed = placed.join(firsts, ["c", "digest"])
    again = F.col("position") > F.col("first")
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(~F.col("ended"), "truncated")
    letter = F.when(F.col("letter").isin("s", "u", "a"), F.instr(F.lit(LETTERS), F.col("letter")) - 1).otherwise(F.lit(3))
    code = letter + F.when(fault == "truncated", 4).when(fault.isNotNull(), 8).otherwise(0)
    coded = materialise(placed.select("c", "turn", "position", "digest", fault.alias("fault"), F.char(code + 97).alias("code")))
    count = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    stats = coded.groupBy("c").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), count("blank"), count("duplicate"), count("truncated"))
    seg = F.shiftright("position", BITS)
    segments = coded.groupBy("c", seg.alias("seg")).agg(F.sort_array(F.collect_list(F.struct("position", "code", "digest"))).alias("turns"))
    segments = segments.withColumn("codes", F.array_join("turns.code", ""))
    segments = materialise(segments.withColumn("before", F.lag(F.right("codes", F.lit(1))).over(Window.partitionBy("c").orderBy("seg"))))
    # Of neighbours: letters are two bits of each code.
    letters = F.translate(F.concat(F.coalesce("before", F.lit("")), F.col("codes")), "abcdefghijklmnop", LETTERS * 4)
    pairs = F.greatest(F.length(letters) - 1, F.lit(0))
    legal = sum((F.length(letters) - F.length(F.replace(letters, F.lit(p), F.lit(p[0])))) for p in ("su", "ua", "au"))
    solved = materialise(least_repairs(segments))
    illegal = segments.groupBy("c").agg(F.sum(pairs - legal).alias("illegal"))
    audit = F.translate(F.array_join("edits", ""), "uaUA", "IIRR")
    audits = solved.groupBy("c").agg(F.max("cost").alias("cost"), F.array_join(F.sort_array(F.collect_list(F.struct("seg", audit.alias("audit"))))["audit"], "").alias("audit"))
    report = stats.join(illegal, "c").join(audits, "c")
    edited = solved.join(segments.select("c", "seg", "turns.digest"), ["c", "seg"]).select("c", "seg", "digest", F.posexplode("edits").alias("i", "made"))
    edited = edited.select("c", (F.shiftleft("seg", BITS) + F.col("i")).alias("position"), "made", F.try_element_at("digest", F.col("i") + 1).alias("digest")).filter("made NOT IN ('D', '')")
    # A turn that stays is the first with its role and text, so these stand once on either side.
    texts = rows.select(named.alias("c"), _digest().alias("digest"), "role", "text").dropDuplicates(["c", "digest"])
    edited = edited.join(texts, ["c", "digest"], "left")
    spoken = lambda role: F.concat(role, F.lit(":"), F.col("text"))
    line = lambda x: F.when(x == "u", "user:").when(x == "a", "assistant:").when(x == "U", spoken(F.lit("user"))).when(x == "A", spoken(F.lit("assistant"))).otherwise(spoken(F.col("role")))
    lines = F.transform(F.filter(F.split("made", ""), lambda x: ~x.isin("D", "")), line)
    return report, edited.select("c", "position", F.array_join(lines, "\n").alias("lines"))


def repair_report(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``, damaged first: conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Needs conv_id, turn, role and text; further columns are ignored. Rows with
    a null conv_id are one conversation, null roles and texts are one space,
    null turns come first and make no gaps, turns that share a number are
    ordered by role and then by digest of the text. Repeated rows are
    duplicates. Conversations that lose all rows have zeros, no audit and the
    hash of an empty text; an empty table gives no rows.
    """
    report, repaired = repairs(damage(conversations))
    hashes = ordered_sha256(repaired.withColumnRenamed("lines", "piece"), ["c"], ["position"], "\n").withColumnRenamed("sha256", "repaired_sha256")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    out = ids.join(report, "c", "left").join(hashes, "c", "left").fillna(0, numbers).fillna("", ["audit"])
    return out.select("conv_id", *[F.col(c).cast("long").alias(c) for c in numbers], "audit", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
