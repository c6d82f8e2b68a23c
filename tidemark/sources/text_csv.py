"""CSV files of unknown encoding, read by ranges of bytes.

Spark cuts files at line breaks, in any store. Of each range a first pass takes
what it does to a reader that comes to it outside or inside of quotes: how it
leaves, how many records start, and which encodings read all its bytes. These
are put together along each file, so that a second pass knows for every range
how it is entered, the number of its first record and the file's encoding.
Records that reach over a border are joined from their pieces.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

_RANGE = ["path", "start", "length"]
#: Fixed value: what a file in UTF-8 may start with.
_MARK = b"\xef\xbb\xbf"


def leaves_quoted(line: bytes, quoted: bool) -> bool:
    """Whether a reader is inside of quotes after the line; quotes open only at
    the start of a field, and two of them inside are one."""
    at = len(_MARK) if line.startswith(_MARK) else 0
    while True:
        if not quoted:
            if line[at : at + 1] == b'"':
                quoted, at = True, at + 1
                continue
        else:
            end = line.find(b'"', at)
            if end < 0:
                return True
            if line[end + 1 : end + 2] == b'"':
                at = end + 2
                continue
            quoted, at = False, end + 1
        comma = line.find(b",", at)
        if comma < 0:
            return False
        at = comma + 1


def parsed(raw: bytes, encoding: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(raw.decode(encoding.removesuffix("-sig")).removeprefix("\ufeff"), newline="")))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes]]]:
    """(columns of the range, lines), range after range, as they come."""
    for batch in batches:
        columns = {c: batch[c].to_pylist() for c in batch.schema.names}
        lines, first = columns.pop("line"), 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or any(columns[c][i] != columns[c][first] for c in _RANGE):
                yield {c: v[first] for c, v in columns.items()}, lines[first:i]
                first = i


_SCANNED = "path string, start long, length long, out_plain boolean, out_quoted boolean, n_plain long, n_quoted long, reads array<boolean>, head binary, head_at long"


def _scan(batches: Iterator[pa.RecordBatch], encodings: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("out_plain", pa.bool_()), ("out_quoted", pa.bool_()), ("n_plain", pa.int64()), ("n_quoted", pa.int64()), ("reads", pa.list_(pa.bool_())), ("head", pa.binary()), ("head_at", pa.int64())])
    now, row, open_head = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([row | {"out_plain": row["states"][0], "out_quoted": row["states"][1]}], schema)

    for place, lines in _in_order(batches):
        if place != now:
            if row:
                yield done()
            now, open_head = place, None
            row = place | {"states": [False, True], "n_plain": 0, "n_quoted": 0, "reads": [True] * len(encodings), "head": None, "head_at": None}
        block = b"\n".join(lines)
        for i, encoding in enumerate(encodings):
            if row["reads"][i]:
                try:
                    block.decode(encoding)
                except UnicodeDecodeError:
                    row["reads"][i] = False
        for line in lines:
            for i, name in enumerate(("n_plain", "n_quoted")):
                if not row["states"][i]:
                    row[name] += 1
            if place["start"] == 0 and row["head"] is None:
                # The first record that is not an empty line, as from the start of the file.
                open_head = line if not row["states"][0] else open_head + b"\n" + line
                if not leaves_quoted(line, row["states"][0]) and open_head.strip(b"\r"):
                    row["head"], row["head_at"] = open_head, row["n_plain"] - 1
            row["states"] = [leaves_quoted(line, s) if b'"' in line else s for s in row["states"]]
    if row:
        yield done()


def _entered(encodings: tuple[str, ...]):
    """How each range of a file is entered."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("start", ignore_index=True)
        good = [e for i, e in enumerate(encodings) if all(reads[i] for reads in part["reads"])]
        if not good:
            raise ValueError(f"{part['path'][0]} is in none of {', '.join(encodings)}")
        quoted, record, out = False, 0, []
        for r in part.itertuples():
            out.append((quoted, record))
            quoted, record = (r.out_quoted, record + r.n_quoted) if quoted else (r.out_plain, record + r.n_plain)
        head = part["head"][0]
        if head is None and record and len(part) > 1:
            raise ValueError(f"{part['path'][0]} has no header in its first range")
        names = next((f for f in parsed(bytes(head), good[0]) if f), []) if head is not None else []
        frame = part[_RANGE].assign(quoted=[q for q, _ in out], record=[n for _, n in out], encoding=good[0])
        return frame.assign(head_at=-1 if head is None else int(part["head_at"][0]), names=[names] * len(part))

    return run


_PIECE = "path string, record long, part long, raw binary, fields array<string>, encoding string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that lie within a range, read; and pieces of others (raw)."""
    schema = pa.schema([("path", pa.string()), ("record", pa.int64()), ("part", pa.int64()), ("raw", pa.binary()), ("fields", pa.list_(pa.string())), ("encoding", pa.string())])
    now, rows = None, []
    held: list[bytes] = []
    whole, quoted, record = True, False, 0

    def out(complete: bool) -> None:
        raw, one = b"\n".join(held), {"path": now["path"], "part": now["start"], "encoding": now["encoding"], "record": record}
        if complete and whole:
            rows.extend(one | {"raw": None, "fields": fields} for fields in parsed(raw, now["encoding"]))
        else:
            rows.append(one | {"raw": raw, "fields": None})
        held.clear()

    for place, lines in _in_order(batches):
        if place != now:
            if held:
                out(False)
            now, quoted, record = place, place["quoted"], place["record"] - 1
            if quoted is None:
                raise RuntimeError(f"the ranges of {place['path']} have changed while it was read")
            whole = not quoted
        for line in lines:
            if not quoted:
                record, whole = record + 1, True
            held.append(line)
            quoted = leaves_quoted(line, quoted) if b'"' in line else quoted
            if not quoted:
                out(True)
        if len(rows) >= 10_000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if held:
        out(False)
    yield pa.RecordBatch.from_pylist(rows, schema)


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(path, record, fields) for path, record, raw, encoding in zip(frame["path"], frame["record"], frame["raw"], frame["encoding"], strict=True) for fields in parsed(bytes(raw), encoding)]
        yield pd.DataFrame(rows, columns=["path", "record", "fields"])


def csv_records(spark: SparkSession, paths: list[str], encodings: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(path, record, fields) of all records of the files, numbered from 0 and
    empty lines included; and (path, head_at, names): each file's header, which
    is its first record that is not empty and lies in its first range."""
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"), F.col("value").cast("binary").alias("line"))
    scanned = lines.mapInArrow(partial(_scan, encodings=tuple(encodings)), _SCANNED)
    entered = written(scanned.groupBy("path").applyInPandas(_entered(tuple(encodings)), "path string, start long, length long, quoted boolean, record long, encoding string, head_at long, names array<string>"), "ranges")
    # One row for each range, of 128 MB as Spark is set by itself: the lines keep their order.
    found = lines.join(F.broadcast(entered.drop("head_at", "names")), _RANGE, "left").select(*_RANGE, "quoted", "record", "encoding", "line").mapInArrow(_pieces, _PIECE)
    records = found.filter("raw IS NULL").select("path", "record", "fields")
    if not entered.filter("quoted").isEmpty():
        cut = found.filter("raw IS NOT NULL").groupBy("path", "record", "encoding").agg(F.sort_array(F.collect_list(F.struct("part", "raw"))).alias("parts"))
        joined = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0]["raw"], lambda a, x: F.concat(a, F.lit(b"\n"), x["raw"]))
        records = records.unionByName(cut.select("path", "record", joined.alias("raw"), "encoding").mapInPandas(_joined, "path string, record long, fields array<string>"))
    return records, entered.filter("start = 0").select("path", "head_at", "names")
