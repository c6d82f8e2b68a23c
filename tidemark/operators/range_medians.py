"""Exact medians over ranges of days, of groups too large for a task.

Values of a group are put into buckets by their rank, which is counted over
ranges of values and not within one task. Rows are counted by day and bucket:
from these counts follows, for each day that asks and each window, which bucket
holds the middle values and which places they have there. Then each bucket is
searched by itself. A day asks once, however many rows it has, so the counts
are at most days times buckets; a bucket has about ``BUCKET`` rows, counted by
day and value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import counted_before, joined_by
from tidemark.sources.scratch import written

#: Rows of a bucket about, and buckets of a group at most.
BUCKET, BUCKETS = 32_768, 4096

_PLACES = "group long, slice int, day int, days int, count long, side int, bucket int, place long"


def _locate(windows: list[int]):
    def run(asks: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        """For each day and window how many values there are, and where the two
        middle ones are (one and the same of an odd number)."""
        out = []
        if len(asks):
            days, at = np.unique(counts["day"].to_numpy(), return_inverse=True)
            buckets, column = np.unique(counts["bucket"].to_numpy(), return_inverse=True)
            table = np.zeros((len(days) + 1, len(buckets)), np.int64)
            np.add.at(table, (at + 1, column), counts["n"].to_numpy())
            table = table.cumsum(axis=0)
            group, part = int(asks["group"].iloc[0]), int(asks["slice"].iloc[0])
            for n in windows:
                for day in asks["day"]:
                    inside = table[np.searchsorted(days, day)] - table[np.searchsorted(days, day - n)]
                    upto, total = inside.cumsum(), int(inside.sum())
                    for side in (0, 1) if total else ():
                        rank = (total - 1 + side) // 2
                        b = int(np.searchsorted(upto, rank, side="right"))
                        out.append((group, part, day, n, total, side, int(buckets[b]), rank - int(upto[b] - inside[b])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PLACES.split(", ")])

    return run


def _search(places: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    """The values at the places of one bucket."""
    cells = cells.sort_values("v", kind="stable")
    days, values, n = (cells[c].to_numpy() for c in ("day", "v", "n"))
    found = np.empty(len(places))
    for i, (day, window, place) in enumerate(zip(places["day"], places["days"], places["place"], strict=True)):
        upto = np.where((days >= day - window) & (days < day), n, 0).cumsum()
        found[i] = values[np.searchsorted(upto, place, side="right")]
    return places[["group", "day", "days", "count"]].assign(v=found)


def range_medians(rows: DataFrame, windows: list[int], width: int) -> DataFrame:
    """(_g, _day, days, count, median) of ``rows`` (_g, _day, _v): for each day
    of a group and each of the windows the finite values of the days before it;
    no row where there are none."""
    ids = written(rows.select("_g").distinct().withColumn("group", F.monotonically_increasing_id()), "groups")
    named = joined_by(rows, ids, ["_g"], "inner").select("group", F.col("_day").alias("day"), F.col("_v").alias("v"))
    good = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf"))
    counts = written(named.groupBy("group", "day", "v").agg(F.count("*").alias("n")), "counts")
    ranks = counted_before(counts.filter(good), ["group"], "v", "n")
    number = F.least(F.ceil(F.col("total") / BUCKET), F.lit(BUCKETS))
    buckets = ranks.select("group", "v", F.floor(F.col("before") * number / F.col("total")).cast("int").alias("bucket"))
    slices = F.explode(F.array(F.floor(F.col("day") / width).cast("int"), F.floor(F.col("day") / width).cast("int") + 1)).alias("slice")
    cells = written(counts.join(buckets, ["group", "v"]).select("group", "day", "v", "n", "bucket"), "cells")
    asks = counts.select("group", "day").distinct().withColumn("slice", F.floor(F.col("day") / width).cast("int"))
    by_day = cells.groupBy("group", "day", "bucket").agg(F.sum("n").alias("n")).select("*", slices)
    places = written(asks.groupBy("group", "slice").cogroup(by_day.groupBy("group", "slice")).applyInPandas(_locate(windows), _PLACES), "places")
    asked = places.groupBy("group", "slice", "bucket")
    # Only buckets in which there is something to look up.
    there = cells.select("group", "day", "v", "n", "bucket", slices).join(places.select("group", "slice", "bucket").distinct(), ["group", "slice", "bucket"])
    found = asked.cogroup(there.groupBy("group", "slice", "bucket")).applyInPandas(_search, "group long, day int, days int, count long, v double")
    out = found.groupBy("group", "day", "days").agg(F.max("count").alias("count"), F.avg("v").alias("median"))
    return out.join(ids, "group").select("_g", F.col("day").alias("_day"), "days", "count", "median")
