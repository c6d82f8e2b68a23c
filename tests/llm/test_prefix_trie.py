import hashlib
import math
import random
import re
import zlib

import pytest

from tidemark.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, k1 string"


def turn_key(row):
    role, text = row[2] or "", row[3] or ""
    return (row[1] is not None, row[1] or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest())


def brute_force(rows):
    convs = {}
    for row in sorted((r for r in rows if r[0] is not None), key=turn_key):
        convs.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    members, ends = {}, {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = (*convs.get(c - int(math.fmod(c, 20)), [])[:h], *turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out, below = [], {}
    for path in sorted(members, key=len, reverse=True):
        kids, n = children.get(path, []), len(members[path])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        below[path] = (sum(below[k][0] for k in kids) or 1, (n - 1) * words + sum(below[k][1] for k in kids))
        ids = ",".join(map(str, sorted(ends.get(path, []))))
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, n, len(kids), *below[path], hashlib.sha256(ids.encode()).hexdigest()))
    return out


def sample_rows():
    r = random.Random(3)
    say = lambda: r.choice(["hi there", "Hi there", "", None, "what is it?", "a  b\nc", "x" * 30_000])
    rows = [(c, t, r.choice(["user", "assistant", None]), say(), 1, "k") for c in range(90) if c not in (40, 61) for t in range(r.randrange(1, 7))]
    rows += [(c, t, "user", "same", 1, "k") for c in range(200, 330) for t in range(5)]  # a third are copies
    rows += [(500, t, "user", f"turn {t}", 1, "k") for t in range(5000)]  # one long conversation
    rows += [(c, t, "user", f"turn {t}", 1, "k") for c in (501, 502) for t in range(60)]
    rows += [(7, None, "user", "no turn", 1, "k"), (7, 2, "user", "tied", 1, "k"), (7, 2, "assistant", "tied", 1, "k"), (None, 1, "user", "nobody", 1, "k"), (-3, 1, "user", "below", 1, "k")]
    return rows + rows[:9]


@pytest.mark.parametrize("most_nodes", [20_000, 64])
def test_against_brute_force(spark, same, most_nodes):
    rows = sample_rows() if most_nodes > 64 else [r for r in sample_rows() if r[1] is None or r[1] < 90]
    found = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), most_nodes)
    same([tuple(r) for r in found.collect()], brute_force(rows))


def test_whole_table(spark, sf_dir, same):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    same([tuple(r) for r in prefix_trie(table).collect()], brute_force([tuple(r) for r in table.collect()]))


def test_empty_and_turnless(spark, same):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    turnless = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    lone = [(turnless, 0, "user", "dropped", 1, "k")]  # its opening comes from an absent conversation
    same([tuple(r) for r in prefix_trie(spark.createDataFrame(lone, SCHEMA)).collect()], brute_force(lone))
