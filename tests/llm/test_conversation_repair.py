import hashlib
import random
import zlib
from functools import cache

from tidemark.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, c string, position long"
SEPARATORS = " \t\n\x0b\x0c\r"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def cheapest(turns):
    """(cost, audit, lines): the least of all edits, with memory. At most three
    inserts in a row can help."""

    @cache
    def best(i, state, inserted=0):
        ways = [(0, "", ())] if i == len(turns) and state in (R.START, R.ASSISTANT) else []
        fit = R.FIT[state]
        name = "user" if fit == R.USER else "assistant"
        moves = [(5, "I", (f"{name}:",), i, fit, inserted + 1)] if inserted < 3 else []
        if i < len(turns):
            role, text, fault = turns[i]
            more = 5 if fault == "truncated" else 0
            moves.append((2, "D", (), i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                moves.append((1 + more, "R", (f"{name}:{text}",), i + 1, fit, 0))
                stays = R.STEP[role[:1] if role[:1] in ("s", "u", "a") else "x"][state]
                if stays is not None:
                    moves.append((more, "K", (f"{role}:{text}",), i + 1, stays, 0))
        for cost, letter, said, *to in moves:
            rest = best(*to)
            ways.append((cost + rest[0], letter + rest[1], said + rest[2]))
        return min(ways, default=(10**9, "", ()))

    for i in range(len(turns), 0, -1):  # so that calls do not nest deeply
        for state in range(4):
            best(i, state)
    return best(0, R.START)


def brute_force(rows):
    out = []
    sp = lambda x: " " if x is None else x
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text, *_ in (r for r in rows if r[0] == conv):
            role, text = sp(role), sp(text)
            v = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
            text = "" if v == 1 else "".join(x for x in text if x not in ".!?") if v == 2 else text
            turns += [(turn, "user" if v == 4 else role, text)] * (0 if v == 0 else 2 if v == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], digest(t[1], t[2])))
        seen, marked = set(), []
        for _, role, text in turns:
            end = text.rstrip(SEPARATORS)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else None if end[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        count = lambda kind, marked=marked: sum(f == kind for *_, f in marked)
        numbers = {t[0] for t in turns} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, lines = cheapest(tuple(marked))
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def sample_rows():
    r = random.Random(8)
    say = lambda: r.choice(["Yes.", "No!", "cut", "", None, " \t", "Why?\n", "ends. ", "long " * 9000 + "."])
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "umbrella"]
    rows = [(c, t, r.choice(roles), say(), "x", 1) for c in range(150) for t in range(r.randrange(1, 10))]
    rows += [(c, t, ("user", "assistant")[t % 2], f"Turn {t}{r.choice('.!?,')}", "x", 1) for c in range(200, 260) for t in range(r.randrange(1, 9))]
    rows += [(3, None, "user", "No turn.", "x", 1), (4, 2, "user", "Tied.", "x", 1), (4, 2, "assistant", "Tied.", "x", 1), (None, 1, "user", "Nobody.", "x", 1), (None, 2, "assistant", "Nobody?", "x", 1)]
    return rows + rows[:20]


def test_against_brute_force(spark, same):
    rows = sample_rows()
    same([tuple(r) for r in R.repair_report(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()], brute_force(rows))


def test_long_conversations(spark, same):
    """Segments that meet in every state, of one turn and of just as many as they may have; some without system turns."""
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "user", "assistant", "assistant", "system"][: 5 if c < 9 else 4]), f"Turn {t % 300}{r.choice('..!,')}", "x", 1) for c, n in ((1, 900), (2, 256), (5, 64), (7, 281), (9, 513), (11, 65), (12, 90)) for t in range(n)]
    same([tuple(x) for x in R.repair_report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()], brute_force(rows))


def test_whole_table_and_empty(spark, sf_dir, same):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    same([tuple(r) for r in R.repair_report(table).collect()], brute_force([tuple(r) for r in table.collect()]))
    assert R.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
