import numpy as np
import pytest

from tidemark.llm.metric_join import Near, keep_one_per_group, near_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, n long, cid long, v string"


def brute_force(rows, at_least):
    ok = [i for i, (_, v, *_) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links, label = np.zeros(len(rows), int), list(range(len(rows)))
    for size in {len(rows[i][1]) for i in ok}:
        at = np.array([i for i in ok if len(rows[i][1]) == size])
        x = np.array([rows[i][1] for i in at], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        hits = x @ x.T >= at_least
        np.fill_diagonal(hits, False)
        links[at] = hits.sum(axis=1)
        for i, j in zip(*np.nonzero(hits), strict=True):
            a, b = label[at[i]], label[at[j]]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for i, k in enumerate(label):
        if rows[i][0] is not None:
            least[k] = min(least.get(k, rows[i][0]), rows[i][0])
    return [(rows[i][0], int(links[i]), least.get(label[i]), rows[i][0] == least.get(label[i])) for i in range(len(rows))]


def sample_rows():
    """A dense cluster, one at the edge of the angle, a chain, copies, scaled copies, odd rows."""
    r = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x)
    centre, other = unit(r.normal(size=16)), unit(r.normal(size=16))
    vectors = [centre + 0.02 * r.normal(size=16) for _ in range(300)]
    vectors += [other + 0.1 * r.normal(size=16) for _ in range(150)]
    vectors += [unit(np.eye(16)[0] * np.cos(t / 3) + np.eye(16)[1] * np.sin(t / 3)) for t in range(12)]
    vectors += [r.normal(size=16) for _ in range(120)]
    vectors += [vectors[5]] * 20 + [vectors[500] * 7] * 3 + [vectors[480]] * 4
    rows = [(1000 - i, [float(x) for x in v], 0, 1, 2, "v") for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 16, [None, *[1.0] * 15], [float("nan")] * 16, [float("inf"), *[1.0] * 15], [1e300] * 16, [1e-300] * 16, [1.0] * 16, [1.0, 2.0], [2.0, 4.0], [-1.0, -2.0]]
    rows += [(2000 + i, v, None, 1, 2, "v") for i, v in enumerate(odd)]
    rows += [(None, [5.0, 0.0, 1.0], 1, 1, 1, "v"), (None, [5.0, 0.0, 1.1], 1, 1, 1, "v"), (None, [1.0, 2.1], 1, 1, 1, "v")]
    return rows + rows[:3]


@pytest.mark.parametrize("rule", [Near(), Near(sample=64, dense=3, block=50), Near(at_least=0.7, block=64), Near(dense=10_000, block=33)])
def test_against_brute_force(spark, same, rule):
    rows = sample_rows()
    big = [i for i, r in enumerate(rows) if r[1] and r[1][0] in (1e300, 1e-300)]
    expected = brute_force([(a, [x / 1e300 if x == 1e300 else x * 1e300 if x == 1e-300 else x for x in v] if i in big else v, *rest) for i, (a, v, *rest) in enumerate(rows)], rule.at_least)
    same([tuple(r) for r in near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), rule).collect()], [(a, n, c, k) for a, n, c, k in expected])


def test_rows_sent_do_not_grow_as_pairs(spark):
    """A ball of near copies leaves one row each, and nothing of it is compared."""
    from tidemark.llm import metric_join as M

    r = np.random.default_rng(1)
    for n in (400, 1600):
        rows = [(i, [float(x) for x in np.eye(8)[0] + 0.005 * r.normal(size=8)], 0, 1, 1, "") for i in range(n)]
        units = M.unit_vectors(np.array([v for _, v, *_ in rows]))
        pivots = M.choose_pivots(units.tolist(), n, Near())
        assert len(pivots[8].balls) == 1
        found = near_vectors(spark.createDataFrame(rows, SCHEMA))
        assert found.filter(f"n_links = {n - 1} AND component_id = 0").count() == n


def test_whole_table_and_empty(spark, sf_dir, same):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in table.collect()]
    same([tuple(r) for r in near_vectors(table).collect()], brute_force(rows, 0.9))
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.vec_id for r in keep_one_per_group(table).collect()} == {r[0] for r in brute_force(rows, 0.9) if r[3]}


def test_sql(spark, same):
    """The SQL beside the query, on clusters, odd vectors and copies."""
    import duckdb
    import pyarrow as pa

    from tidemark.llm.queries import ORACLES

    rows = [r[:2] for r in sample_rows() if r[0] is not None and not (r[1] and r[1][0] in (1e300, 1e-300))][:-3]
    db = duckdb.connect()
    db.register("embeddings", pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))}))
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    same([tuple(r) for r in found.collect()], db.sql(ORACLES["op13_embedding_near_dedup"]).select("vec_id, n_links, component_id, kept").fetchall())
