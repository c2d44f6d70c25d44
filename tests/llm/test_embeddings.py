import math

import numpy as np
import pytest

from lacewing.llm import embeddings as e


def clustered(rng, n, dim=32):
    base = rng.normal(size=(n // 4, dim))
    x = np.concatenate([base, *[base + rng.normal(size=base.shape) * s for s in (0.1, 0.25, 0.4)]])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_graph_recall():
    x = clustered(np.random.default_rng(1), 3000)
    g = e.Graph.build(x)
    truth = set(map(tuple, np.argwhere(x @ x.T >= 0.93).tolist()))
    r, c, beam = g.audited(g.x, np.float32(0.93))
    assert beam < 500
    found = set(zip(r.tolist(), c.tolist()))
    assert len(found & truth) >= 0.99 * len(truth)


def test_large_balls_widen_the_beam():
    rng = np.random.default_rng(2)
    x = rng.normal(size=16) + rng.normal(size=(900, 16)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r, *_ = e.Graph.build(x).audited(x.astype(np.float32), np.float32(0.9))
    assert len(r) >= 0.99 * 900 * 900


@pytest.mark.parametrize("shard", [8192, 60])
def test_against_brute_force(spark, shard):
    rng = np.random.default_rng(3)
    x = clustered(rng, 240, 24).astype(np.float32)
    rows = [(i * 3, [float(v) for v in x[i]], int(i % 3 == 0), "clash") for i in range(len(x))]
    rows += [(5000 + i, rows[4][1], rows[4][2], "") for i in range(5)] + [(6000, [2 * v for v in rows[8][1]], rows[8][2], "")]
    bad = [(7000, None, 1, ""), (7001, [0.0] * 24, 1, ""), (7002, [math.nan] + [1.0] * 23, 1, ""), (7003, [None] + [1.0] * 23, 1, ""), (7004, [math.inf] * 24, 1, ""), (7005, rows[0][1], None, ""), (7006, [1.0], 1, ""), (7007, [], 1, "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int, rep string")
    good = [(i, np.array(v, np.float32).astype(float), k) for i, v, k, _ in rows]
    unit = np.stack([v / np.linalg.norm(v) for _, v, _ in good])
    near = (unit @ unit.T >= 0.93) & np.equal.outer([k for *_, k in good], [k for *_, k in good])
    label = np.array([i for i, *_ in good])
    for _ in range(50):
        label = np.array([label[near[j]].min() for j in range(len(good))])
    want = {(i, int(near[j].sum()) - 1, int(label[j]), i == label[j]) for j, (i, *_) in enumerate(good)} | {(i, 0, i, True) for i, *_ in bad}
    got = {tuple(r) for r in e.near_duplicates(df, shard=shard).collect()}
    assert got == want
    assert e.near_duplicates(df.limit(0)).count() == 0


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_rare_links_are_found_by_the_graph_alone():
    rng = np.random.default_rng(12)
    x, q = unit(rng.normal(size=(2000, 64))), unit(rng.normal(size=(2000, 64)))
    x[100] = x[1500]
    q[[5, 700, 1333]] = x[[9, 40, 1999]]
    g = e.Graph.build(x)
    asked, near = [], g.near
    g.near = lambda q, least, beam, own=None: asked.append((len(q), beam)) or near(q, least, beam, own)
    r, c, beam = g.audited(q, np.float32(0.93))
    assert set(zip(r.tolist(), c.tolist())) == {(5, 9), (700, 40), (1333, 1999)}
    assert asked[-1] == (2000, beam) and beam < 2000  # all queries go to the graph, within a beam
    u, v, _ = g.audited(x, np.float32(0.93), np.arange(2000, dtype=np.int32))
    assert {(100, 1500), (1500, 100)} == {p for p in zip(u.tolist(), v.tolist()) if p[0] != p[1]}
    for layer in g.layers:
        layer[:] = -1  # a graph that finds nothing answers nothing
    for own in (None, np.arange(2000, dtype=np.int32)):
        with pytest.raises(RuntimeError, match="links of its sample"):
            g.audited(x, np.float32(0.93), own)


def test_every_node_can_be_met():
    rng = np.random.default_rng(5)
    islands = unit(np.repeat(rng.normal(size=(40, 48)), 60, axis=0) + rng.normal(size=(2400, 48)) * 0.02)
    g = e.Graph.build(islands[rng.permutation(2400)])
    met, edge = {0}, {0}
    while edge:
        edge = {int(j) for i in edge for j in g.layers[0][i] if j >= 0} - met
        met |= edge
    assert len(met) == 2400
    r, c, beam = g.audited(g.x, np.float32(0.93), np.arange(2400, dtype=np.int32))
    assert len(r) >= 0.995 * int((g.x @ g.x.T >= 0.93).sum())


def test_recall_within_and_across_shards(spark):
    """20,000 vectors of a label in three shards, with chains and pairs planted at random: what the graphs alone find of all links."""
    rng = np.random.default_rng(7)
    x = unit(rng.normal(size=(18_500, 32)))
    bits = np.repeat(x[rng.permutation(18_500)[:500]], 3, axis=0)
    x = np.concatenate([x, unit(bits + rng.normal(size=bits.shape) * rng.uniform(0.005, 0.07, (1500, 1)))])[rng.permutation(20_000)]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in e.near_duplicates(df).select("vec_id", "n_links").collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(y[lo : lo + 2000] @ y.T >= 0.93).sum(1) - 1 for lo in range(0, 20_000, 2000)])
    assert want.sum() > 2000 and all(got[i] <= want[i] for i in range(20_000))
    assert sum(got.values()) >= 0.99 * want.sum()


def test_query_against_sql(spark, tmp_path):
    """The given vectors and perturbed copies of them, so that the SQL has links to find."""
    import duckdb

    rng = np.random.default_rng(9)
    base = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows = base + [(10_000 + 10 * i + k, [float(v) for v in np.float32(np.array(e_) * (1 + rng.normal(size=len(e_)) * s))], label) for i, e_, label in base for k, s in enumerate((0.0, 0.1, 0.3))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = duckdb.sql(e.ORACLE.replace("from embeddings", f"from '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, e.op6_embeddings(spark, str(tmp_path)).collect())) == sorted(want) and sum(r[1] for r in want) > 100
