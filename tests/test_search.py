import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lacewing.operators import matching, search

SCHEMA = "vec_id long, label int, embedding array<float>"


def clustered(rng, n, dim):
    centre = rng.normal(size=(n // 20, dim)) * 3
    return (centre[rng.integers(0, len(centre), n)] + rng.normal(size=(n, dim))).astype(np.float32)


def tables(spark, x, labels=5):
    rows = [(i, i % labels, [float(v) for v in e]) for i, e in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.where("vec_id % 50 = 0"), df


def brute(x, k, labels=5):
    x = x.astype(float)
    out = {}
    for q in range(0, len(x), 50):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        out[q] = [(int(i), float(far[i])) for i in np.lexsort((np.arange(len(x)), far)) if i != q]
    return out


@pytest.mark.parametrize("piece, part", [(8192, 2048), (37, 3)])
def test_exact_over_any_pieces(spark, monkeypatch, piece, part):
    monkeypatch.setattr(search, "PIECE", piece)
    monkeypatch.setattr(search, "SLICE", part)
    x = clustered(np.random.default_rng(1), 600, 12)
    x[100:140] = x[50]  # ties: forty equal vectors, one of them a query
    queries, own = tables(spark, x)
    want = brute(x, 8)
    got = search.nearest(queries, own, 8).orderBy("query", "place").collect()
    assert [(r.query, r.vec_id) for r in got] == [(q, i) for q in sorted(want) for i, _ in want[q][:8]]
    assert all(abs(r.distance - dict(want[r.query])[r.vec_id]) < 1e-9 and r.label == r.vec_id % 5 and r.query_label == r.query % 5 for r in got)
    least = {}
    for q, near in want.items():
        for i, d in near:
            least.setdefault(q, {}).setdefault(i % 5, d)
    two = {}
    for r in search.nearest_labels(queries, own).collect():
        two.setdefault(r.query, []).append((r.distance, r.label))
    assert all([(pytest.approx(d), c) for d, c in sorted(v)[:2]] == sorted((d, c) for c, d in least[q].items())[:2] for q, v in two.items()) and len(two) == 12
    votes = {r.query: (r.label, r.distinctive) for r in matching.ratio_votes(search.nearest_labels(queries, own), 0.95).collect()}
    for q, v in least.items():
        (d1, c1), (d2, _) = sorted((d, c) for c, d in v.items())[:2]
        assert votes[q] == (c1, d1 < 0.95 * d2)


def test_cells_hold_the_neighbours(spark, monkeypatch):
    monkeypatch.setattr(search, "PIECE", 200)
    x = clustered(np.random.default_rng(2), 4000, 16)
    queries, own = tables(spark, x)
    found, probes, held = search.nearest_in_cells(queries, own, 8)
    want = brute(x, 8)
    truth = {(q, i) for q, v in want.items() for i, _ in v[:8]}
    got = {(r.query, r.vec_id): r.distance for r in found.collect()}
    assert len(truth & set(got)) >= 0.95 * len(truth) and held >= 0.97
    assert 1 <= probes < 20  # of 63 cells
    assert all(abs(d - dict(want[q])[i]) < 1e-9 for (q, i), d in got.items())


def test_all_cells_are_searched_where_vectors_have_no_shape(spark):
    x = np.random.default_rng(3).normal(size=(500, 64)).astype(np.float32)
    queries, own = tables(spark, x)
    found, probes, _ = search.nearest_in_cells(queries, own, 8, recall=1.0)
    want = brute(x, 8)
    assert {(r.query, r.vec_id) for r in found.collect()} == {(q, i) for q, v in want.items() for i, _ in v[:8]} and probes > 10


def test_few_vectors(spark):
    queries, own = tables(spark, clustered(np.random.default_rng(4), 60, 4)[:3])
    assert sorted((r.query, r.vec_id) for r in search.nearest(queries, own, 8).collect()) == [(0, 1), (0, 2)]
    assert search.nearest_in_cells(queries, own, 8)[0].count() == 2
    for q, v in ((queries, own.limit(0)), (queries.limit(0), own)):
        assert search.nearest(q, v, 3).count() == 0 == search.nearest_in_cells(q, v, 3)[0].count() and search.nearest_labels(q, v).count() == 0


def test_cells_are_given_in_batches_of_a_bounded_size():
    """A batch of vectors with all its cells was one batch, and so were the distances of a fit's sample to all centres."""
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(3000, 16)).astype(np.float32), rng.normal(size=(300, 16))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(list(x), pa.list_(pa.float32()))], names=["vec_id", "embedding"])
    rows, most = 0, 0
    for b in search.cell_rows(iter([batch.slice(0, 1700), batch.slice(1700)]), 1, c, 300, 1 << 20):
        rows, most = rows + b.num_rows, max(most, b.nbytes)
        if b.column(0)[0].as_py() == 0:
            far = ((x[0].astype(float) - c) ** 2).sum(1)
            assert b.column(2).to_pylist()[:300] == np.argsort(far).tolist() and b.column(3).to_pylist()[:300] == list(range(1, 301))
    assert rows == 3000 * 300 and most < 2 << 20
    sample = pa.RecordBatch.from_arrays([pa.array(rng.permutation(20000)), pa.array(list(rng.normal(size=(20000, 8))), pa.list_(pa.float64()))], names=["nth", "embedding"])
    tracemalloc.start()
    (fit,) = search._fitted(iter([sample]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert fit.num_rows == 625 and peak < 150 << 20
