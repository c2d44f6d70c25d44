import random

from lacewing.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def level(sizes):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s] + 1e-9]
        if not over:
            return capped | {s: left * weight[s] / w for s in free}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_copies(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        source = rng.choice(["a", "b", "é", "Z", None, "hot", "hot", "hot", "hot", "tiny"])
        if source == "tiny" and rng.random() < 0.8:
            source = "hot"
        rows.append((i, " ".join(["w"] * rng.randint(0, 60)) + " \t", source, "clash"))
    rows += [(900, None, "empty", None), (901, "", "empty", None), (None, "x y", "a", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixing_plan(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    want = level(sizes)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate) <= r.n_copies <= min(3, int(rate) + 1)
    taken = sum(r.size * r.n_copies for r in got if r.source == "hot")
    assert abs(taken / want["hot"] - 1) < 0.2
    out = mixing.mix(df)
    assert out.count() == sum(r.n_copies for r in got)
    assert mixing.mixing_plan(df.limit(0)).count() == 0


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1, 2, 3), (2, None, None, 1, 2, 3)], "doc_id long, text string, source string, `_source` int, own_source int, `a.b` int")
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "copy"] and {(r["_source"], r["own_source"], r["a.b"]) for r in out.collect()} <= {(1, 2, 3)}


def test_rows_without_id_draw_apart(spark):
    df = spark.createDataFrame([(None, f"text {i}", "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    taken = [r.n_copies for r in mixing.mixing_plan(df).where("source = 'a'").collect()]
    assert len(set(taken)) == 2
