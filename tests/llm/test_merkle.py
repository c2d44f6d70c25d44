import hashlib
import random
import zlib

from lacewing.llm import merkle
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return h("".join(map(written, row)))


def lowered(row):
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 3 or row[4] is None:
        return row
    return (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))


def climb(digests, changed):
    """The root of a run of digests, and of each leaf the siblings and the root that `changed` makes in its place."""
    beside, folded, at, level = [""] * len(digests), list(changed), list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for i, k in enumerate(at):
            run, slot = runs[k // 8], k % 8
            beside[i] += "".join(run[:slot] + run[slot + 1 :])
            folded[i] = h("".join(run[:slot] + [folded[i]] + run[slot + 1 :]))
        at, level = [k // 8 for k in at], [h("".join(r)) for r in runs]
    return level[0], beside, folded


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    low = {g: climb([leaf(r) for r in own], [leaf(lowered(r)) for r in own]) for g, own in groups.items()}
    out, tops = [], [low[g][0] for g in langs]
    for k, g in enumerate(langs):
        for r, beside, folded in zip(groups[g], low[g][1], low[g][2], strict=True):
            root, more, last = climb(tops, [folded if i == k else t for i, t in enumerate(tops)])
            out.append((r[0], leaf(r), low[g][0], root, h(beside + more[k]), last[k], last[k] == root))
    return sorted(out, key=repr)


def of(spark, rows, tmp_path, name="t"):
    folder = f"{tmp_path}/{name}"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, merkle.op11_merkle(spark, folder).collect()), key=repr)


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "é", None]), rng.choice(["hot"] * 6 + ["de", "é", "Z", None]), rng.choice([None, 7]), rng.choice([None, "", "ABC é\n" * rng.randint(0, 9), f"Text {i}"])) for i in range(700)]
    rows += [(5000, "x", "lone", 1, "Long " * 60_000), (None, None, None, None, None), (None, None, None, None, None)]
    rows += [(3, "again", "hot", 1, "T"), (3, "again", "hot", 1, "T"), (3, "again", "hot", 2, "t"), (-4, "s", "hot", 2, "t")]
    got, want = of(spark, rows, tmp_path), brute(rows)
    assert got == want
    assert {r[6] for r in got} == {True, False}


def test_sizes_around_the_fan_out(spark, tmp_path):
    for n in (1, 2, 8, 9, 64, 65):
        rows = [(i, "s", "x", 1, f"T{i}") for i in range(n)]
        assert of(spark, rows, tmp_path, f"n{n}") == brute(rows)
    assert of(spark, [], tmp_path, "none") == []


def test_names_that_clash_and_lower_fan_out(spark):
    df = spark.createDataFrame([(i, "t", None, None, f"T{i}", "x", 1, "y") for i in range(20)], SCHEMA + ", path string, idx int, `a.b` string")
    rows = merkle.manifest(df, fan_out=2).collect()
    assert len(rows) == 20 and len({r.root for r in rows}) == 1 and {len(r.path) for r in rows} == {5}
    other = merkle.manifest(df.withColumn("text", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text"))), fan_out=2).collect()
    assert rows[0].root != other[0].root
    assert [r.doc_id for r in rows if r.leaf not in {o.leaf for o in other}] == [7]


def test_fields_are_told_apart():
    assert leaf(("1", "23", None, None, "")) != leaf(("12", "3", None, None, "")) != leaf(("12", "3", None, None, None))
