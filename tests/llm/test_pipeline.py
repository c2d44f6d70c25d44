"""The pipeline against a plain version of its stages, and what the entry file registers."""

import math
import random
from hashlib import md5

import corpus_pipeline
from test_decontamination import brute as contained
from test_lines import brute as without_lines
from test_mixing import level
from test_simhash import brute as near

from lacewing.llm import entries, toxicity


def test_names():
    assert {int(q[2:].split("_")[0]) for q in entries.QUERIES} == set(range(1, 14))
    assert set(entries.SQL) <= set(entries.QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_against_plain_stages(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abdegiklmnorstu") for _ in range(rng.randint(3, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 25)))) for i in range(5)]
    footer, docs, labels = " ".join(word() for _ in range(30)), [], []
    for i in range(260):
        lines = [" ".join(word() for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(1, 5))]
        if i % 7 == 0:
            lines.append(footer if i % 2 else footer[:60] + "x" + footer[61:])
        if i % 6 == 1:
            lines[0] += " zorqing zorqs zorqed zorqa"
        if i % 23 == 2:
            lines.append(rng.choice(items)[1].upper())
        docs.append((i, "\n".join(lines), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 6 == 1)))
        if i % 10 == 3:
            docs.append((1000 + i, " ".join(docs[-1][1].split()), "en", "s1", 0))
    docs += [(2000, None, None, None, None), (2001, "", "", "s0", 0)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, columns).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r.score for r in toxicity.assess(table, toxicity.fit(table, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()}
    rows = [(i, t) for i, t, *_ in docs if score[i] < 0.5]
    assert {i for i, *_ in docs} - {i for i, _ in rows} == {i for i, *_ in docs if i < 1000 and i % 6 == 1} | {1000 + i for i in range(260) if i % 10 == 3 and i % 6 == 1}
    before = dict(rows)
    rows = [(i, t) for i, t in without_lines(rows) if t == before[i] or (t or "").strip()]
    keep = {i for i, _, c in near(rows) if i == c}
    rows = [(i, t) for i, t in rows if i in keep]
    dirty = {d for d, *_ in contained(rows, items)}
    rows = [(i, t) for i, t in rows if i not in dirty]
    source = {i: s for i, _, _, s, _ in docs}
    sizes = {}
    for i, t in rows:
        sizes[source[i]] = sizes.get(source[i], 0) + len((t or "").split())
    target, want = level(sizes), []
    for i, t in rows:
        rate = target[source[i]] / sizes[source[i]] if sizes[source[i]] else 0
        draw = int(md5(f"{i}:mix".encode()).hexdigest()[:13], 16) / 2**52
        want += [(i, t, k) for k in range(math.floor(rate) + (draw < rate - math.floor(rate)))]
    assert sorted((r.doc_id, r.text, r.copy) for r in got) == sorted(want)
    assert all(r.n_chars in (len(r.text or ""), 0, None) for r in got)


def test_empty_tables(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    for name, schema in (("documents", columns), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"] and out.count() == 0


def test_columns_of_any_name_keep_their_values(spark, tmp_path):
    names = ["n_lines", "n_removed", "_n_lines", "size", "target", "source_size", "n_copies", "a.b", "x`y", "row", "score", "count"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` int" for c in names)
    docs = spark.createDataFrame([(i, f"a line that many have\nown words {'abcdef'[i] * 9} here", "en", "s", 9, *range(10 * i, 10 * i + len(names))) for i in range(6)], schema)
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "quite another text of some length that is nowhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns and (out.columns == docs.columns or name == "mixing")
        assert out.count() and all(tuple(r)[5 : 5 + len(names)] == tuple(range(10 * r.doc_id, 10 * r.doc_id + len(names))) for r in out.collect()), name
        docs = out
