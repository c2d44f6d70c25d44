import random

from lacewing.llm import lines as li


def grams(x):
    return {x[i : i + 8] for i in range(max(1, len(x) - 7))}


def brute(rows):
    """Lines that stay, by row and position: the first of each component of similar lines."""
    at = {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        for pos, line in enumerate(t.split("\n")):
            if line.strip(" \t\n\r\x0b\x0c"):
                at.setdefault(line, (i, t, pos))
    names = list(at)
    sets, label = [grams(x) for x in names], list(range(len(names)))
    pairs = [(a, b) for a in range(len(names)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in names:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    keep = {at[names[k]] for k in range(len(names)) if label[k] == k}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        out.append((i, "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip(" \t\n\r\x0b\x0c") or (i, t, p) in keep)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrsé𝄞") for _ in range(rng.randint(2, 9)))
    pool = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["", "  ", "short", "x"]
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "same\nsame\nother"), (4, "same\nsame\nother"), (None, "no id\nsame")]
    for i in range(10, 90):
        own = []
        for _ in range(rng.randint(0, 9)):
            line = rng.choice(pool)
            if len(line) > 120 and rng.random() < 0.5:
                at = rng.randint(0, len(line) - 1)
                line = line[:at] + word()[:2] + line[at + 2 :]
            own.append(line)
        rows.append((i, "\n".join(own)))
    df = spark.createDataFrame([(i, t, 1, "c", 2) for i, t in rows], "doc_id long, text string, pos int, line string, row int")
    out = li.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = sorted([(r.doc_id, r.text) for r in out.collect()], key=key)
    assert got == sorted(brute(rows), key=key)
    assert li.dedup_lines(df.limit(0)).count() == 0


def families(rng, seeds, copies, length, edits):
    """Rows of lines that come from a few seeds by random edits, some of them far from their seed but near each other."""
    rows = []
    for c in range(seeds):
        seed = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(length)]
        for k in range(copies):
            line = list(seed)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(length - 3)
                line[at : at + 3] = [rng.choice("0123456789") for _ in range(3)]
            rows.append((10_000 * c + k, "".join(line)))
    return rows


def parts(components):
    """The groups of two and more that a table of (node, component) tells."""
    out = {}
    for node, component in components:
        out.setdefault(component, set()).add(node)
    return sorted(map(sorted, out.values()))


def all_links(spark, rows, **keywords):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines, links = li.similar_lines(df, **keywords)
    return {r.id: r.line for r in li.line_rows(df).collect()}, parts(map(tuple, li.components(links, "t").collect()))


def brute_parts(name):
    ids = sorted(name)
    sets, label = [grams(name[i]) for i in ids], list(range(len(ids)))
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    out = {}
    for i, k in zip(ids, label):
        out.setdefault(k, set()).add(i)
    return sorted(map(sorted, (v for v in out.values() if len(v) > 1)))


def test_families_around_a_leader(spark):
    name, got = all_links(spark, families(random.Random(8), 3, 120, 240, 8))
    assert got == brute_parts(name) and len(got) > 1


def test_drifting_lines(spark):
    rng = random.Random(8)
    rows = []
    for c in range(25):
        line = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)]
        for k in range(12):
            at = 24 * k
            line[at : at + 14] = [rng.choice("0123456789") for _ in range(14)]
            rows.append((100 * c + k, "".join(line)))
    name, got = all_links(spark, rows)
    assert got == brute_parts(name)


def test_two_thousand_near_copies_make_few_rows(spark):
    rows = families(random.Random(3), 1, 2000, 400, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = li.dedup_lines(df)
    assert sum(1 for r in out.collect() if r.text) == 1


def test_recall_at_the_threshold(spark):
    rng, rows = random.Random(31), []
    for c in range(300):
        line = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(207)]
        other = list(line)
        other[-22:] = [rng.choice("0123456789") for _ in range(22)]  # 178 of 222 shingles are shared: 0.802
        rows += [(2 * c, "".join(line)), (2 * c + 1, "".join(other))]
    _, got = all_links(spark, rows)
    assert len(got) >= 0.975 * 300


def test_one_very_long_line(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300_000))
    rows = [(1, long), (2, long[:150_000] + "#" + long[150_001:]), (3, "own line"), (4, long + "\n" + "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.doc_id, len(r.text), r.n_removed) for r in li.dedup_lines(df).orderBy("doc_id").collect()] == [(1, 300_000, 0), (2, 0, 1), (3, 8, 0), (4, 100_000, 1)]


def test_names_that_clash(spark):
    names = ["row", "gone", "_row", "_gone", "id", "Pos", "line", "node", "component", "N_LINES", "a.b", "first row", "key"]
    df = spark.createDataFrame([(i, "same line\nown %d" % i, *range(len(names))) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in names))
    out = li.dedup_lines(df)
    assert out.columns == ["doc_id", "text", *[c for c in names if c != "N_LINES"], "n_lines", "n_removed"]
    assert sorted((r["doc_id"], r["text"], r["a.b"]) for r in out.collect()) == [(0, "same line\nown 0", 10), (1, "own 1", 10), (2, "own 2", 10)]


def test_lines_that_repeat_content(spark):
    rng = random.Random(5)
    rows = [(k, chr(k) * size) for k in range(33, 127) for size in (7, 20, 200, 300)]
    for i in range(200, 220):
        phrase = "".join(rng.choice("abcdefghij klmnopq") for _ in range(59)) + "."
        rows += [(i, phrase * 2), (i + 100, phrase * 3)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in li.dedup_lines(df).collect()) == sorted(brute(rows))


def test_signatures_ship_no_text(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = li.signatures(li.line_rows(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Python" not in plan
    shuffled = plan[plan.index("Exchange hashpartitioning"):].split("\n")[1]
    assert "HashAggregate" in shuffled and "points" not in shuffled


def test_joins_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"the same line over and over again\nand line {i * 7919} of its own kind") for i in range(20)], "doc_id long, text string")
    want = sorted(li.dedup_lines(df).collect())
    monkeypatch.setattr(li, "bounded", lambda x, most=0: x)
    monkeypatch.setattr(li, "bounded_lists", lambda x, *_: x)
    assert sorted(li.dedup_lines(df).collect()) == want
