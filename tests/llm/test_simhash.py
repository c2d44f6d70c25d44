import random

import numpy as np
import pyarrow as pa
import xxhash

from lacewing.llm import simhash as s


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "one TWO", "a\x1cb c", "É é x y"] + ["".join(rng.choice("abC \n\t\x0b\x0cé") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    assert s.fingerprints(pa.array(texts)).tolist() == [plain(t) for t in texts]


def test_trie_join_is_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *[base ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, k))) for k in range(1, 6)]]))
    groups = np.sort(rng.integers(0, 3, len(prints)))
    order = np.lexsort((prints, groups))
    prints, groups = prints[order], groups[order]
    x, y = s.trie_join(prints, groups)
    got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if groups[i] == groups[j] and int(prints[i] ^ prints[j]).bit_count() <= 3}
    assert got == want and len(x) == len(want) > 10


def brute(rows):
    ids = {i: plain(t) for i, t in rows}
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[b] > label[a] and (ids[a] ^ ids[b]).bit_count() <= 3:
                    label[b], changed = label[a], True
    return {(i, f"{p:016x}", label[i]) for i, p in ids.items()}


def test_components(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randint(0, 9))
    rows = [(1, None), (2, ""), (3, "One"), (4, "oNE")]
    for i in range(10, 40):
        words = [word() for _ in range(rng.randint(5, 120))]
        for j in range(rng.randint(1, 6)):
            rows.append((i * 10 + j, " ".join(words)))
            words = [word() if rng.random() < 0.01 else w for w in words]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, component_id string, print int")
    assert {tuple(r) for r in s.near_duplicates(df).collect()} == brute(rows)
    keep = {i for i, _, c in brute(rows) if i == c}
    kept = s.one_of_each(df.union(df))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(keep)
    assert s.near_duplicates(df.limit(0)).count() == 0


def test_hot_groups_are_dealt_out_again(spark):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 2**63))
    prints = sorted({center ^ sum(1 << int(b) for b in rng.choice(63, 4, replace=False)) for _ in range(160)})
    df = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "print long, rep long")
    label = list(range(len(prints)))
    for _ in label:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in s.components(s.near_links(df, group=20), "t").collect()}
    assert [got.get(i, i) for i in range(len(prints))] == label


def test_components_of_a_long_path(spark):
    rng = random.Random(1)
    ids = [rng.getrandbits(63) - 2**62 for _ in range(1000)]
    df = spark.createDataFrame(list(zip(ids, ids[1:])), "u long, v long")
    assert {tuple(r) for r in s.components(df, "path").collect()} == {(i, min(ids)) for i in ids}
