import hashlib
import random
from collections import Counter

import numpy as np

from lacewing.llm import substrings as s


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 13, 500)
    tree = s.WaveletTree(seq, 13)
    c, at = rng.integers(0, 13, 300), rng.integers(0, 501, 300)
    assert tree.rank(c, at).tolist() == [int((seq[:i] == k).sum()) for k, i in zip(c, at)]


def test_windows_of_an_index():
    rng = np.random.default_rng(2)
    for _ in range(20):
        seqs = [rng.integers(0, 3, rng.integers(30, 90)).astype(np.uint64) for _ in range(12)]
        seqs += [seqs[0][5:60].copy(), np.zeros(80, np.uint64)]
        copies = rng.integers(1, 3, len(seqs))
        got = s.repeated_windows(seqs, copies, window=35)
        seen = Counter()
        for q, k in zip(seqs, copies):
            for i in range(len(q) - 34):
                seen[q[i : i + 35].tobytes()] += int(k)
        assert [g.tolist() for g in got] == [[seen[q[i : i + 35].tobytes()] > 1 for i in range(len(q) - 34)] for q in seqs]


def test_matching_statistics():
    """The longest stretch that ends at each place and stands elsewhere too, in whole symbols, by trying all lengths."""
    rng = np.random.default_rng(7)
    shared = rng.integers(0, 9, 70).astype(np.uint64)
    seqs = [np.concatenate([rng.integers(10, 99, k).astype(np.uint64), shared[a:b], rng.integers(10, 99, 20).astype(np.uint64)]) for k, a, b in ((10, 0, 70), (3, 5, 62), (40, 20, 66), (0, 30, 70))]
    got = s.matching_statistics(seqs, np.ones(4, int))
    text = [q.tolist() for q in seqs]
    for i, q in enumerate(text):
        want = []
        for end in range(35, len(q) + 1):
            best = 0
            for n in range(5, end + 1, 5):
                piece = q[end - n : end]
                if sum(t[k : k + n] == piece for t in text for k in range(len(t) - n + 1)) < 2:
                    break
                best = n
            want.append(best)
        assert got[i].tolist() == want
    assert max(m.max() for m in got) >= 55


def brute(rows):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for _, w in split for i in range(len(w) - 34))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("the of and to in is it was éa Zz x\x1cy".split(" ")) + rng.choice(["", "s", "ing", str(rng.randint(0, 99))])
    text = lambda n: [word() for _ in range(n)]
    passages = [text(rng.randint(20, 90)) for _ in range(8)]
    rows = [(1, None), (2, ""), (3, " \t\x0b"), (4, "la " * 200), (5, "la " * 36), (6, "only " + "la " * 30)]
    for i in range(10, 130):
        words = text(rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "odd"
            at = rng.randint(0, len(words))
            words[at:at] = p
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [rows[20], (500, rows[30][1]), (20, rows[31][1]), (None, rows[40][1])]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, run int, row string")
    got = s.dedup_substrings(df)
    want = brute(rows)
    assert sorted([tuple(r)[:4] for r in got.collect()], key=str) == want
    for r in got.collect():
        assert sum(x.end - x.start for x in r.spans) == r.n_removed and hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert s.dedup_substrings(df.limit(0)).count() == 0


def test_lone_periodic_texts(spark):
    rows = [(1, "la " * 36), (2, " ".join(f"p{k % 27}" for k in range(62))), (3, " ".join(f"q{k % 27}" for k in range(61))), (4, " ".join(f"w{k}" for k in range(80)))]
    rows += [(5, " ".join([f"h{k}" for k in range(40)] + [f"r{k % 5}" for k in range(41)] + [f"t{k}" for k in range(40)]))]
    for i, (tag, text) in enumerate(rows):
        df = spark.createDataFrame([(tag, text)], "doc_id long, text string")
        assert [tuple(r)[:4] for r in s.dedup_substrings(df).collect()] == brute(rows[i : i + 1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in s.dedup_substrings(df).collect()}
    assert got == {1: 36, 2: 62, 3: 0, 4: 0, 5: 41}


def test_hot_anchors_give_the_same(spark):
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(50)]
    rows = [(i, " ".join([f"a{rng.randint(0, 3)}" for _ in range(30)] + passage + [f"b{rng.randint(0, 3)}" for _ in range(30)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spots = lambda k: sorted((r.row, sorted(map(tuple, r.spots))) for r in s.repeated(df, anchor_runs=k).collect())
    assert spots(3) == spots(1000) == spots(1) == spots(0)


def test_parts_of_hot_runs_are_searched_together(spark, monkeypatch):
    """The edge of a passage in many contexts: its windows are dealt out by gram after gram, and what repeats beyond the edge is found."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(40)]
    tails = [[f"t{i}_{k}" for k in range(40)] for i in range(5)]
    rows = [(i, " ".join([f"x{i}_{k}" for k in range(20)] + passage + (tails[i % 5] if i % 2 else [f"y{i}_{k}" for k in range(40)]))) for i in range(80)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    deepest, split = [0], s._split
    monkeypatch.setattr(s, "_split", lambda known, grams: deepest.append(grams) or split(known, grams))
    spots = s.repeated(df, anchor_runs=5).count()
    assert spots == 80 and max(deepest) > 4
    assert sorted([tuple(r)[:4] for r in s.dedup_substrings(df).collect()], key=str) == brute(rows)


def test_words_that_structured_hashes_confuse(spark):
    """A Thue-Morse word and its complement, which collide in any polynomial hash modulo 2**64, are different words."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    odd = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    shared = [f"w{i}" for i in range(34)]
    rows = [(k, " ".join([*shared, odd[k]])) for k in (0, 1)]
    out = s.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in out] == [0, 0]
