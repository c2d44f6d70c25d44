import random

from lacewing.llm import decontamination as d


def brute(docs, items, n=5, t=0.8):
    def grams(text, k):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    out = set()
    for i, x in items:
        k = min(n, len((x or "").split()))
        own = grams(x, k) if k else set()
        for j, y in docs:
            hit = len(own & grams(y, k)) if own else 0
            if own and hit >= t * len(own) - 1e-9:
                out.add((j, i, len(own), hit))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("alpha Beta gamma delta eps zeta eta theta iota kappa lam mu nu xi".split())
    items = [(i, " ".join(word() + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 40)))) for i in range(60)] + [(100, None), (101, " "), (1, "twice here")]
    docs = [(0, None), (1, ""), (2, "twice HERE"), (3, "x\x0btwice\there\n")]
    for j in range(10, 200):
        words = [word() + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 2)):
            own = items[rng.randrange(60)][1].split()
            own = [w.upper() if rng.random() < 0.3 else "odd" if rng.random() < 0.02 else w for w in own]
            at = rng.randint(0, len(words))
            words[at:at] = own
        docs.append((j, "\n".join(words)))
    docs.append((11, docs[15][1]))
    a = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    want = brute(docs, items)
    for block in (10**6, 100):
        got = d.contained_items(a, b, block_words=block).collect()
        assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got} == want
    dirty = {w[0] for w in want}
    assert {r.doc_id for r in d.decontaminate(a, b).collect()} == {j for j, _ in docs} - dirty
    assert d.contained_items(a, b.limit(0)).count() == 0 and d.contained_items(a.limit(0), b).count() == 0
