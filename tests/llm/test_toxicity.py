import random

import pyarrow as pa

from lacewing.llm import toxicity as t


def run(machine, symbols):
    state, out = 0, ""
    for s in symbols:
        state, o, _ = machine.step(state, s)
        out += o
    return out


def test_composition_is_the_cascade():
    rng = random.Random(2)
    neg, rep = t.within(3, "N", {"I": ("i", 1.0)}), t.Transducer({(0, "R"): (1, "R", 1.0), (1, "I"): (1, "r", 1.0)}, {})
    both = t.composed(neg, rep)
    for _ in range(300):
        s = "".join(rng.choice("wITNRHQ") for _ in range(12))
        assert run(both, s) == run(rep, run(neg, s))


def test_grammar():
    assert run(t.GRAMMAR, "TwI") == "TwD" and run(t.GRAMMAR, "wwI") == "wwI"
    assert run(t.GRAMMAR, "NwI") == "Nwi" and run(t.GRAMMAR, "RwI") == "Rwr"
    assert run(t.GRAMMAR, "wHT") == "wHX" and run(t.GRAMMAR, "NHT") == "NwT"
    assert run(t.GRAMMAR, "QIQI") == "QrQI"


def test_clauses_of_whole_text():
    m = t.Model({}, t.PRIOR, t.PRIOR_BIAS)
    text = "Nice day. You are an IDIOT! They said \"stupid\" thing, no moron. " + "filler words; " * 30_000 + "é scum"
    found = list(m.clauses(pa.array([None, "", text, "kill you"])))
    raw = text.encode()
    assert [(r, raw[a:b].decode(), "".join(k for k, _ in x)) for r, a, b, x in found[:-1]] == [(2, "You are an IDIOT", "D"), (2, 'They said "stupid" thing, no moron', "rr"), (2, "é scum", "I")]
    assert found[-1][0] == 3 and found[-1][3][0][0] == "X"


def data(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abdegiklmnorstu") for _ in range(rng.randint(3, 8)))
    docs, labels = [], []
    for i in range(900):
        words, bad = [word() for _ in range(rng.randint(30, 150))], i % 5 == 0
        for _ in range(rng.randint(2, 5) * bad):
            words.insert(rng.randint(0, len(words)), "zorq" + rng.choice(["", "ed", "ing", word()]))
        docs.append((i, " ".join(words) + ".", 7))
        if i < 800:
            labels.append((i, int(bad), "clash"))
    docs += [(2000, None, 0), (2001, "", 0), (2002, "a " * 100_000 + "zorqing zorqs zorqa", 0), (None, "x", 0), (5, docs[5][1], 0)]
    labels += [(2000, 1, ""), (None, 1, ""), (10, None, ""), (5, 1, "")]
    return docs, spark.createDataFrame(docs, "doc_id long, text string, toxic int"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_held_out(spark):
    docs, d, labels = data(spark)
    out = t.assess(d, t.fit(d, labels)).collect()
    assert len(out) == len(docs)
    judged = [r for r in out if r.doc_id is not None and r.doc_id < 900 and (r.held_out or r.doc_id >= 800)]
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in judged) and len(judged) > 200
    assert next(r for r in out if r.doc_id == 2002).predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    kept = t.without_toxic(d, labels)
    assert kept.columns == d.columns
    gone = sorted(r.doc_id for r in out if r.predicted)
    assert kept.count() == len(docs) - len(gone)
    nothing = labels.limit(0)
    assert t.assess(d.limit(0), t.fit(d.limit(0), nothing)).count() == 0 and t.assess(d, t.fit(d, nothing)).count() == len(docs)


def test_typographic_marks_end_words():
    m = t.Model({}, t.PRIOR, t.PRIOR_BIAS)
    kinds = lambda text: "".join(k for _, _, _, x in m.clauses(pa.array([text])) for k, _ in x)
    assert kinds("you idiot") == kinds("you—idiot") == kinds("you…idiot") == kinds("You\u00a0IDIOT") == "D"
    assert kinds("“idiot”") == kinds("«idiot»") == kinds('"idiot"') == "r"
    assert kinds("“You are an idiot” he added") == kinds('"You are an idiot" he added') == "r"
    assert kinds('He added "no." You idiot.') == "D"
    assert kinds("it isn’t stupid") == kinds("it isn't stupid") == "i"
    assert kinds("l’idiot") == kinds("l'idiot") == "I" and kinds("’t stupid") == "I"


def plain_clauses(m, text):
    """The kinds of the matches of one text: a character at a time, a clause at a time, a word through the machine at a time."""
    import unicodedata

    raw, out, words = text or "", [], []
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "\xc0" <= c <= "\xde" and c != "\xd7" else c for c in raw)
    letter = [c.isascii() and c.isalpha() or not c.isascii() and unicodedata.category(c)[0] in "LM" for c in low]
    joins = [i for i, c in enumerate(low) if c in "'’" and 0 < i < len(low) - 1 and low[i - 1] == "n" and low[i + 1] == "t" and not (i + 2 < len(low) and letter[i + 2])]
    for i in joins:
        letter[i] = True
    at = 0
    while at < len(low):
        if not letter[at]:
            at += 1
            continue
        end = at
        while end < len(low) and letter[end]:
            end += 1
        words.append((at, end))
        at = end
    symbol = {w: s for s, ws in t.WORDS.items() for w in ws.split()}
    clause = lambda a: sum(c in ".!?;\n" for c in low[:a])
    for number in dict.fromkeys(clause(a) for a, _ in words):
        mine = [w for w in range(len(words)) if clause(words[w][0]) == number]
        state = 0
        for w in mine:
            gap = low[words[w - 1][1] if w else 0 : words[w][0]]
            if w == mine[0]:
                gap = gap[len(gap.rstrip(t.QUOTES)) :]
            for c in gap:
                if c in t.QUOTES:
                    state = t.GRAMMAR.step(state, "Q")[0]
            state, o, _ = t.GRAMMAR.step(state, symbol.get(low[slice(*words[w])].replace("’", "'"), "w"))
            if o in t.KINDS:
                out.append(o)
    return "".join(out)


def test_clauses_against_a_plain_machine():
    rng = random.Random(11)
    m = t.Model({}, t.PRIOR, t.PRIOR_BIAS)
    bits = "you idiot IDIOT stupid not never isn’t don't said “ ” \" « » — ' ’ . ! ; \n kill them hurt word Érable jamais été du dich töten scum ' , others n't".split(" ")
    texts = [None, ""] + [("" if rng.random() < 0.2 else " ").join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    got = [""] * len(texts)
    for row, _, _, matches in m.clauses(pa.array(texts)):
        got[row] += "".join(k for k, _ in matches)
    for text, kinds in zip(texts, got):
        assert kinds == plain_clauses(m, text), text
