import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from lacewing.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"
SIGNS = ["a'S,'ll 'LLx.'re;x're 'tis ''s --'m 9's s'9 12.5% A1b2'd", "x<|ENDOFTEXT|>y A<|endoftext|>B.c D.e <|", "e\u0301.e \u0301x Á1 .\u0301a ÉCOLE.É", "\x7fa\x01b.C\x1fd", "don't,won't!x'Ve'RE"]
ODD = [*SIGNS, "", None, " \t\n\x0b", "It's WE'VE Don't", "a b c\x85d", "é ́x École", "ΟΔΟΣ ΣΑΣ Σ", "<|endoftext|> x<|startoftext|>y", "日本語 テキスト 12 345", "🙂🙃 a🙂b", "x" * 9000, "ſ İ ǅ ﬁ", "\x00 \x1c\x1d a​b c"]


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def plain_best_fit(lengths, capacity):
    """Sequences that best-fit in descending order needs, piece by piece."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def check(rows, lengths, capacity):
    """Every piece lies in one sequence without gap, overlap or excess."""
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(r.length for r in rows) == sorted(lengths)
    return len(at)


def test_query_against_plain_tokens(spark, tmp_path):
    rng, tokenizer = random.Random(2), Tokenizer.from_file(PATH)
    words = ["alpha", "Béta", "it's", "unbelievably", "x1", "(hm)", "ÆØÅ", "—", "naïve", "don't,", "qwrtzp"]
    texts = ODD + [" ".join(rng.choices(words, k=rng.choice([1, 5, 60, 700, 3000]))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, "no id"), (500, "w " * 2047), (501, "w " * 2048), (502, "w " * 4095)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op13_packing(spark, str(tmp_path)).collect()
    want = []
    for doc, text in rows:
        own = ids(tokenizer, text)
        for piece, start in enumerate(range(0, len(own), 2048)):
            part = own[start : start + 2048]
            want.append((doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    lengths = [w[3] for w in want]
    assert check(got, lengths, 2048) <= plain_best_fit(lengths, 2048)


def test_plan_is_that_of_single_pieces():
    rng = random.Random(4)
    for capacity, most in ((10, 10), (64, 40), (2048, 2048), (2048, 300)):
        for n in (1, 7, 900):
            lengths = [rng.choice([rng.randint(1, most), max(1, most // 3), most]) for _ in range(n)]
            counts = {x: lengths.count(x) for x in lengths}
            plan = packing.best_fit(counts, capacity)
            ranks, used = {}, {}
            for length, rank, pieces, sequence, each, offset in plan:
                assert rank == ranks.get(length, 0)
                ranks[length] = rank + pieces
                for k in range(pieces):
                    s = sequence + k // each
                    assert used.get(s, 0) == offset + k % each * length
                    used[s] = used.get(s, 0) + length
            assert ranks == counts and max(used.values()) <= capacity
            assert len(used) == plain_best_fit(lengths, capacity)


def test_plan_does_not_grow_with_the_counts():
    rng = random.Random(5)
    counts = {x: rng.randint(1, 40) for x in range(1, 2049)}
    small, large = packing.best_fit(counts), packing.best_fit({x: n * 1000 for x, n in counts.items()})
    assert len(large) < 4 * len(small) < 100_000


def test_sequences_hold_the_ids(spark):
    rng, tokenizer = random.Random(6), Tokenizer.from_file(PATH)
    rows = [(i, " ".join(rng.choices(["a", "Bc", "de,f"], k=rng.randint(0, 90))), "clash", 1) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA + ", row string, `a.b` int")
    packed = packing.pack(packing.pieces(df, PATH, 64, with_ids=True), 64)
    full = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    own = {r[0]: ids(tokenizer, r[1]) for r in rows}
    for r in packed.collect():
        assert full[r.sequence_id][r.offset : r.offset + r.length] == own[r.doc_id][r.start : r.start + r.length]
    assert all(len(x) <= 64 for x in full.values())


def test_cuts_within_words_change_no_id():
    """Random signs, and the same with words whole: the file's pattern decides, not the rule for cutting."""
    rng, tokenizer = random.Random(8), Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as f:
        known = packing.Pieces(f.read(), 0)
    assert known.fine
    signs = ["a", "S", "'", "t", "re", "LL", ".", "-", "1", "9", " ", "\u0301", "é", "<|", "|>", "<|endoftext|>", "\x01", "\u2028", "Σ", "\t"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(4000)]
    for fine in (True, False):
        known.fine = fine
        got, off = packing.token_ids(pa.array(texts), known)
        assert [got[a:b].tolist() for a, b in zip(off, off[1:])] == [ids(tokenizer, t) for t in texts]


def test_empty_table(spark):
    assert packing.pack(packing.pieces(spark.createDataFrame([], SCHEMA), PATH)).count() == 0
