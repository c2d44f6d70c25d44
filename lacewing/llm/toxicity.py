"""Toxicity: a weighted finite-state grammar of clauses, composed of small transducers."""

from __future__ import annotations

import math
import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, remainder, span_hashes, steps, string_bytes, table, word_spans
from .quality import labelled

#: What a fit sees at most: labelled documents of each class (clean, toxic), whole ones.
CLEAN, TOXIC = 3000, 800
FIT_STEP = 256 << 10
THRESHOLD = 0.5
#: Lengths in bytes of the word beginnings that may become insults; 0 is the whole word.
STEMS = (4, 5, 6, 7, 8, 0)
#: Closed word classes of the grammar, by symbol.
WORDS = {
    "T": "you your yours yourself he him his she her they them their these those people everyone du dich dir ihr euch sie ihn vous toi ton ta leur ils elles tú tu usted ustedes ellos ellas",
    "N": "not no never isn't aren't wasn't don't doesn't cannot without nicht kein keine nie niemals ohne ne pas jamais sans ni nunca jamás sin",
    "R": "said says say saying wrote writes called calls quoted quote claimed claims reported according sagte schrieb nannte laut dit écrit appelé selon dijo escribió llamó según",
    "H": "kill kills killing murder hurt destroy beat shoot stab burn töten umbringen vernichten tuer frapper détruire matar golpear destruir",
    "I": "idiot idiots moron morons stupid scum worthless pathetic loser losers",
}
SEED_WEIGHT = 2.0
#: What comes out: plain, directed, negated and reported insults, and threats.
KINDS = "IDirX"
PRIOR = np.array([2.0, 3.0, 0.7, 0.7, 3.0])
PRIOR_BIAS = -3.0
END = b".!?;\n"
QUOTES = '"“”«»„'
#: The typographic apostrophe, in UTF-8; it counts as the plain one.
APOSTROPHE = "’".encode()


class Transducer:
    """Deterministic: (state, symbol) to (state, symbol written, factor on the weight). Without an arc, the
    symbol passes and the state goes to `rest(state)`."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]], rest: dict[int, int]):
        self.arcs, self.rest = arcs, rest

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol, 1.0)


SYMBOLS = "wTNRHQIDirX"


def composed(a: Transducer, b: Transducer) -> Transducer:
    """First a, then b on what a writes: one machine over the reachable pairs of states."""
    number, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
    for pair in todo:
        for symbol in SYMBOLS:
            p, mid, f = a.step(pair[0], symbol)
            q, out, g = b.step(pair[1], mid)
            if (p, q) not in number:
                number[p, q] = len(number)
                todo.append((p, q))
            arcs[number[pair], symbol] = number[p, q], out, f * g
    return Transducer(arcs, {})


def within(words: int, opener: str, changes: dict[str, tuple[str, float]], keep: bool = True) -> Transducer:
    """After `opener`, for so many words, the symbols in `changes` are rewritten."""
    arcs = {(s, opener): (words, opener, 1.0) for s in range(words + 1)}
    for s in range(1, words + 1):
        for symbol, (out, factor) in changes.items():
            arcs[s, symbol] = s - 1 if keep else 0, out, factor
    return Transducer(arcs, {s: max(0, s - 1) for s in range(words + 1)})


def grammar() -> Transducer:
    """Negation reaches three words on, a target four, harm two; reported speech holds to the clause's end, quotes toggle it."""
    negation = within(3, "N", {"I": ("i", 1.0), "H": ("w", 1.0)})
    reported = Transducer({(0, "R"): (2, "R", 1.0), (1, "R"): (2, "R", 1.0), (0, "Q"): (1, "Q", 1.0), (1, "Q"): (0, "Q", 1.0)} | {(s, x): (s, "r", 1.0) for s in (1, 2) for x in "Ii"} | {(s, "H"): (s, "w", 1.0) for s in (1, 2)}, {})
    target = within(4, "T", {"I": ("D", 1.0)})
    threat = within(2, "H", {"T": ("X", 1.0)}, keep=False)
    return composed(composed(negation, reported), composed(threat, target))


GRAMMAR = grammar()


def letters(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which bytes of lower-cased text belong to words: letters and marks by code point, and the apostrophe of a negation (n't)."""
    out = (data >= 97) & (data <= 122)
    head = np.flatnonzero(data >= 0xC0)
    more = 1 + (data[head] >= 0xE0) + (data[head] >= 0xF0).astype(np.int64)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    point = padded[head] & np.array([0, 0x1F, 0x0F, 0x07])[more]
    for k in (1, 2, 3):
        point = np.where(more >= k, point << 6 | padded[np.minimum(head + k, len(padded) - 1)] & 0x3F, point)
    known, at = np.unique(point, return_inverse=True)
    word = np.array([c < 0x110000 and unicodedata.category(chr(c))[0] in "LM" for c in known.tolist()], bool)[at]
    for k in range(4):
        out[np.minimum(head + k, len(data) - 1)[word & (more >= k)]] = True
    plain = np.flatnonzero(data == 39)
    curled = head[point == 0x2019]
    for size, at in ((1, plain), (3, curled)):
        at = at[~np.isin(at, off) & ~np.isin(at + size, off)]
        ends = np.isin(at + size + 1, off) | ~out[np.minimum(at + size + 1, len(data) - 1)]
        at = at[(data[at - 1] == 110) & (data[np.minimum(at + size, len(data) - 1)] == 116) & ends]
        for k in range(size):
            out[at + k] = True
    return out


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, the letters' runs in them (start, end), each row's first run, and each byte's clause so far."""
    data, off = string_bytes(col)
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    data[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    starts, ends, first = word_spans(np.where(letters(data, off), np.uint8(97), np.uint8(32)), off)
    clause = np.cumsum(np.isin(data, np.frombuffer(END, np.uint8)))
    return data, starts, ends, first, clause


def keys_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words have a beginning of that length (or 0: all), and the hashes of the beginnings."""
    which = np.arange(len(starts)) if not length else np.flatnonzero(ends - starts > length)
    end = ends[which] if not length else starts[which] + length
    return which, span_hashes(data, starts[which], end) ^ np.uint64(length)


class Model:
    def __init__(self, lexicon: dict[int, dict[int, float]], weights: np.ndarray, bias: float):
        closed = {}
        for symbol, words in WORDS.items():
            for word in words.split():
                for spelt in {word.encode(), word.encode().replace(b"'", APOSTROPHE)}:
                    raw = np.frombuffer(spelt, np.uint8)
                    closed[int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])] = symbol
        self.closed, self.lexicon, self.weights, self.bias = closed, lexicon, weights, bias
        self.sorted = {k: np.array(sorted(v), np.uint64) for k, v in lexicon.items() if v}
        self.harm = np.array(sorted(h for h, s in closed.items() if s in "HI"), np.uint64)

    @staticmethod
    def _in(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys

    def clauses(self, col: pa.Array) -> Iterator[tuple[int, int, int, list[tuple[str, float]]]]:
        """(row, start, end, matches) of each clause with an insult or a word of harm; start and end are bytes in the row,
        a match is its kind and weight."""
        data, starts, ends, first, clause = tokens(col)
        _, off = string_bytes(col)
        if not len(starts):
            return
        insult: dict[int, float] = {}
        for length, known in self.sorted.items():
            which, keys = keys_of(data, starts, ends, length)
            if len(which):
                for i in np.flatnonzero(self._in(keys, known)):
                    w = int(which[i])
                    insult[w] = max(insult.get(w, 0.0), self.lexicon[length][int(keys[i])])
        whole = span_hashes(data, starts, ends)
        for w in np.flatnonzero(self._in(whole, self.harm)).tolist():
            insult.setdefault(w, SEED_WEIGHT if self.closed[int(whole[w])] == "I" else 0.0)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        done, of_word = -1, clause[starts]
        for hit in sorted(insult):
            if hit <= done:
                continue
            lo = max(int(np.searchsorted(of_word, of_word[hit], "left")), int(first[row[hit]]))
            hi = min(int(np.searchsorted(of_word, of_word[hit], "right")), int(first[row[hit] + 1]))
            done = hi - 1
            state, found = 0, []
            for w in range(lo, hi):
                left = int(ends[w - 1]) if w > first[row[hit]] else int(off[row[hit]])
                between = data[left : starts[w]].tobytes().decode("utf-8", "ignore")
                if w == lo:  # only a quote that opens at the clause's first word
                    between = between[len(between.rstrip(QUOTES)) :]
                for c in between:
                    if c in QUOTES:
                        state, _, _ = GRAMMAR.step(state, "Q")
                weight = insult.get(w, 0.0)
                symbol = "I" if weight else self.closed.get(int(whole[w]), "w")
                state, out, factor = GRAMMAR.step(state, symbol)
                if out in KINDS:
                    found.append((out, (weight or SEED_WEIGHT) * factor))
            if found:
                base = int(off[row[hit]])
                yield int(row[hit]), int(starts[lo]) - base, int(ends[hi - 1]) - base, found

    def features(self, col: pa.Array) -> tuple[np.ndarray, list]:
        """Log-damped weight of each kind of match a row, and the matched clauses."""
        total, found = np.zeros((len(col), len(KINDS))), list(self.clauses(col))
        for row, _, _, matches in found:
            for kind, weight in matches:
                total[row, KINDS.index(kind)] += weight
        return np.log1p(total), found

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))


def learn_lexicon(texts: list[str], toxic: np.ndarray) -> dict[int, dict[int, float]]:
    """Word beginnings and words that toxic texts have and clean ones hardly do, with their log-odds.

    Texts that share their least word hash count once, so a group of near copies is no evidence by itself. A
    candidate must stand in three such groups, and be rare by chance: (toxic share)^count below one over the number of
    candidates, where each different word of a group counts.
    """
    words = []
    groups: tuple[set, set] = (set(), set())
    for text, bad in zip(texts, toxic):
        data, starts, ends, _, _ = tokens(pa.array([text]))
        if len(starts):
            whole, once = np.unique(span_hashes(data, starts, ends), return_index=True)
            groups[bad].add(int(whole[0]))
            words.append((data, starts[once].astype(np.int32), ends[once].astype(np.int32), bool(bad)))
    n_bad, n_clean = len(groups[1]), len(groups[0])
    if not n_bad or not n_clean:
        return {}
    chance, found, candidates = math.log(n_bad / (n_bad + n_clean)), [], 0
    for k in STEMS:
        keys, owner, word = [], [], []
        for data, starts, ends, _ in words:
            whole = span_hashes(data, starts, ends)
            which, key = keys_of(data, starts, ends, k)
            keys.append(key)
            owner.append(np.full(len(key), whole[0]))
            word.append(whole[which])
        bad = np.repeat([w[3] for w in words], [len(x) for x in keys])
        keys, owner, word = (np.concatenate(x) for x in (keys, owner, word))
        suspect = np.unique(keys[bad])
        candidates += len(suspect)
        at = np.minimum(np.searchsorted(suspect, keys), max(0, len(suspect) - 1))
        mine = suspect[at] == keys if len(suspect) else np.zeros(0, bool)
        at, owner, word, bad = at[mine], owner[mine], word[mine], bad[mine]

        def distinct(*what: np.ndarray) -> np.ndarray:
            """For each suspect, how many different tuples it has."""
            tag = mix(sum(mix(x.astype(np.uint64) + np.uint64(i)) for i, x in enumerate(what)))
            _, first = np.unique(tag, return_index=True)
            return np.bincount(what[0][first], minlength=len(suspect))

        own, other, pairs = distinct(at[bad], owner[bad]), distinct(at[~bad], owner[~bad]), distinct(at[bad], owner[bad], word[bad])
        weight = np.log((own + 0.5) / (n_bad + 1)) - np.log((other + 0.5) / (n_clean + 1))
        good = np.flatnonzero((own >= 3) & (other <= 0.02 * own) & (weight > 2))
        found += [(k, int(suspect[i]), float(weight[i]), int(pairs[i])) for i in good]
    out: dict[int, dict[int, float]] = {}
    for k, key, weight, pairs in found:
        if pairs * chance < -math.log(candidates):
            out.setdefault(k, {})[key] = weight
    return out


def learn_weights(features: np.ndarray, toxic: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression drawn towards the prior, so a kind of match that no label shows keeps the prior's weight."""
    w, b = PRIOR.copy(), PRIOR_BIAS
    n = max(1, len(toxic))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w + b, -30, 30)))
        w -= 0.5 * (features.T @ (p - toxic) / n + 0.002 * (w - PRIOR))
        b -= 0.5 * ((p - toxic).mean() + 0.002 * (b - PRIOR_BIAS) if len(toxic) else 0)
    return np.maximum(w, 0.0), float(b)


def fit(docs: DataFrame, labels: DataFrame, clean: int = CLEAN, toxic: int = TOXIC) -> Model:
    """A model from labels whose crc32(doc_id) mod 5 isn't 0: at most `clean` and `toxic` documents, the least by hash, read
    whole. Labels other than 0 and 1 are ignored; with no labels the seed words and the prior stand alone."""
    rows = labelled(docs, labels, "toxic", {0: clean, 1: toxic}, 5, 0)
    raw = rows.repartition(1).mapInArrow(_fitted, "model binary").first()["model"]
    return Model(*pickle.loads(raw))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lexicon and weights from the bounded sample, which one task holds."""
    rows = sorted((label, nth, text or "") for batch in batches for text, label, nth in zip(*(c.to_pylist() for c in batch.columns)))
    texts, label = [r[2] for r in rows], np.array([r[0] for r in rows], int)
    lexicon = learn_lexicon(texts, label)
    model = Model(lexicon, PRIOR, PRIOR_BIAS)
    whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    features = np.concatenate([np.zeros((0, len(KINDS))), *(model.features(step.column(0))[0] for step in steps(whole, "text", FIT_STEP))])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((lexicon, *learn_weights(features, label)))], pa.binary())], names=["model"])


def assess(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, clauses) of every row, from its whole text.

    `clauses` are the matched ones: start and end byte, and the kinds found in order (I insult, D directed,
    i negated, r reported, X threat). Words are runs of letters, by code point, so any quote, dash or other mark ends one. Null
    and empty texts match nothing; rows that repeat give rows that repeat; a score that equals the threshold is predicted 1.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for step in steps(batch, "text"):
                features, found = m.features(step.column(2))
                p = m.score(features)
                flat = pa.StructArray.from_arrays([pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array(["".join(k for k, _ in f[3]) for f in found], pa.string())], ["start", "end", "kinds"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted([f[0] for f in found], np.arange(len(p) + 1)), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([step.column(0), step.column(1), pa.array(p, pa.float64()), pa.array(p >= threshold).cast(pa.int32()), lists], names=["doc_id", "held_out", "score", "predicted", "clauses"])

    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(read, f"doc_id {id_type}, held_out boolean, score double, predicted int, clauses array<struct<start:long,end:long,kinds:string>>")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below the threshold, with their columns of any name; the text is scored where it lies, nothing is
    shuffled. Rows that repeat stay or go alike, also those of null id; null and empty texts stay, a score that equals the threshold goes."""
    held, columns = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)), docs.columns
    place = columns.index("text")
    rows = docs.toDF(*[f"c{i}" for i in range(len(columns))])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, f"c{place}"):
                p = held.value.score(held.value.features(step.column(place))[0])
                yield step.filter(pa.array(p < threshold))

    return rows.mapInArrow(keep, rows.schema).toDF(*columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return assess(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("clauses")
