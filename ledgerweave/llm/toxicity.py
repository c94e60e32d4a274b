"""Toxicity by noisy-channel deobfuscation.

Character trigrams counted over all documents make a language model. Words that look disguised - digits or signs among
letters, letters spelled apart, letters repeated - become lattices of what each sign may stand for, and Viterbi picks
the likeliest reading, of any length; a gap between spelled letters may be a word boundary or nothing. Plain and restored
words then meet a sparse logistic model over whole words and word beginnings.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, materialise, table, text_blocks

FIT_ROWS, MAX_FEATURES = 20_000, 1 << 16
NEAR = 6.0  # nats between the best parting of spelled letters and others whose words count too
#: fixed values: what a sign may stand for
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SIGNS = "0123456789@$!|+(€£"
GAPS = " .-_*"

_LETTERS = np.zeros(256, np.int64)  # 0 boundary, 1-26 letters, 27 bytes of other letters, 28 digits
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(1, 27)
_LETTERS[128:] = 27
_LETTERS[48:58] = 28
_SIZE = 29
_LETTER = (_LETTERS >= 1) & (_LETTERS <= 27)
_SIGN = np.isin(np.arange(256), [ord(c) for c in SIGNS if ord(c) < 128])
_GAP = np.isin(np.arange(256), [ord(c) for c in GAPS])

_WORD = re.compile(r"[^\W\d_]+")
_LEET = re.compile(rf"(?<![^\W\d_])(?<![{re.escape(SIGNS)}])[^\W\d_]*+(?:[{re.escape(SIGNS)}]++[^\W\d_]++)++")
_PAIR = re.compile(r"([^\W\d_])\1")
_APART = re.compile(r"(?<![^\W_])(?:[^\W_@$!|+][ .\-_*]{1,2}|[@$!|+][ .\-_*]{1,2}){3,}[^\W_@$!|+](?![^\W_])")

def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over every whole text, 29^3 of them; summed in the cluster, not on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            for _, _, data, offs in text_blocks(batch, "text"):
                begins = (data & 0xC0) != 0x80  # one symbol a character
                at = np.zeros(len(data) + 1, np.int64)
                np.cumsum(begins, out=at[1:])
                data, offs = data[begins], at[offs]
                c = _LETTERS[data]
                if len(c) > 2:
                    code = (c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:]
                    inside = np.ones(len(data), bool)
                    ends = offs[1:]
                    inside[ends[ends >= 1] - 1] = inside[ends[ends >= 2] - 2] = False  # no trigram crosses a text's end
                    total += np.bincount(code[inside[:-2]], minlength=_SIZE**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["code", "n"])

    rows = docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()  # at most 29^3
    out = np.zeros(_SIZE**3, np.int64)
    for r in rows:
        out[r.code] = r.n
    return out


class Decoder:
    """Viterbi over character lattices under an interpolated trigram model."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(_SIZE, _SIZE, _SIZE).astype(np.float64)
        tri[:, :, 28] = tri[:, 28, :] = 0
        two, one = tri.sum(0), tri.sum((0, 1))
        p1 = (one + 1) / (one + 1).sum()
        p2 = (two + 5 * p1) / (two + 5 * p1).sum(1, keepdims=True)
        p3 = (tri + 2 * p2[None]) / (tri + 2 * p2[None]).sum(2, keepdims=True)
        self.log = np.log(p3)
        self.bonus = -float((p1 * np.log(p1)).sum()) * 0.8  # a letter's worth, so readings of different length compare
        self.table = self.log.tolist()
        self.memo: dict[str, str] = {}

    def code(self, c: str) -> int:
        o = ord(c)
        return o - 96 if 97 <= o <= 122 else 0 if c == " " else 27

    def restore(self, word: str) -> str:
        """The likeliest reading of a disguised lower-case word; signs with no reading are dropped, gaps are too or part words."""
        if len(word) > 60:  # read like any other, not remembered
            return self._viterbi(self.lattice(word))
        if word not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = self._viterbi(self.lattice(word))
        return self.memo[word]

    def lattice(self, word: str) -> list[tuple[str, ...]]:
        """Readings of each run of one letter, across signs and gaps: once, twice, or twice with a boundary; and of each gap."""
        runs: list[list] = []  # [letters it may be, length, whether gaps are inside]
        gap = False
        for c in word:
            if c in GAPS:
                gap = True
                continue
            key = LEET.get(c) or (c if c.isalpha() else "")
            if not key:
                continue
            if runs and runs[-1][0] == key:
                runs[-1][1] += 1
                runs[-1][2] |= gap
            else:
                if gap and runs:
                    runs.append(["", 0, False])
                runs.append([key, 1, False])
            gap = False
        out: list[tuple[str, ...]] = []
        for key, n, parted in runs:
            twice = [r + r for r in key] if n > 1 else []
            out.append((*key, *twice, *(f"{r} {r}" for r in key if parted)) if key else ("", " "))
        return out

    def _viterbi(self, steps: list[tuple[str, ...]]) -> str:
        best: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}  # (worth, (option, what came before it))
        table, bonus = self.table, self.bonus
        for options in steps:
            spelled = [(option, [self.code(c) for c in option]) for option in options]
            then: dict[tuple[int, int], tuple] = {}
            for (a, b), (s, came) in best.items():
                for option, codes in spelled:
                    x, y, t = a, b, s
                    for k in codes:
                        t += table[x][y][k] + (bonus if k else 0.0)
                        x, y = y, k
                    if (x, y) not in then or then[x, y][0] < t:
                        then[x, y] = (t, (option, came))
            best = then
        _, came = max(((s + table[a][b][0], came) for (a, b), (s, came) in best.items()), key=lambda e: e[0])
        out = []
        while came:
            out.append(came[0])
            came = came[1]
        return "".join(reversed(out))

    def parts(self, letters: str) -> set[str]:
        """Words of every way to part spelled letters that is at most NEAR less likely than the best way."""
        c, table, n = [self.code(x) for x in letters], self.table, len(letters)
        if not n:
            return set()
        fore, ahead = [0.0], (-math.inf, table[0][0][c[0]])  # best of letters[:i] as whole words; a letter inside, at the start of a word
        for i in range(n):
            inside, begun = table[c[i - 1]][c[i]], table[0][c[i]]
            fore.append(max(ahead[0] + inside[0], ahead[1] + begun[0]))
            if i + 1 < n:
                ahead = max(ahead[0] + inside[c[i + 1]], ahead[1] + begun[c[i + 1]]), fore[-1] + table[c[i]][0][c[i + 1]]
        rest, start = [(0.0, 0.0)] * n, [0.0] * (n + 1)  # best of what follows letter i inside, at the start of a word; of letters[i:] as words
        for i in range(n - 1, -1, -1):
            rest[i] = tuple(max(t[0] + start[i + 1], t[c[i + 1]] + rest[i + 1][0] if i + 1 < n else -math.inf) for t in (table[c[i - 1]][c[i]], table[0][c[i]]))
            start[i] = table[c[i - 1] if i else 0][0][c[i]] + rest[i][1]
        out, floor = set(), start[0] - NEAR
        for i in range(n):
            s = fore[i] + table[c[i - 1] if i else 0][0][c[i]]
            for j in range(i, n):
                t = table[0 if j == i else c[j - 1]][c[j]]
                if s + rest[j][j == i] < floor:
                    break
                if s + t[0] + start[j + 1] >= floor:
                    out.add(letters[i : j + 1])
                if j + 1 < n:
                    s += t[c[j + 1]]
        return out


def suspects(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts of a block that may hold a disguised word: a superset, found on bytes."""
    first = (data & 0xC0) != 0x80  # one byte a character
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=at[1:])
    data, offs = data[first], at[offs]
    hit = np.zeros(len(data), bool)
    letter, sign, gap = _LETTER[data], _SIGN[data], _GAP[data]
    if len(data) > 4:
        hit[:-1] |= sign[:-1] & letter[1:]
        alone = np.zeros(len(data) + 3, bool)
        alone[1 : len(data) - 1] = gap[:-2] & (letter | sign)[1:-1] & gap[2:]
        hit |= alone[:-3] & (alone[2:-1] | alone[3:])
        hit |= (data == 0xE2) | (data == 0xC2)  # euro and pound signs
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(hit, out=total[1:])
    return np.diff(total[offs]) > 0


def readings(text: str, decoder: Decoder, suspect: bool) -> set[str]:
    """Distinct lower-case words of a text and the restored readings of its disguised ones, but for repeated letters."""
    low = text.lower()
    words = set(_WORD.findall(low))
    if suspect:
        for m in _LEET.finditer(low):
            words.add(decoder.restore(m[0]))
        for m in _APART.finditer(low):
            spelled = decoder.restore(m[0])
            words.update(spelled.split(), decoder.parts(spelled.replace(" ", "")), decoder.restore("".join(c for c in m[0] if c not in GAPS)).split())
    return words


def features(word: str) -> list[str]:
    """The word and its beginnings of 4 to 6 letters, marked apart."""
    return [f"={word}", *(word[:n] for n in (4, 5, 6) if len(word) >= n)]


def marks(word: str, decoder: Decoder) -> list[str]:
    """Features of a word and, if a letter repeats in it, of its restored reading."""
    if not _PAIR.search(word):
        return features(word)
    return list(dict.fromkeys(features(word) + features(decoder.restore(word))))


def words_of(batch: pa.RecordBatch, decoder: Decoder) -> Iterator[tuple[int, set[str]]]:
    for lo, _, data, offs in text_blocks(batch, "text"):
        raw, odd = data.tobytes(), suspects(data, offs)
        for i in range(len(offs) - 1):
            yield lo + i, readings(raw[offs[i] : offs[i + 1]].decode("utf-8", "replace"), decoder, bool(odd[i]))


def train(docs: DataFrame, labels: DataFrame, counts: np.ndarray, limit: int = FIT_ROWS) -> tuple[float, dict[str, float]]:
    """(intercept, weight by feature) from at most ``limit`` labelled rows outside the held-out fold.

    Candidate features are those at least half of whose documents are toxic, three documents at least, the strongest
    ``MAX_FEATURES`` of them (a bound on what is broadcast; 20,000 rows give far fewer). All texts are scored.
    """
    spark = docs.sparkSession
    rows = materialise(labelled_sample(docs, labels, "toxic", limit), "labelled")
    shared = spark.sparkContext.broadcast(counts)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        n: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            y = batch.column("y").to_pylist()
            for i, words in words_of(batch, decoder):
                for f in {f for w in words for f in marks(w, decoder)}:
                    n[f][y[i]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array([v[1] for v in n.values()], pa.int64()), pa.array([v[0] for v in n.values()], pa.int64())], ["f", "bad", "good"])

    seen = rows.mapInArrow(tally, "f string, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    kept = seen.where("bad >= 3 and bad >= good").orderBy(F.desc(F.expr("(bad - good) * bad / (bad + good)")), "f").limit(MAX_FEATURES).collect()
    at = {r.f: i for i, r in enumerate(kept)}
    named = spark.sparkContext.broadcast(at)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            hits = [sorted({named.value[f] for w in words for f in marks(w, decoder) if f in named.value}) for _, words in words_of(batch, decoder)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("y"), pa.array(hits, pa.list_(pa.int32()))], ["doc_id", "y", "hits"])

    found = rows.mapInArrow(present, "doc_id long, y int, hits array<int>").orderBy("doc_id").collect()
    return fit([list(r.hits) for r in found], [r.y for r in found], [r.f for r in kept])


def fit(hits: list[list[int]], y: list[int], names: list[str], rounds: int = 300, ridge: float = 0.02) -> tuple[float, dict[str, float]]:
    """Logistic regression with non-negative weights on present features, by diagonally scaled gradient steps."""
    if not y or min(y) == max(y) or not names:
        return (-3.0 if not y else 3.0 if min(y) else -3.0), {}
    target = np.asarray(y, np.float64)
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    col = np.fromiter((j for h in hits for j in h), np.int64, len(row))
    curve = 0.25 * np.bincount(col, np.bincount(row, minlength=len(hits))[row], len(names)) + ridge + 1e-9
    w, b = np.zeros(len(names)), -2.0
    for _ in range(rounds):
        z = b + np.bincount(row, w[col], len(hits))
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        w = np.maximum(0, w - (np.bincount(col, g[row], len(names)) + ridge * w) / curve)
        b -= g.sum() / (0.25 * len(y))
    return float(min(b, -1.0)), {n: float(v) for n, v in zip(names, w, strict=True) if v > 1e-6}


class Scorer:
    """Scores of the texts of Arrow batches; remembers which words have features."""

    def __init__(self, model: tuple[float, dict[str, float]], counts: np.ndarray):
        (self.b, self.weights), self.decoder, self.worth = model, Decoder(counts), {}

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.empty(batch.num_rows)
        for i, words in words_of(batch, self.decoder):
            got: dict[str, float] = {}
            for w in words:
                if (v := self.worth.get(w)) is None:
                    v = self.worth[w] = tuple(f for f in marks(w, self.decoder) if f in self.weights)
                for f in v:
                    got[f] = self.weights[f]
            out[i] = 1 / (1 + math.exp(-max(-40.0, min(40.0, self.b + sum(got.values())))))
        if len(self.worth) > 500_000:
            self.worth.clear()
        return out


def score(docs: DataFrame, model: tuple[float, dict[str, float]], counts: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Null and empty texts have no words and score low."""
    shared = docs.sparkSession.sparkContext.broadcast((model, counts))  # at most MAX_FEATURES weights and 29^3 counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.scores(batch))], ["doc_id", "score"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scored = texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whatever their columns, whose text isn't scored toxic."""
    counts = count_trigrams(docs)
    shared = docs.sparkSession.sparkContext.broadcast((train(docs, labels, counts), counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    counts = count_trigrams(docs)
    return score(docs, train(docs, labels, counts), counts)


def op2_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
