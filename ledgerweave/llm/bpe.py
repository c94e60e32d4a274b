"""Byte-level BPE with a minimal acyclic transducer lexicon.

Frequent words of the corpus are compiled, with their ids, into a minimal acyclic automaton: suffixes are shared, and
integer outputs on arcs add up to a word's rank, which addresses its ids. The flat arrays travel once to each worker,
which maps them into memory. Words the lexicon lacks are merged exactly, so the result never depends on the lexicon.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_blocks, text_column

LEXICON_WORDS = 1 << 15
SPECIAL = "<|endoftext|>"
#: fixed values: the public pattern of byte-level BPE, and the same for texts of the simple characters below
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
SIMPLE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
NOT_SIMPLE = re.compile(rf"[^\t-\r -~{_L}]")


def words(text: str) -> list[str]:
    """The pieces of a text that are merged on their own; joined they are the text."""
    return (PATTERN if NOT_SIMPLE.search(text) else SIMPLE).findall(text)


def byte_letters() -> dict[int, str]:
    """The printable letter byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


# ------------------------------------------------------------------ the lexicon

class Lexicon:
    """A minimal acyclic transducer from byte strings to id sequences, as flat arrays."""

    #: starts: where each rank's ids begin, their end, and last the root state
    KINDS = {"arcs": np.int64, "targets": np.int64, "outputs": np.int64, "starts": np.int64, "ids": np.int32, "final": np.int8}

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        """Adds words in byte order; a state that can no longer change is merged with an equal one (same finality and arcs)."""
        ordered = sorted(w for w in entries if w)
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((byte, target), ...)), children before parents

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, []]]
        last = b""
        for word in ordered:
            keep = len(os.path.commonprefix([word, last]))
            while len(path) > keep + 1:
                at = freeze(path.pop())
                path[-1][1].append((last[len(path) - 1], at))
            path += [[False, []] for _ in word[keep:]]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            at = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], at))
        root = freeze(path[0])
        count: list[int] = []
        arcs, targets, outputs = [], [], []
        for s, (final, out) in enumerate(states):
            n = int(final)
            for byte, to in out:
                arcs.append(s << 8 | byte)
                targets.append(to)
                outputs.append(n)
                n += count[to]
            count.append(n)
        order = np.argsort(np.asarray(arcs, np.int64), kind="stable")
        starts = np.concatenate([[0], np.cumsum([len(entries[w]) for w in ordered])]).astype(np.int64)
        ids = np.asarray([i for w in ordered for i in entries[w]], np.int32)
        final = np.asarray([s[0] for s in states], np.int8)
        arrays = {"arcs": np.asarray(arcs, np.int64)[order], "targets": np.asarray(targets, np.int64)[order], "outputs": np.asarray(outputs, np.int64)[order], "final": final, "starts": np.append(starts, root), "ids": ids}
        return cls(arrays)

    def __len__(self) -> int:
        return len(self.starts) - 2

    def find(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Rank of each key (bytes between neighbouring offsets), or -1; all keys walk the automaton side by side, a byte a step."""
        begin, lens = offs[:-1], np.diff(offs)
        state, rank = np.full(len(lens), self.starts[-1]), np.zeros(len(lens), np.int64)
        at = np.flatnonzero(lens > 0) if len(self.arcs) else np.zeros(0, np.int64)
        rank[lens == 0] = -1
        if not len(self.arcs):
            rank[:] = -1
        step = 0
        while len(at):
            want = state[at] << 8 | data[begin[at] + step]
            arc = np.minimum(np.searchsorted(self.arcs, want), len(self.arcs) - 1)
            hit = self.arcs[arc] == want
            rank[at[~hit]] = -1
            at, arc = at[hit], arc[hit]
            rank[at] += self.outputs[arc]
            state[at] = self.targets[arc]
            step += 1
            ended = lens[at] == step
            rank[at[ended & (self.final[state[at]] == 0)]] = -1
            at = at[~ended]
        return rank

    def pack(self) -> bytes:
        arrays = [np.ascontiguousarray(getattr(self, name), kind) for name, kind in self.KINDS.items()]
        return np.asarray([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def map(cls, packed: bytes) -> Lexicon:
        """Maps packed arrays from a file of the worker's own, which goes away with the mapping."""
        fd, path = tempfile.mkstemp(prefix="lexicon")
        with os.fdopen(fd, "r+b") as f:
            f.write(packed)
            f.flush()
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        os.unlink(path)
        sizes, arrays, at = np.frombuffer(held, np.int64, len(cls.KINDS)), {}, 8 * len(cls.KINDS)
        for (name, kind), n in zip(cls.KINDS.items(), sizes.tolist(), strict=True):
            arrays[name] = np.frombuffer(held, kind, n, at)
            at += arrays[name].nbytes
        return cls(arrays)


# ------------------------------------------------------------------ exact merging

NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Merge ranks and ids of a byte-level BPE file in the tokenizers library's JSON format."""

    #: longer words are merged one by one with a heap, others side by side
    LONG = 64

    def __init__(self, text: str):
        spec = json.loads(text)
        model, letters = spec["model"], byte_letters()
        back = {c: b for b, c in letters.items()}
        raw = lambda token: bytes(back[c] for c in token)
        id_of = {raw(t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
        self.bytes_of = {i: t for t, i in id_of.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of.update({i: t.encode() for t, i in self.special.items()})
        self.size = max(self.bytes_of, default=0) + 1
        pairs = [(raw(a), raw(b)) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        left, right = (np.asarray([id_of[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.asarray([id_of[a + b] for a, b in pairs], np.int32)  # by rank
        key = left * self.size + right
        order = np.argsort(key)
        self.keys, self.rank = key[order], order.astype(np.int32)
        self.letters = np.asarray([id_of[bytes([b])] for b in range(256)], np.int32)
        self.first = self.ranks(np.repeat(self.letters, 256), np.tile(self.letters, 256)).reshape(256, 256)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE for those that aren't merged."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE).astype(np.int32)

    def merge_all(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each word's) - the lowest-ranked neighbouring pair joins first, the leftmost of equals.

        Words of one present length are a matrix of ids; each step joins one pair in each and makes all one shorter.
        """
        lens = np.diff(offs)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for w in np.flatnonzero(lens > self.LONG).tolist():
            done.append((np.asarray([w]), np.asarray([self.merge(data[offs[w] : offs[w + 1]].tobytes())], np.int32)))
        short = np.where(lens > self.LONG, 0, lens)
        who, ids, ranks = np.zeros(0, np.int64), np.zeros((0, 0), np.int32), np.zeros((0, 0), np.int32)
        for n in range(int(short.max(initial=0)), 0, -1):
            fresh = np.flatnonzero(short == n)
            raw = data[offs[fresh][:, None] + np.arange(n)]
            ids = np.concatenate([ids.reshape(len(who), n), self.letters[raw]])
            ranks = np.concatenate([ranks.reshape(len(who), n - 1), self.first[raw[:, :-1], raw[:, 1:]]])
            who = np.concatenate([who, fresh])
            if n == 1 or not len(who):
                done.append((who, ids))
                who = who[:0]
                ids = ranks = np.zeros((0, 0), np.int32)
                continue
            at = ranks.argmin(1)
            low = ranks[np.arange(len(who)), at]
            whole = low == NONE
            done.append((who[whole], ids[whole]))
            who, ids, ranks, at, low = who[~whole], ids[~whole], ranks[~whole], at[~whole], low[~whole]
            row, col = np.arange(len(who)), np.arange(n - 1)
            ids[row, at] = self.made[low]
            ids = np.take_along_axis(ids, col + (col > at[:, None]), 1)
            ranks = np.take_along_axis(ranks, col[:-1] + (col[:-1] >= at[:, None]), 1)
            for shift in (-1, 0):  # the pairs before and after the joined one
                k = np.flatnonzero((at + shift >= 0) & (at + shift < n - 2))
                p = at[k] + shift
                ranks[k, p] = self.ranks(ids[k, p], ids[k, p + 1])
        count = np.zeros(len(lens), np.int64)
        for w, found in done:
            count[w] = found.shape[1]
        begin = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for w, found in done:
            out[begin[w][:, None] + np.arange(found.shape[1])] = found
        return out, count

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word of any length: pairs wait in a heap, parts are a linked list."""
        ids = self.letters[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        first = self.first[np.frombuffer(word[:-1], np.uint8), np.frombuffer(word[1:], np.uint8)].tolist() if n > 1 else []
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapify(heap)
        rank_of = dict(zip(self.keys.tolist(), self.rank.tolist(), strict=True))
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.made[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := rank_of.get(ids[x] * self.size + ids[y])) is not None:
                    heappush(heap, (q, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]


class Coder:
    """Encodes and decodes texts with a vocabulary and a lexicon."""

    _held: dict[bytes, Coder] = {}

    def __init__(self, vocabulary: str, packed: bytes):
        self.vocabulary, self.lexicon = Vocabulary(vocabulary), Lexicon.map(packed)
        self.decimal = pa.array([f"{i}," for i in range(self.vocabulary.size)], pa.large_string())
        self.raw = pa.array([self.vocabulary.bytes_of.get(i, b"") for i in range(self.vocabulary.size)], pa.large_binary())

    @classmethod
    def of(cls, vocabulary: str, packed: bytes) -> Coder:
        """One coder a worker process, whatever number of tasks it runs."""
        key = hashlib.sha256(vocabulary.encode() + packed).digest()
        if key not in cls._held:
            cls._held.clear()
            cls._held[key] = cls(vocabulary, packed)
        return cls._held[key]

    def ids(self, words_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each word's): from the lexicon, merged exactly where it lacks a word."""
        data, offs = text_column(words_)
        rank = self.lexicon.find(data, offs)
        for word, i in self.vocabulary.special.items():
            rank[pc.equal(words_, word).to_numpy(zero_copy_only=False)] = -2 - i
        missing = np.flatnonzero(rank == -1)
        lacked = text_column(words_.take(pa.array(missing)))
        merged, many = self.vocabulary.merge_all(*lacked)
        hit = np.flatnonzero(rank >= 0)
        count = np.ones(len(rank), np.int64)
        count[missing], count[hit] = many, np.diff(self.lexicon.starts[:-1])[rank[hit]]
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        out[begin[rank < -1]] = -2 - rank[rank < -1]
        out[ranges(begin[missing], many)] = merged
        out[ranges(begin[hit], count[hit])] = self.lexicon.ids[ranges(self.lexicon.starts[rank[hit]], count[hit])]
        return out, count

    def encode(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """(number of ids, decimal ids joined by commas, bytes of the decoded ids) of each text."""
        split = [[w for part in self._parts(t) for w in ([part] if part in self.vocabulary.special else words(part))] for t in texts]
        ends = np.cumsum([0, *map(len, split)])
        coded = pa.array(list(chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        distinct, at = coded.dictionary, coded.indices
        ids, count = self.ids(distinct)
        ends_of = np.concatenate([[0], np.cumsum(count)])
        each = np.concatenate([[0], np.cumsum(count[at.to_numpy()])])[ends]
        said, told = text_column(joined(self.decimal, ids, ends_of).take(at))
        told = told[ends]
        spelled = joined(self.raw, ids, ends_of)
        same = spelled.equals(distinct.cast(pa.large_binary()))  # every word's ids decode to the word, so a text's do to the text
        back, spans = (None, None) if same else text_column(spelled.take(at))
        out = []
        for i, t in enumerate(texts):
            line = said[told[i] : max(told[i], told[i + 1] - 1)].tobytes()
            out.append((int(each[i + 1] - each[i]), line, t.encode() if same else back[spans[ends[i]] : spans[ends[i + 1]]].tobytes()))
        return out

    def _parts(self, text: str) -> list[str]:
        if not any(s in text for s in self.vocabulary.special):
            return [text]
        return re.split("(" + "|".join(map(re.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")", text)


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for count[0] numbers, then the same for the next."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def joined(spelled: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """What ids spell, joined between neighbouring ends."""
    data, offs = text_column(spelled.take(pa.array(ids)))
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs[ends])), pa.py_buffer(data)])


# ------------------------------------------------------------------ in Spark

def frequent_words(docs: DataFrame, limit: int = LEXICON_WORDS, keep: int = 1 << 18) -> list[str]:
    """The most frequent words over all whole texts, at most ``limit``; each task keeps a lossy count of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in batches:
            for _, _, data, offs in text_blocks(batch, "text"):
                raw = data.tobytes()
                found = [words(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                told = pa.array(list(chain.from_iterable(found)), pa.large_string()).value_counts()
                n.update(dict(zip(told.field(0).to_pylist(), told.field(1).to_pylist(), strict=True)))
                floor = 1
                while len(n) > keep:
                    n = Counter({w: c for w, c in n.items() if c > floor})
                    floor *= 2
        top = n.most_common(limit)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], ["w", "n"])

    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [r.w for r in counted.orderBy(F.desc("n"), "w").limit(limit).collect()]


def build_lexicon(vocabulary: str, found: list[str]) -> Lexicon:
    spec = Vocabulary(vocabulary)
    plain = [w.encode("utf-8", "replace") for w in found if w not in spec.special]
    ids, count = spec.merge_all(*text_column(pa.array(plain, pa.large_binary())))
    ends = np.cumsum(count).tolist()
    return Lexicon.build({w: ids[end - n : end].tolist() for w, end, n in zip(plain, ends, count.tolist(), strict=True)})


def encode_column(docs: DataFrame, vocabulary: str, lexicon: Lexicon, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids array<int> with decoded text - or, with ``digests``, SHA-256 of both."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, lexicon.pack()))  # the file and at most LEXICON_WORDS words
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(*shared.value)
        for batch in batches:
            for lo, hi, data, offs in text_blocks(batch, "text", 1 << 21):
                raw = data.tobytes()
                got = coder.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
                plain = [d.decode("utf-8", "replace") for _, _, d in got]
                ids = pa.array([sha(i) for _, i, _ in got]) if digests else pa.array([[int(x) for x in i.split(b",")] if i else [] for _, i, _ in got], pa.list_(pa.int32()))
                text = pa.array([sha(t.encode("utf-8")) for t in plain] if digests else plain, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([n for n, _, _ in got], pa.int64()), ids, text], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS, digests: bool = False) -> DataFrame:
    """Ids and decoded text of every document; null counts as empty, repeated rows are each answered."""
    with open(path, encoding="utf-8") as f:
        vocabulary = f.read()
    return encode_column(docs, vocabulary, build_lexicon(vocabulary, frequent_words(docs, lexicon_words)), digests)


def op6_bpe(spark, sf_dir):
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)
