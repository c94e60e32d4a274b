"""Exact Jaccard join on word shingles with count-vector R-trees.

Documents with one shingle set are one class. In a total order of all shingles (frequent ones last, else by hash) two
sets of Jaccard similarity t or more share one of the first n - ceil(t n) + 1 shingles of either, so classes meet in
blocks by those. A block proposes pairs: first every class with the block's least one, then - where verified links have
not already joined a block into one component - all that its R-tree can't rule out. The tree holds count vectors:
shingles hashed into groups, the group counts a point; the sum of coordinate-wise minima of a point and a box bounds the
overlap of the point's set with any set in the box. Pairs that survive are verified on the whole sets.

A block that is still open and holds more than ``block`` classes is dealt again by a second shingle of a prefix one
longer (similar sets share two of those), then by a third: no task gets all of it, and its cuts needn't all meet.

Equal shingles are told by 64-bit hashes of their words, and so are equal sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, prefix_sums, release, span_hashes, table, text_blocks
from .components import components

WORDS, PERCENT = 5, 75
#: at most so many frequent shingles are broadcast (8 bytes each); which ones only changes the order, not the result
FREQUENT = 1 << 18
FANOUT = 16
#: at most so many rows that ask for texts are broadcast (about 40 bytes each); beyond, texts are shuffled to them
BROADCAST = 1 << 20
#: so many of a class's lowest blocks are known in each of its blocks; more spares repeated proposals, not results
EARLIER = 16
#: partners of a class verified in one group
GROUP = 256
#: times a large block is dealt again by one shingle more; what is still larger then is cut, and every two cuts meet
DEEPER = 3

BLOCK = "h long, k long, n int, part long, path array<long>"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TURN = np.random.default_rng(99).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a block; fewer words than a shingle has count as one shingle."""
    data = _LOWER[data] if len(data) else data
    space = _SPACE[data]
    begins, ends = ~space, ~space
    first, last = offs[:-1][np.diff(offs) > 0], offs[1:][np.diff(offs) > 0] - 1
    begins[1:] &= space[:-1]
    begins[first] = ~space[first]
    ends[:-1] &= space[1:]
    ends[last] = ~space[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    key = span_hashes(prefix_sums(data), starts, stops)
    at = np.searchsorted(starts, offs)
    rolled = np.zeros(max(0, len(key) - words + 1), np.uint64)
    for j in range(words):
        rolled += key[j : j + len(rolled)] * _TURN[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix((key[a:b] * _TURN[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """64-bit name of a set."""
    return int(mix(np.asarray([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].view(np.int64))


def prefix(s: np.ndarray, frequent: np.ndarray, percent: int, more: int = 0) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles in the common order: not frequent before frequent, then by hash.

    With ``more`` of them added, similar sets share 1 + ``more`` shingles of these, or are equal on all they have.
    """
    n = len(s)
    p = n - (percent * n + 99) // 100 + 1 + more
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        often = frequent[at] == s
        s = np.concatenate([s[~often], s[often]])
    return s[:p]


def verified(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


# ------------------------------------------------------------------ R-trees of count vectors

def groups_for(n: int) -> int:
    """Groups shingles are hashed into for sets of about n: a power of two, about two a shingle, fewer for sets beyond 512; from 4,096 on a quarter."""
    return 1 << max(4, min(n.bit_length() + 1, 10), (n // 4).bit_length())


def count_vector(s: np.ndarray, groups: int) -> bytes:
    """Counts by group: a byte each, or four and a mark should one of them need more."""
    n = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return n.astype(np.uint8).tobytes() if n.max(initial=0) < 256 else n.astype(np.uint32).tobytes() + b"+"


def point(vector: bytes) -> np.ndarray:
    return np.frombuffer(vector[:-1], np.uint32) if len(vector) % 2 else np.frombuffer(vector, np.uint8)


def may_reach(v: np.ndarray, w: np.ndarray, percent: int) -> bool:
    """Whether sets of these count vectors can have the similarity."""
    g = min(len(v), len(w))
    common = int(np.minimum(fold(v[None], g), fold(w[None], g)).sum(dtype=np.int64))
    return (100 + percent) * common >= percent * int(v.sum(dtype=np.int64) + w.sum(dtype=np.int64))


def fold(vectors: np.ndarray, groups: int) -> np.ndarray:
    """Vectors over fewer groups: counts of groups with the same low bits add up."""
    return vectors.reshape(len(vectors), -1, groups).sum(1, dtype=np.uint32) if vectors.shape[1] > groups else vectors


class RTree:
    """Packed R-tree over points in order of size and then of their largest coordinates; boxes keep maxima and size ranges."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((vectors.argmax(1), sizes))
        v, n = vectors[self.order], sizes[self.order]
        self.levels = [(v, n, n)]
        while len(v) > FANOUT:
            cut = np.arange(0, len(v), FANOUT)
            low = np.minimum.reduceat(self.levels[-1][1], cut)
            high = np.maximum.reduceat(self.levels[-1][2], cut)
            v = np.maximum.reduceat(v, cut)
            self.levels.append((v, low, high))

    def search(self, vector: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points whose set may have the similarity with a set of this vector and size."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            v, low, high = self.levels[depth]
            near = (100 * high[at] >= percent * size) & (percent * low[at] <= 100 * size)
            at = at[near]
            bound = np.minimum(v[at], vector).sum(1, dtype=np.int64)
            # overlap o needs 100 o >= percent (size + other - o); the smallest other set of the box needs least
            at = at[(100 + percent) * bound >= percent * (size + np.maximum(low[at], -(-percent * size // 100)))]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def block_pairs(keys: np.ndarray, sizes: np.ndarray, parts: np.ndarray, vectors: list[np.ndarray], percent: int, earlier: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of one block, in different components, that its R-tree can't rule out; the largest component isn't queried.

    ``earlier`` holds, per class, blocks before this one that have the class too (0: none); pairs that meet in one of
    those are proposed there.
    """
    names, counts = np.unique(parts, return_counts=True)
    ask = np.flatnonzero(parts != names[counts.argmax()])
    width = np.fromiter(map(len, vectors), np.int64, len(vectors))
    trees: dict[int, tuple[RTree, np.ndarray]] = {}
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        trees[w] = (RTree(np.stack([vectors[r] for r in rows]), sizes[rows]), rows)
    folded: dict[tuple[int, int], RTree] = {}
    seen = np.zeros(len(keys), bool)
    for i in ask.tolist():
        seen[i] = True
        for w, (tree, rows) in trees.items():
            g = min(w, int(width[i]))
            if max(w, int(width[i])) > 4 * g:
                continue  # sizes that differ this much can't reach any similarity of a half or more
            if g < w:
                if (w, g) not in folded:
                    folded[w, g] = RTree(fold(np.stack([vectors[r] for r in rows]), g), sizes[rows])
                tree = folded[w, g]
            mine = fold(vectors[i][None], g)[0]
            met = rows[tree.search(mine, int(sizes[i]), percent)]
            if earlier is not None:
                met = met[~(np.isin(earlier[met], earlier[i]) & (earlier[met] != 0)).any(1)]
            for j in met.tolist():
                if parts[j] != parts[i] and not seen[j]:
                    yield (int(keys[i]), int(keys[j]))


def reachable(parts: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Rows of a block with a row of another component that is near enough in size."""
    out = np.zeros(len(parts), bool)
    order = np.argsort(sizes, kind="stable")
    n, p = sizes[order], parts[order]
    low = np.searchsorted(n, -(-percent * n // 100), "left")
    high = np.searchsorted(n, 100 * n // percent, "right")
    change = np.concatenate([[0], np.cumsum(p[1:] != p[:-1])])  # components in low..high differ if it changes there
    out[order] = change[high - 1] > change[low]
    return out


# ------------------------------------------------------------------ in Spark

def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, often: int = 4, block: int = 8192) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Null and empty texts, and texts of white space only, have no shingles and link with nothing. Rows that repeat a
    text, an id or both are answered each; a null id is its own component unless linked with an id. ``percent`` must
    be 50 or more. Columns other than id and text are not read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50..100")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def told() -> pa.RecordBatch:
            name = np.concatenate(held)
            held.clear()
            name.sort()
            first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            n = np.diff(np.append(first, len(name)))
            name, n = name[first[n >= often]], n[n >= often]
            none = pa.nulls(len(name), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(name.view(np.int64)), pa.array(n)], ["id", "k", "n", "h", "c"])

        seen: set[int] = set()
        for batch in batches:
            for lo, hi, data, offs in text_blocks(batch, "text"):
                sets = shingle_sets(data, offs, words)
                names = [class_of(s) if len(s) else None for s in sets]
                fresh = []
                for s, k in zip(sets, names, strict=True):
                    if k is not None and k not in seen:
                        seen.add(k)
                        fresh.append(s)
                held += fresh
                size += sum(map(len, fresh))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(names, pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.nulls(hi - lo, pa.int64()), pa.nulls(hi - lo, pa.int64())], ["id", "k", "n", "h", "c"])
                if size > 1 << 22:
                    yield told()
                    size = 0
                    seen.clear()
        if held:
            yield told()

    described = materialise(texts.mapInArrow(describe, "id long, k long, n long, h long, c long"), "shingled")
    rows = described.where("n is not null").select("id", "k", "n")
    top = described.where("h is not null").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(FREQUENT).select("h").collect()
    frequent = spark.sparkContext.broadcast(np.sort(np.asarray([r.h for r in top], np.int64).view(np.uint64)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offs in text_blocks(batch, "text"):
                hs, ks, ns = [], [], []
                for s in shingle_sets(data, offs, words):
                    if len(s) and (k := class_of(s)) not in seen:
                        seen.add(k)
                        hs.append(prefix(s, frequent.value, percent))
                        ks.append(k)
                        ns.append(len(s))
                if hs:
                    many = [len(h) for h in hs]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.repeat(np.asarray(ks, np.int64), many)), pa.array(np.repeat(np.asarray(ns, np.int32), many))], ["h", "k", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (h, k, n) of shingles that two classes or more share; input is sorted by h and k."""
        rest = (np.zeros(0, np.int64),) * 3
        for batch in chain(_noted(batches), [None]):
            if batch is None:
                h, k, n = rest
                whole = len(h)
            else:
                h, k, n = (np.concatenate([r, batch.column(c).to_numpy()]) for r, c in zip(rest, ("h", "k", "n"), strict=True))
                whole = int(np.searchsorted(h, h[-1], "left")) if len(h) else 0
                if len(h) - whole > 1 << 20:
                    whole = len(h)  # a very frequent shingle: told in parts that share their last class
            rest = (h[whole:], k[whole:], n[whole:])
            if batch is not None and whole == len(h) and len(h):
                rest = (h[-1:], k[-1:], n[-1:])
            h, k, n = h[:whole], k[:whole], n[:whole]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
            h, k, n = h[new], k[new], n[new]
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            same[:-1] |= same[1:]
            if same.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[same]), pa.array(k[same]), pa.array(n[same].astype(np.int32))], ["h", "k", "n"])

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of blocks (sorted by h and k) with another of near size in another component; sig and m name a block's rows."""
        for part in _groups(batches, "h"):
            k = part["k"].to_numpy()
            part = part.filter(pa.array(np.concatenate([[True], k[1:] != k[:-1]])))
            near = reachable(part["part"].to_numpy(), part["n"].to_numpy().astype(np.int64), percent)
            if near.any():
                part = part.filter(pa.array(near))
                sig = mix(part["k"].to_numpy().view(np.uint64)).sum(dtype=np.uint64, keepdims=True).view(np.int64)
                m = part.num_rows
                yield from part.append_column("sig", pa.array(np.repeat(sig, m))).append_column("m", pa.array(np.full(m, m, np.int64))).combine_chunks().to_batches()

    def narrowed(blocks: DataFrame) -> DataFrame:
        """Blocks (h, k, n, part, path) less rows that can't reach any other; blocks of equal rows are one."""
        kept = materialise(blocks.repartition("h").sortWithinPartitions("h", "k").mapInArrow(narrow, f"{BLOCK}, sig long, m long"), "narrow")
        one = kept.groupBy("sig", "m").agg(F.min("h").alias("h"))
        out = materialise(kept.join(one, ["sig", "m", "h"], "left_semi").drop("sig", "m"), "open")
        release(kept)
        return out

    def again(more: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, data, offs in text_blocks(batch, "text"):
                    at, blocks, paths = [], [], []
                    for i, (s, path) in enumerate(zip(shingle_sets(data, offs, words), batch.column("path").slice(lo, hi - lo).to_pylist(), strict=True)):
                        used = np.asarray(path, np.int64).view(np.uint64)
                        new = np.setdiff1d(prefix(s, frequent.value, percent, more), used)
                        blocks.append(mix(mix(new) + mix(used).sum(dtype=np.uint64)))  # whatever the order of the path
                        at += [lo + i] * len(new)
                        paths += [[*path, x] for x in new.view(np.int64).tolist()]
                    if at:
                        rows = batch.select(["k", "n", "part"]).take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks).view(np.int64)), *rows.columns, pa.array(paths, pa.list_(pa.int64()))], ["h", "k", "n", "part", "path"])

        return run

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, "g"):
            points = [point(v) for v in part.column("vector").to_pylist()]
            found: list[tuple[int, int]] = []
            low = np.zeros((len(points), EARLIER), np.int64)
            for i, hs in enumerate(part.column("low").to_pylist()):
                before = [h for h in hs if h < part["h"][0].as_py()]
                low[i, : len(before)] = before
            for a, b in block_pairs(part["k"].to_numpy(), part["n"].to_numpy().astype(np.int64), part["part"].to_numpy(), points, percent, low):
                found.append((min(a, b), max(a, b)))
                if len(found) == 1 << 16:
                    yield _pairs(found)
                    found = []
            if found:
                yield _pairs(found)

    prefixes = texts.select("text").mapInArrow(index, "h long, k long, n int")
    shared = materialise(prefixes.repartition("h").sortWithinPartitions("h", "k").mapInArrow(meet, "h long, k long, n int"), "shared")
    classes = materialise(rows.where("k is not null").groupBy("k").agg(F.min("id").alias("rep")), "classes")
    needed = materialise(shared.select("k").distinct(), "needed")
    read = _reader(texts, rows, classes, needed, words)

    least = shared.groupBy("h").agg(F.min_by(F.struct("k", "n"), "k").alias("a"))
    others = materialise(shared.join(least, "h").where("k <> a.k"), "others")  # a block of two has one other: its star is all of it
    release(shared)
    stars = materialise(others.where(f"100 * least(n, a.n) >= {percent} * greatest(n, a.n)").select(F.col("a.k").alias("a"), F.col("k").alias("b")).distinct(), "stars")
    vectors = _vectors(read, needed, words)
    close = _near(stars, vectors, percent)
    links = materialise(_verified(close, read, words, percent), "links")
    release(close)
    parts = components(links)
    joined = others.join(parts, F.col("k") == F.col("node"), "left").select("h", "k", "n", F.coalesce("component", "k").alias("part"))
    about = joined.groupBy("h").agg(F.min("part").alias("p"), F.max("part").alias("q"))
    open_ = about.where("p <> q").select("h")  # those without their least class: its pairs are all tried
    left = narrowed(joined.join(open_, "h").select("h", "k", "n", "part", F.array("h").alias("path")))
    release(others)
    for more in range(1, DEEPER + 1):
        big = materialise(left.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block).select("h"), "big")
        if big.isEmpty():
            break
        finer = read(left.join(big, "h", "left_semi").drop("h")).mapInArrow(again(more), BLOCK)
        left = narrowed(left.join(big, "h", "left_anti").unionByName(finer))
    if not left.isEmpty():
        lowest = left.groupBy("k").agg(F.slice(F.array_sort(F.collect_list("h")), 1, EARLIER).alias("low"))  # bounded by a text's prefix
        placed = _dealt(left.join(lowest, "k"), block).join(vectors, "k")
        more = placed.repartition("g").sortWithinPartitions("g").mapInArrow(propose, "a long, b long").distinct()
        tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        close = materialise(more.join(tried, ["a", "b"], "left_anti"), "proposed")
        links = materialise(links.unionByName(_verified(close, read, words, percent)), "links")
        parts = components(links)
    release(vectors, stars, needed, left)
    named = classes.join(parts, F.col("k") == F.col("node"), "left").select("k", "rep", F.coalesce("component", "k").alias("part"))
    low = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    answer = named.join(low, "part").select("k", "component_id")
    return rows.join(answer, "k", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows with a task group g: a block of more than ``block`` classes is cut, and every two of its cuts meet in a group."""
    cuts = rows.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("k"), F.col("cuts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    dealt = rows.join(cuts, "h").withColumn("own", own).withColumn("other", other)
    g = F.when(F.col("cuts") == 1, F.col("h")).otherwise(F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")))
    return dealt.select("h", "k", "n", "part", "low", g.alias("g"))


def _noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from (b for b in batches if b.num_rows)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.asarray(found, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted batches, as tables."""
    held: list[pa.RecordBatch] = []
    for batch in _noted(batches):
        k = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and held[-1].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _reader(texts: DataFrame, rows: DataFrame, classes: DataFrame, needed: DataFrame, words: int) -> Callable[[DataFrame], DataFrame]:
    """Adds the text of class k to rows that name a class of ``needed``; texts are read from the input again."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_blocks(batch, "text"):
                names = [class_of(s) if len(s) else None for s in shingle_sets(data, offs, words)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.column("text").slice(lo, hi - lo)], ["k", "text"])

    def by_id(named: DataFrame) -> DataFrame:
        at = materialise(named.join(classes.select("k", F.col("rep").alias("id")), "k"), "at")
        return texts.join(F.broadcast(at) if at.count() <= BROADCAST else at, "id").drop("id")

    odd = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null")
    if odd.isEmpty():  # an id names one text
        return by_id
    keyed = materialise(texts.select("text").mapInArrow(name, "k long, text string").join(needed, "k", "left_semi").dropDuplicates(["k"]), "keyed")
    return lambda named: keyed.join(named, "k")


def _vectors(read: Callable[[DataFrame], DataFrame], needed: DataFrame, words: int) -> DataFrame:
    """(k, vector) of the classes that share anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_blocks(batch, "text"):
                vectors = [count_vector(s, groups_for(len(s))) for s in shingle_sets(data, offs, words)]
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(lo, hi - lo), pa.array(vectors, pa.binary())], ["k", "vector"])

    return materialise(read(needed).select("k", "text").mapInArrow(run, "k long, vector binary"), "vectors")


def _led(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as rows (a, slot, k): a's partners in groups of about ``GROUP``, each with a itself too, so none grows with a's partners."""
    cuts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("cuts"))
    dealt = pairs.join(cuts, "a").select("a", F.pmod(F.xxhash64("b"), "cuts").cast("int").alias("slot"), F.col("b").alias("k"))
    partners = materialise(dealt, "partners")
    return partners.unionByName(partners.select("a", "slot", F.col("a").alias("k")).distinct())


def _in_order(rows: DataFrame) -> DataFrame:
    """Groups together, in each a itself before its partners."""
    return rows.repartition("a", "slot").sortWithinPartitions("a", "slot", F.col("a") != F.col("k"))


def _near(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that count vectors don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.zeros(0, np.uint8)
        for batch in batches:
            a, k = (batch.column(c).to_numpy() for c in ("a", "k"))
            ok = np.zeros(len(a), bool)
            for i, v in enumerate(batch.column("vector").to_pylist()):
                if a[i] == k[i]:
                    lead = point(v)
                else:
                    ok[i] = may_reach(lead, point(v), percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(k[ok])], ["a", "b"])

    return materialise(_in_order(_led(pairs).join(vectors, "k")).select("a", "k", "vector").mapInArrow(run, "a long, b long"), "near")


def _verified(pairs: DataFrame, read: Callable[[DataFrame], DataFrame], words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.zeros(0, np.uint64)
        for batch in batches:
            for lo, hi, data, offs in text_blocks(batch, "text"):
                a, k = (batch.column(c).slice(lo, hi - lo).to_numpy() for c in ("a", "k"))
                ok = np.zeros(hi - lo, bool)
                for i, s in enumerate(shingle_sets(data, offs, words)):
                    if a[i] == k[i]:
                        lead = s
                    else:
                        ok[i] = verified(lead, s, percent)
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(k[ok])], ["a", "b"])

    return _in_order(read(_led(pairs))).select("a", "k", "text").mapInArrow(run, "a long, b long")


def op9_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))
