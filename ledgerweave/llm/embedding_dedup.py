"""Embedding near-duplicates by product quantisation.

Unit vectors fall into coarse inverted lists (k-means centroids) and are stored there as residual codes, one byte per
subspace. A query probes every list whose cell boundary is nearer than ``margin``; in a list, asymmetric table-lookup
distances, widened by the stored quantisation error of each code, drop only vectors that can't reach the threshold;
what is left gets its exact double-precision cosine.

Centroids and codebooks are fitted on a bounded sample (``sample`` distinct vectors); every vector is indexed.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table
from .components import components


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's iterations from k sampled rows; an emptied cell keeps its centre."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


@dataclass
class Index:
    """Coarse centroids (lists, d), distances between them, and codebooks (subspaces, codewords, width)."""

    centres: np.ndarray
    gaps: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int, codewords: int, seed: int = 7) -> Index:
        rng = np.random.default_rng(seed)
        centres = kmeans(x, lists, 8, rng)
        rest = x - centres[nearest(x, centres)]
        width = -(-x.shape[1] // subspaces)
        rest = np.pad(rest, ((0, 0), (0, width * subspaces - x.shape[1])))
        books = [kmeans(rest[:, s * width : (s + 1) * width], codewords, 8, rng) for s in range(subspaces)]
        gaps = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(2), 1e-12))
        return cls(centres, gaps, np.stack(books))

    def split(self, rest: np.ndarray) -> np.ndarray:
        s, _, width = self.books.shape
        return np.pad(rest, ((0, 0), (0, s * width - rest.shape[1]))).reshape(len(rest), s, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(home list, codes, quantisation error, squared distances to all centroids)."""
        far = np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(1), 0)
        home = far.argmin(1)
        parts = self.split(x - self.centres[home])
        codes = np.stack([nearest(parts[:, s], self.books[s]) for s in range(len(self.books))], 1).astype(np.uint8)
        back = self.books[np.arange(len(self.books)), codes]
        return home, codes, np.sqrt(((parts - back) ** 2).sum((1, 2))), far

    def probes(self, home: np.ndarray, far: np.ndarray, margin: float) -> list[np.ndarray]:
        """Lists whose boundary with the home cell is at most ``margin`` from the vector, the home list included."""
        depth = (far - far[np.arange(len(home)), home][:, None]) / (2 * self.gaps[home])
        return [np.flatnonzero(row <= margin) for row in depth]


def unit(raw: list[bytes], width: int) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so no square overflows."""
    x = np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * width else np.float64) for v in raw]).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, width, node): float32 bytes if those hold the vector exactly, else float64; node is 128 bits of their SHA-256.

    All but id are null for vectors that link with nothing.
    """

    def clean(batches):
        for batch in batches:
            v = batch.column(1)
            flat = v.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # null components become NaN
            begin, end = v.offsets.to_numpy()[:-1], v.offsets.to_numpy()[1:]
            known = v.is_valid().to_numpy(zero_copy_only=False)
            raw: list[bytes | None] = []
            for ok, a, b in zip(known.tolist(), begin.tolist(), end.tolist(), strict=True):
                x = flat[a:b] if ok else flat[:0]
                if len(x) and np.isfinite(x).all() and x.any():
                    with np.errstate(over="ignore"):
                        short = x.astype(np.float32)
                    raw.append((short if (short == x).all() else x).tobytes())
                else:
                    raw.append(None)
            width = [None if r is None else b - a for r, a, b in zip(raw, begin.tolist(), end.tolist(), strict=True)]
            node = [None if r is None else hashlib.sha256(b"%d:" % w + r).digest()[:16] for r, w in zip(raw, width, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(raw, pa.binary()), pa.array(width, pa.int32()), pa.array(node, pa.binary())], ["id", "vec", "width", "node"])

    wide = F.col(vec_col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("id"), wide.alias("v")).mapInArrow(clean, "id long, vec binary, width int, node binary")


def near_dedup(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, lists: int | None = None, subspaces: int = 8, codewords: int = 64, sample: int = 16384, margin: float | None = None, chunk: int = 4096
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Equal vectors are one class before anything is compared, so a vector that a third of the rows repeat is one point
    with a weight; its copies are linked with each other and with all that the point is linked with. Null, zero, empty,
    null-holding and non-finite vectors link with nothing: n_links 0, their own component, kept. Vectors of one width
    are compared with each other, each width by an index of its own (the driver loops over the widths that occur). Null
    ids are answered like any other. A list of more than ``chunk`` classes is searched in chunks by different tasks.
    Other columns are not read.

    ``margin`` is how far beyond its own cell a query looks: three deviations of the offset that a link at the threshold
    has along one direction, and never more than that offset itself, so vectors of up to nine components lose nothing.
    A link that only one of its ends finds joins both and counts for the end that found it.
    """
    rows = materialise(vectors(df, id_col, vec_col), "vectors")
    classes = materialise(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("width").alias("width"), F.first("vec").alias("vec")), "classes")
    widths = [(r.width, r["count"]) for r in classes.groupBy("width").count().orderBy("width").collect()]
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    found = None
    for width, total in widths:
        own = classes.where(F.col("width") == width).select("node", "w", "vec")
        margin_ = reach * min(1.0, 3 / math.sqrt(width)) if margin is None else margin
        some = _search(own, width, total, threshold, reach, lists, subspaces, codewords, sample, margin_, chunk)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    groups = components(found.where("other is not null").select("node", "other"))
    named = groups.join(classes.select("node", "rep"), "node", "right").select("node", "rep", F.coalesce("component", "node").alias("component"))
    roots = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    answers = named.join(roots, "component").join(counts, "node", "left").select("node", "component_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    per = classes.select("node", "w").join(answers, "node").select("node", "component_id", (F.col("n") + F.col("w") - 1).alias("n_links"))
    out = rows.select("id", "node").join(per, "node", "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))


def _search(classes: DataFrame, width: int, total: int, threshold: float, reach: float, lists: int | None, subspaces: int, codewords: int, sample: int, margin: float, chunk: int) -> DataFrame:
    """(node, n, other) of classes (node, w, vec) of one width: weights of linked classes, and edges that join them."""
    spark = classes.sparkSession
    fitted = classes.orderBy("node").limit(sample).select("vec").collect()  # at most `sample` vectors
    index = spark.sparkContext.broadcast(Index.fit(unit([r.vec for r in fitted], width), lists or min(1024, max(8, math.isqrt(total))), min(subspaces, width), codewords))

    def place(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                home, codes, error, far = index.value.encode(unit(part.column("vec").to_pylist(), width))
                lists_of = index.value.probes(home, far, margin)
                at = np.repeat(np.arange(len(home)), [len(p) for p in lists_of])
                at = np.concatenate([np.arange(len(home)), at])
                to = np.concatenate([home, *lists_of])
                base = np.arange(len(at)) < len(home)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").take(pa.array(at)), part.column("w").take(pa.array(at)), part.column("vec").take(pa.array(at)), pa.array(to.astype(np.int32)), pa.array(base), pa.array([c.tobytes() for c in codes[at]], pa.binary()), pa.array(error[at])],
                    ["node", "w", "vec", "list", "base", "code", "error"],
                )

    placed = materialise(classes.mapInArrow(place, "node binary, w long, vec binary, list int, base boolean, code binary, error double"), "placed")
    sizes = placed.where("base").groupBy("list").count().collect()  # at most one row per list
    cuts = spark.createDataFrame([(r["list"], -(-r["count"] // chunk)) for r in sizes], "list int, chunks int")
    cut = placed.join(F.broadcast(cuts), "list")
    keyed = cut.where("base").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int")).unionByName(cut.where("not base").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))))
    keyed = keyed.repartition("list", "chunk").sortWithinPartitions("list", "chunk", F.desc("base"))

    def search(batches):
        here, base, state = None, [], None
        for batch in batches:
            keys = list(zip(batch.column("list").to_pylist(), batch.column("chunk").to_pylist(), strict=True))
            flags = batch.column("base").to_pylist()
            lo = 0
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo] and flags[hi] == flags[lo] and hi - lo < 256:
                    hi += 1
                part = batch.slice(lo, hi - lo)
                if keys[lo] != here:
                    here, base, state = keys[lo], [], None
                if flags[lo]:
                    base.append(part)
                elif base:
                    state = state or Chunk(index.value, here[0], base, threshold, reach, width)
                    yield state.answer(part)
                lo = hi

    return materialise(keyed.mapInArrow(search, "node binary, n long, other binary"), "found")


def nodes(column: pa.Array) -> np.ndarray:
    """16-byte names as a numpy column that compares."""
    return np.frombuffer(b"".join(column.to_pylist()), "V16")


class Chunk:
    """The base vectors of one chunk of a list, and the linked sets among them so far."""

    def __init__(self, index: Index, at: int, base: list[pa.RecordBatch], threshold: float, reach: float, width: int):
        whole = pa.Table.from_batches(base)
        self.index, self.centre, self.threshold, self.reach = index, index.centres[at], threshold, reach
        self.k, self.w, self.width = nodes(whole["node"]), whole["w"].to_numpy(), width
        self.x = unit(whole["vec"].to_pylist(), width)
        self.codes = np.stack([np.frombuffer(c, np.uint8) for c in whole["code"].to_pylist()])
        self.error = whole["error"].to_numpy()
        self.root = np.arange(len(self.k))

    def answer(self, part: pa.RecordBatch) -> pa.RecordBatch:
        """Links of some queries: weights of what each is linked with here, and edges that join the linked sets."""
        k, x = nodes(part.column("node")), unit(part.column("vec").to_pylist(), self.width)
        parts = self.index.split(x - self.centre)
        near = np.zeros((len(k), len(self.k)))
        for s, book in enumerate(self.index.books):  # asymmetric distances: one table per query and subspace
            near += ((parts[:, s, None] - book[None]) ** 2).sum(2)[:, self.codes[:, s]]
        q, b = np.nonzero(np.sqrt(near) <= self.reach + self.error + 1e-9)
        ok = (np.einsum("ij,ij->i", x[q], self.x[b]) >= self.threshold) & (k[q] != self.k[b])
        q, b = q[ok], b[ok]
        n = np.bincount(q, self.w[b], len(k)).astype(np.int64)
        ends: list[tuple[bytes, bytes]] = []
        for i in np.unique(q):
            roots = np.unique(self.root[b[q == i]])
            ends += [(k[i].tobytes(), self.k[r].tobytes()) for r in roots]
            if len(roots) > 1:
                self.root[np.isin(self.root, roots)] = roots[0]
        keys, other = [*part.column("node").to_pylist(), *(e[0] for e in ends)], [None] * len(k) + [e[1] for e in ends]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([*n.tolist(), *[0] * len(ends)], pa.int64()), pa.array(other, pa.binary())], ["node", "n", "other"])


def op10_embedding_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "embeddings"))
