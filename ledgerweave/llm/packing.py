"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths.

Documents longer than the largest length are cut into full sequences, each a bin of its own; what is left of every
document is packed. Shards of a bounded number of documents, dealt by row number, are packed independently, so a run of
any size is many equal tasks and no task sees more than about ``per_shard`` rows, whatever their ids.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

#: permitted sequence lengths, and what a sequence costs besides its length, in tokens
CAPACITIES, OVERHEAD = (512, 1024, 2048, 4096, 8192), 64
SCHEMA = "doc_id long, piece long, n_tokens long, bin string, bin_offset long, bin_size long"


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, offset in it, size of each bin); lengths 1..max(capacities), taken longest first.

    An item goes to the open bin that it leaves the least space in. Where none has room, every permitted size is
    tried against the lengths still to come, filled greedily from the longest, and the one with the least cost per
    packed token opens. In the end each bin shrinks to the smallest permitted size that holds its contents.
    """
    sizes = sorted(set(capacities))
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left: dict[int, int] = {}
    for n in lengths:
        left[n] = left.get(n, 0) + 1
    to_come = sum(1 << n for n in left)
    spaces: dict[int, list[int]] = {}
    open_ = 0
    bin_of, offset, used = [0] * len(lengths), [0] * len(lengths), []
    for i in order:
        n = lengths[i]
        left[n] -= 1
        if not left[n]:
            to_come ^= 1 << n
        if wide := open_ >> n:
            space = n + (wide & -wide).bit_length() - 1
            b = spaces[space].pop()
            if not spaces[space]:
                open_ ^= 1 << space
        else:
            space = min((c for c in sizes if c >= n), key=lambda c: ((c + overhead) / _fill(c, n, to_come, left), c))
            b = len(used)
            used.append(0)
        bin_of[i], offset[i] = b, used[b]
        used[b] += n
        if rest := space - n:
            if not spaces.setdefault(rest, []):
                open_ |= 1 << rest
            spaces[rest].append(b)
    return bin_of, offset, [next(c for c in sizes if c >= u) for u in used]


def _fill(size: int, first: int, to_come: int, left: dict[int, int]) -> int:
    """Tokens a bin of ``size`` holds if ``first`` and then always the longest length to come that fits go in."""
    space, full = size - first, size
    while space and (fits := to_come & ((1 << (space + 1)) - 1)):
        n = fits.bit_length() - 1
        take = min(left[n], space // n)
        space -= take * n
        to_come &= (1 << n) - 1
    return full - space


def pack(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, per_shard: int = 16384) -> DataFrame:
    """One row per piece of a document: doc_id, piece, n_tokens, bin, bin_offset, bin_size.

    ``lengths`` has doc_id and n_tokens; other columns are not read. Null or no tokens: one row with n_tokens 0 and null
    bin. Every row is a document of its own, also if its id is null or repeated, and no two share a bin name by
    accident: bins are named by row or shard numbers. Equal lengths are packed in order of id, null last.
    """
    most = max(capacities)
    tokens = F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long")
    numbered = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), tokens.alias("n")).withColumn("row", F.monotonically_increasing_id())
    docs = materialise(numbered, "lengths")  # texts are read once, and row numbers stay
    shards = max(1, -(-docs.count() // per_shard))
    full = docs.where(F.col("n") >= most).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {most} - 1"))))
    name = F.format_string("d%d-%d", "row", "piece")
    whole = full.select("doc_id", "piece", F.lit(most).cast("long").alias("n_tokens"), name.alias("bin"), F.lit(0).cast("long").alias("bin_offset"), F.lit(most).cast("long").alias("bin_size"))
    none = F.lit(None)
    empty = docs.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("piece"), F.col("n").alias("n_tokens"), none.cast("string").alias("bin"), none.cast("long").alias("bin_offset"), none.cast("long").alias("bin_size"))
    rest = docs.select("doc_id", "row", F.expr(f"n div {most}").alias("piece"), (F.col("n") % most).alias("n_tokens")).where("n_tokens > 0")
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        at, offset, size = best_fit(rows["n_tokens"].to_pylist(), capacities, overhead)
        shard = rows["shard"][0].as_py()
        return rows.select(["doc_id", "piece", "n_tokens"]).append_column("bin", pa.array([f"s{shard}-{b}" for b in at], pa.string())).append_column("bin_offset", pa.array(offset, pa.int64())).append_column("bin_size", pa.array([size[b] for b in at], pa.int64()))

    return rest.groupBy("shard").applyInArrow(one, SCHEMA).unionByName(whole).unionByName(empty)


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): white-space words of each whole text; null has none."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n_tokens"))


def op4_best_fit_packing(spark, sf_dir):
    return pack(word_lengths(table(spark, sf_dir, "documents")))
