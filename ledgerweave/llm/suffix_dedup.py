"""Removal of repeated byte strings with per-shard suffix arrays.

A byte is removed when some string of ``length`` bytes that covers it also starts anywhere else in the corpus.

1. Every window of ``length`` bytes has an anchor value: the least hash of its ``gram``-byte substrings. Neighbouring
   windows with one anchor value form a run; equal windows have equal anchors wherever they stand. Runs whose anchor
   value occurs once in the corpus, and once in the run, hold no repeats and go no further.
2. Runs that are left are segments, named by a digest of their bytes. Equal segments of one anchor become one with a
   count, partially before the shuffle, so thousands of copies arrive as one row. An anchor whose only segment occurs
   several times is done: all its windows repeat. Of the other segments the bytes are cut out, once each.
3. Segments are dealt by anchor. A shard concatenates segments up to a bounded size and builds its suffix array by
   Larsson-Sadakane refinement in numpy - groups still tied are sorted by the ranks ``h`` and 2 ``h`` further on, h
   growing threefold until it covers ``length`` - then common prefixes by Kasai's algorithm, lanes of some windows in lock
   step. A window repeats if its common prefix with a neighbour in the array is ``length`` or its segment occurs more than
   once.
4. An anchor whose segments fill several shards is merged across them: windows that are single in their own shard are
   looked up in the other shards' arrays by binary search.
5. An anchor with more bytes than ``hot`` is not given to one task: its windows are dealt again by a further anchor of
   longer substrings, level after level; at the last level the substring is the window itself.

Nothing is dropped or capped on the way; hashes only bring equal strings together, equality is decided on bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, prefix_sums, release, span_hashes, table, text_blocks, text_column

LENGTH, GRAM = 400, 64
#: bytes of segments in one suffix array, and of one anchor's segments in one task
SHARD, HOT = 1 << 20, 1 << 23
#: windows whose common prefixes are found one after the other; lanes of so many are in lock step
LANE = 32


# ------------------------------------------------------------------ anchors

def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w neighbours, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def runs(data: np.ndarray, offs: np.ndarray, length: int, gram: int, salt: int = 0) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor value, repeats inside) of every run of windows with one anchor value."""
    n = np.diff(offs)
    if not len(data) or not (n >= length).any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, bool)
    sums = prefix_sums(data)
    starts = np.arange(len(data) - gram + 1)
    value = span_hashes(sums, starts, starts + gram)
    if salt:
        value = mix(value + np.uint64(salt))
    low = sliding_min(value, length - gram + 1)  # of the window that starts here; also across texts, dropped next
    doc = np.repeat(np.arange(len(n)), n)[: len(low)]
    valid = doc == np.repeat(np.arange(len(n)), n)[length - 1 :]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & valid)
    # windows of one text are contiguous, so a run ends where the next begins or its text has no more windows
    ends = np.append(first[1:], len(low))
    last_window = offs[doc[first] + 1] - length + 1
    count = np.minimum(ends, last_window) - first
    # windows of one run may equal each other if its anchor stands at two places: the only place of the first window
    # is then not the only place of the last one
    wide, several = np.arange(length - gram + 1), np.zeros(len(first), bool)
    for lo in range(0, len(first), 4096):
        f, last = first[lo : lo + 4096], first[lo : lo + 4096] + count[lo : lo + 4096] - 1
        one, two = (value[x[:, None] + wide] == low[f][:, None] for x in (f, last))
        several[lo : lo + 4096] = (one.sum(1) > 1) | (two.sum(1) > 1) | (f + one.argmax(1) != last + two.argmax(1))
    return doc[first], first - offs[doc[first]], count, low[first], several


# ------------------------------------------------------------------ one shard

class Shard:
    """Suffix array of concatenated segments; ``mask``: per position, is the window there equal to another one here."""

    def __init__(self, segments: list[bytes], length: int):
        self.length = length
        self.lens = np.fromiter(map(len, segments), np.int64, len(segments))
        self.begin = np.cumsum(self.lens + 1) - self.lens - 1
        self.size = n = int((self.lens + 1).sum())
        text = np.zeros(n + 8, np.uint16)  # bytes are 1..256; 0 ends a segment
        text[:n] = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
        text[:n] += 1
        text[self.begin + self.lens] = 0
        self.key = np.zeros(n + self.length + 8, np.uint64)
        key = self.key[:n]
        for k in range(7):  # seven letters of nine bits
            key <<= np.uint64(9)
            key |= text[k : k + n]
        left = np.repeat(self.begin + self.lens, self.lens + 1) - np.arange(n)  # letters to the segment's end
        self.fits = left >= self.length
        self.array, least = self._refine(key)
        self.mask = self._repeated(self._kasai(least))

    def _refine(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Larsson-Sadakane: sorts tied groups by the ranks h and 2 h further on until the depth covers the length.

        The last round, and the array it leaves, are of the suffixes that start a window. With it, per suffix: letters
        that it has in common with the one before it in the array at least, -1 where they are fewer than ``length``.
        """
        n = len(key)
        bits = np.uint64((n + 1).bit_length())
        ranks = 2 if 3 * bits <= 64 else 1  # ranks further on that go into one number with a suffix's own
        array = np.argsort(key).astype(np.int32)
        ordered = key[array]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        del ordered
        rank = np.zeros(n + 2 * max(7, self.length), np.uint32)  # behind the end: 0, before all others
        rank[array] = np.flatnonzero(new)[np.cumsum(new, dtype=np.int32) - 1] + 1  # a group's number: where it begins
        h = 7
        while True:
            last = (ranks + 1) * h >= self.length
            if last:
                array = array[self.fits[array]]
                new = np.ones(len(array), bool)
                new[1:] = rank[array[1:]] != rank[array[:-1]]
            tied = ~new
            tied[:-1] |= ~new[1:]
            tied = np.flatnonzero(tied)
            who = array[tied]
            mine = rank[who].astype(np.uint64)
            for k in range(ranks):
                mine <<= bits
                mine |= rank[who + (k + 1) * h]
            order = np.argsort(mine)
            who, mine = who[order], mine[order]
            array[tied] = who
            split = np.ones(len(who), bool)
            split[1:] = mine[1:] != mine[:-1]
            new[tied] = split
            if last:
                break
            rank[who] = (tied[split] + 1)[np.cumsum(split) - 1]
            h *= ranks + 1
        group = np.cumsum(new).astype(np.uint64) << np.uint64(32) | array.astype(np.uint64)
        group.sort()  # equal windows as they stand in the text
        array = (group & np.uint64(0xFFFFFFFF)).astype(np.int32)
        least = np.full(n, -1 if h < self.length else 0, np.int32)
        least[array[1:][rank[array[1:]] == rank[array[:-1]]]] = h
        least[array[1:][~new[1:]]] = self.length
        least[array[:1]] = -1
        return array, least

    def _kasai(self, least: np.ndarray) -> np.ndarray:
        """Per suffix that starts a window: has it ``length`` letters in common with the one before it in the array.

        ``least``: what the refinement knows of them. ``LANE`` windows of a segment are a lane of their own.
        """
        place = np.full(self.size + 1, self.size, np.int32)  # what starts no window stands behind all that do
        place[self.array] = np.arange(len(self.array), dtype=np.int32)
        before = np.full(self.size, -1, np.int32)
        before[self.array[1:]] = self.array[:-1]
        out = np.zeros(self.size, bool)
        fits = np.maximum(0, self.lens - self.length + 1)
        parts = -(-fits // LANE)
        first = LANE * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        left = np.minimum(LANE, np.repeat(fits, parts) - first)
        lanes = np.argsort(-left, kind="stable")
        at, h, left = (np.repeat(self.begin, parts) + first)[lanes], np.zeros(len(lanes), np.int64), left[lanes]
        for step in range(int(left.max(initial=0))):
            live = int(np.searchsorted(-left, -step, "left"))  # lanes with more windows than the step
            i, hh = at[:live] + step, np.maximum(h[:live] - 1, 0)
            j = before[i]
            if step:  # suffixes tied over the sorted depth may stand the other way round one letter on: then start anew
                last = before[i - 1]
                hh[(last < 0) | (place[last + 1] >= place[i])] = 0
            hh = np.where(least[i] < 0, 0, np.maximum(hh, least[i]))
            todo = np.flatnonzero((least[i] >= 0) & (hh < self.length))
            while len(todo):
                a, b = self.key[i[todo] + hh[todo]], self.key[j[todo] + hh[todo]]
                same = a == b
                differ = np.flatnonzero(~same)
                if len(differ):
                    x = a[differ] ^ b[differ]
                    equal = np.zeros(len(differ), np.int64)
                    for k in range(1, 7):
                        equal += x >> np.uint64(9 * (7 - k)) == 0
                    hh[todo[differ]] += equal
                hh[todo[same]] += 7
                todo = todo[same]
                todo = todo[hh[todo] < self.length]
            h[:live] = hh
            out[i] = hh >= self.length
        return out

    def _repeated(self, common: np.ndarray) -> np.ndarray:
        ok = common[self.array]
        out = np.zeros(self.size, bool)
        both = ok.copy()
        both[:-1] |= ok[1:]
        out[self.array] = both
        return out

    def holds(self, other: Shard, at: np.ndarray) -> np.ndarray:
        """Which of another shard's windows stand here too: binary search in the suffix array, seven letters a step."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.array), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._compare(other, at[open_], self.array[mid]) > 0
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        found = np.zeros(len(at), bool)
        inside = np.flatnonzero(lo < len(self.array))
        found[inside] = self._compare(other, at[inside], self.array[lo[inside]]) == 0
        return found

    def _compare(self, other: Shard, at: np.ndarray, here: np.ndarray) -> np.ndarray:
        """Sign of other's window against the suffix here over ``length`` letters."""
        out, todo = np.zeros(len(at), np.int8), np.arange(len(at))
        for k in range(0, self.length, 7):
            a, b = other.key[at[todo] + k], self.key[here[todo] + k]
            if self.length - k < 7:
                cut = np.uint64(9 * (7 - (self.length - k)))
                a, b = a >> cut, b >> cut
            out[todo[a > b]], out[todo[a < b]] = 1, -1
            todo = todo[a == b]
            if not len(todo):
                break
        return out


def repeated_windows(groups: list[tuple[int, list[bytes], list[int]]], length: int, shard: int = SHARD) -> Iterator[tuple[int, int, np.ndarray]]:
    """(group, segment, mask of its windows that repeat) for every segment of groups (key, distinct segments, counts)."""
    alone = [len(segments) == 1 and counts[0] > 1 for _, segments, counts in groups]
    for g, (_, segments, _) in enumerate(groups):
        if alone[g]:  # an anchor's only text, told several times: all its windows repeat, and equal nothing else
            yield g, 0, np.ones(max(0, len(segments[0]) - length + 1), bool)
    flat = [(g, s, counts[s]) for g, (_, segments, counts) in enumerate(groups) if not alone[g] for s in range(len(segments))]
    parts: list[list[tuple[int, int, int]]] = [[]]
    held = 0
    for item in flat:
        n = len(groups[item[0]][1][item[1]])
        if held and held + n > shard:
            parts.append([])
            held = 0
        parts[-1].append(item)
        held += n
    built: list[tuple[Shard, list[tuple[int, int, int]], np.ndarray]] = []
    for part in parts:
        if part:
            made = Shard([groups[g][1][s] for g, s, _ in part], length)
            built.append((made, part, made.mask))
    for x, (one, part, mask) in enumerate(built):
        here = {g for g, _, _ in part}
        for y, (two, other, _) in enumerate(built):
            if x == y or not (shared := here & {g for g, _, _ in other}):
                continue
            mine = np.concatenate([np.arange(one.begin[k], one.begin[k] + max(0, one.lens[k] - length + 1)) for k, p in enumerate(part) if p[0] in shared])
            mine = mine[~mask[mine]]
            mask[mine[two.holds(one, mine)]] = True
    for one, part, mask in built:
        for k, (g, s, count) in enumerate(part):
            n = max(0, int(one.lens[k]) - length + 1)
            yield g, s, np.ones(n, bool) if count > 1 else mask[one.begin[k] : one.begin[k] + n]


# ------------------------------------------------------------------ in Spark

def spans_of(mask: np.ndarray) -> list[int]:
    """Window runs of a mask as start, end, start, end ..."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.tolist()


def content(b: bytes) -> bytes:
    return hashlib.blake2b(b, digest_size=16).digest()


def _search(length: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, list[bytes], list[bytes], list[int]]] = []
        held, here = 0, None

        def flush() -> pa.RecordBatch:
            out_k, out_c, out_s = [], [], []
            groups = [(k, seg, n) for k, _, seg, n in done]
            for g, s, mask in repeated_windows(groups, length, shard):
                if mask.any():
                    out_k.append(done[g][0])
                    out_c.append(done[g][1][s])
                    out_s.append(spans_of(mask))
            return pa.RecordBatch.from_arrays([pa.array(out_k, pa.int64()), pa.array(out_c, pa.binary()), pa.array(out_s, pa.list_(pa.int32()))], ["key", "content", "spans"])

        for batch in batches:
            for key, c, seg, n in zip(*(batch.column(x).to_pylist() for x in ("key", "content", "segment", "n")), strict=True):
                if key != here:
                    if held >= shard:
                        yield flush()
                        done, held = [], 0
                    done.append((key, [], [], []))
                    here = key
                done[-1][1].append(c)
                done[-1][2].append(seg)
                done[-1][3].append(n)
                held += len(seg)
        if done:
            yield flush()

    return run


def _resolve(segments: DataFrame, length: int, gram: int, shard: int, hot: int, level: int = 1) -> DataFrame:
    """(key, content, spans) of the segments (key, content, segment, n) that hold repeated windows."""
    last = gram >= length
    sizes = segments.groupBy("key").agg(F.sum(F.length("segment")).alias("bytes")).where(F.col("bytes") > hot)
    big = None if last else materialise(sizes.select("key"), "hot")
    if last or big.isEmpty():
        cold = segments
    else:
        cold = segments.join(big, "key", "left_anti")
    found = cold.repartition("key").sortWithinPartitions("key", "content").mapInArrow(_search(length, shard), "key long, content binary, spans array<int>")
    if last or big.isEmpty():
        return found
    finer = min(length, length - (length - gram) // 2) if length - gram > 1 else length

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_blocks(batch, "segment"):
                text, first, count, anchor, several = runs(data, offs, length, finer, salt=level)
                raw = data.tobytes()
                begin = offs[text] + first
                cut = [raw[a:b] for a, b in zip(begin.tolist(), (begin + count + length - 1).tolist(), strict=True)]
                at = pa.array(lo + text)
                above = batch.column("key").take(at)
                key = mix(anchor ^ mix(above.to_numpy().view(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [above, batch.column("content").take(at), pa.array(first.astype(np.int32)), pa.array(key), pa.array([content(c) for c in cut], pa.binary()), pa.array(cut, pa.binary()), batch.column("n").take(at), pa.array(several)],
                    ["above", "whole", "first", "key", "content", "segment", "n", "several"],
                )

    sub = materialise(segments.join(big, "key", "left_semi").mapInArrow(again, "above long, whole binary, first int, key long, content binary, segment binary, n long, several boolean"), "finer")
    busy = sub.groupBy("key").agg(F.sum("n").alias("n"), F.max("several").alias("several")).where("n > 1 or several").select("key")
    below = sub.join(busy, "key", "left_semi").groupBy("key", "content").agg(F.sum("n").alias("n"), F.first("segment").alias("segment"))
    deeper = _resolve(materialise(below, "segments"), length, finer, shard, hot, level + 1)
    up = sub.select("above", "whole", "first", "key", "content").join(deeper, ["key", "content"]).select(F.col("above").alias("key"), F.col("whole").alias("content"), F.transform("spans", lambda s: s + F.col("first")).alias("spans"))
    return found.unionByName(up.groupBy("key", "content").agg(F.flatten(F.collect_list("spans")).alias("spans")))  # a segment's own runs


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(row, windows): row numbers are doc keys of ``docs`` (row, body); windows = start, end pairs of repeated windows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offs in text_blocks(batch, "body"):
                text, first, count, anchor, several = runs(data, offs, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(lo + text)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(several)], ["row", "first", "windows", "key", "several"]
                )

    anchors = materialise(docs.mapInArrow(find, "row long, first int, windows int, key long, several boolean"), "anchors")
    busy = materialise(anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("several").alias("several")).where("n > 1 or several").select("key"), "busy")
    places = anchors.join(busy, "key").select("row", F.struct("first", "windows", "key").alias("at"))
    per_row = places.groupBy("row").agg(F.collect_list("at").alias("at"))  # runs of one text: bounded by its bytes

    def told(batch: pa.RecordBatch) -> Iterator[tuple[int, list[dict], list[bytes]]]:
        """Per text: its row, the runs asked for and their bytes."""
        data, offs = text_column(batch.column("body"))
        raw = memoryview(data)
        for i, (row, at) in enumerate(zip(batch.column("row").to_pylist(), batch.column("at").to_pylist(), strict=True)):
            yield row, at, [bytes(raw[offs[i] + x["first"] : offs[i] + x["first"] + x["windows"] + length - 1]) for x in at]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows, runs_, sums = [], [], []
                for row, at, cut in told(batch.slice(lo, 64)):
                    rows += [row] * len(at)
                    runs_ += at
                    sums += map(content, cut)
                firsts, windows, keys = ([x[c] for x in runs_] for c in ("first", "windows", "key"))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(firsts, pa.int32()), pa.array(windows, pa.int32()), pa.array(keys, pa.int64()), pa.array(sums, pa.binary())], ["row", "first", "windows", "key", "content"])

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                runs_, segs = [], []
                for _, at, cut in told(batch.slice(lo, 64)):
                    runs_ += at
                    segs += cut
                keys, sums, n = ([x[c] for x in runs_] for c in ("key", "content", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sums, pa.binary()), pa.array(segs, pa.binary()), pa.array(n, pa.int64())], ["key", "content", "segment", "n"])

    named = docs.join(per_row, "row").mapInArrow(name, "row long, first int, windows int, key long, content binary")
    pieces = materialise(named.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    release(anchors, busy)
    contents = materialise(pieces.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min("piece").alias("piece")), "contents")
    per_key = contents.groupBy("key").agg((F.count(F.lit(1)) == 1).alias("only"))
    known = contents.join(per_key, "key").withColumn("whole", F.col("only") & (F.col("n") > 1))  # an anchor's only content, several times
    asked = known.where("not whole").select("piece", "n").join(pieces, "piece")
    places = asked.groupBy("row").agg(F.collect_list(F.struct("first", "windows", "key", "content", "n")).alias("at"))
    segments = materialise(docs.join(places, "row").mapInArrow(bring, "key long, content binary, segment binary, n long"), "segments")
    spans = _resolve(segments, length, gram, shard, hot)
    spans = spans.unionByName(known.where("whole").select("key", "content", F.lit(None).cast("array<int>").alias("spans")))  # all its windows
    own = F.coalesce(F.transform("spans", lambda s: s + F.col("first")), F.array("first", F.col("first") + F.col("windows")))
    found = pieces.select("row", "first", "windows", "key", "content").join(spans, ["key", "content"])
    return found.select("row", own.alias("windows")).groupBy("row").agg(F.flatten(F.collect_list("windows")).alias("windows"))


def removed_runs(windows: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the windows whose start ranges are given as start, end pairs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(windows[::2], windows[1::2], strict=True)) if windows else ():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + length - 1))
        else:
            out.append((a, b + length - 1))
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, hot: int = HOT, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, the columns named in ``carry``, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes).

    Null counts as empty; texts shorter than ``length`` bytes lose nothing. Rows are told apart by their own number,
    not by id, so repeated or null ids are documents like any other, and repeated rows repeat each other. Columns of
    the input other than id and text are not read.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be 1..length")
    own = docs.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), F.coalesce(text_col, F.lit("")).cast("binary").alias("body"))
    rows = materialise(own.withColumn("row", F.monotonically_increasing_id()), "bodies")
    out = _removed(rows, repeated_spans(rows.select("row", "body"), length, gram, shard, hot), length)
    return out.withColumnsRenamed({"id": id_col} | {f"c{i}": c for i, c in enumerate(carry)})


def _removed(rows: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_column(batch.column("body"))
            raw = data.tobytes() if batch.num_rows else b""
            cut = [removed_runs(w, length) for w in batch.column("windows").to_pylist()]
            kept = []
            for i, spans in enumerate(cut):
                at, parts = int(offs[i]), []
                for a, b in spans:
                    parts.append(raw[at : int(offs[i]) + a])
                    at = int(offs[i]) + b
                parts.append(raw[at : int(offs[i + 1])])
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept_cols), pa.array(np.diff(offs)), pa.array([sum(b - a for a, b in s) for s in cut], pa.int64()), pa.array([len(s) for s in cut], pa.int64()), pa.array(kept, pa.binary())], [*kept_cols, "n_bytes", "n_removed", "n_spans", "kept"]
            )

    kept_cols = [c for c in rows.columns if c not in ("row", "body")]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept_cols)
    return rows.join(windows, "row", "left").select(*kept_cols, "body", "windows").mapInArrow(run, f"{kinds}, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark, sf_dir):
    kept = F.make_valid_utf8(F.col("kept").cast("string"))  # a character that a cut splits becomes U+FFFD
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), kept.alias("text"))
