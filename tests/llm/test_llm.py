"""Operators against brute force on small fixtures, and their defined results for odd inputs."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import bpe, embedding_dedup, exact_dedup, html_extract, ngram_join, packing, quality, suffix_dedup, toxicity, url_filter
from ledgerweave.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, row string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(n))


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None, "clash", "clash") for i, t in zip(ids, texts, strict=True)], DOC).repartition(3)


def corpus(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(20, 160)) for _ in range(25)]
    passage = prose(rng, 70)
    out = base + base[:4] + base[:2] + [None, "", " \t\n", "One", "one", "two Words"]
    for t in base[:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [prose(rng, 15) + " " + passage + " " + prose(rng, rng.randint(5, 30)) for _ in range(6)]
    out += ["ab " * 400, "é" * 700, base[3].upper()]
    return out


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs + [(None, 3)], "a int, b int")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_exact(spark):
    texts = corpus()
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256((t or "").encode()).hexdigest())
    odd = exact_dedup.exact_dedup(frame(spark, ["x", "x", "x", "y"], [1, 1, None, None])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in odd) == [("1", "1", 3, True), ("1", "1", 3, True), ("None", "1", 3, False), ("None", "None", 1, True)]
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def brute_suffix(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(b), int(gone.sum()), int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum()), bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return out


@pytest.mark.parametrize("length,gram,shard,hot", [(400, 64, 1 << 20, 1 << 23), (40, 8, 2000, 1 << 23), (40, 8, 1500, 3000), (50, 50, 1 << 20, 1 << 23)])
def test_suffix(spark, length, gram, shard, hot):
    texts = corpus(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(frame(spark, texts), length=length, gram=gram, shard=shard, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_suffix(texts, length)


def test_suffix_odd_rows(spark):
    t = prose(random.Random(1), 100)
    rows = suffix_dedup.suffix_dedup(frame(spark, [t, t, None], [7, 7, None]), carry=("source",)).collect()
    assert sorted((r.n_removed == len(t), r.source) for r in rows) == [(False, "s"), (True, "s"), (True, "s")]
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0


def test_shard_against_sorting():
    rng = np.random.default_rng(5)
    for length in (8, 20):
        segs = [rng.integers(97, 99, int(rng.integers(1, 90)), dtype=np.uint8).tobytes() for _ in range(30)] + [b"a" * 60]
        mine = {(s, i): m for _, s, mask in suffix_dedup.repeated_windows([(0, segs, [1] * len(segs))], length, 200) for i, m in enumerate(mask.tolist())}
        seen = [b[i : i + length] for b in segs for i in range(len(b) - length + 1)]
        want = {(s, i): seen.count(b[i : i + length]) > 1 for s, b in enumerate(segs) for i in range(len(b) - length + 1)}
        assert mine == want


@pytest.mark.parametrize("length", [1, 3, 7, 8, 14, 21, 22, 64])
def test_shard_across_lanes(length):
    rng = np.random.default_rng(length)
    base = rng.integers(97, 123, 300, dtype=np.uint8).tobytes()
    segs = [rng.integers(97, 97 + k, int(rng.integers(0, 200)), dtype=np.uint8).tobytes() for k in (1, 2, 3) for _ in range(5)]
    segs = list(dict.fromkeys([*segs, base, base[7:250], base[40:] + b"x", base[:150] + b"y" + base[150:], b"ab" * 90]))
    windows = [(s, i) for s, b in enumerate(segs) for i in range(len(b) - length + 1)]
    seen = Counter(segs[s][i : i + length] for s, i in windows)
    for shard in (1 << 20, 300):
        found = suffix_dedup.repeated_windows([(0, segs, [1] * len(segs))], length, shard)
        assert {(s, i): m for _, s, mask in found for i, m in enumerate(mask.tolist())} == {(s, i): seen[segs[s][i : i + length]] > 1 for s, i in windows}
    made = suffix_dedup.Shard(segs, length)
    assert sorted(made.array.tolist()) == [int(made.begin[s]) + i for s, i in windows]  # what starts no window is no place to look at


def test_shard_of_one_long_segment():
    """One long segment costs about what its bytes in short ones cost: its windows aren't gone through one by one."""
    text = np.random.default_rng(3).integers(97, 123, 120_000, dtype=np.uint8).tobytes()
    text += text[:60_000]
    took = []
    for segs in ([text[i : i + 1800] for i in range(0, 60_000, 1800)] + [text[i : i + 1801] for i in range(60_000, len(text), 1801)], [text]):
        runs = []
        for _ in range(3):
            start = time.process_time()
            made = suffix_dedup.Shard(segs, 400)
            runs.append(time.process_time() - start)
        took.append(min(runs))
    assert int(made.mask.sum()) == 2 * (60_000 - 399)
    assert took[1] < 8 * took[0]


def brute_passages(texts):
    import corpus_pipeline

    return brute_suffix(texts, corpus_pipeline.PASSAGE)


def brute_ngrams(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("block,often", [(8192, 4), (3, 1), (12, 4)])
def test_ngram_join(spark, block, often):
    rng = random.Random(8)
    texts = corpus(4)
    long = prose(rng, 60).split()
    for _ in range(25):  # a family around the threshold
        w = list(long)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 9)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, texts), block=block, often=often).collect()}
    assert got == brute_ngrams(texts)


def test_ngram_odd_rows(spark):
    t = prose(random.Random(1), 40)
    got = sorted(((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.ngram_join(frame(spark, [t, t, t + " x", None], [5, None, 3, 9])).collect()))
    assert got == [("3", 37, "3"), ("5", 36, "3"), ("9", 0, "9"), ("None", 36, "3")]
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0


def test_rtree_never_loses():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 62, int(rng.integers(30, 60)), dtype=np.uint64)) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[: len(s) - 3], rng.integers(0, 1 << 62, 2, dtype=np.uint64)])) for s in sets[:30]]
    keys, sizes = np.arange(len(sets)), np.asarray(list(map(len, sets)))
    vectors = [ngram_join.point(ngram_join.count_vector(s, ngram_join.groups_for(len(s)))) for s in sets]
    found = {tuple(sorted(p)) for p in ngram_join.block_pairs(keys, sizes, keys, vectors, 75)}
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if ngram_join.verified(sets[a], sets[b], 75)}
    assert want <= found and len(found) < len(sets) ** 2 / 8


def test_counts_beyond_a_byte():
    s = np.arange(0, 16 * 300, 16, dtype=np.uint64)  # one group holds all 300
    v = ngram_join.point(ngram_join.count_vector(s, 16))
    assert v[0] == 300 and v.sum() == 300 and ngram_join.may_reach(v, v, 100)


def test_reachable():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        parts, sizes = rng.integers(0, 3, n), rng.integers(1, 12, n)
        want = [any(parts[i] != parts[j] and 100 * min(sizes[i], sizes[j]) >= 75 * max(sizes[i], sizes[j]) for j in range(n)) for i in range(n)]
        assert ngram_join.reachable(parts, sizes, 75).tolist() == want


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x = np.concatenate([x, x[:60] + rng.normal(size=(60, 16)) * 0.08, x[:5], x[:5] * 2]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [], 0), (904, [1.0] * 3, 0), (905, [None] * 16, 0)]
    got = {r.vec_id: r for r in embedding_dedup.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), lists=8, margin=2.0, chunk=40).collect()}
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    link = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    label = np.arange(len(u))
    for _ in range(len(u)):
        label = np.minimum(label, np.where(link, label[None], len(u)).min(1))
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(u))] == [(int(link[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(len(u))]
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 906))
    far = [(1, [1e300] * 8), (2, [1e300] * 8), (3, [2e299] * 8), (4, [1.0] * 3), (5, [2.0] * 3), (6, [1.0] * 8), (6, [-1.0] * 8), (None, [1.0] * 3), (8, [1e-320] * 3)]
    got = embedding_dedup.near_dedup(spark.createDataFrame([(*r, "clash") for r in far], "vec_id long, embedding array<double>, node string")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == [("1", 3, 1), ("2", 3, 1), ("3", 3, 1), ("4", 3, 4), ("5", 3, 4), ("6", 0, 6), ("6", 3, 1), ("8", 3, 4), ("None", 3, 4)]
    assert embedding_dedup.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_recall_as_registered(spark):
    """Every hundredth vector against all, production parameters."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64))
    x[3000:] = x[rng.integers(0, 600, 3000)] + rng.normal(size=(3000, 64)) * 0.27
    x = x.astype(np.float32)
    got = {r.vec_id: r for r in embedding_dedup.near_dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    ask = np.arange(0, len(u), 100)
    want = (u[ask] @ u.T >= 0.95).sum(1) - 1
    mine = np.asarray([got[i].n_links for i in ask.tolist()])
    assert want.sum() > 40 and (mine <= want).all() and mine.sum() >= 0.9 * want.sum()


def test_embedding_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    x = np.concatenate([x, x[:600] + rng.normal(size=(600, 64)) * 0.3])
    x /= np.sqrt((x * x).sum(1))[:, None]
    ix = embedding_dedup.Index.fit(x, 56, 8, 64)
    home, _, _, far = ix.encode(x)
    probes = ix.probes(home, far, 0.12)
    a, b = np.nonzero((x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool))
    assert len(a) > 500 and np.mean([home[j] in probes[i] for i, j in zip(a, b, strict=True)]) >= 0.99


def test_packing(spark):
    rng = random.Random(3)
    lengths = [rng.randint(1, 900) for _ in range(400)] + [0, None, 8192, 20_000, 8191]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    rows = packing.pack(df).collect()
    for i, n in enumerate(lengths):
        assert sum(r.n_tokens for r in rows if r.doc_id == i) == (n or 0)
    bins = {}
    for r in rows:
        if r.bin:
            bins.setdefault((r.bin, r.bin_size), []).append((r.bin_offset, r.n_tokens))
    for (_, size), items in bins.items():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert size == min(c for c in packing.CAPACITIES if c >= at)
    used = sum(n or 0 for n in lengths)
    assert sum(size for _, size in bins) < 1.06 * used
    assert packing.best_fit([6, 5, 4, 3, 2], [10], 0)[2] == [10, 10]
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
    big = 2**60 + 1
    odd = packing.pack(spark.createDataFrame([(7, 9000, "x")] * 2 + [(None, 8192, "x")] * 2 + [(None, 10, "x"), (big, 10, "x")], "doc_id long, n_tokens long, row string")).collect()
    full = [r.bin for r in odd if r.n_tokens == 8192]
    assert len(full) == len(set(full)) == 4 and {r.doc_id for r in odd} == {7, None, big}
    assert len({(r.bin, r.bin_offset) for r in odd}) == len(odd) == 8


def test_packing_against_every_packing():
    rng = random.Random(5)
    cost = lambda sizes, over: sum(s + over for s in sizes)

    def best(items, loads, caps, over):
        if not items:
            return sum(min(c for c in caps if c >= x) + over for x in loads)
        n, rest = items[0], items[1:]
        found = [best(rest, [*loads, n], caps, over)]
        found += [best(rest, [*loads[:i], x + n, *loads[i + 1 :]], caps, over) for i, x in enumerate(loads) if x + n <= max(caps)]
        return min(found)

    ratio = []
    for _ in range(60):
        caps, over = (8, 16, 32), rng.choice([0, 1, 4])
        items = [rng.randint(1, 32) for _ in range(rng.randint(1, 6))]
        ratio.append(cost(packing.best_fit(items, caps, over)[2], over) / best(items, [], caps, over))
    assert min(ratio) >= 1 and max(ratio) <= 1.5 and sum(ratio) / len(ratio) < 1.06


def test_shards_are_dealt_by_row(spark):
    rows = packing.pack(spark.range(3000).selectExpr("cast(null as long) AS doc_id", "7L AS n_tokens"), per_shard=500)
    sizes = [r["count"] for r in rows.groupBy(F.split("bin", "-")[0]).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 700


def test_bpe(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = corpus(6)[:40] + ["It's we'll  two   spaces\n\n x\t", "naïve Straße 日本語 ١٢ ½ ²x  y z \x1c\x85", "<|endoftext|>a<|endoftext|>", "😀👍🏽 é", "a" * 5000, None]
    got = {r.doc_id: r for r in bpe.encode(frame(spark, texts), path, lexicon_words=100).collect()}
    for i, t in enumerate(texts):
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert (list(got[i].ids), got[i].n_tokens, got[i].decoded) == (ids, len(ids), own.decode(ids, skip_special_tokens=False)), t


def test_lexicon_is_minimal_and_exact():
    rng = random.Random(9)
    entries = {("".join(rng.choice("ab") for _ in range(rng.randint(1, 8)))).encode(): [rng.randrange(99) for _ in range(rng.randint(1, 3))] for _ in range(200)}
    lex = bpe.Lexicon.map(bpe.Lexicon.build(entries).pack())
    keys = [bytes(k) for n in range(1, 9) for k in itertools.product(b"abc", repeat=n)]
    find = lambda lex, keys: lex.find(np.frombuffer(b"".join(keys), np.uint8), np.cumsum([0, *map(len, keys)])).tolist()
    assert all((r < 0) == (k not in entries) and (r < 0 or lex.ids[lex.starts[r] : lex.starts[r + 1]].tolist() == entries[k]) for k, r in zip(keys, find(lex, keys), strict=True))
    tails = bpe.Lexicon.build({w + b"ing": [1] for w in (b"a", b"b", b"cd", b"e")})
    assert len(tails.final) < 4 * 4  # suffixes are shared
    assert find(bpe.Lexicon.build({}), [b"a", b""]) == [-1, -1] and find(lex, [b""]) == [-1]


def test_merging_side_by_side():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    own, spec = Tokenizer.from_file(path), bpe.Vocabulary(open(path, encoding="utf-8").read())
    rng = random.Random(4)
    words = ["", "a", *("".join(rng.choice("aeinorstü日") for _ in range(rng.randint(1, 90))) for _ in range(400)), "no" * 3000]
    raw = [w.encode() for w in words]
    ids, count = spec.merge_all(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    ends = np.cumsum(count)
    for w, r, n, end in zip(words, raw, count, ends, strict=True):
        want = own.encode(w, add_special_tokens=False).ids
        assert ids[end - n : end].tolist() == want == (spec.merge(r) if r else []), w


def test_bpe_odd_rows(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    assert bpe.encode(frame(spark, []), path).count() == 0
    got = bpe.encode(frame(spark, ["a b", "a b", None, ""], [1, 1, None, 2]), path, digests=True).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 2), ("1", 2), ("2", 0), ("None", 0)]
    assert {r.decoded_sha256 for r in got if r.n_tokens} == {hashlib.sha256(b"a b").hexdigest()}


def test_html(spark):
    main = "<article><h1>Title</h1><p>One &amp; two\n three.</p><p>Short.</p><p><b>Open<br><p>Next one.</article>"
    page = f"<html><head><title>no</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- x --><div class='ad'>Buy this now.</div>{main}<script>var x='<p>';</script><div id='comments'><p>I like it.</p></div><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<div>" * 3000)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Title\n\nOne & two three.\n\nShort.\n\nOpen\n\nNext one." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    rng = np.random.default_rng(77)
    pages = [html_extract.labelled_page(rng) for _ in range(120)]
    field = html_extract.trained()
    right = [a == b for p, y in pages if p for a, b in zip(field.decode(p), y, strict=True)]
    assert np.mean(right) > 0.95


@pytest.mark.parametrize("page,want", [
    ("<html><head><title>x</title><body><article><p>Said.</p></article>", ["Said."]), ("<head><title>x</title><meta a=b><p>Said.</p>", ["Said."]),
    ("<head><title>x <b>y</b> < z</title> <link a>\n<b>Said.</b>", ["Said."]), ("<head><title>x</title><noscript><p>no</p></noscript></head><p>Said.</p>", ["Said."]), ("<head><title>x<body>Said.", ["Said."]),
    ("<p>One <svg class=i/> two.</p><p>Three.</p>", ["One two.", "Three."]), ("<p>One <math/> two.</p><svg><text>no</text></svg><p>Three.</p>", ["One two.", "Three."]),
    *[(f"<p>One <{t} class=i> two.</p><p>Three.</p><{t}>no</{t}><p>Four.</p>", ["One two.", "Three.", "Four."]) for t in ("svg", "select", "iframe", "object", "canvas", "math", "noscript", "template")],
    ("<p>One.</p><object><object>no</object>no</object><p>Two.</p>", ["One.", "Two."]), ("<script-like>One.</script-like>", ["One."]), ("<p>One.</p><script>no <p>no</p>", ["One."]), ("<p>One.</p><!-- <p>no", ["One."]),
])
def test_html_hides_no_more_than_it_must(page, want):
    assert [b[1] for b in html_extract.blocks(page)] == want


def test_viterbi_is_best_path():
    field = html_extract.Field({"bias": 0.3, "own:p": 0.4, "own:li": -1.1, "open": 0.2}, np.array([[0.7, -0.4], [-0.2, 0.5]]))
    page = [((t,), x, 0.0, False) for t, x in (("p", "a."), ("li", "b"), ("li", "c."), ("p", "d"), ("li", "e"))]
    u = field.unary(page)
    worth = lambda y: sum(u[i] for i in range(5) if y[i]) + sum(field.steps[y[i], y[i + 1]] for i in range(4))
    assert worth(field.decode(page)) == pytest.approx(max(worth(y) for y in itertools.product((0, 1), repeat=5)))


def test_urls(spark):
    rows = [
        (1, "http://A.example.NET/en/1?x#y", None), (2, "https://a.example.net/", None), (3, None, None), (4, "no scheme", ""), (5, "http://example.org", "<link rel='canonical' href='http://bad.net/x'>"),
        (6, "http://example.org/q", '<meta http-equiv="refresh" content="0; url=http://example.org/fr/ok">'), (7, "http://example.com/de/1", None), (8, "http://x.org/a", '<link href="/b" rel="canonical">'), (9, "http://x.org/b", "<link rel=canonical href=http://bad.net/x>"),
        (10, "http://y.org/z", '<link rel="canonical" href="http://example.org">'), (11, "http://y.org/z", None),
    ]
    got = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("net/", "block") and (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("", "", None, "allow")
    assert got[7].verdict == "block" and got[4].verdict == "allow"
    odd = [(1, "http://a.net/x\x01y/z", None), (1, "http://a.net/x\x01y/z", None), (None, "http://q.org/1", "<!-- <link rel=canonical href=http://bad.net/x> --><script>'<link rel=canonical href=http://bad.net/x>'</script>"), (2, "http://q.org/2", "<link rel=canonical href='http&#58;//bad&#x2e;net&#x2F;x'>"), (3, "http://q.org/3", "<!-- open <link rel=canonical href=http://bad.net/x>")]
    frame_ = spark.createDataFrame([(*r, "clash") for r in odd], "page_id long, url string, html string, node string")
    got_ = sorted((str(r.page_id), r.host, r.rule, r.verdict) for r in url_filter.url_filter(frame_).collect())
    assert got_ == [("1", "a.net", "net/", "block")] * 2 + [("2", "q.org", None, "block"), ("3", "q.org", None, "allow"), ("None", "q.org", None, "allow")]
    assert url_filter.url_filter(frame_.limit(0)).count() == 0
    assert [got[i].verdict for i in (5, 6, 8, 9, 10, 11)] == ["block", "allow", "block", "block", "block", "block"]
    assert [got[i].rule for i in (5, 6, 8)] == [None] * 3


def test_relative_urls(spark):
    bases = ["http://x.org", "http://x.org/", "https://x.org/a/b/c.html?q=1#f", "http://x.org/a/b/", "http://X.org?z/y"]
    refs = "page2.html ../x ../../../x ./ . .. ?id=3 #top a/./b/../c /y/../z //y.org/k/. http://z.org/d/../e g;x=1/../y ..g ../a/.. .well-known/u ?u=../v /a/..".split()
    got = spark.createDataFrame([(b, r, urljoin(b, r)) for b in bases for r in refs], "b string, r string, want string")
    rows = got.select("b", "r", url_filter.node(url_filter.resolve(F.col("r"), F.col("b"))).alias("got"), url_filter.node(F.col("want")).alias("want")).collect()
    assert [(r.b, r.r, r.got) for r in rows] == [(r.b, r.r, r.want) for r in rows]
    assert {r.got for r in rows} >= {"x.org/a/b/page2.html", "x.org/a/x", "x.org/a/b/c.html?id=3", "x.org/z"}
    lost = spark.createDataFrame([("mailto:a@b.c", "http://x.org/"), ("", "http://x.org/"), ("x", "no scheme"), ("x", None), (None, "http://x.org/")], "r string, b string")
    assert [r[0] for r in lost.select(url_filter.resolve(F.col("r"), F.col("b"))).collect()] == [None] * 5
    pages = [
        (1, "http://a.org/d/1", "<link rel=canonical href='../../bad/2'>"), (2, "http://a.org/bad/2", "<link rel=canonical href='?id=3'>"), (3, "http://a.org/bad/2?id=3", '<meta http-equiv=refresh content="0; url=http://b.net/">'),
        (4, "http://c.org/d/", '<meta http-equiv=refresh content="0; url=index.html">'), (5, "http://c.org/d/index.html", "<base href='//b.net/k/'><link rel=canonical href=l>"), (6, "http://c.org/d/other.html", None),
    ]
    got = url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.verdict for r in got} == dict(zip(range(1, 7), ["block"] * 5 + ["allow"], strict=True))


def test_toxicity_restores(spark):
    rng = random.Random(1)
    texts = [prose(rng, 30).translate(str.maketrans("", "", "0123456789")) + f" you {rng.choice(['idiot', 'scum']) if i % 4 == 0 else 'friend'} there" for i in range(160)]
    docs = frame(spark, texts + ["you id10t", "what scuuuum", "you i d i o t", "", None])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(160))
    assert [got[i].predicted for i in (160, 161, 162, 163, 164)] == [1, 1, 1, 0, 0]
    assert toxicity.clean(docs, labels).columns == docs.columns
    assert toxicity.toxicity(frame(spark, []), labels.limit(0)).count() == 0


def test_decoder_is_best_reading():
    counts = np.zeros(29**3, np.int64)
    for w in ("idiot", "sit", "to", "lot"):
        c = [0, 0, *(ord(x) - 96 for x in w), 0]
        for i in range(len(c) - 2):
            counts[(c[i] * 29 + c[i + 1]) * 29 + c[i + 2]] += 20
    d = toxicity.Decoder(counts)

    def worth(path):
        x, y, t = 0, 0, 0.0
        for c in "".join(path):
            t += d.log[x, y, d.code(c)] + d.bonus
            x, y = y, d.code(c)
        return t + d.log[x, y, 0]

    for word in ("1d10t", "s!t", "l00t", "idiooot"):
        best = max(itertools.product(*d.lattice(word)), key=worth)
        assert worth([d.restore(word)]) == pytest.approx(worth(best))
    assert d.restore("1d10t") == "idiot" and d.restore("idiooot") == "idiot"


def decoder_of(*words):
    """A decoder whose counts are of texts that say each word many times."""
    text = np.frombuffer(" ".join(("", *words, "")).encode() * 50, np.uint8)
    c = toxicity._LETTERS[text]
    return toxicity.Decoder(np.bincount((c[:-2] * 29 + c[1:-1]) * 29 + c[2:], minlength=29**3))


def test_long_disguises():
    d = decoder_of("idiot", "sit", "to", "lot")
    assert "idiot" in toxicity.readings("an 1di" + "o" * 70 + "t here", d, True)
    assert len(d.restore("1dlot" * 4000)) >= 16_000


def test_gaps_and_repeats():
    d = decoder_of("you", "are", "idiot", "stupid", "scum", "clown", "a")

    def read(text):
        data = np.frombuffer(text.encode(), np.uint8)
        found = toxicity.readings(text, d, bool(toxicity.suspects(data, np.array([0, len(data)]))[0]))
        return {f for w in found for f in toxicity.marks(w, d)}

    assert {"=a", "=idiot"} <= read("you are a i d i o t") and {"=stupid", "=idiot"} <= read("s t u p i d i d i o t")
    assert "=scum" in read("s c u u u u m") & read("s  c  u  m") & read("s.c.u.m") & read("scuum") & read("sscumm")
    assert "=idiot" in read("idi" + "o" * 70 + "t")
    assert "=clown" in read("cl0000wn") & read("cl0o0wn") and "=clown" in read("c l 0 0 w n")
    assert {"=you", "=are", "=stupid", "=scum"} <= read("y o u a r e s t u p i d  s c u m " * 5)
    for word in ("aidiot", "youscum", "zz", "a"):
        worth = {}
        for cuts in itertools.product(("", " "), repeat=len(word) - 1):
            text = word[0] + "".join(g + c for g, c in zip(cuts, word[1:], strict=True))
            codes = [0, 0, *map(d.code, text), 0]
            worth[text] = sum(d.log[codes[i], codes[i + 1], codes[i + 2]] for i in range(len(text) + 1))
        near = max(worth.values()) - toxicity.NEAR
        assert d.parts(word) == {w for text, v in worth.items() if v >= near for w in text.split()}


def test_quality(spark):
    rng = random.Random(5)
    texts = [prose(rng, 40) if i % 3 else " | ".join(prose(rng, 30).split()) for i in range(150)] + ["", None]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert all(got[i].predicted == (i % 3 > 0) for i in range(150)) and all(0 <= got[i].score <= 1 for i in got) and len(got) == 152
    assert any(r.held_out for r in got.values())
    assert quality.fit_rules(np.zeros((0, len(quality.STATS))), np.zeros(0)) == (0.0, [])


def test_trees_see_every_row(monkeypatch):
    seen, grow = [], quality.grow
    monkeypatch.setattr(quality, "grow", lambda x, target, rows, depth, path, out: (seen.append(len(rows)) if not path else None, grow(x, target, rows, depth, path, out))[1])
    x = np.random.default_rng(2).normal(size=(9000, len(quality.STATS)))
    quality.fit_rules(x, (x[:, 0] > 0).astype(float), trees=3)
    assert seen == [9000] * 3


def test_rules_compile_to_the_same_score(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.STATS)))
    b, rules = quality.fit_rules(x, (x[:, 3] + x[:, 5] > 0).astype(float), trees=6)
    want = quality.sigmoid(b + sum(w * quality.holds(r, x) for r, w in rules))
    df = spark.createDataFrame(x[:50].tolist(), ", ".join(f"{s} double" for s in quality.STATS))
    assert np.allclose([r[0] for r in df.select(quality.compile_rules(b, rules)).collect()], want[:50])
    assert len(rules) < 60


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(12)
    texts = corpus(7) + [f"{prose(rng, 12)} idiot {prose(rng, 12)}" for _ in range(40)]
    bad = {i for i, t in enumerate(texts) if t and "idiot" in t}
    folder = str(tmp_path / "sf")
    docs = frame(spark, texts).select(*P.COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in bad)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    left = {i: t or "" for i, t in enumerate(texts) if i not in bad}
    left = {i: t for i, t in left.items() if i == max(j for j, u in left.items() if u == t)}
    order = sorted(left)
    comp = brute_ngrams([left[i] for i in order])
    kept = [i for k, i in enumerate(order) if comp[k][1] == k]
    cut = brute_passages([left[i] for i in kept])
    want = sorted((i, len(re.findall(rb"[^\x20\x09-\x0D]+", c[3]))) for i, c in zip(kept, cut, strict=True))
    got = P.run(spark, folder).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert sorted((r.doc_id, r.n) for r in got) == want
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "suffix_dedup", "packing"]


def test_pipeline_odd_ids(spark):
    import corpus_pipeline as P

    near = prose(random.Random(2), 60)
    rows = [(None, "X"), (None, "Y"), (9, "X"), (9, "Z"), (9, "Z"), (8, "Z"), (None, "N"), (None, "N"), (7, None), (7, "")]
    told = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    got = P.exact_stage(spark, frame(spark, [t for _, t in rows], [i for i, _ in rows]), "")
    assert got.columns == list(P.COLUMNS)
    assert [(i, t or "") for i, t in told(got)] == [("7", ""), ("9", "X"), ("9", "Z"), ("None", "N"), ("None", "Y")]
    rows = [(None, near), (None, near + " a"), (4, near + " b"), (4, near + " c"), (5, near + " d"), (None, "alone"), (None, "lone"), (4, "other")]
    got = told(P.ngram_stage(spark, frame(spark, [t for _, t in rows], [i for i, _ in rows]), ""))
    assert got in [sorted([("4", near + e), ("4", "other"), ("None", "alone"), ("None", "lone")]) for e in (" b", " c")]
