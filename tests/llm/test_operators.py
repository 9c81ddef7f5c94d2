"""Every operator against a brute-force version, on odd rows, empty tables and clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import (chat_format, exact_dedup, fingerprints, html_extract, lattice_lm, line_dedup, mixing, near_dups, packing, toxicity)

from .conftest import rows

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def split(t):
    return (t or "").encode().lower().split()


# exact dedup

@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_owners(odd, clashing, none, keep):
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[t or ""].append(i)
    pick = max if keep == "largest" else min
    want = Counter()
    for t, ids in groups.items():
        own = pick((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, own, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    for docs in (odd, clashing):
        got = exact_dedup.exact_owners(docs, keep).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert len(kept) == len(groups) and set(kept.values()) == {1}
    assert exact_dedup.exact_owners(none, keep).collect() == []


def test_small_tries_spill(odd):
    want = sorted(map(str, exact_dedup.exact_owners(odd).select("doc_id", "keep_id", "group_size").collect()))
    got = exact_dedup.exact_owners(odd, trie_bytes=500).select("doc_id", "keep_id", "group_size").collect()
    assert sorted(map(str, got)) == want


def test_spills_take_no_walk_of_all_strings():
    import time
    trie, out, t = exact_dedup.PatriciaTrie(), 0, time.time()
    for i in range(40_000):  # 120 MB in a trie of 8 MB
        key = hashlib.sha256(str(i).encode()).digest() + bytes(3000)
        trie.terminal(key)[1] = i
        if trie.size > 8 << 20:
            while trie.size > 4 << 20:
                first = trie.largest_subtree()
                out += sum(1 for _ in trie.strings(first))
                trie.drop(first)
    assert out + sum(1 for _ in trie.strings()) == 40_000 and time.time() - t < 10
    for first in list(trie.sizes):
        trie.drop(first)
    assert trie.size == 0 and not trie.root[0]


def test_trie_is_exact_where_hashes_meet(monkeypatch, odd):
    trie = exact_dedup.PatriciaTrie()
    random.seed(3)
    keys = {bytes(random.choices(b"ab", k=random.randint(0, 9))) for _ in range(300)}
    for k in keys:
        trie.terminal(k)[1] = k
    assert {v for _, v in trie.strings()} == keys == {k for k, _ in trie.strings()}


# packing

def test_pack(odd, clashing, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, *_ in rows():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    for docs in (odd, clashing):
        got = packing.pack(docs).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        _gapless(got)
    assert packing.pack(none).collect() == []


def _gapless(got):
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 1024
    return len(bins)


def test_few_sequences(spark):
    got = packing.pack(documents(spark), shard_pieces=50).collect()
    total = sum(r.length for r in got)
    assert _gapless(got) <= 1.12 * total / 1024 + 1


def test_sum_of_squares_rule():
    sizes = np.array([random.Random(i).randint(1, 10) for i in range(200)])
    bins, offsets = packing.sum_of_squares(sizes, 10)
    level, count = {}, Counter()
    for s, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        def cost(gap):
            after = Counter(count)
            if gap < 10:
                after[gap] -= 1
            if gap > s:
                after[gap - s] += 1
            return sum(n * n for n in after.values())
        open_gaps = [g for g in range(s, 10) if count[g] > 0] + [10]
        gap = 10 - level.get(b, 0)
        assert o == level.get(b, 0) and cost(gap) == min(map(cost, open_gaps))
        if gap < 10:
            count[gap] -= 1
        if gap > s:
            count[gap - s] += 1
        level[b] = level.get(b, 0) + s


# line dedup

def brute_lines(data, min_docs=3, min_chars=20):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k) if len(k) >= min_chars else None
    refs, owner = Counter(), {}
    low = lambda i: -(1 << 63) if i is None else i
    for i, t in data:
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            refs[k] += 1
            owner[k] = max(owner.get(k, low(None)), low(i))
    out = Counter()
    for i, t in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (k := key(x)) is None or refs[k] < min_docs or owner[k] == low(i)]
        out[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


def told(df):
    return Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect())


def test_line_dedup(odd, clashing, none):
    want = brute_lines([(i, t) for i, t, *_ in rows()])
    assert sum(k[3] for k in want) > 3
    assert told(line_dedup.dedup_lines(odd)) == told(line_dedup.dedup_lines(clashing, shard_bytes=100)) == want
    assert line_dedup.dedup_lines(none).collect() == []


def test_lines_come_and_go(spark, odd):
    data = [(i, t) for i, t, *_ in rows() if i is not None]
    some, more = data[:12], data[12:]
    table = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    index = line_dedup.LineIndex.build(table(some), shard_bytes=200)
    assert told(index.apply(table(some))) == brute_lines(some)
    index = index.insert(table(more))
    assert told(index.apply(table(data))) == brute_lines(data)
    gone = [x for x in data if x[0] in (8, 101, 10)]
    rest = [x for x in data if x not in gone]
    index = index.delete(table(gone), table(rest))
    assert told(index.apply(table(rest))) == brute_lines(rest)


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(3000)]
    f = line_dedup.CuckooFilter.of(keys[:2000])
    assert f.contains(keys[:2000]).all() and f.contains(keys[2000:]).mean() < 0.01
    f = line_dedup.CuckooFilter.load(f.dump())
    assert all(f.delete(k) for k in keys[:1000])
    assert f.contains(keys[1000:2000]).all() and f.contains(keys[:1000]).mean() < 0.01


def test_clean_rows(odd, clashing, none):
    for docs in (odd, clashing):
        got = line_dedup.clean_rows(docs)
        assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        want = Counter((i, t if t is None or not n else x) for (i, t, *_), (i2, x, _, n) in _paired())
        assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert line_dedup.clean_rows(none).collect() == []


def _paired():
    data = [(i, t) for i, t, *_ in rows()]
    want = list(brute_lines(data))
    for r in rows():
        n = len((r[1] or "").split("\n"))
        yield r, next(w for w in want if w[0] == r[0] and w[2] == n and (w[3] or w[1] == (r[1] or "")))


# mixing

def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2.0 * sizes[s] for s in full)
        weight = sum(w[s] for s in order if s not in full)
        t = {s: 2.0 * sizes[s] if s in full else rest * w[s] / weight for s in order}
        over = {s for s in order if s not in full and t[s] > 2 * sizes[s]}
        if not over:
            return t
        full |= over


def test_mix(odd, clashing, none, spark):
    sizes = defaultdict(int)
    for i, t, lang, source, n in rows():
        sizes[source] += len(split(t))
    want = brute_targets(sizes)
    mixes = []
    for docs in (odd, clashing):
        got = mixing.mix(docs).collect()
        assert len(got) == len(rows())
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2
        taken = Counter()
        for r in got:
            taken[r.id, r.source, r.size] += r.copies
        out = mixing.repeated(docs)
        assert out.columns == docs.columns
        copies = Counter((r.doc_id, r.source, len(split(r.text))) for r in out.collect())
        assert copies == +taken
        mixes.append(Counter(map(str, mixing.repeated(docs.repartition(5)).select(*odd.columns).collect())) == Counter(map(str, out.select(*odd.columns).collect())))
    assert all(mixes)
    assert mixing.mix(none).collect() == [] and mixing.repeated(none).collect() == []


@pytest.mark.parametrize("shard_docs", [2048, 14])
def test_mix_comes_near(spark, shard_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.union(docs.where("doc_id < 30")).union(docs.where("doc_id < 10"))  # some rows more than once
    runs = [mixing.mix(d, shard_docs=shard_docs).toPandas().sort_values(["id", "copies"]) for d in (docs, docs.repartition(7), docs.repartition(2, "lang").sortWithinPartitions("text"))]
    for other in runs[1:]:
        assert runs[0].id.tolist() == other.id.tolist() and runs[0].copies.tolist() == other.copies.tolist()
    r = runs[0].assign(taken=runs[0]["size"] * runs[0].copies).groupby("source").agg(t=("target", "first"), taken=("taken", "sum"))
    assert (abs(r.taken - r.t) <= 0.01 * r.t + 1).all()


def test_flight_keeps_sums():
    rng = np.random.default_rng(5)
    p, x = rng.random(500), rng.integers(1, 1000, 500).astype(float)
    q = mixing.flight(p, x, rng.random(500))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum(), abs=1e-6) and q @ x == pytest.approx(p @ x, rel=1e-9)


# chat formatting

def test_chat(spark):
    wild = ["", None, "a\\b<|im_end|>\n<|im_start|>x", "\\n\\l\\b<|", "<\\l", "plain\ntext", "<|im_end|>\n", "<", "|", "\\"]
    talks = [(c, t, random.Random(c * 31 + t).choice(["user", "assistant", "system", None, "ro\nle<|"]), random.Random(c * 7 + t).choice(wild))
             for c in range(30) for t in range(c % 7 + 1)] + [(None, None, "assistant", "x"), (3, 0, "user", "tie"), (3, 0, "user", "tie")]
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    examples = chat_format.prefix_examples(df)
    got = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    by = defaultdict(list)
    for c, t, r, x in talks:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    n = Counter(r.conv_id for r in examples.collect())
    for c, held in by.items():
        held.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [h[2:] for h in held]
        assert "".join(got[c].losses) == "".join(h[3] for h in held if h[2] == "assistant")
        assert n[c] == sum(h[2] == "assistant" for h in held) + (held[-1][2] != "assistant")
    assert chat_format.prefix_examples(df.where("false")).collect() == []


# near-dedup

def brute_components(data, words, percent):
    sets = [frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
            for w in (split(t) for _, t in data)]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(data, sets)))


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_components(odd, clashing, none, words, percent):
    want = brute_components([(i, t) for i, t, *_ in rows()], words, percent)
    for docs in (odd, clashing):
        assert Counter(tuple(r) for r in near_dups.near_components(docs, words, percent).collect()) == want
    assert near_dups.near_components(none, words, percent).collect() == []


def test_near_family(spark):
    """A group whose members are alike by chains, and texts just under the threshold."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    data = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(120)] = f"x{rng.randrange(40)}"
        data.append((i, " ".join(t)))
    want = brute_components(data, 3, 85)
    assert 1 < len({c for _, _, c in want}) < 120
    assert Counter(tuple(r) for r in near_dups.near_components(spark.createDataFrame(data, "doc_id long, text string"), 3, 85).collect()) == want


def test_keep_one(odd, clashing, none):
    groups = Counter(c if n else ("alone", d) for (d, n, c), k in brute_components([(i, t) for i, t, *_ in rows()], 5, 80).items() for _ in range(k))
    empties = sum(1 for _, t, *_ in rows() if not split(t))
    for docs in (odd, clashing):
        got = near_dups.keep_one(docs)
        assert got.columns == docs.columns
        assert got.count() == len([g for g in groups if not isinstance(g, tuple)]) + empties
    assert near_dups.keep_one(none).collect() == []


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 50, 5000):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert (near_dups.sketch(s) < np.iinfo(np.uint64).max).all()
    x = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    same = [(near_dups.sketch(np.sort(x[a:a + 900])) == near_dups.sketch(x)).mean() for a in range(0, 100, 5)]
    assert abs(np.mean(same) - 0.9) < 0.03


# fingerprints

def test_fingerprints(odd, clashing, none):
    data = sorted(((i is not None, i or 0, t or "") for i, t, *_ in rows()))
    want = Counter()
    for k, (known, i, t) in enumerate(data):
        q = len(t) // 4
        e = t[:len(t) - q] + data[(k + 1) % len(data)][2][:q]
        want[i if known else None, len(t), hashlib.sha256(e.encode()).hexdigest()] += 1
    for docs, size in ((odd, 2048), (clashing, 3)):
        got = fingerprints.fingerprint_edits(docs, size).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprint_edits(none).collect() == []


def test_fingerprints_add_up():
    parts = [b"first paragraph here", b"second one", b"", b"third and last paragraph", b"second one"]
    whole = fingerprints.fingerprint(b"\n".join(parts))
    assert fingerprints.as_hex(whole) == fingerprints.as_hex(fingerprints.fingerprint(b"\n".join(parts[::-1])))
    fewer = fingerprints.delete(whole, fingerprints.fingerprint(parts[3]))
    assert fingerprints.as_hex(fewer) == fingerprints.as_hex(fingerprints.fingerprint(b"\n".join(parts[:3] + parts[4:])))
    assert fingerprints.as_hex(fingerprints.insert(fewer, fingerprints.fingerprint(parts[3]))) == fingerprints.as_hex(whole)
    assert fingerprints.likeness(whole, fewer) > 0.3 and fingerprints.likeness(whole, whole) == 1


# toxicity

def test_toxicity(odd, clashing, none, spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)] + [(None, None, None), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    for docs in (odd, clashing):
        got = toxicity.scores(docs, model).collect()
        assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
        kept = toxicity.clean_rows(docs, model)
        assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.7 for r in got)
    for docs, known in ((none, labels), (odd, labels.where("false")), (none, labels.where("false"))):
        m = toxicity.fit(docs, known)
        assert toxicity.scores(none, m).collect() == [] and toxicity.scores(odd, m).count() == len(rows())


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.scores(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    found = got.score >= toxicity.THRESHOLD
    assert found[got.toxic == 1].mean() > 0.85 and found[got.toxic == 0].mean() < 0.02


def test_toxic_vocabulary_of_rare_words(spark):
    """Two hundred words, each in 1.5 % of 3000 toxic documents; three in each of them and no other marker."""
    r = np.random.default_rng(5)
    words = np.array(["".join(chr(97 + c) for c in r.integers(0, 26, 8)) for _ in range(2200)])
    data = []
    for i in range(30_000):
        text = list(words[200:][r.integers(0, 2000, 12)]) + (list(words[:200][r.integers(0, 200, 3)]) if i % 10 == 0 else [])
        data.append((i, " ".join(r.permutation(text)), int(i % 10 == 0)))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    got = toxicity.scores(df, toxicity.fit(df, df)).join(df.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    found = got.score >= toxicity.THRESHOLD
    assert found[got.toxic == 1].mean() > 0.9 and found[got.toxic == 0].mean() < 0.02


def test_risk_stays_above_zero():
    rows_ = [np.array([0])] * 5 + [np.array([1])] * 40 + [np.array([0])] * 5
    w, b = toxicity.nnpu(rows_, np.array([True] * 5 + [False] * 45), 0.1, 2)
    assert w[0] + b > 0.5 > -0.5 > w[1] + b and np.isfinite(w).all()


# lattice language model

def test_lattice_sums_all_spellings():
    pieces = sorted([b" ", b"a", b"b", b"ab", b" a", b"bab", b"\xc3", b"\xa9"])
    p = np.random.default_rng(1).dirichlet(np.ones(len(pieces)))
    lattice = lattice_lm.Lattice(pieces, np.log(p))
    of = dict(zip(pieces, p))

    def brute(w):
        return 1.0 if not w else sum(of[x] * brute(w[len(x):]) for x in pieces if w.startswith(x))
    words = [b" a", b" abab", b" b", b" ababab", b" \xc3\xa9a", b" a" + b"ab" * 30]
    got, expected = lattice.words(words, np.ones(len(words)))
    for w, z in zip(words[:5], got):
        assert z == pytest.approx(math.log(brute(w)))
    assert sum(len(x) * n for x, n in zip(pieces, expected)) == pytest.approx(sum(map(len, words)))
    assert lattice._long(words[3], 0, expected) == pytest.approx(got[3])


def test_score_documents(odd, clashing, none):
    data = [(i, t) for i, t, *_ in rows()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = Counter(w for i, t in data if not held(i) for w in [*split(t), b""])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in data:
        own = [*split(t), b""]
        want[i, held(i), len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6)] += 1
    for docs in (odd, clashing):
        got = lattice_lm.score_documents(docs).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
    assert lattice_lm.score_documents(none).collect() == []


def test_urn_is_a_probability():
    p = np.array([[0.5, 0.2], [0.3, 0.3], [0.2, 0.5]])
    prior = np.log([0.6, 0.4])
    total = sum(math.exp(lattice_lm.log_probability(np.array([a, b, c]), np.log(p), prior, 2.0)) for a in range(3) for b in range(3) for c in range(3))
    assert total == pytest.approx(1.0)


# html

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site"><a href="/">Home</a> Site name</header>
<nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="main"><div class="post post-%d"><h1>Head &amp; line</h1><p>First para&shy;graph  with <b>bold</b> and <a href="x">link</a>.<p>Second &eacute; one<br>goes on
<script>var a = "<p>no</p>";</script><blockquote>Quoted</blockquote><form>Mail <input></form><ul><li>item 1<li>item 2</ul></div>
<div class="sidebar">Side</div><section class="comments"><p>I think so too, a comment that is quite long, longer than others</p></section></div>
<footer>&copy; foot</footer></body></html>"""
TEXT = "Head & line\nFirst para\xadgraph with bold and link.\nSecond é one goes on\nQuoted\nitem 1\nitem 2"


def test_pages(spark):
    data = [(i, f"https://www.a.example/{i}", PAGE % i) for i in range(4)]
    data += [(9, None, None), (10, "nonsense", ""), (11, "https://www.a.example/x", "<p>bare text"), (12, "http://b.example", "a < b & c"), (None, "http://b.example", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "paths": F.lit(1)})
    for most in (10_000, 0):
        got = Counter((r.page_id, r.text) for r in html_extract.extract_pages(df, most_hosts=most).collect())
        assert got == Counter([*((i, TEXT) for i in range(4)), (9, ""), (10, ""), (11, "bare text"), (12, "a < b & c"), (None, "deep")])
    assert html_extract.extract_pages(df.where("false")).collect() == []


def test_hosts_agree(spark):
    """The host's path outvotes a page whose longest block is elsewhere."""
    odd_page = (PAGE % 7).replace("Side</div>", "Side</div><div class='extra'>" + "long text of a teaser that nobody wants " * 20 + "</div>")
    df = spark.createDataFrame([*((i, "http://h/", PAGE % i) for i in range(3)), (7, "http://h/", odd_page)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract_pages(df).collect()} == {TEXT}


BODY = "<p>" + "the text of the body goes on and on " * 20 + "</p>"


@pytest.mark.parametrize("page", [
    "<article><h1>Head</h1><p>Lead</p><div class='body'>%s</div><p>End</p></article>",
    "<div class='post'><h1>Head</h1><p>Lead</p><div class='a'><div class='b'>%s</div></div><p>End</p></div>",
    "<div><h1><a href='/x'>Head</a></h1><p>Lead</p><section><div>%s</div></section>End</div>",
    "<article><h1>Head</h1><p>Lead</p><ul><li>%s</li></ul><p>End</p></article>",
    "<div id='content'><h1>Head</h1><p>Lead</p><blockquote>%s</blockquote><p>End</p></div>",
    "<div><header><h1>Head</h1></header><p>Lead</p><table><tr><td>%s</td></tr></table><p>End</p></div>"])
def test_text_around_a_nested_body_stays(page):
    frame = "<body><header><a href='/'>Site</a> of many pages</header><nav><a>One</a></nav>%s<ul><li><a>More</a><li><a>Still more</a></ul></body>"
    root, blocks = html_extract.parse(frame % (page % BODY))
    found = html_extract.best(root)
    assert blocks[slice(*found.blocks)] == ["Head", "Lead", BODY[3:-4].strip(), "End"]
    assert html_extract.extract(frame % (page % BODY), [found.path]) == "\n".join(["Head", "Lead", BODY[3:-4].strip(), "End"])


@pytest.mark.parametrize("wrap", [
    "<div id='content' class='content with-sidebar'>%s</div>", "<div class='site header-fixed'>%s</div>", "<section class='entry no-comments'>%s</section>",
    "<article class='hentry sidebar-left'>%s</article>", "<div class='header-fixed'><div class='modal-open'>%s</div></div>", "<div id='sidebar-main'>%s</div>",
    "<div class='cookie-theme'><div class='content-sidebar-wrap'><article>%s</article></div></div>"])
def test_classes_of_wrappers_lose_no_article(wrap):
    frame = "<body><nav>Menu of pages</nav>%s<div class='sidebar'>Side</div><div class='post-comments'>I think so</div><footer>Foot</footer></body>"
    inner = "<header class='entry-header'><h1 class='header'>Head</h1></header>" + BODY + "<div class='related'>Read on</div>"
    assert html_extract.extract(frame % (wrap % inner), None) == "Head\n" + BODY[3:-4].strip()


def test_long_noise_beside_an_article_stays_out():
    page = "<body><div class='ad'>%s</div><article><h1>Head</h1><p>%s</p></article><div class='comments'>%s</div></body>"
    assert html_extract.extract(page % ("buy this " * 9, "short text " * 9, "I think so " * 50), None) == "Head\n" + ("short text " * 9).strip()
    assert html_extract.extract("<body><h1>Forum</h1><div class='comments'>%s</div></body>" % ("I think so " * 50), None).startswith("Forum\nI think")


def extracted(page):
    return html_extract.extract(page, None).split("\n")


LONG = "Sentences of the article that go on for a while, so that most of the page is here. " * 8


def test_inline_words_stay():
    page = ("<body><nav><a>Menu</a></nav><article><h1>Keys</h1><p>Press the <span class='menu'>File</span> key and <b class='alert'>never</b> the "
            "<code class='search'>grep</code> one, <a class='related' href='x'>see</a> <span class=comment>this</span>.</p><p>%s</p>"
            "<p>Seen <span hidden>not <span>this</span> either</span><i aria-hidden='true'>nor this</i>here<b style='display: none'>!</b>.</p>"
            "<span class='ad'><span>x</span> buy now</span><p>A <span class='ad'>word</span> in a sentence.</p><p><span class='advert'>All of it</span></p></article></body>") % LONG
    assert extracted(page) == ["Keys", "Press the File key and never the grep one, see this.", LONG.strip(), "Seen here.", "A word in a sentence."]


def test_positions_survive_lower_case():
    for tag in ("script", "SCRIPT", "Style", "noscript"):
        page = f"<article><p>First.</p><p>{'İ' * 300}</p><{tag}>var a = '<p>no</p>';</{tag.swapcase()} ><p>{LONG}</p><{tag}>unclosed <p>no</p>"
        assert extracted(page) == ["First.", "İ" * 300, LONG.strip()]


NOISES = ["sponsored-content", "related-content", "comment-body", "comment-content", "modal-body", "cookie-content", "newsletter-body", "sidebar-content", "comments-main",
          "related-posts", "post-comments", "site-header", "ad-slot", "article-footer", "cookie-notice", "widget_area", "commentArea", "social-links"]


@pytest.mark.parametrize("word", NOISES)
def test_noise_content_stays_out(word):
    noise = f"<div class='{word}'><p>Some text of no concern, of a sentence or two.</p></div>"
    for page in (f"<body><article><h1>Head</h1><p>{LONG}</p>{noise}</article></body>", f"<body>{noise}<article><h1>Head</h1><p>{LONG}</p></article></body>",
                 f"<body><div class='post'><h1>Head</h1><p>{LONG}</p></div>{noise}</body>"):
        assert extracted(page) == ["Head", LONG.strip()]


@pytest.mark.parametrize("part", ["<ul class='menu-items'><li>Soup of the day</li></ul>", "<p class='search-result'>Soup of the day</p>", "<h2 class='social-history'>Soup of the day</h2>",
                                  "<ul><li class='sharing'>Soup of the day</li></ul>", "<div class='recommended-dose'>Soup of the day</div>", "<figure class='figure-ad-free'>Soup of the day</figure>",
                                  "<blockquote class='comment'>Soup of the day</blockquote>", "<div class='ad-free'>Soup of the day</div>", "<p class='notice'>Soup of the day</p>", "<pre class='search'>Soup of the day</pre>"])
def test_parts_of_an_article_stay(part):
    assert extracted(f"<body><nav>Menu</nav><article><h1>Head</h1><p>{LONG}</p>{part}<p>End.</p></article></body>") == ["Head", LONG.strip(), "Soup of the day", "End."]


def test_links_and_adverts_in_an_article_go():
    page = f"<body><article><h1>Head</h1><p>{LONG}</p><ul class='share-links'><li><a href=x>Here</a><li><a href=y>There</a></ul><p class='ad'>Buy now.</p><aside>Aside</aside></article></body>"
    assert extracted(page) == ["Head", LONG.strip()]


def test_deep_pages_take_linear_time():
    import time
    for page in ("<div>" * 50_000 + "<p>Deep text</p>", "<div><span>" * 50_000 + "text", "<b>" * 50_000 + "<p>x</b>" * 1000, "<ul><li>" * 20_000 + "text", "</section>" * 50_000 + "<p>x"):
        t = time.time()
        html_extract.extract(page, ["/body/article", html_extract.best(html_extract.parse(page)[0]).path])
        assert time.time() - t < 5


def test_rare_language_gets_a_class(spark):
    """0.5 % of the documents have words of their own; the sample that starts the classes holds none of them."""
    random.seed(8)
    common = [[f"{c}{i}" for i in range(300)] for c in "abc"]
    texts = [" ".join(random.choices(common[i % 3], k=60)) for i in range(1990)] + [" ".join(random.choices([f"zz{i}" for i in range(200)], k=60)) for _ in range(10)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    held = lattice_lm.blocks(docs)
    train = [i for i in range(1990, 2000) if lattice_lm.learn_remainder(i, 5) != 1]
    assert len(train) > 3
    words = lattice_lm.document_classes(held, 5, 1, classes=3, most_fitted=40)
    best = [int((words @ lattice_lm.bag(texts[i].encode())).argmax()) for i in range(2000)]
    assert len({best[i] for i in train}) == 1 and best[train[0]] not in {best[i] for i in range(1990)}


def test_urn_counts_every_class():
    """A class that gives the text's repeated word nearly nothing, and would be cut by its plain sum, has the largest part in the end."""
    logp = np.log(np.array([[1e-3, 1e-30], [1e-9, 1e-2]]))
    at = np.array([0] * 40 + [1])
    prior = np.log([0.5, 0.5])
    z = [math.log(0.5) + sum(math.log((lattice_lm.URN * math.exp(logp[w, k]) + (i if w == 0 else 0)) / (lattice_lm.URN + i)) for i, w in enumerate(at)) for k in (0, 1)]
    assert z[1] - z[0] > -60
    assert lattice_lm.log_probability(at, logp, prior) == pytest.approx(np.logaddexp(*z), rel=1e-9)


def test_fingerprints_of_repeats_and_scripts_without_blanks():
    random.seed(9)
    chinese = "".join(chr(random.randint(0x4E00, 0x9FA5)) for _ in range(4000))
    other = "".join(chr(random.randint(0x4E00, 0x9FA5)) for _ in range(4000))
    for text, following in ((("same words " * 50_000).strip(), "others here " * 50_000), ("word " * 100_000, "else " * 100_000), (chinese, other)):
        a, b = (fingerprints.fingerprint(x.encode()) for x in (text, fingerprints.edited(text, following)))
        assert 0.4 < fingerprints.likeness(a, b) < 1
        assert fingerprints.likeness(a, fingerprints.fingerprint(following.encode())) < 0.3
