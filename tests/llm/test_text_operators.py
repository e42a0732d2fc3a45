"""Packing, substring dedup, SimHash, BPE, toxicity and language operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from twinfold.llm import bpe, common, crf_langid, packing, queries, simhash, substring, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "   \n\t "), (10**6 + 3, "one"), (10**6 + 4, "one"), (10**6 + 5, "x" * 200_000), (10**6 + 6, "a " * 30_000), (10**6 + 7, "<|endoftext|> it's 12,5 — ñ, é. 日本　x  y\n\n z")]


def documents(spark, sf, n=60):
    """Some real rows, odd ones, a repeated row, and columns with names that operators use."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id") < n)
    odd = spark.createDataFrame([(i, t, None, None, 0) for i, t in ODD], docs.schema)
    return docs.unionByName(odd).unionByName(docs.where("doc_id = 3")).withColumns({"t": F.lit(1), "fp": F.lit("x"), "d": F.lit(2), "bucket": F.lit(3), "score": F.lit("y")})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return documents(spark, sf)


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_pack_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path, with_ids=True).toPandas()
    by_window = got.sort_values(["sequence_id", "offset"])
    end = 0
    for k, g in by_window.groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all()
        assert k == end and (g.length.sum() == 4096 or k == got.sequence_id.max())
        end += 1
    wanted = {}
    for i, x in texts:
        wanted.setdefault(i, []).append(t.encode(x or "", add_special_tokens=False).ids + [2])
    for i, group in got.groupby("doc_id"):
        assert group.length.sum() == sum(map(len, wanted[i]))
        if len(wanted[i]) == 1:
            g = group.sort_values("start")
            ids = [x for row in g.ids for x in row]
            assert ids == wanted[i][0] and set(g.doc_tokens) == {len(ids)}
            assert all(zlib.crc32(np.array(row, "<u4").tobytes()) == c for row, c in zip(g.ids, g.ids_crc32, strict=True))
    assert packing.pack(docs.limit(0), path).count() == 0


@pytest.mark.parametrize(("totals", "targets"), [([50_000, 30_000, 9000], [0.5, 0.4, 0.1]), ([100_000, 100], [0.5, 0.5]), ([10], [1.0]), ([4096 * 3] * 3, [1 / 3] * 3), ([7, 5, 40_000], [0.3, 0.3, 0.4])])
def test_windows_keep_the_mixture(totals, targets):
    plan = packing.phases(totals, targets)
    layout = packing.Layout(plan)
    cover = {}
    for q, n in enumerate(totals):
        cuts, seqs, offs = layout.pieces(q, 0, n)
        sizes = np.diff(np.append(cuts, n))
        assert cuts[0] == 0 and (sizes > 0).all()
        for s, o, k in zip(seqs.tolist(), offs.tolist(), sizes.tolist(), strict=True):
            cover.setdefault(s, []).append((o, k, q))
    for s, parts in cover.items():
        at = 0
        for o, k, _ in sorted(parts):
            assert o == at
            at += k
        assert at == 4096 or s == max(cover)
    assert sum(k for p in cover.values() for _, k, _ in p) == sum(totals)
    first = {q: k for _, k, q in cover[0]}
    if sum(totals) > 40_960 and min(totals) > 4096:
        assert all(abs(first.get(q, 0) - 4096 * w) <= 2 for q, w in enumerate(targets))


def brute_repeats(rows):
    first, out = {}, []
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            first[key] = min(first.get(key, (i, s)), (i, s))
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (i, s):
                gone[s : s + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substring_against_brute_force(spark, docs, texts):
    rng = random.Random(1)
    base = [t.split() for _, t in texts if t and len(t.split()) > 60]
    extra = [(2 * 10**6 + k, " ".join(rng.choice(base)[:40] + ["q"] * rng.randrange(50) + rng.choice(base)[5:60])) for k in range(25)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(both).collect())
    assert got == brute_repeats(texts + extra) and sum(r[2] for r in got) > 1000
    assert substring.digests(both.limit(0)).count() == 0


def test_substring_cut_keeps_columns(spark, docs, texts):
    cut = substring.without_repeats(docs)
    assert cut.columns == docs.columns
    kept = sorted((i, hashlib.sha256(" ".join(WORD.findall(t or "")).encode()).hexdigest()) for i, t in cut.select("doc_id", "text").collect())
    assert kept == sorted((i, h) for i, _, _, h in brute_repeats(texts))


def test_rolling_hash_is_position_free():
    h = common.mix(np.arange(1, 200, dtype=np.uint64))
    for n in (1, 7, 10, 20):
        r = common.rolled(h, n, 0x1234567)
        assert len(r) == len(h) - n + 1 and common.rolled(h[13 : 13 + n], n, 0x1234567)[0] == r[13]


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_groups(spark, docs, texts):
    short = docs.where("length(coalesce(text, '')) < 5000")
    some = [(i, t) for i, t in texts if len(t or "") < 5000]
    near = [(3 * 10**6 + k, t.replace(t.split()[5], "zz", 1)) for k, (_, t) in enumerate(some) if t and len(t.split()) > 300][:10]
    both = short.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(both).collect()}
    fps = {i: brute_fingerprint(t) for i, t in some + near}
    assert {i: f"{f:016x}" for i, f in fps.items()} == {i: g[0] for i, g in got.items()}
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {i: find(i) for i in ids} == {i: g[1] for i, g in got.items()}
    assert simhash.near_duplicates(both.limit(0)).count() == 0


@pytest.mark.parametrize(("crowd", "recall"), [(simhash.CROWD, 0.97), (0, 0.85)])
def test_near_copies_against_brute_force(spark, docs, monkeypatch, crowd, recall):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(5)
    base = [" ".join(f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(rng.choice((30, 120, 700)))) for _ in range(40)]
    rows = [(10**7 + k, t) for k, t in enumerate(base)]
    for k in range(120):
        own = rng.choice(base).split()
        for _ in range(rng.randrange(1 + len(own) // 45)):
            own[rng.randrange(len(own))] = f"new{rng.random()}"
        rows.append((2 * 10**7 + k, " ".join(own)))
    both = docs.select("doc_id", "text", "t", "fp").unionByName(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, t int, fp string"))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(both).collect()}
    texts = {}
    for r in both.collect():
        w = (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = WORD.findall(w)
        texts[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(texts[a] & texts[b])
            if n and n >= 0.8 * (len(texts[a]) + len(texts[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in ids}
    assert got.keys() == want.keys()
    assert all(want[i] == want[c] for i, c in got.items())  # no link between texts that aren't similar
    linked = [i for i in ids if want[i] != i]
    assert len(linked) > 60 and sum(got[i] != i for i in linked) >= recall * len(linked)
    assert simhash.near_copies(both.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0, 1, 2])
@pytest.mark.parametrize("hot", [simhash.HOT, 0])
def test_covering_loses_no_link(spark, threshold, hot):
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = list(dict.fromkeys(base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.choice((1, 1, 2, 3)))) for b in base for _ in range(8)]))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long"), threshold, hot).collect()
    near = {(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= threshold}
    root = np.arange(len(fps))
    for a, b in near:
        root[root == max(root[a], root[b])] = min(root[a], root[b])
    mine = np.arange(len(fps))
    for a, b in edges:
        assert (fps[a] ^ fps[b]).bit_count() <= 2
        mine[mine == max(mine[a], mine[b])] = min(mine[a], mine[b])
    assert (root == mine).all()


def test_bpe_round_trip(docs, texts):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(docs, path).collect())
    want = []
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_decode(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("text", ["  a   b \n\n c", " \nfoo  \x01, bar", "x\x01,y, z. ", "a \x01, b", "a\x1c b\x85c d", "don't we'll I'VE 's", "aaaa" * 50, "\U0001f600 é", "a ,b . c,d.\n", "×, é, ÷."])
def test_bpe_odd_texts(text):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    model = bpe._models.setdefault(path, bpe.PairIndexBPE(path))
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    n, joined, raw = model.encode([text.encode()])[0]
    assert (n, joined, raw.decode()) == (len(ids), ",".join(map(str, ids)), text) and bpe.decode(ids, path) == text


def test_toxicity_search_is_exact_and_accurate(spark, sf):
    rng = random.Random(6)
    rows = [{t: rng.random() for t in rng.sample(range(40), rng.randrange(1, 8))} for _ in range(700)]
    index = toxicity.BlockMaxIndex(rows, 40)
    for _ in range(40):
        q = {t: rng.random() for t in rng.sample(range(40), rng.randrange(1, 6))}
        u, units = index.unit(q), [index.unit(r) for r in rows]
        sims = np.array([sum(w * r.get(t, 0.0) for t, w in u.items()) for r in units])
        ids, got = index.top(q, 16)
        best = np.lexsort((np.arange(len(rows)), -np.round(sims, 12)))[:16]
        best = best[sims[best] > 0]
        assert ids.tolist() == best.tolist() and np.allclose(got, sims[best])
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = toxicity.score(docs, toxicity.fit(docs, labels), evidence=True)
    held = got.where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.9
    assert all((r.held_out) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.select("doc_id", "held_out").collect())


def test_toxicity_cases(spark, docs, sf):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("text", F.lit("clash"))
    model = toxicity.fit(docs, labels.unionByName(labels))
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    column = {r[0]: r[1] for r in docs.select("doc_id", toxicity.score_column(spark, model)(F.col("text"))).collect()}
    assert column == {r.doc_id: r.score for r in got}


def brute_posteriors(model, words):
    e, a = model.emissions(words), np.exp(model.moves - model.moves.max())
    alpha, now = [], np.full(len(model.labels), 1 / len(model.labels))
    for x in e:
        now = now @ a * x
        now = now / now.sum()
        alpha.append(now)
    beta, out = np.ones(len(model.labels)), []
    for x, y in zip(alpha[::-1], e[::-1], strict=True):
        g = x * beta
        out.append(g / g.sum())
        beta = a @ (y * beta)
        beta = beta / beta.sum()
    return np.array(out[::-1])


def test_language_chain_is_exact_and_accurate(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = crf_langid.fit(docs)
    rng = random.Random(8)
    lengths = np.array([1, 63, 64, 65, 0, 200])
    words = [rng.choice(["the", "und", "les", "que", "of", "zq"]) for _ in range(int(lengths.sum()))]
    got = model.posteriors(np.arange(len(words)), lengths, model.emissions(words), each=True)
    at = 0
    for n in lengths.tolist():
        if n:
            assert np.allclose(got[at : at + n], brute_posteriors(model, words[at : at + n]))
        at += n
    held = crf_langid.identify(docs, model).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    mixed = crf_langid.words_of("the thing with that and the ") + crf_langid.words_of("les et dans une pour le")
    best = [model.labels[i] for i in model.posteriors(np.arange(len(mixed)), np.array([len(mixed)]), model.emissions(mixed), each=True).argmax(1)]
    assert best[0] == "en" and best[-1] == "fr"


def test_language_cases(spark, docs):
    blank = crf_langid.identify(docs, crf_langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {(r.lang_pred, r.score) for r in blank} == {("und", 0.0)}
    model = crf_langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in crf_langid.identify(docs, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (10**6, 10**6 + 1, 10**6 + 2)) and all(0 <= s <= 1 for _, s in got.values()) and got[10**6 + 6][0] != "und"
    digits = spark.createDataFrame([(1, "12 !? 3", None)], "doc_id long, text string, lang string")
    assert crf_langid.identify(digits, model).first().lang_pred == "und" and crf_langid.identify(digits.limit(0), model).count() == 0
    assert {r[0]: r[1] for r in docs.select("doc_id", crf_langid.language_column(spark, model)(F.col("text"))).collect()} == {i: g[0] for i, g in got.items()}


@pytest.mark.parametrize("part", [40, 5000])
def test_components(spark, part):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300) if i % 60] + [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(200)] + [(7, 7), (7, 8), (8, 7)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(7), part).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == root and common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_layout_is_a_literal_deficit_round_robin():
    """Window by window, queue by queue, with carried deficits, as the method is written down."""
    from fractions import Fraction

    totals, targets, window = [90_000, 60_000, 31_000, 20_000], [0.43, 0.31, 0.16, 0.1], 512
    plan = packing.phases(totals, targets, window)
    layout = packing.Layout(plan, window)
    served = {}
    for q, n in enumerate(totals):
        cuts, seqs, _ = layout.pieces(q, 0, n)
        for k, size in zip(seqs.tolist(), np.diff(np.append(cuts, n)).tolist(), strict=True):
            served[k, q] = served.get((k, q), 0) + size
    windows = 0
    for first, n, _, cum in plan:
        if n == 1:
            continue
        quantum = [Fraction(b - a, packing.SCALE) * window for a, b in zip([0, *cum[:-1]], cum, strict=True)]
        deficit = [Fraction(0)] * len(totals)
        for k in range(first, first + n):
            carried = Fraction(0)  # what rounding of the queues before leaves over in this round
            for q, share in enumerate(quantum):
                due = deficit[q] + share + carried
                take = due.numerator // due.denominator
                assert served.get((k, q), 0) == take, (k, q)
                deficit[q], carried = due - take - carried, due - take  # what its share is ahead of what it has got
            windows += 1
            assert sum(served.get((k, q), 0) for q in range(len(totals))) == window
    assert windows > 200


@pytest.mark.parametrize("few", [False, True])
def test_many_sources_keep_their_shares(spark, few):
    """300 equal sources, with and without stated targets: each has its share after every window, to the token."""
    rows = [(k, "a b c d e f g " * 60, f"s{k % 300}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    targets = {f"s{k}": 1 / 300 for k in range(300)} if few else None
    got = packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), targets).join(docs.select("doc_id", "source"), "doc_id").groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).toPandas()
    assert got.groupby("sequence_id").n.sum().iloc[:-1].eq(4096).all()
    table = got.pivot(index="sequence_id", columns="source", values="n").fillna(0)
    full = table.iloc[: int(len(table) * 0.9)]
    due = (np.arange(len(full)) + 1)[:, None] * 4096 / 300
    assert table.shape[1] == 300 and (abs(full.cumsum() - due) < 1.1).all().all() and (abs(full - 4096 / 300) < 2).all().all()


def test_small_sources_share_a_queue(spark):
    rows = [(k, "word " * 50, f"s{k}" if k % 3 else None if k % 2 else "big") for k in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = packing.pack(docs, queries.vocabulary("word_bpe_49k.json")).toPandas().sort_values(["sequence_id", "offset"])
    assert got.groupby("sequence_id").length.sum().iloc[:-1].eq(4096).all() and got.length.sum() == 9000 * 51 and got.doc_id.nunique() == 9000


def test_toxicity_index_holds_all_words_and_skips_blocks(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = toxicity.fit(docs, labels)
    index = model.index
    assert index.n == len(model.ids) > 3000 and len(model.terms) > 50_000
    some = docs.where("doc_id % 50 = 7").select("doc_id", "text").collect()
    words = [re.findall(r"[^\W\d_]+", (r.text or "").lower()) for r in some]
    every = sum(int((index.posting[index.entry[t + 1]] - index.posting[index.entry[t]]).sum()) for t in (np.array(sorted({model.terms[w] for w in own if w in model.terms}), np.int64) for own in words))
    index.read = 0

    got = model.score(pa.array([r.text or "" for r in some]))
    assert 0 < index.read < every
    assert all(len(ids) == toxicity.NEIGHBOURS and s == sorted(s, reverse=True) for (_, ids, s), own in zip(got, words, strict=True) if len(own) > 50)
    held = toxicity.score(docs, model).where("held_out").join(labels, "doc_id").collect()
    caught = [r.predicted for r in held if r.toxic == 1]
    assert sum(caught) / len(caught) > 0.85 and sum(r.predicted == r.toxic for r in held) / len(held) > 0.98


def test_toxicity_search_is_exact_on_postings():
    """Rare terms only, so that nothing is a dense column and blocks are really skipped."""
    rng = random.Random(7)
    rows = [{t: rng.random() + 5 * (t % 37 == 0) for t in rng.sample(range(8000), 12)} | {37 * (i // 40): 9.0} for i in range(1500)]
    index = toxicity.BlockMaxIndex(rows, 8000)
    assert not len(index.dense)
    units = [index.unit(r) for r in rows]
    for k in range(30):
        q = {t: rng.random() for t in rng.sample(range(8000), 30)} | {37 * k: 4.0}
        u = index.unit(q)
        sims = np.array([sum(w * r.get(t, 0.0) for t, w in u.items()) for r in units])
        ids, got = index.top(q, 16)
        best = np.lexsort((np.arange(len(rows)), -np.round(sims, 12)))[:16]
        best = best[sims[best] > 0]
        assert ids.tolist() == best.tolist() and np.allclose(got, sims[best])
    assert index.read < 30 * len(index.places) / 2
