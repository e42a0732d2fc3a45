"""Near copies that meet in crowded anchors or differ by more than scattered words."""

import random

import numpy as np
import pyarrow as pa
import pytest
from twinfold.llm import simhash


def test_crowded_anchors_lose_no_pair(spark, monkeypatch):
    """Many different texts of the same words share their anchors; two of them are near copies."""
    monkeypatch.setattr(simhash, "CROWD", 0)
    monkeypatch.setattr(simhash, "STAR", 0)
    monkeypatch.setattr(simhash, "BANDS", 0, raising=False)
    rng = random.Random(9)
    bag, rows = [f"w{k}" for k in range(60)], []
    for k in range(24):
        own = rng.sample(bag, 60)
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[:57] + [own[58], own[57], own[59]]))]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


def test_appended_cut_and_short_copies(spark):
    rng = random.Random(4)
    bag = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(120):
        n = (60, 200, 600, 16, 25, 40)[k % 6]
        a = [rng.choice(bag[:400]) for _ in range(n)]
        b = a[:-1] + ["other"] if n < 60 else a + rng.choices(bag[400:], k=n // 5 - 1) if k % 12 < 6 else a[: n - n // 6]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    assert all(len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) for i in range(0, 240, 2))
    assert got == {i: i // 2 * 2 for i, _ in rows}


def test_bands_depend_on_similarity_alone():
    rng = np.random.default_rng(1)
    for n in (9, 90, 900):
        same, sets = n * 8 // 9, []
        for _ in range(300):
            x = rng.integers(0, 1 << 63, 2 * n - same, dtype=np.uint64)
            sets += [x[:n], np.concatenate([x[:same], x[n:]])]
        keys = simhash.band_keys(sets)
        equal = (keys[::2] == keys[1::2]).mean()
        j = same / (2 * n - same)
        assert abs(equal - j**simhash.BAND_ROWS) < 0.03 and (keys[::2] == keys[1::2]).any(1).all()


def test_one_shared_key_is_enough(spark, monkeypatch):
    """Texts beyond the centres: a pair that shares one band only is compared, exactly, and so are those that only meet in lanes."""
    monkeypatch.setattr(simhash, "STAR", 10**9)
    monkeypatch.setattr(simhash, "CROWD", 10**9)
    rng, rows, want = np.random.default_rng(5), [], {}
    for k in range(0, 120, 2):
        own = [f"w{x}" for x in rng.integers(0, 10**9, 300)]
        other = [*own]
        for at in range(5, 300, 13):
            other[at] = "edited"
        rows += [(k, " ".join(own)), (k + 1, " ".join(other))]
        h, first = simhash._hashed(pa.array([rows[-2][1], rows[-1][1]]))
        sets = simhash._sets(h, first, 5)
        both = len(np.intersect1d(*sets))
        bands = simhash.band_keys(sets)
        assert both >= 0.4 * (len(sets[0]) + len(sets[1]) - both)
        want[k] = int((bands[0] == bands[1]).sum())
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), least=0.4).collect()}
    assert sum(n == 1 for n in want.values()) > 10 and all(got[k + 1] == k for k, n in want.items() if n) and all(c // 2 == i // 2 for i, c in got.items())


@pytest.mark.parametrize("full", [64, 1])
def test_unlike_texts_of_small_anchors_need_no_prefix_filter(spark, monkeypatch, full):
    """Different texts of the same words share their anchors; few of them are compared directly, only more than FULL by the filter on all shingles, with the same result."""
    filtered, real = [], simhash.prefix_pairs

    def counted(live, *more):
        filtered.append(live.count())
        return real(live, *more)

    monkeypatch.setattr(simhash, "prefix_pairs", counted)
    monkeypatch.setattr(simhash, "FULL", full, raising=False)
    rng, rows = random.Random(6), []
    for k in range(20):
        bag = [f"w{k}x{j}" for j in range(80)]
        for j in range(3):
            own = rng.sample(bag, 80)
            i = 6 * k + 2 * j
            rows += [(i, " ".join(own)), (i + 1, " ".join(own[:77] + [own[78], own[77], own[79]]))]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows} and filtered == [0 if full > 1 else 120]


def test_outlines_differ_by_no_more_than_their_sets():
    rng, sets = np.random.default_rng(8), []
    for n in (0, 1, 9, 60, 64, 65, 700, 5000, 50_000):
        for part in (0.0, 0.7, 0.95, 1.0):
            x = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            keep = int(n * part)
            sets.append((np.unique(x[:n]), np.unique(np.concatenate([x[:keep], x[n : 2 * n - keep // 3]]))))
    found = simhash.apart(*(pa.array([simhash._outline(s[k]) for s in sets], pa.binary()) for k in (0, 1)))
    true = np.array([len(np.setxor1d(*s)) for s in sets])
    assert (found <= true).all() and (found[true == 0] == 0).all()
    size = np.array([len(u) + len(v) for u, v in sets])
    like = np.array([min(map(len, s)) >= 60 and len(np.intersect1d(*s)) < 0.01 * len(s[0]) for s in sets])
    assert like.sum() >= 5 and (found > size / 9)[like].all()  # unlike texts are ruled out
