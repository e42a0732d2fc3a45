"""Link-graph verdicts, wrapper extraction, vector and image operators against brute force and planted cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from twinfold.llm import flat_graph, image_copies, link_graph, wrappers

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize(("url", "host", "path", "rule"), [
    ("HTTPS://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/"), ("http://x.net/", "x.net", "/", "net/"), ("http://net/a", "net", "/a", "net/"), ("http://x.net", "x.net", "", None), ("http://xnet/", "xnet", "/", None),
    ("http://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/"), ("http://notexample.com/de/1", "notexample.com", "/de/1", None), ("ftp://a.org/fr/", "a.org", "/fr/", "org/fr/"), ("a.org/fr/", "", "", None), (None, "", "", None), ("x://", "", "", None), ("p://h?q://r/s", "h", "", None), ("://É.NET/\nen", "É.net", "/\nen", "net/"),
])
def test_rules(spark, url, host, path, rule):
    r = link_graph.judge(spark.createDataFrame([(1, url, None)], SCHEMA)).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, link_graph.RULES.get(rule, "allow"))


def brute_rank(edges, seeds, damping, rounds=200):
    hosts = sorted({h for e in edges for h in e[:2]} | set(seeds))
    total, out = sum(seeds.values()), {}
    for a, _, n in edges:
        out[a] = out.get(a, 0) + n
    start = {h: seeds.get(h, 0) / total * (1 - damping) for h in hosts}
    rank = dict(start)
    for _ in range(rounds):
        new = dict(start)
        for a, b, n in edges:
            new[b] += damping * rank[a] * n / out[a]
        rank = new
    s = sum(rank.values())
    return {h: x / s for h, x in rank.items()}


def test_propagation_against_brute_force(spark):
    rng = random.Random(2)
    edges = list({(f"h{a}", f"h{b}"): (f"h{a}", f"h{b}", rng.randrange(1, 5)) for a, b in ((rng.randrange(12), rng.randrange(14)) for _ in range(40)) if a != b}.values())
    seeds = {"h0": 2.0, "h3": 1.0, "alone": 1.0}
    got = {r.host: r.share for r in link_graph.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, w double"), rounds=60).collect()}
    want = brute_rank(edges, seeds, link_graph.DAMPING)
    assert all(abs(got.get(h, 0) - x) < 2e-4 for h, x in want.items())


def test_verdicts_by_method(spark):
    link = lambda *hs: "".join(f"<A class=x HREF='http://{h}/p'>l</A>" for h in hs)
    pages = [(1, "http://bad.net/x", None), (2, "http://shady.com/x", link("bad.net", "bad.net")), (3, "http://good.org/fr/1", link("friend.com")), (4, "http://friend.com/x", ""), (5, "http://other.com/x", link("friend.com")), (6, "http://deep.com/x", link("shady.com")), (6, "http://deep.com/x", link("shady.com"))]
    got = {r.page_id: r.verdict for r in link_graph.judge(spark.createDataFrame(pages, SCHEMA).withColumn("host", F.lit("clash"))).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}
    assert link_graph.judge(spark.createDataFrame([], SCHEMA)).count() == 0


SHELL = "<html><head><title>{t}</title><script>var a='<p>';</script></head><body><header class=top>Head {n}</header><nav><ul><li><a href=/>Home</a><li>Menu {n}</ul></nav><div class='cookie-notice'><p>We use cookies</p></div>{body}<aside>Side</aside><div id=comments><p>Nice {n}</p></div><form>Mail <input></form><footer>Foot</footer></body></html>"


def test_wrappers_find_the_article(spark):
    pages = []
    for k in range(30):
        inner = f"<h1>Title &amp; {k}</h1>" + "".join(f"<p>Para  {j}\n of <b>page</b> {k}.<br>" for j in range(1 + k % 4))
        pages.append((k, f"http://a.example/{k}", SHELL.format(t="T", n=k, body=f"<article>{inner}</article>")))
        long = "".join(f"<p>Some long running sentence number {j} of page {k}, with words.</p>" for j in range(3))
        pages.append((100 + k, f"http://b.example/{k}", SHELL.format(t="T", n=k, body=f"<div class=wrap><div class=story>{long}</div></div>")))
    pages += [(900, None, None), (901, "http://a.example/z", ""), (902, "http://a.example/z", "<<p>&#65;&nbsp;&lt;b"), (1, "http://a.example/1", pages[2][2])]
    df = spark.createDataFrame(pages, SCHEMA).withColumns({"host": F.lit("x"), "wrapper": F.lit("y")})
    rows = wrappers.extract(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    for k in range(30):
        assert got[k].split("\n") == [f"Title & {k}"] + [f"Para {j} of page {k}." for j in range(1 + k % 4)]
        assert got[100 + k].split("\n") == [f"Some long running sentence number {j} of page {k}, with words." for j in range(3)]
    assert got[900] == got[901] == "" and got[902].startswith("<")
    assert wrappers.extract(df.limit(0)).count() == 0


def test_the_wrapper_decides():
    """Hosts without article elements: what all pages say, and where most of the varying text is, only the host's other pages tell."""
    rng = random.Random(3)
    word = lambda: rng.choice(("alpha", "beta", "gamma", "delta", "rho", "sigma", "tau", "phi"))
    pages, want = [], []
    for k in range(20):
        body = [" ".join(word() for _ in range(3 if k % 4 == 0 else 30)) + f" {k} {j}." for j in range(2)]
        links = "".join(f"<li><a href='/{word()}'>{word()} {word()} story</a>" for _ in range(6))
        inner = "".join(f"<p>{x}</p>" for x in body)
        pages.append(f"<div class=top>The paper of record, since a very long time and for all who read it</div><div class=page><div class=text><div class=tagline>All the news that all of us print</div>{inner}<div class=comment-list><p>Reader {k}: {word()}</p></div></div><ul class=more>{links}</ul></div><div class=end>Imprint and all other things that stand here always</div>")
        want.append("\n".join(body))
    host = None
    for x in pages:
        host = wrappers.merge(host, wrappers.skeleton(x))
    host = wrappers.Wrapper(host)
    assert [wrappers.main_text(x, host) for x in pages] == want
    alone = [wrappers.main_text(x, None) for x in pages]
    assert sum(a != w for a, w in zip(alone, want, strict=True)) == len(pages) and all("All the news" in a for a in alone)


def test_titles_stay_with_their_text():
    for shell in ("<article><h1>Title {k}</h1><div class=body>{p}</div></article>", "<div class=page><h1>Title {k}</h1><div class=body>{p}</div></div>", "<main><div class=hold><h2>Title {k}</h2><div class=body>{p}</div></div></main>"):
        pages = ["<nav><a href=/>Home</a></nav>" + shell.format(k=k, p="".join(f"<p>Words that vary with page {k} and block {j}, at some length.</p>" for j in range(3))) for k in range(12)]
        host = None
        for x in pages:
            host = wrappers.merge(host, wrappers.skeleton(x))
        for k, x in enumerate(pages):
            for w in (host, None):
                assert wrappers.main_text(x, w).split("\n") == [f"Title {k}"] + [f"Words that vary with page {k} and block {j}, at some length." for j in range(3)]


def test_merging_is_union_free_and_covers_both_sides():
    """Brute force: every page's element sequences are words of the merged expression, read as a regular expression."""
    import re

    rng = random.Random(5)

    def page(depth=0):
        return "".join(f"<{t}>{page(depth + 1) if t in ('div', 'ul') and depth < 2 else 'x'}</{t}>" for t in rng.choices(("div", "p", "ul", "h2", "table"), k=rng.randrange(1, 5)))

    def flat(node):
        return "#" if node.name == "#" else ("" if node.name == "#root" else f"<{node.name}>") + "".join(map(flat, node.children)) + ("" if node.name == "#root" else f"</{node.name}>")

    for _ in range(60):
        pages = [page() for _ in range(rng.randrange(2, 6))]
        merged = None
        for x in pages:
            merged = wrappers.merge(merged, wrappers.skeleton(x))
        text = wrappers.expression(merged)
        assert "|" not in text
        pattern = re.compile(text.replace("#TEXT", "#"))
        assert all(pattern.fullmatch(flat(wrappers.parse(x))) for x in pages), (text, pages)


def test_wrapper_expressions():
    a = wrappers.skeleton("<div><h1>x</h1><p>a</p></div>")
    b = wrappers.skeleton("<div><h1>y</h1><p>a</p><p>b</p><ul><li>1<li>2</ul></div>")
    assert wrappers.expression(wrappers.merge(a, b)) == "<div><h1>#TEXT</h1>(<p>#TEXT</p>)+(<ul>(<li>#TEXT</li>)+</ul>)?</div>"
    deep = wrappers.main_text("<div>" * 5000 + "x", None)
    assert deep == "x"


def test_pages_as_given(spark, sf):
    import html
    import re

    for r in wrappers.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").select("text", "html").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [b for b in (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner)) if b]
        assert r.text.split("\n") == want


def vectors(rng, n=500, d=24):
    base = rng.normal(size=(60, d))
    rows = [base[rng.integers(60)] + rng.normal(size=d) * rng.choice([0.05, 0.25, 2.0]) for _ in range(n)]
    rows += [rows[0] * 3] * 5 + [rows[1]] * 4
    out = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)]
    return [*out, (7, out[7][1]), (9000, None), (9001, []), (9002, [0.0] * d), (9003, [float("nan")] + [1.0] * (d - 1)), (9004, [1.0] * (d - 2)), (9005, [None] + [1.0] * (d - 1)), (9006, [float("inf")] + [1.0] * (d - 1))]


@pytest.mark.parametrize("chunk", [3000, 60])
def test_vectors_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(flat_graph, "CHUNK", chunk)
    monkeypatch.setattr(flat_graph, "PER_SHARD", 120)
    rows = vectors(np.random.default_rng(4))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rep": F.lit(1), "v": F.lit(2), "n": F.lit(3)})
    got = flat_graph.near_duplicates(df)
    kept = got.toPandas()
    x = np.array([v for i, v in rows if i < 9000], float)
    ids = np.array([i for i, _ in rows if i < 9000])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    want = hit.sum(1)
    mine = np.array([kept[kept.vec_id == i].n_links.iloc[0] for i in ids])
    assert (mine <= want).all() and mine.sum() / want.sum() >= 0.97
    assert (kept[kept.vec_id >= 9000].n_links == 0).all() and kept[kept.vec_id >= 9000].kept.all() and len(kept) == len(rows)
    assert (kept.kept == (kept.vec_id == kept.component_id)).all()
    assert flat_graph.audit(df, got, every=3) >= 0.95
    assert flat_graph.near_duplicates(df.limit(0)).count() == 0 and flat_graph.near_duplicates(df.where("vec_id > 8999 and vec_id <> 9004")).count() == 6


def test_vectors_of_rare_lengths_link(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(700)] + [(1000, [1.0, 2.0]), (1001, [1.0, 2.0]), (1002, [1.0, 2.1]), (1003, [2.0, -1.0]), (1004, [1.0, 2.0, 3.0]), (1005, [5.0, 10.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in flat_graph.near_duplicates(df).collect()}
    assert got[1000] == got[1001] == got[1002] == got[1005] == (3, 1000) and got[1003] == (0, 1003) and got[1004] == (0, 1004) and len(got) == len(rows)


def test_dense_groups_are_found_whole(spark):
    """Groups of 40 to 400 vectors that are all near each other, among others; recall by the audit."""
    rng = np.random.default_rng(12)
    rows = []
    for size in (40, 150, 400):
        centre = rng.normal(size=32)
        rows += [centre + rng.normal(size=32) * 0.12 for _ in range(size)]
    rows += list(rng.normal(size=(900, 32)))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    assert flat_graph.audit(df, flat_graph.near_duplicates(df), every=4) >= 0.97


def pgm(a):
    a = np.clip(a, 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % a.shape[::-1] + a.tobytes()


@pytest.mark.parametrize("group", [image_copies.GROUP, 3])
def test_image_copies(spark, monkeypatch, group):
    """With a small GROUP all keys are split by second keys, and the largest go by their first and last images."""
    monkeypatch.setattr(image_copies, "GROUP", group)
    rng, rows = np.random.default_rng(1), []
    for k in range(6):
        a = np.zeros((120, 140)) + rng.integers(60, 190)
        for _ in range(60):
            y, x, h, w = rng.integers(0, 110), rng.integers(0, 130), rng.integers(4, 30), rng.integers(4, 30)
            a[y : y + h, x : x + w] = rng.integers(0, 256)
        rows += [(k * 10, pgm(a)), (k * 10 + 1, pgm(a[20:110, 25:130])), (k * 10 + 2, pgm(a * 0.8 + 20)), (k * 10 + 3, pgm(np.rot90(a)))]
    rows += [(1000, None), (1001, b"junk"), (1002, rows[0][1]), (1003, pgm(np.zeros((50, 50)))), (1004, b"P5\n9 9\n255\n"), (1001, b"junk")]
    got = image_copies.copies(spark.createDataFrame(rows, "img long, data binary")).toPandas()
    component = dict(zip(got.img, got.component_id, strict=True))
    assert len(got) == len(rows) and component[1002] == 0
    assert sum(component[k * 10 + j] == k * 10 for k in range(6) for j in range(4)) >= 23 and all(component[i] == i for i in (1000, 1001, 1003, 1004))
    assert image_copies.copies(spark.createDataFrame([], "img long, data binary")).count() == 0


def brute_links(points):
    """Linked images by all pairs of descriptors (img, x, y, s, o, d0, d1), without tables of keys' groups or kernels."""
    field = lambda r, t: r[5 + t // 3] >> 21 * (t % 3) & (1 << 21) - 1
    votes = {}
    for p in points:
        for q in points:
            if p[0] < q[0] and sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(p[5:], q[5:], strict=True)) <= image_copies.MOST_BITS and any(field(p, t) == field(q, t) for t in range(image_copies.TABLES)):
                scale = q[3] / p[3]
                turn = (round(q[4] / (2 * np.pi) * 65536) % 65536 - round(p[4] / (2 * np.pi) * 65536) % 65536) * (2 * np.pi / 65536)
                x, y = q[1] - scale * (np.cos(turn) * p[1] - np.sin(turn) * p[2]), q[2] - scale * (np.sin(turn) * p[1] + np.cos(turn) * p[2])
                r, u, v = int(turn / (2 * np.pi) % 1.0 * 24), int(np.floor(x / 6)), int(np.floor(y / 6))
                for g in (0, 1):
                    votes.setdefault((p[0], q[0], scale, g, (r + g) // 2 % 12, (u + g) // 2, (v + g) // 2), set()).add((p[1:], q[1:]))
    return {k[:2] for k, v in votes.items() if len(v) >= image_copies.LEAST}


@pytest.mark.parametrize("few", [image_copies.FEW, 40])
def test_crowded_keys_lose_no_link(spark, monkeypatch, few):
    """More images than any group had members, alike in parts, so that most keys are crowded: every link, in one block or many."""
    monkeypatch.setattr(image_copies, "FEW", few)
    rng, rows = np.random.default_rng(7), []
    shared = rng.normal(0, 1, (3, 8, 8))
    for i in range(90):
        grid = shared[i % 3] + rng.normal(0, 0.02 + 0.2 * (i % 7 == 0), (8, 8))
        rows.append((1000 - i, (grid.ravel()).tolist()))
    images = image_copies.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    points = image_copies.descriptors(images).localCheckpoint()
    want = brute_links([tuple(r) for r in points.collect()])
    got = [(r.a, r.b) for r in image_copies.links(points).collect()]
    assert len(want) > 500 and len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(image_copies, "HELD", 50)  # candidates of an image come in pieces
    assert {(r.a, r.b) for r in image_copies.links(points).collect()} == want


def test_links_of_a_group_are_summed_not_listed(spark, monkeypatch):
    """Alike images, some of them in several copies: links and components as by all pairs, but no table with a row a pair."""
    counts, real = [], image_copies.written

    def counted(df, *more):
        out = real(df, *more)
        if "d0" not in out[0].columns:
            counts.append(out[0].count())
        return out

    rng, rows = np.random.default_rng(11), []
    shared = rng.normal(0, 1, (3, 8, 8))
    for i in range(120):
        grid = shared[i % 3] + rng.normal(0, 0.02 + 0.2 * (i % 7 == 0), (8, 8))
        rows += [(1000 - i + 500 * k, grid.ravel().tolist()) for k in range(1 + (i % 10 == 0) + (i % 30 == 0))]
    images = image_copies.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    data = {r.img: r.data for r in images.collect()}
    rep = {}
    for i in sorted(data):
        rep.setdefault(bytes(data[i]), i)
    points = image_copies.descriptors(images.where(f"img in ({', '.join(map(str, rep.values()))})")).localCheckpoint()
    monkeypatch.setattr(image_copies, "FEW", 700)
    pairs = [(r.a, r.b) for r in image_copies.links(points).collect()]
    same = {i: [j for j in data if data[j] == data[i]] for i in rep.values()}
    peers, low = {i: set() for i in same}, {i: i for i in same}
    for a, b in pairs:
        peers[a].add(b)
        peers[b].add(a)
    for _ in same:
        low = {i: min([low[i], *(low[j] for j in peers[i])]) for i in same}
    want = {j: (sum(len(same[k]) for k in peers[i]) + len(same[i]) - 1, low[i]) for i in same for j in same[i]}
    monkeypatch.setattr(image_copies, "written", counted)
    got = {r.img: (r.n_links, r.component_id) for r in image_copies.copies(images).collect()}
    blocks = -(-points.count() // 700)
    assert got == want and blocks > 1 and len(pairs) > 1.5 * max(len(data), blocks * len(same)) and max(counts) <= max(len(data), blocks * len(same))


def test_small_crops_and_edits_are_found(spark):
    """Crops of a tenth of the area, brightness, noise, turns and halves of large pictures."""
    rng, rows = np.random.default_rng(3), []
    for k in range(6):
        h, w = 300, 340
        a = np.zeros((h, w)) + rng.integers(60, 190)
        for _ in range(260):
            y, x, hh, ww = rng.integers(0, h - 5), rng.integers(0, w - 5), rng.integers(4, 40), rng.integers(4, 40)
            a[y : y + hh, x : x + ww] = rng.integers(0, 256)
        edits = [a, a[100:196, 113:222], a * 0.7 + 30, a + rng.normal(0, 6, a.shape), np.rot90(a), a.reshape(h // 2, 2, w // 2, 2).mean((1, 3))]
        rows += [(k * 10 + j, pgm(x)) for j, x in enumerate(edits)]
    got = image_copies.copies(spark.createDataFrame(rows, "img long, data binary").withColumns({"p": F.lit(1), "key": F.lit(2), "lo": F.lit(3)}))
    assert [r.component_id for r in got.orderBy("img").collect()] == [i // 10 * 10 for i, _ in rows]


def test_corners_follow_the_area():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (400, 400)).astype(np.float32).repeat(4, 0).repeat(4, 1)[:1200, :1200]
    few, many = len(image_copies.describe(a[:300, :300])), len(image_copies.describe(a))
    assert 10 * few < many < 30 * few


def test_png():
    import struct
    import zlib

    def chunk(tag, body):
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    px = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    lines = b"".join(bytes([0]) + row.tobytes() for row in px)
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert np.allclose(image_copies.decode(data), px @ np.array([0.299, 0.587, 0.114]))
    assert image_copies.decode(data[:30]) is None and image_copies.decode(b"") is None
