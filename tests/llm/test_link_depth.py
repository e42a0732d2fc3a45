"""Distrust reaches every linked host, whatever the seeds weigh and however deep it is."""

from twinfold.llm import link_graph


def test_distrust_reaches_hosts_beside_heavy_seeds(spark):
    heavy = spark.range(100_000).selectExpr("id + 100 as page_id", "concat('http://lone', id % 9, '.net/', id) as url", "cast(null as string) as html")
    link = lambda h: f"<a href='http://{h}/p'>l</a>"
    few = [(k, "http://bad.net/x", None) for k in range(5)] + [(10, "http://shady.com/x", link("bad.net")), (11, "http://deep.com/x", link("shady.com"))]
    few += [(20, "http://h0.com/x", link("deep.com")), *((20 + k, f"http://h{k}.com/x", link(f"h{k - 1}.com")) for k in range(1, 34))]
    pages = heavy.unionByName(spark.createDataFrame(few, "page_id long, url string, html string"))
    got = {r.page_id: r.verdict for r in link_graph.judge(pages).where("page_id < 100").collect()}
    assert set(got.values()) == {"block"} and len(got) == len(few)


def test_blocked_paths_seed_distrust_but_not_their_own_host(spark):
    link = lambda h: f"<a href='http://{h}/p'>l</a>"
    pages = [(1, "http://www.example.com/de/1", None), (2, "http://www.example.com/en/1", "<a href='/x'>x</a><a href='mailto:a@b.c'>m</a>"), (3, "http://friend.com/x", link("www.example.com")), (4, "http://other.com/x", "<a href='y'>y</a>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in link_graph.judge(df).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}


def test_links_to_the_own_host_count(spark):
    """Against PageRank by plain iteration, with links that stay on their host."""
    edges = [("a", "a", 3), ("a", "b", 1), ("b", "c", 2), ("b", "b", 1), ("c", "a", 1), ("c", "d", 4), ("d", "d", 5)]
    seeds = {"a": 1.0, "c": 2.0}
    got = {r.host: r.share for r in link_graph.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, w double")).collect()}
    out = {h: sum(n for a, _, n in edges if a == h) for h in "abcd"}
    start = {h: seeds.get(h, 0.0) / 3 * 0.15 for h in "abcd"}
    rank = dict(start)
    for _ in range(500):
        new = dict(start)
        for a, b, n in edges:
            new[b] += 0.85 * rank[a] * n / out[a]
        rank = new
    total = sum(rank.values())
    assert all(abs(got[h] - rank[h] / total) < 1e-9 for h in "abcd")
