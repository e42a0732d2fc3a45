"""URL verdicts by rules and by propagation over the host graph (operator 1).

Rules judge the urls they fit. For all other urls, trust spreads from the hosts of all pages that a rule allows
along links (personalised PageRank) and distrust from the hosts of all pages that a rule blocks
against links (a host that links to blocked ones is suspect); a host whose share of distrust
exceeds its share of trust is blocked. A rule on a path says nothing of the host's other pages: its seed spreads to other hosts,
but does not count for the host itself, of which only what arrives over links (and seeds of rules on whole hosts) does.

* Host edges are counted links of all pages, aggregated before anything is joined, so a hot host leaves one row an edge.
  Relative links stay on their host: they are edges to itself, and mass that goes round there is summed in closed form.
* A page without links keeps no mass: it returns to the seeds, which by linearity is a
  division by the total at the end.
* Every round is a written table; rounds end when no host is new and none gained more than TOLERANCE of
  its own share, so neither the size of the seeds nor the depth of the graph decides. Shares within TIE of
  each other are ties.
* Cases: null or ``://``-less urls have empty host and path, fit no rule and are allowed;
  null html has no links; without seeds all shares are 0 and the verdict is allow; ties
  are allowed; repeated rows count as often as they occur; urls and pages of any length are read whole; null ids stay null; an empty
  table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
DAMPING, TOLERANCE, TIE = 0.85, 1e-12, 1e-9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_column(url: str) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_column(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return out if out is not None else F.lit(None).cast("string")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links of all pages by host; relative ones lead to their own host. Links that are no pages (mailto: and the like, fragments) don't count."""
    links = F.regexp_extract_all(F.col("html"), F.lit(r"""(?is)<a\s[^>]*?href\s*=[\s"']*([^"'\s>]+)"""), 1)
    out = pages.select("host", F.explode(links).alias("link")).where(~F.col("link").startswith("#"))
    far = F.col("link").rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//")
    other = F.col("link").rlike(r"(?i)^[a-z][a-z0-9+.-]*:") & ~far
    full = out.where(~other).select(F.col("host").alias("src"), far.alias("far"), F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link")).alias("link"))
    return full.select("src", F.when(F.col("far"), host_column("link")).otherwise(F.col("src")).alias("dst")).where("dst <> '' and src <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """host, share, counted: personalised PageRank of seeds (host, w[, path]) over edges (src, dst, n), shares summing to 1. counted: share without the start of what path says of w."""
    seeds = seeds if "path" in seeds.columns else seeds.withColumn("path", F.lit(0.0))
    to_self = F.col("src") == F.col("dst")
    out = edges.groupBy("src").agg(F.sum("n").alias("total"), F.sum(F.when(to_self, F.col("n")).otherwise(0)).alias("own"))
    out, _ = written(out.select(F.col("src").alias("at"), "total", (1 / (1 - damping * F.col("own") / F.col("total"))).alias("round")))  # round: what a unit makes by going round at its host
    odds = edges.where(~to_self).join(out, F.col("src") == F.col("at")).select("src", "dst", (damping * F.col("n") / F.col("total") * F.col("round")).alias("p"))
    odds, _ = written(odds.join(out.select("at", F.col("round").alias("there")), F.col("dst") == F.col("at"), "left").select("src", "dst", "p", (F.col("p") * F.coalesce("there", F.lit(1.0))).alias("r")))
    total = seeds.agg(F.sum("w")).first()[0]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("share"), F.lit(0.0).alias("counted"))
    unit = F.lit((1 - damping) / total)
    start = seeds.join(out, F.col("host") == F.col("at"), "left").select("host", (F.col("w") * unit).alias("m"), (F.col("w") * unit * F.coalesce("round", F.lit(1.0))).alias("r"), (F.col("path") * unit * F.coalesce("round", F.lit(1.0))).alias("o"))
    rank, path = written(start)  # m: what arrived in the last round, o: what the host itself doesn't count
    done = 0
    while rounds is None or done < rounds:
        moved = rank.where("m > 0").select("host", F.col("m").alias("mass")).join(odds, F.col("host") == odds.src).groupBy("dst").agg(F.sum(F.col("mass") * F.col("p")).alias("m"), F.sum(F.col("mass") * F.col("r")).alias("gain")).select(F.col("dst").alias("host"), "gain", "m", F.lit(0.0).alias("o"), F.col("gain").alias("r"))
        both = rank.select("host", F.lit(0.0).alias("gain"), F.lit(0.0).alias("m"), "o", "r").unionByName(moved)
        rank, path = written(both.groupBy("host").agg(F.sum("gain").alias("gain"), F.sum("m").alias("m"), F.sum("o").alias("o"), F.sum("r").alias("r")), path)
        done += 1
        if (rank.agg(F.max(F.col("gain") / F.col("r"))).first()[0] or 0) <= TOLERANCE:  # 1 where a host is new
            break
    total = rank.agg(F.sum("r")).first()[0]
    return rank.select("host", (F.col("r") / total).alias("share"), (F.greatest(F.col("r") - F.col("o"), F.lit(0.0)) / total).alias("counted"))


def judge(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), host_column("url").alias("host"), path_column("url").alias("path"), F.col("html").cast("string").alias("html"))
    ruled = slim.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules))
    edges, _ = written(host_edges(slim))

    def pages_of(verdict: str, whole: bool):
        return F.sum(F.col("rule").isin([r for r, v in rules.items() if v == verdict and (not whole or r.find("/") == len(r) - 1)]).cast("double"))

    held, _ = written(ruled.groupBy("host").agg(*(F.coalesce(pages_of(v, w), F.lit(0.0)).alias(f"{v}_{'whole' if w else 'all'}") for v in ("allow", "block") for w in (False, True))))
    seeds = lambda v: held.where(f"{v}_all > 0").select("host", F.col(f"{v}_all").alias("w"), (F.col(f"{v}_all") - F.col(f"{v}_whole")).alias("path"))
    trust = propagate(edges, seeds("allow")).select("host", F.col("counted").alias("trust"))
    distrust = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), seeds("block")).select("host", F.col("counted").alias("distrust"))
    hosts = held.select("host").join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0)
    hosts, _ = written(hosts.select(F.col("host").alias("h"), "trust", "distrust"))
    listed = F.create_map(*[x for r, v in rules.items() for x in (F.lit(r), F.lit(v))])
    verdict = F.coalesce(listed[F.col("rule")], F.when(F.col("distrust") > F.col("trust") * (1 + TIE), "block").otherwise("allow"))
    return ruled.drop("html").join(hosts, F.col("host") == F.col("h"), "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
