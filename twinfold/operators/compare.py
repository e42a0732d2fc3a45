"""Findings of aligned blocks: one function per rule group, and relational forms of the rules that are joins."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redact import excerpt, redact_text, shown_href, visible_numbers
from ..functions.text import code_whitespace_key, loose_normalize, text_key
from ..functions.urls import href_difference, href_relation, trim_href
from ..options import Limits
from .align import UNCERTAIN, AlignmentLimitError, Pair, align

SEVERITY = {"error": 0, "warning": 1, "info": 2}
FAR = 2**31 - 1


def label(b: dict) -> str:
    return {"heading": f"heading (h{b['depth']})", "listItem": "list item", "code": "code block"}.get(b["type"], b["type"])


def _words(b: dict) -> str:
    return b["code"] if b["type"] == "code" and b["code"] is not None else shown(b)


def shown(x: dict) -> str:
    """The text of a block or link as a report shows it."""
    return x["text"] if x.get("shown") is None else x["shown"]


def side(b: dict) -> dict:
    if "_side" not in b:
        b["_side"] = {"line": b["line"], "path": b["path"], "blockIndex": b["idx"], "excerpt": excerpt(_words(b))}
    return b["_side"]


def finding(code: str, severity: str, direction: str, message: str, html: dict | None = None, markdown: dict | None = None, before: str | None = None, after: str | None = None) -> dict:
    return {"code": code, "severity": severity, "direction": direction, "message": message, "html": html, "markdown": markdown, "before": before, "after": after}


def unmatched_values(a: list[str], b: list[str]) -> list[str]:
    """Values of a that b lacks, one for one, in order."""
    left, out = Counter(b), []
    for v in a:
        if left[v] > 0:
            left[v] -= 1
        else:
            out.append(v)
    return out


def diff_numbers(a: list[str], b: list[str]) -> tuple[list[str], list[str]] | None:
    """None if equal; what each side has alone; both lists where only the order differs."""
    if a == b:
        return None
    before, after = unmatched_values(a, b), unmatched_values(b, a)
    return (before, after) if before or after else (a, b)


def same_target(a: dict, b: dict) -> bool:
    if a["resolved"] is not None and b["resolved"] is not None:
        return a["resolved"] == b["resolved"]
    if a["resolved"] is None and b["resolved"] is None:
        return href_relation(a["rawHref"], b["rawHref"]) == "same"
    return trim_href(a["rawHref"]) == trim_href(b["rawHref"])


def pair_links(h: list[dict], m: list[dict], most_work: float = float("inf")) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Pairs by position in h, and the links without one on each side.

    Links of one text pair by rank where both sides have as many; else the shorter side is
    embedded in order by target, or by rank if it can't be. What is left pairs by loose text,
    labels of punctuation alone by target.
    """
    work = 0

    def same(i: int, j: int) -> bool:
        nonlocal work
        work += 1
        if work > most_work:
            raise AlignmentLimitError(f"pairing links needs more than {most_work:g} comparisons")
        return same_target(h[i], m[j])

    def embed(few: list[int], many: list[int], test) -> list[int]:
        rest, out = iter(many), []
        for x in few:
            hit = next((y for y in rest if test(x, y)), None)
            if hit is None:
                return many[: len(few)]
            out.append(hit)
        return out

    by_h, by_m = defaultdict(list), defaultdict(list)
    for own, links in ((by_h, h), (by_m, m)):
        for k, x in enumerate(links):
            own[x["text"]].append(k)
    pairs: list[tuple[int, int]] = []
    for text, hs in by_h.items():
        ms = by_m.get(text, [])
        if not ms:
            continue
        if len(hs) == len(ms):
            pairs += zip(hs, ms, strict=True)
        elif len(hs) < len(ms):
            pairs += zip(hs, embed(hs, ms, same), strict=True)
        else:
            pairs += zip(embed(ms, hs, lambda j, i: same(i, j)), ms, strict=True)
    done_h, done_m = {p[0] for p in pairs}, {p[1] for p in pairs}
    queues, bare = defaultdict(list), []
    for j, x in enumerate(m):
        if j not in done_m:
            key = loose_normalize(x["text"])
            (queues[key] if key else bare).append(j)
    missing = []
    heads = Counter()
    for i, x in enumerate(h):
        if i in done_h:
            continue
        key = loose_normalize(x["text"])
        hit = None
        if not key:
            hit = next((j for j in bare if same(i, j)), None)
            if hit is not None:
                bare.remove(hit)
        elif heads[key] < len(queues.get(key, ())):
            hit = queues[key][heads[key]]
            heads[key] += 1
        if hit is None:
            missing.append(i)
        else:
            pairs.append((i, hit))
            done_m.add(hit)
    pairs.sort()
    return pairs, missing, [j for j in range(len(m)) if j not in done_m]


def _link_text(x: dict, y: dict | None = None) -> str:
    return "***" if x["masked"] or y and y["masked"] else redact_text(shown(x))


def _link_href(x: dict, href: str) -> str:
    return "***" if x["masked"] else shown_href(href)


def link_findings(h: dict, m: dict, both_bases: bool, limits: Limits) -> list[dict]:
    out = []
    pairs, missing, added = pair_links(h["links"], m["links"], limits.max_similarity_work)
    for i, j in sorted([*pairs, *((i, -1) for i in missing)]):
        x = h["links"][i]
        if j < 0:
            target = _link_href(x, x["rawHref"])
            out.append(finding("LINK_MISSING", "error", "html_only", f'link "{_link_text(x)}" to {target} is only in the HTML', side(h), side(m), target))
            continue
        y = m["links"][j]
        if same_target(x, y):
            continue
        text, pick = _link_text(x, y), "resolved" if x["resolved"] is not None and y["resolved"] is not None else "rawHref"
        before, after = _link_href(x, x[pick]), _link_href(y, y[pick])
        both_relative = x["resolved"] is None and y["resolved"] is None
        if pick == "resolved" or both_relative and href_relation(x["rawHref"], y["rawHref"]) != "uncertain":
            kind = "relative target" if both_relative else "target"
            out.append(finding("LINK_TARGET_CHANGED", "error", "both", f'link "{text}" has another {kind}: {href_difference(x[pick], y[pick])}', side(h), side(m), before, after))
        else:
            why = "one side could not be resolved" if both_bases and not both_relative else "without a base the targets can't be told apart"
            out.append(finding("LINK_UNVERIFIED", "warning", "both", f'link "{text}": {why}', side(h), side(m), before, after))
    for j in added:
        y = m["links"][j]
        target = _link_href(y, y["rawHref"])
        out.append(finding("LINK_ADDED", "error", "markdown_only", f'link "{_link_text(y)}" to {target} is only in the Markdown', side(h), side(m), None, target))
    return out


def list_findings(h: dict, m: dict) -> list[dict]:
    a, b, out = h["list"], m["list"], []
    if not a or not b:
        return out
    if a["ordered"] != b["ordered"]:
        x, y = ("numbered" if o["ordered"] else "bulleted" for o in (a, b))
        out.append(finding("LIST_KIND_CHANGED", "warning", "both", f"{x} in the HTML, {y} in the Markdown", side(h), side(m), x, y))
    elif a["ordinal"] is not None and b["ordinal"] is not None and a["ordinal"] != b["ordinal"]:
        out.append(finding("LIST_NUMBER_CHANGED", "error", "both", f"item {a['ordinal']} in the HTML, {b['ordinal']} in the Markdown", side(h), side(m), str(a["ordinal"]), str(b["ordinal"])))
    if a["depth"] != b["depth"]:
        x, y = str(a["depth"] + 1), str(b["depth"] + 1)
        out.append(finding("LIST_NESTING_CHANGED", "warning", "both", f"level {x} in the HTML, {y} in the Markdown", side(h), side(m), x, y))
    if a["checked"] != b["checked"]:
        x, y = ({None: "no checkbox", True: "checked", False: "unchecked"}[o["checked"]] for o in (a, b))
        severity = "warning" if None in (a["checked"], b["checked"]) else "error"
        out.append(finding("LIST_TASK_CHANGED", severity, "both", f"{x} in the HTML, {y} in the Markdown", side(h), side(m), x, y))
    return out


def table_findings(h: dict, m: dict) -> list[dict]:
    if h["spanned"] or m["spanned"]:
        return []
    a, b = h["cells"] or [], m["cells"] or []
    shapes = [f"{len(t)}x{max(map(len, t), default=0)}" for t in (a, b)]
    if shapes[0] != shapes[1]:
        return [finding("TABLE_SHAPE_CHANGED", "error", "both", f"{shapes[0]} in the HTML, {shapes[1]} in the Markdown", side(h), side(m), *shapes)]
    out = []
    for r, (x, y) in enumerate(zip(a, b, strict=True)):
        for c in range(max(len(x), len(y))):
            u, v = x[c] if c < len(x) else "", y[c] if c < len(y) else ""
            if u != v:
                u, v = (t["cells_shown"][r][c] if t.get("cells_shown") and c < len(t["cells"][r]) else w for t, w in ((h, u), (m, v)))
                out.append(finding("TABLE_CELL_CHANGED", "error", "both", f"cell in row {r + 1}, column {c + 1}", side(h), side(m), excerpt(u), excerpt(v)))
    return out


def text_findings(h: dict, m: dict) -> list[dict]:
    if h["type"] == "table" == m["type"]:
        return table_findings(h, m)
    if h["type"] == "code" == m["type"]:
        x, y = h["code"] or "", m["code"] or ""
        if x == y:
            return []
        if code_whitespace_key(x) == code_whitespace_key(y):
            return [finding("CODE_WHITESPACE_CHANGED", "warning", "both", "code differs in white space only", side(h), side(m))]
        return [finding("TEXT_CHANGED", "error", "both", "code differs", side(h), side(m), excerpt(x), excerpt(y))]
    if h["text"] == m["text"]:
        return []
    if diff_numbers(h["numbers"], m["numbers"]):
        apart = diff_numbers(visible_numbers(shown(h)), visible_numbers(shown(m)))
        if apart is None:
            return [finding("NUMBER_CHANGED", "error", "both", f"a number of the {label(h)} differs inside a masked part of an address", side(h), side(m))]
        x, y = (", ".join(s) for s in apart)
        return [finding("NUMBER_CHANGED", "error", "both", f"numbers of the {label(h)}: {x or '(none)'} in HTML, {y or '(none)'} in Markdown", side(h), side(m), x, y)]
    minor = text_key(h["text"]) == text_key(m["text"])
    code, severity = ("TEXT_MINOR_CHANGED", "warning") if minor else ("TEXT_CHANGED", "error")
    return [finding(code, severity, "both", f"the {label(h)} differs" + (" in case, punctuation or typography only" if minor else ""), side(h), side(m), excerpt(shown(h)), excerpt(shown(m)))]


def pair_findings(p: Pair, h: dict, m: dict, both_bases: bool, limits: Limits) -> list[dict]:
    out = []
    if p.kind == "moved" or p.reordered:
        out.append(finding("ORDER_CHANGED", "warning", "both", f"the {label(h)} stands elsewhere in the Markdown", side(h), side(m)))
    if h["type"] != m["type"]:
        out.append(finding("STRUCTURE_CHANGED", "warning", "both", f"{label(h)} in HTML, {label(m)} in Markdown", side(h), side(m), h["type"], m["type"]))
    if h["type"] == "heading" == m["type"] and h["depth"] != m["depth"]:
        out.append(finding("HEADING_LEVEL_CHANGED", "warning", "both", f"h{h['depth']} in HTML, h{m['depth']} in Markdown", side(h), side(m), f"h{h['depth']}", f"h{m['depth']}"))
    rows = h["type"] == "table" == m["type"] and len(h["cells"] or []) == len(m["cells"] or [])
    if p.kind == "similar" and p.similarity < UNCERTAIN and not rows:
        out.append(finding("ALIGNMENT_UNCERTAIN", "warning", "both", f"aligned at {int(p.similarity * 100 + 0.5)} % token similarity", side(h), side(m)))
    return out + text_findings(h, m) + list_findings(h, m) + link_findings(h, m, both_bases, limits)


def sort_key(f: dict) -> tuple:
    def at(s):
        return FAR if not s or s.get("blockIndex") is None else s["blockIndex"]

    return at(f["html"]), at(f["markdown"]), SEVERITY[f["severity"]], f["code"]


def compare(html: dict, markdown: dict, both_bases: bool = False, limits: Limits | None = None) -> tuple[list[dict], dict]:
    """Ordered findings and coverage of two extractions."""
    limits = limits or Limits()
    a, b = html["blocks"], markdown["blocks"]
    pairs, only_a, only_b = align(a, b, limits)
    out = []
    if html["confidence"] == "low":
        out.append(finding("EXTRACTION_LOW_CONFIDENCE", "warning", "html_only", "no main content element; body was compared and may hold page chrome"))
    for name, direction, source in (("html", "html_only", html), ("markdown", "markdown_only", markdown)):
        for i in source["issues"]:
            out.append(finding(i["code"], i["severity"], direction, i["message"], **{name: {"line": i["line"], "path": None, "blockIndex": None, "excerpt": i["excerpt"]}}))
    for p in pairs:
        out += pair_findings(p, a[p.a], b[p.b], both_bases, limits)
    out += [finding("BLOCK_MISSING", "error", "html_only", f"the {label(a[i])} is only in the HTML", side(a[i]), None, excerpt(_words(a[i]))) for i in only_a]
    out += [finding("BLOCK_ADDED", "error", "markdown_only", f"the {label(b[j])} is only in the Markdown", None, side(b[j]), None, excerpt(_words(b[j]))) for j in only_b]
    out.sort(key=sort_key)
    na, nb = len(a) - len(only_a), len(b) - len(only_b)
    return out, {"htmlBlocks": len(a), "markdownBlocks": len(b), "htmlMatched": na, "markdownMatched": nb, "htmlRatio": na / len(a) if a else 0.0, "markdownRatio": nb / len(b) if b else 0.0}


# Relational forms.


def number_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """pair_id, idx, direction, value, n: how often each number occurs more on one side (multiset difference both ways). Inputs: pair_id, idx, numbers."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.select("pair_id", "idx", F.explode("numbers").alias("value")).groupBy("pair_id", "idx", "value").agg(F.count(F.lit(1)).alias(name))

    both = counts(left, "x").join(counts(right, "y"), ["pair_id", "idx", "value"], "full")
    gap = F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))
    return both.select("pair_id", "idx", "value", F.when(gap > 0, "html_only").otherwise("markdown_only").alias("direction"), F.abs(gap).alias("n")).where("n > 0")


def cell_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """pair_id, r, c, before, after of cells that differ, a missing cell being empty. Inputs: pair_id, cells."""
    def cells(df: DataFrame, name: str) -> DataFrame:
        rows = df.select("pair_id", F.posexplode("cells").alias("r", "row"))
        return rows.select("pair_id", "r", F.posexplode("row").alias("c", name))

    both = cells(left, "x").join(cells(right, "y"), ["pair_id", "r", "c"], "full")
    return both.select("pair_id", "r", "c", F.coalesce("x", F.lit("")).alias("before"), F.coalesce("y", F.lit("")).alias("after")).where("before <> after")


def severity_counts(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """pair_id, errors, warnings, infos; pairs without findings have zeros."""
    counts = findings.groupBy("pair_id").agg(*[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "infos"))])
    return pairs.select("pair_id").join(counts, "pair_id", "left").na.fill(0, ["errors", "warnings", "infos"])


def verdicts(counts: DataFrame, strict: bool = False) -> DataFrame:
    """result and exit_code from severity counts."""
    fail = (F.col("errors") > 0) | (F.lit(strict) & (F.col("warnings") > 0))
    return counts.withColumn("result", F.when(fail, "fail").otherwise("pass")).withColumn("exit_code", F.when(fail, 1).otherwise(0))


def ordered(findings: DataFrame) -> DataFrame:
    """Findings with position, their order within the pair. Needs html_index, md_index, severity, code and emit_seq."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    w = Window.partitionBy("pair_id").orderBy(F.coalesce("html_index", F.lit(FAR)), F.coalesce("md_index", F.lit(FAR)), rank, "code", "emit_seq")
    return findings.withColumn("position", F.row_number().over(w))
