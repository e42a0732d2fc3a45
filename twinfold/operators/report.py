"""Reports of checked pairs as JSON or text, masked; one string a pair."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame

from .. import __version__
from ..functions.redact import map_strings, one_line, redact_report
from ..plans.check import LIMITATIONS, ParityResult

TOOL = "twinfold"


def report(row: dict, strict: bool = False, sources: dict | None = None, generated_at: str | None = None) -> dict:
    """The report of one result row; absent fields of findings are left out, known unknowns are null."""
    findings = []
    for f in row["findings"] or []:
        f = {k: v for k, v in f.items() if v is not None}
        for s in ("html", "markdown"):
            if s in f:
                f[s] = {k: v for k, v in f[s].items() if v is not None}
        findings.append(f)
    count = {s: sum(f["severity"] == s for f in findings) for s in ("error", "warning", "info")}
    bad = count["error"] > 0 or strict and count["warning"] > 0
    error = row["error"]
    summary = {"result": "error" if error else "fail" if bad else "pass", "strict": strict, "errors": count["error"], "warnings": count["warning"], "infos": count["info"], "coverage": row["coverage"], "exitCode": 2 if error else int(bad)}
    if error:
        summary["error"] = error
        if row["error_value"] is not None:
            summary["errorValue"] = row["error_value"]
    coverage = row["coverage"]
    extraction = None
    if row["strategy"] is not None:
        extraction = {"html": {"strategy": row["strategy"], "confidence": row["confidence"], "blockCount": coverage and coverage["htmlBlocks"]}, "markdown": {"strategy": "markdown", "confidence": "high", "blockCount": coverage and coverage["markdownBlocks"]}, "notes": row["notes"]}
    return {"schemaVersion": 1, "toolVersion": __version__, "generatedAt": generated_at, "pairId": row["pair_id"], "sources": sources, "extraction": extraction, "summary": summary, "findings": findings, "limitations": LIMITATIONS}


def _whole(v):
    """Floats without a fraction as integers, as JSON writers of other languages have them."""
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if isinstance(v, dict):
        return {k: _whole(x) for k, x in v.items()}
    return [_whole(x) for x in v] if isinstance(v, list) else v


def render_json(r: dict) -> str:
    return json.dumps(_whole(redact_report(r)), indent=2, ensure_ascii=False) + "\n"


def render_text(r: dict) -> str:
    r = map_strings(redact_report(r), one_line)
    s, out = r["summary"], []
    out.append(f"{TOOL} {r['toolVersion']}, pair {r['pairId']}{', strict' if s['strict'] else ''}")
    if s["result"] == "error":
        out.append(f"ERROR: {s.get('error')}" + (f' (value "{s["errorValue"]}")' if "errorValue" in s else ""))
    else:
        out.append(f"{s['result'].upper()}: {s['errors']:,} errors, {s['warnings']:,} warnings, {s['infos']:,} infos")
    for side, meta in (r["sources"] or {}).items():
        out.append(f"{side}: " + ", ".join(f"{k} {v}" for k, v in meta.items() if v is not None))
    e, c = r["extraction"], s["coverage"]
    if e:
        out.append(f"read via {e['html']['strategy']} ({e['html']['confidence']} confidence)")
        out += [f"  note: {n}" for n in e["notes"]]
    if c:
        out.append(f"aligned: {c['htmlMatched']:,}/{c['htmlBlocks']:,} HTML blocks ({c['htmlRatio'] * 100:.0f} %), {c['markdownMatched']:,}/{c['markdownBlocks']:,} Markdown blocks ({c['markdownRatio'] * 100:.0f} %)")
    out.append(f"{len(r['findings']):,} findings" + (":" if r["findings"] else ""))
    for i, f in enumerate(r["findings"], 1):
        out.append(f"{i:4}. {f['severity']} {f['code']}: {f['message']}")
        for name in ("html", "markdown"):
            if name in f:
                x = f[name]
                at = ", ".join(str(v) for v in (x.get("line") and f"line {x['line']}", x.get("path"), x.get("blockIndex") is not None and f"block {x['blockIndex']}") if v)
                out.append(f"      {name}: {at}" + (f' "{x["excerpt"]}"' if x.get("excerpt") is not None else ""))
        if "before" in f or "after" in f:
            out += [f"      before: {f.get('before', '(none)')}", f"      after:  {f.get('after', '(none)')}"]
    out += ["limitations:", *(f"  - {x}" for x in r["limitations"])]
    return "\n".join(out) + "\n"


def reports(result: ParityResult, form: str = "json") -> DataFrame:
    """pair_id, report of every pair, ready for a text sink."""
    strict, render = result.strict, render_json if form == "json" else render_text

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = batch.slice(k, 64).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([r["pair_id"] for r in rows], pa.string()), pa.array([render(report(r, strict)) for r in rows], pa.string())], names=["pair_id", "report"])

    return result.results.mapInArrow(run, "pair_id string, report string")
