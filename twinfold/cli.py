"""Command line: ``python -m twinfold.cli``. Exit code 0 pass, 1 fail, 2 error."""

from __future__ import annotations

import argparse
import datetime
import os
import sys
import tempfile

from .functions.redact import echo_value, one_line, redact_text
from .operators.report import render_json, render_text, report
from .options import Options, positive_int
from .plans.check import check_pair
from .sources.files import decode_bytes
from .sources.http import FetchOptions, fetch


def same_path(a: str, b: str) -> bool:
    return os.path.realpath(a) == os.path.realpath(b) or os.path.exists(a) and os.path.exists(b) and os.path.samefile(a, b)


def write_atomic(path: str, text: str) -> None:
    """A file beside the target, then renamed over it."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("twinfold", description=__doc__)
    for name in ("url", "markdown-url", "html-file", "markdown-file", "base-url", "selector", "output", "timeout-ms", "max-bytes"):
        p.add_argument(f"--{name}")
    p.add_argument("--html-profile", choices=("generic", "starlight"), default="generic")
    p.add_argument("--front-matter", choices=("keep", "strip"), default="keep")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--format", choices=("text", "json"), default="text")
    return p


def read_file(path: str) -> tuple[str, int]:
    with open(path, "rb") as f:
        data = f.read()
    text = decode_bytes(data, "text/plain")
    return text, len(text.encode())


def main(argv: list[str] | None = None, out=sys.stdout, err=sys.stderr) -> int:
    def say(text: str) -> int:
        print(one_line(redact_text(text)), file=err)
        return 2

    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    try:
        o = Options(a.selector, a.html_profile, a.front_matter, a.strict)
        timeout, most = positive_int("--timeout-ms", a.timeout_ms, 15_000), positive_int("--max-bytes", a.max_bytes, 5 << 20)
        if bool(a.url) == bool(a.html_file or a.markdown_file) or not a.url and not (a.html_file and a.markdown_file):
            return say("give --url, or --html-file with --markdown-file")
        if a.url and a.base_url:
            return say("--base-url goes with files")
        if a.output and any(x and same_path(a.output, x) for x in (a.html_file, a.markdown_file)):
            return say("--output must not be an input")
    except ValueError as e:
        return say(str(e))
    try:
        if a.url:
            got = [fetch(u, FetchOptions(accept, timeout / 1000, most)) for u, accept in ((a.url, "text/html"), (a.markdown_url or a.url, "text/markdown"))]
            for g in got:
                if g["error"]:
                    return say(f"{g['error_kind']}: {g['error']}")
            if got[0]["status"] >= 400:
                return say(f"HTTP {got[0]['status']} for the HTML")
            bodies, bases = [g["body"] for g in got], [g["final_url"] for g in got]
            sources = {n: {k: g[k] for k in ("final_url", "status", "content_type", "accept", "redirects", "bytes")} for n, g in zip(("html", "markdown"), got, strict=True)}
        else:
            read = [read_file(x) for x in (a.html_file, a.markdown_file)]
            bodies, bases = [r[0] for r in read], [a.base_url] * 2
            sources = {n: {"file": f, "bytes": r[1]} for n, f, r in zip(("html", "markdown"), (a.html_file, a.markdown_file), read, strict=True)}
    except OSError as e:
        return say(f"cannot read {echo_value(str(e.filename))}: {e.strerror}")
    row = check_pair(*bodies, *bases, o) | {"pair_id": "0"}
    r = report(row, o.strict, sources, datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z")
    text = render_json(r) if a.format == "json" else render_text(r)
    try:
        if a.output:
            write_atomic(a.output, text)
        else:
            out.write(text)
            out.flush()
    except OSError as e:
        return say(f"cannot write: {e.strerror}")
    return r["summary"]["exitCode"]


if __name__ == "__main__":
    sys.exit(main())
