"""A Markdown reader: CommonMark blocks and inlines with tables, task items, strikethrough, literal links and footnotes.

Blocks are dicts with type and line; inline content is a list of nodes: ("text", s),
("code", s), ("break",), ("html", s, line), ("image", alt), ("note",) and
("link", children, url, form, offset), form being "[", "<" or "" for a literal link.
"""

from __future__ import annotations

import html as _html
import re
import unicodedata

_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})\s*(.*)$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( {1,4}(?! )| (?= {4})|(?=$)|\t)")
_NOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*")
_DEF = re.compile(r""" {0,3}\[((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*\n?[ \t]*(<(?:[^<>\n\\]|\\.)*>|[^\s<][^\s]*)(?:[ \t]*\n?[ \t]+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|\Z)""", re.S)
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
#: Names that start an HTML block (CommonMark, condition 6).
_HTML_NAMES = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".replace(" ", "|")
_OPEN_TAG = r"""<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>"""
_CLOSE_TAG = r"</[A-Za-z][A-Za-z0-9-]*\s*>"
_HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{_HTML_NAMES})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf" {{0,3}}(?:{_OPEN_TAG}|{_CLOSE_TAG})[ \t]*$"), None),
]
_INLINE_HTML = re.compile(rf"{_OPEN_TAG}|{_CLOSE_TAG}|<!--(?:>|->|.*?-->)|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>|<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,31});")
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LITERAL = re.compile(r"(?:(?<=^)|(?<=[\s*_~(]))(?:(?:https?://|www\.)(?:[\w-]+\.)*[\w-]+\.[\w-]+[^\s<]*|https?://[\w-]+(?:[:/][^\s<]*)?)", re.I)
_MAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@(?:[\w-]+\.)+[A-Za-z0-9-]*[A-Za-z0-9](?![\w-])")
_TASK = re.compile(r"\s*\[([ xX\t])\](?=[ \t\n]|$)[ \t]*")
_TICKS = re.compile(r"`+")
_REFERENCE = re.compile(r"\[\^([^\]\s]+)\]")
_MARKS = {c: re.compile(re.escape(c) + "+") for c in "*_~"}
_WORDS = re.compile(r"[^\\`<&\n!\[\]*_~]+")
#: What begins a mark, a link, a reference or a break inside a text.
_INLINE = re.compile(r"[\\`<&\n\[*_~]")
#: First characters, behind indentation, of lines that can be more than a paragraph's (beside digits).
_STARTS = frozenset("`~#=-*_<>[+|:")


def _plain_line(s: str) -> bool:
    """Whether a line with text can only be a paragraph's or indented code."""
    c = s.lstrip(" ")[:1]
    return c not in _STARTS and not c.isdecimal()


def _expand(line: str) -> str:
    """Tabs of the indentation as spaces."""
    if "\t" not in line:
        return line
    out, col = [], 0
    for i, c in enumerate(line):
        if c == "\t":
            n = 4 - col % 4
            out.append(" " * n)
            col += n
        elif c == " ":
            out.append(c)
            col += 1
        else:
            return "".join(out) + line[i:]
    return "".join(out)


def _indent(s: str) -> int:
    return len(s) - len(s.lstrip(" "))


def label_key(s: str) -> str:
    return re.sub(r"\s+", " ", s.strip()).casefold()


def unescape(s: str) -> str:
    s = re.sub(rf"\\([{re.escape(_PUNCT)}])|({_ENTITY.pattern})", lambda m: m[1] if m[1] else _html.unescape(m[2]), s)
    return s


class Document:
    """A parsed source: blocks in order and link definitions by label."""

    def __init__(self, source: str):
        self.definitions: dict[str, str] = {}
        self.notes: set[str] = set()
        lines = re.split(r"\r\n|\n|\r", source) if "\r" in source else source.split("\n")
        self.blocks = self._blocks([(_expand(s), i + 1) for i, s in enumerate(lines)])

    # blocks

    def _interrupts(self, s: str) -> bool:
        """Whether a line ends a paragraph by starting another block."""
        if _plain_line(s):
            return False
        if _RULE.match(s) or _ATX.match(s) or _FENCE.match(s) or _QUOTE.match(s):
            return True
        m = _ITEM.match(s)
        if m and s[m.end() :].strip() and (m[2] in "-+*" or m[2][:-1] == "1"):
            return True
        return any(p.match(s) for p, _ in _HTML[:6])

    def _blocks(self, lines: list[tuple[str, int]]) -> list[dict]:
        out: list[dict] = []
        para: list[tuple[str, int]] = []

        def flush() -> None:
            if not para:
                return
            text, line = "\n".join(s.strip(" \t") if k else s.lstrip(" \t") for k, (s, _) in enumerate(para)), para[0][1]
            para.clear()
            while text.startswith("["):
                m = _DEF.match(text)
                if not m or not label_key(m[1]) or m[1].startswith("^"):
                    break
                url = m[2][1:-1] if m[2].startswith("<") else m[2]
                self.definitions.setdefault(label_key(m[1]), unescape(url))
                line += text[: m.end()].count("\n")
                text = text[m.end() :]
            if text.strip():
                out.append({"type": "paragraph", "line": line, "raw": text.rstrip(" \t")})

        i = 0
        while i < len(lines):
            s, n = lines[i]
            if not s.strip():
                flush()
                i += 1
                continue
            if _indent(s) >= 4:
                if para:
                    para.append((s, n))
                    i += 1
                    continue
                body = []
                while i < len(lines) and (_indent(lines[i][0]) >= 4 or not lines[i][0].strip()):
                    body.append(lines[i][0][4:])
                    i += 1
                while body and not body[-1].strip():
                    body.pop()
                out.append({"type": "code", "line": n, "value": "\n".join(body)})
                continue
            if _plain_line(s):
                para.append((s, n))
                i += 1
                continue
            m = _FENCE.match(s)
            if m:
                flush()
                mark, pad = m[1], _indent(s)
                body, i = [], i + 1
                end = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
                while i < len(lines) and not end.match(lines[i][0]):
                    t = lines[i][0]
                    body.append(t[min(pad, _indent(t)) :])
                    i += 1
                i += 1
                out.append({"type": "code", "line": n, "value": "\n".join(body), "lang": m[2].strip()})
                continue
            m = _ATX.match(s)
            if m:
                flush()
                out.append({"type": "heading", "line": n, "depth": len(m[1]), "raw": (m[2] or "").strip()})
                i += 1
                continue
            m = _SETEXT.match(s)
            if m and para:
                line = para[0][1]
                flush()
                if out and out[-1]["type"] == "paragraph" and out[-1]["line"] >= line and "raw" in out[-1]:
                    out[-1] = {"type": "heading", "line": out[-1]["line"], "depth": 1 if m[1][0] == "=" else 2, "raw": out[-1]["raw"].strip()}
                    i += 1
                    continue
                if m[1][0] == "=":
                    para.append((s, n))
                    i += 1
                    continue
            if _RULE.match(s):
                flush()
                out.append({"type": "rule", "line": n})
                i += 1
                continue
            kind = next((k for k, (p, _) in enumerate(_HTML) if p.match(s)), None) if "<" in s else None
            if kind is not None and not (kind == 6 and para):
                flush()
                end, body = _HTML[kind][1], []
                while i < len(lines):
                    if end is None and not lines[i][0].strip():
                        break
                    body.append(lines[i][0])
                    i += 1
                    if end is not None and end.search(body[-1]):
                        break
                out.append({"type": "html", "line": n, "value": "\n".join(body)})
                continue
            if _QUOTE.match(s):
                flush()
                inner = []
                while i < len(lines):
                    t, k = lines[i]
                    q = _QUOTE.match(t)
                    if q:
                        inner.append((_expand(t[q.end() :]), k))
                    elif t.strip() and inner and inner[-1][0].strip() and not self._interrupts(t) and self._open_paragraph(inner):
                        inner.append((t.lstrip(" "), k))
                    else:
                        break
                    i += 1
                out.append({"type": "quote", "line": n, "children": self._blocks(inner)})
                continue
            m = _NOTE.match(s)
            if m and not para:
                inner, i = [(s[m.end() :], n)], i + 1
                while i < len(lines) and (not lines[i][0].strip() or _indent(lines[i][0]) >= 4 or inner[-1][0].strip() and not self._interrupts(lines[i][0]) and not _NOTE.match(lines[i][0])):
                    inner.append((lines[i][0][4:] if _indent(lines[i][0]) >= 4 else lines[i][0], lines[i][1]))
                    i += 1
                self.notes.add(label_key(m[1]))
                out.append({"type": "note", "line": n, "label": m[1], "children": self._blocks(inner)})
                continue
            m = _ITEM.match(s)
            if m and not (para and (not s[m.end() :].strip() or m[2][0].isdigit() and m[2][:-1] != "1")):
                flush()
                i = self._list(lines, i, out)
                continue
            if para and _DELIMITER.match(s) and ("|" in s or len(para) == 1 and "|" in para[-1][0]):
                head = _row(para[-1][0])
                if len(head) == len(_row(s)) and ("|" in s or "|" in para[-1][0]):
                    top = para.pop()
                    flush()
                    rows, i = [(head, top[1])], i + 1
                    while i < len(lines) and lines[i][0].strip() and not self._interrupts(lines[i][0]) and _indent(lines[i][0]) < 4:
                        cells = _row(lines[i][0])[: len(head)]
                        rows.append((cells + [""] * (len(head) - len(cells)), lines[i][1]))
                        i += 1
                    out.append({"type": "table", "line": top[1], "rows": rows})
                    continue
            para.append((s, n))
            i += 1
        flush()
        return out

    def _open_paragraph(self, lines: list[tuple[str, int]]) -> bool:
        """Whether the last of these lines belongs to a paragraph, however deep, that a lazy line may continue."""
        keep = dict(self.definitions), set(self.notes)
        last = self._blocks(lines[-40:])
        self.definitions, self.notes = keep
        while last and last[-1].get("children"):
            last = last[-1]["children"]
        return bool(last) and last[-1]["type"] == "paragraph"

    def _list(self, lines, i: int, out: list[dict]) -> int:
        m = _ITEM.match(lines[i][0])
        mark = m[2][-1]
        ordered = m[2][0].isdigit()
        node = {"type": "list", "line": lines[i][1], "ordered": ordered, "start": int(m[2][:-1]) if ordered else None, "children": []}
        while i < len(lines):
            s, n = lines[i]
            m = _ITEM.match(s)
            if not m or m[2][-1] != mark or m[2][0].isdigit() != ordered or _RULE.match(s):
                break
            rest = s[m.end() :]
            width = m.end() if rest.strip() else len(m[1]) + len(m[2]) + 1
            inner, i, blank = [(_expand(" " * 0 + rest), n)], i + 1, 0
            fence = _FENCE.match(rest)
            while i < len(lines):
                t, k = lines[i]
                if not t.strip():
                    if len(inner) == 1 and not inner[0][0].strip():
                        break
                    blank += 1
                    inner.append(("", k))
                elif _indent(t) >= width:
                    blank = 0
                    inner.append((t[width:], k))
                elif not blank and not fence and not self._interrupts(t) and not _ITEM.match(t) and inner[-1][0].strip() and self._open_paragraph(inner):
                    inner.append((t.lstrip(" "), k))
                else:
                    break
                i += 1
            checked = None
            task = _TASK.match(inner[0][0]) if "[" in inner[0][0] else None
            if task and inner[0][0][task.end() :].strip():
                checked = task[1] in "xX"
                inner[0] = (inner[0][0][task.end() :], inner[0][1])
            only = inner[0][0]
            if len(inner) == 1 and only.strip() and _indent(only) < 4 and _plain_line(only):
                children = [{"type": "paragraph", "line": n, "raw": only.strip(" \t")}]
            else:
                children = self._blocks(inner)
            node["children"].append({"type": "item", "line": n, "checked": checked, "children": children})
        out.append(node)
        return i

    # inlines

    def inline(self, raw: str, line: int, in_link: bool = False) -> list[tuple]:
        return _Inline(self, raw, line, in_link).nodes()


def _row(s: str) -> list[str]:
    """Cells of a table line; a backslash keeps a bar."""
    s = s.strip()
    s = s[1:] if s.startswith("|") else s
    cells = [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", s)]
    if len(cells) > 1 and cells[-1] == "" and re.search(r"(?<!\\)\|$", s):
        cells.pop()
    return cells


class _Inline:
    def __init__(self, doc: Document, raw: str, line: int, in_link: bool):
        self.doc, self.raw, self.line, self.in_link = doc, raw, line, in_link

    def nodes(self) -> list[tuple]:
        raw, n = self.raw, len(self.raw)
        literal = {} if self.in_link else self._literals()
        if not literal and not _INLINE.search(raw):
            return [("text", raw)] if raw else []
        out: list = []  # nodes, or [char, count, opens, closes] of delimiter runs
        brackets: list[tuple[int, int, bool]] = []
        ticks: dict[int, list[int]] = {}
        for m in _TICKS.finditer(raw) if "`" in raw else ():
            ticks.setdefault(len(m[0]), []).append(m.start())
        text: list[str] = []

        def put(node=None) -> None:
            if text:
                out.append(("text", "".join(text)))
                text.clear()
            if node is not None:
                out.append(node)

        i = 0
        while i < n:
            c = raw[i]
            if literal and i in literal and (hit := self._literal(literal[i])):
                put(hit[0])
                i = hit[1]
            elif c == "\\" and i + 1 < n:
                if raw[i + 1] == "\n":
                    put(("break",))
                    i += 2
                elif raw[i + 1] in _PUNCT:
                    text.append(raw[i + 1])
                    i += 2
                else:
                    text.append(c)
                    i += 1
            elif c == "`":
                m = _TICKS.match(raw, i)
                end = next((p for p in ticks.get(len(m[0]), ()) if p > i), None)
                if end is None:
                    text.append(m[0])
                    i = m.end()
                else:
                    body = raw[m.end() : end].replace("\n", " ")
                    if body[:1] == " " == body[-1:] and body.strip(" "):
                        body = body[1:-1]
                    put(("code", body))
                    i = end + len(m[0])
            elif c == "<" and (m := _AUTO.match(raw, i)):
                put(("link", [("text", m[1] or m[2])], m[1] or f"mailto:{m[2]}", "<", i))
                i = m.end()
            elif c == "<" and (m := _INLINE_HTML.match(raw, i)):
                put(("html", m[0], self.line + raw.count("\n", 0, i)))
                i = m.end()
            elif c == "&" and (m := _ENTITY.match(raw, i)):
                text.append(_html.unescape(m[0]))
                i = m.end()
            elif c == "\n":
                before = "".join(text)
                text[:] = [before.rstrip(" ")]
                put(("break",) if before.endswith("  ") else None)
                text.append("\n")
                i += 1
                while i < n and raw[i] == " ":
                    i += 1
            elif c == "!" and raw[i + 1 : i + 2] == "[":
                put()
                brackets.append((len(out), i + 2, True))
                out.append(("text", "!["))
                i += 2
            elif c == "[":
                m = _REFERENCE.match(raw, i)
                if m and label_key(m[1]) in self.doc.notes:
                    put(("note",))
                    i = m.end()
                    continue
                put()
                brackets.append((len(out), i + 1, False))
                out.append(("text", "["))
                i += 1
            elif c == "]" and brackets:
                put()
                at, start, image = brackets.pop()
                hit = self._target(start, i)
                if hit is None or not image and self._holds_link(out[at + 1 :]):
                    text.append("]")
                    i += 1
                    continue
                url, i = hit
                flat = [("text", plain(x[1])) if isinstance(x, tuple) and x[0] == "link" and x[3] == "" else x for x in out[at + 1 :]]
                inner = _pair(flat)
                del out[at:]
                if image:
                    out.append(("image", plain(inner)))
                else:
                    out.append(("link", inner, url, "[", start - 1))
                    brackets = [b for b in brackets if b[2]]
            elif c in "*_~":
                m = _MARKS[c].match(raw, i)
                put()
                out.append(self._run(m))
                i = m.end()
            else:
                m = _WORDS.match(raw, i)
                stop = m.end() if m else i + 1
                if literal:
                    stop = min([stop, *(k for k in literal if i < k < stop)])
                text.append(raw[i:stop])
                i = stop
        put()
        return _pair(out)

    def _literals(self) -> dict[int, re.Match]:
        """Mail addresses and literal links by offset, looked for where a text holds what each needs."""
        found = {m.start(): m for m in _MAIL.finditer(self.raw)} if "@" in self.raw else {}
        if "://" in self.raw or "www." in self.raw.lower():
            found |= {m.start(): m for m in _LITERAL.finditer(self.raw)}
        return found

    def _holds_link(self, nodes) -> bool:
        """Literal links inside brackets are text again; other links forbid a link around them."""
        return any(isinstance(x, tuple) and x[0] == "link" and x[3] for x in nodes)

    def _literal(self, m) -> tuple[tuple, int] | None:
        url, end = m[0], m.end()
        if "@" in url and not re.match(r"https?://|www\.", url, re.I):
            return ("link", [("text", url)], f"mailto:{url}", "", m.start()), end
        while True:
            if url and url[-1] in "?!.,:*_~'\"":
                url = url[:-1]
            elif url.endswith(")") and url.count(")") > url.count("("):
                url = url[:-1]
            elif e := re.search(r"&[A-Za-z0-9]+;$", url):
                url = url[: e.start()]
            else:
                break
        if not url:
            return None
        return ("link", [("text", url)], url if url.lower().startswith("http") else f"http://{url}", "", m.start()), m.start() + len(url)

    def _target(self, start: int, close: int) -> tuple[str, int] | None:
        """The url and end of what follows a closing bracket: (url "title"), [label], [] or nothing."""
        raw = self.raw
        if raw[close + 1 : close + 2] == "(":
            m = re.compile(r"""\(\s*(?:(<(?:[^<>\n\\]|\\.)*>)|((?:[^\s()\\<]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))*)?)(?:\s+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)""").match(raw, close + 1)
            if m:
                return unescape(m[1][1:-1] if m[1] else m[2] or ""), m.end()
        m = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(raw, close + 1)
        label = m[1] if m and m[1].strip() else raw[start:close]
        url = self.doc.definitions.get(label_key(label))
        if url is not None:
            return url, m.end() if m else close + 1
        if m and m[1].strip():
            return None
        return None

    def _run(self, m) -> list:
        raw, c = self.raw, m[0][0]
        before = raw[m.start() - 1] if m.start() else " "
        after = raw[m.end()] if m.end() < len(raw) else " "
        space = lambda x: x.isspace()
        punct = lambda x: unicodedata.category(x)[0] in "PS"
        left = not space(after) and (not punct(after) or space(before) or punct(before))
        right = not space(before) and (not punct(before) or space(after) or punct(after))
        if c == "_":
            return [c, len(m[0]), left and (not right or punct(before)), right and (not left or punct(after))]
        if c == "~" and len(m[0]) > 2:
            return [c, len(m[0]), False, False]
        return [c, len(m[0]), left, right]


def _pair(items: list) -> list[tuple]:
    """Matched emphasis and strikethrough marks taken out; the rest are text."""
    opened: list[int] = []
    size = {k: x[1] for k, x in enumerate(items) if isinstance(x, list)}
    for k, x in enumerate(items):
        if not isinstance(x, list):
            continue
        c, whole, opens, closes = x
        if closes:
            j = len(opened) - 1
            while j >= 0 and size[k] > 0:
                o = opened[j]
                y = items[o]
                fits = y[0] == c and (c == "~" and y[1] == whole or c != "~" and not ((y[3] or opens) and (y[1] + whole) % 3 == 0 and (y[1] % 3 or whole % 3)))
                if not fits:
                    j -= 1
                    continue
                take = whole if c == "~" else 2 if size[o] >= 2 and size[k] >= 2 else 1
                size[o] -= take
                size[k] -= take
                del opened[j + 1 :]
                if size[o] == 0:
                    opened.pop()
                    j -= 1
        if opens and size[k] > 0:
            opened.append(k)
    out: list[tuple] = []
    for k, x in enumerate(items):
        if isinstance(x, list):
            if size[k]:
                out.append(("text", x[0] * size[k]))
        else:
            out.append(x)
    return out


def plain(nodes: list[tuple]) -> str:
    return "".join(plain(x[1]) if x[0] == "link" else x[1] if x[0] in ("text", "code", "image") else " " if x[0] == "break" else "" for x in nodes)
