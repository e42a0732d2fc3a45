"""A tolerant HTML tree (source offsets kept) and a small CSS selector engine."""

from __future__ import annotations

import html as _html
import re

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<!--(.*?)(?:-->|\Z)|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp".split())
_P_BREAKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("optgroup", "option"), "thead": ("tbody", "tfoot", "tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "rt": ("rt", "rp"), "rp": ("rt", "rp"), "h1": ("p",), "body": ("head",)}
_WALLS = frozenset("table ul ol dl td th article section div main body template".split())


class Element:
    __slots__ = ("name", "attrs", "children", "parent", "start", "end")

    def __init__(self, name: str, attrs: dict[str, str], parent: Element | None, start: int):
        self.name, self.attrs, self.parent, self.start, self.end = name, attrs, parent, start, start
        self.children: list[Element | Text] = []

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def walk(self):
        """Descendant elements in document order."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Element):
                yield n
                stack.extend(reversed(n.children))

    def ancestors(self):
        p = self.parent
        while p is not None and p.parent is not None or p is not None and p.name != "#document":
            yield p
            p = p.parent

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())


class Text:
    __slots__ = ("data", "parent", "start")

    def __init__(self, data: str, parent: Element, start: int):
        self.data, self.parent, self.start = data, parent, start


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        value = m[2]
        out.setdefault(m[1].lower(), "" if value is None else _html.unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


def parse(source: str, close: bool = True) -> Element:
    """The document as a tree. close False: .end of the document's attrs holds the elements that are still open."""
    root = Element("#document", {}, None, 0)
    stack = [root]
    at, n = 0, len(source)

    def text(data: str, start: int, literal: bool = False) -> None:
        if data:
            stack[-1].children.append(Text(data if literal else _html.unescape(data), stack[-1], start))

    def close_upto(names) -> None:
        hit = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                hit = i
            elif stack[i].name in _WALLS:
                break
        if hit is not None:
            del stack[hit:]

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            text(source[at:], at)
            break
        m = _TAG.match(source, lt)
        if m is None:
            nxt = source.find("<", lt + 1)
            nxt = n if nxt < 0 else nxt
            text(source[at:nxt], at)
            at = nxt
            continue
        text(source[at:lt], at)
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                stack[-1].children.append(Element("br", {}, stack[-1], lt))
            elif name == "p" and not any(e.name == "p" for e in stack):
                stack[-1].children.append(Element("p", {}, stack[-1], lt))
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        stack[i].end = at
                        del stack[i:]
                        break
            continue
        if name in _ENDS:
            close_upto(_ENDS[name])
        if name in _P_BREAKS:
            close_upto(("p",))
        body = m[3]
        element = Element(name, attributes(body), stack[-1], lt)
        stack[-1].children.append(element)
        if name in VOID or body.endswith("/") and any(e.name in ("svg", "math") for e in [*stack, element]):
            continue
        stack.append(element)
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            stop = end.start() if end else n
            text(source[at:stop], at, literal=name in ("script", "style", "xmp"))
            at = end.end() if end else n
            stack.pop()
    if not close:
        root.attrs["open"] = stack[1:]
    return root


def depth(root: Element) -> int:
    """Deepest nesting of elements, counted without recursion."""
    most, stack = 0, [(c, 1) for c in root.children]
    while stack:
        node, d = stack.pop()
        if isinstance(node, Element):
            most = max(most, d)
            stack.extend((c, d + 1) for c in node.children)
    return most


class SelectorError(ValueError):
    """The selector can't be read."""


_SIMPLE = re.compile(r"""(?P<tag>[A-Za-z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*(?P<flag>[is])?\s*)?\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?""")


def _nth(arg: str):
    arg = arg.strip().lower()
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    m = re.fullmatch(r"([+-]?\d*)n\s*([+-]\s*\d+)?|([+-]?\d+)", arg)
    if not m:
        raise SelectorError(arg)
    if m[3] is not None:
        return 0, int(m[3])
    a = {"": 1, "+": 1, "-": -1}.get(m[1], None)
    return a if a is not None else int(m[1]), int((m[2] or "0").replace(" ", ""))


def _compound(text: str) -> list:
    out, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise SelectorError(text)
        at = m.end()
        if m["tag"]:
            name = m["tag"].lower()
            out.append(lambda e, name=name: name == "*" or e.name == name)
        elif m["id"]:
            out.append(lambda e, v=m["id"]: e.attrs.get("id") == v)
        elif m["cls"]:
            out.append(lambda e, v=m["cls"]: v in e.classes())
        elif m["attr"]:
            key, op, val = m["attr"].lower(), m["op"], m["val"]
            val = val[1:-1] if val and val[0] in "\"'" else val
            tests = {
                None: lambda x, v: True, "=": lambda x, v: x == v, "~=": lambda x, v: v in x.split(), "^=": lambda x, v: bool(v) and x.startswith(v),
                "$=": lambda x, v: bool(v) and x.endswith(v), "*=": lambda x, v: bool(v) and v in x, "|=": lambda x, v: x == v or x.startswith(f"{v}-"),
            }
            low = m["flag"] == "i"
            out.append(lambda e, key=key, t=tests[op], v=val, low=low: key in e.attrs and t(e.attrs[key].lower() if low else e.attrs[key], v.lower() if low and v else v))
        else:
            name, arg = m["pseudo"].lower(), m["arg"]
            if name in ("not", "is", "where"):
                inner = compile_selector(arg or "")
                out.append(lambda e, s=inner, no=name == "not": matches(e, s) != no)
            elif name in ("first-child", "last-child", "only-child", "nth-child", "nth-of-type", "first-of-type", "last-of-type"):
                a, b = _nth(arg) if name.startswith("nth") else (0, 1)

                def position(e, name=name, a=a, b=b):
                    peers = [x for x in e.parent.elements() if "type" not in name or x.name == e.name] if e.parent else [e]
                    i = peers.index(e) + 1
                    if name.startswith("last"):
                        return i == len(peers)
                    if name == "only-child":
                        return len(peers) == 1
                    return i == b if a == 0 else (i - b) % a == 0 and (i - b) // a >= 0

                out.append(position)
            elif name == "empty":
                out.append(lambda e: not e.children)
            else:
                raise SelectorError(text)
    if not out:
        raise SelectorError(text)
    return out


def compile_selector(text: str) -> list[list[tuple[str, list]]]:
    """Alternatives, each a list of (combinator before, tests)."""
    out = []
    for alternative in re.split(r",(?![^\[(]*[\])])", text):
        alternative = alternative.strip()
        if not alternative:
            raise SelectorError(text)
        parts = re.findall(r"\s*[>+~]\s*|\s+|(?:\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\)|[^\s>+~\[(])+", alternative)
        if "".join(parts) != alternative:
            raise SelectorError(text)
        chain, comb = [], ""
        for p in parts:
            if not p.strip() or p.strip() in (">", "+", "~"):
                if comb.strip() and p.strip():
                    raise SelectorError(text)
                comb = p.strip() or comb or " "
            else:
                if chain and not comb:
                    raise SelectorError(text)
                chain.append((comb or " ", _compound(p)))
                comb = ""
        if comb.strip() or not chain:
            raise SelectorError(text)
        out.append(chain)
    return out


def matches(e: Element, selector) -> bool:
    def chain(e: Element, parts) -> bool:
        comb, tests = parts[-1]
        if not all(t(e) for t in tests):
            return False
        rest = parts[:-1]
        if not rest:
            return True
        if comb == ">":
            return e.parent is not None and e.parent.name != "#document" and chain(e.parent, rest)
        if comb == " ":
            return any(chain(a, rest) for a in e.ancestors())
        peers = e.parent.elements() if e.parent else [e]
        before = peers[: peers.index(e)]
        return bool(before) and (chain(before[-1], rest) if comb == "+" else any(chain(b, rest) for b in before))

    return any(chain(e, parts) for parts in selector)


def select(root: Element, text: str) -> list[Element]:
    selector = compile_selector(text)
    return [e for e in root.walk() if matches(e, selector)]
