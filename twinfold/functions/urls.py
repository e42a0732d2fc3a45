"""URL kernels: a subset of the WHATWG parser, link resolution, relations of unresolved references, and masking for display.

Covers special schemes with domain, IPv4 (also in parts, octal or hex) and IPv6 hosts,
default ports, dot segments and percent-encoding by component; other schemes keep opaque
paths. International hosts go through the IDNA codec of Python.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, quote_plus

from .text import utf16_len

PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
MAX_LINK_TARGET_CHARS = 8192
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")
_FORBIDDEN = set("\x00\t\n\r #/:<>?@[\\]^|%") | {chr(i) for i in range(0x20)} | {"\x7f"}
_DOTS = {".", "%2e", "%2E"}


class UrlError(ValueError):
    """The parser refuses the text."""


class LinkTargetError(ValueError):
    """A link target beyond MAX_LINK_TARGET_CHARS; the target itself is never repeated."""

    def __init__(self, length: int):
        super().__init__(f"link target of {length} characters, over the limit of {MAX_LINK_TARGET_CHARS}")
        self.length = length


def trim_href(href: str) -> str:
    a, b = 0, len(href)
    while a < b and href[a] <= " ":
        a += 1
    while b > a and href[b - 1] <= " ":
        b -= 1
    return href[a:b]


def parser_input(href: str) -> str:
    return re.sub(r"[\t\n\r]", "", trim_href(href))


def _encode(s: str, unsafe: str) -> str:
    if s.isascii() and not any(c in unsafe or c < "!" or c > "~" for c in s):
        return s
    out = []
    for c in s:
        if c in unsafe or c < "!" or c > "~":
            out += [f"%{b:02X}" for b in c.encode("utf-8", "replace")]
        else:
            out.append(c)
    return "".join(out)


def _part(s: str) -> int | None:
    base = 10
    if s[:2].lower() == "0x":
        s, base = s[2:], 16
    elif len(s) > 1 and s[0] == "0":
        s, base = s[1:], 8
    try:
        return int(s, base) if re.fullmatch(r"[0-9a-fA-F]*", s) and s else 0 if not s else None
    except ValueError:
        return None


def _host(raw: str, special: bool) -> str:
    if raw.startswith("["):
        if not raw.endswith("]"):
            raise UrlError("host")
        try:
            v6 = ipaddress.IPv6Address(raw[1:-1])
        except ValueError as e:
            raise UrlError("host") from e
        if "%" in raw:
            raise UrlError("host")
        words = [int.from_bytes(v6.packed[i : i + 2], "big") for i in range(0, 16, 2)]
        best = (0, 0)
        i = 0
        while i < 8:
            j = i
            while j < 8 and words[j] == 0:
                j += 1
            if j - i > max(1, best[1] - best[0]):
                best = (i, j)
            i = max(j, i + 1)
        text = [f"{w:x}" for w in words]
        if best[1]:
            return f"[{':'.join(text[: best[0]])}::{':'.join(text[best[1] :])}]"
        return f"[{':'.join(text)}]"
    if not special:
        if any(c in _FORBIDDEN - {"%"} for c in raw):
            raise UrlError("host")
        return _encode(raw, "")
    from urllib.parse import unquote

    host = unquote(raw, errors="replace").lower()
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError as e:
            raise UrlError("host") from e
    if not host or any(c in _FORBIDDEN for c in host):
        raise UrlError("host")
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts = parts[:-1]
    if re.fullmatch(r"\d+|0[xX][0-9a-fA-F]*", parts[-1]):
        values = [_part(p) if p else None for p in parts]
        if len(values) > 4 or any(v is None for v in values) or any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - len(values)):
            raise UrlError("host")
        n = values[-1] + sum(v * 256 ** (3 - i) for i, v in enumerate(values[:-1]))
        return str(ipaddress.IPv4Address(n))
    return host


@dataclass
class Url:
    scheme: str
    user: str = ""
    password: str = ""
    host: str | None = None
    port: int | None = None
    path: list[str] | str = field(default_factory=list)
    query: str | None = None
    fragment: str | None = None

    @property
    def special(self) -> bool:
        return self.scheme in PORTS

    @property
    def pathname(self) -> str:
        return self.path if isinstance(self.path, str) else "".join(f"/{p}" for p in self.path)

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}{'' if self.port is None else f':{self.port}'}" if self.scheme in PORTS and self.scheme != "file" else "null"

    @property
    def href(self) -> str:
        auth = ""
        if self.host is not None:
            login = self.user + (f":{self.password}" if self.password else "")
            auth = f"//{login}{'@' if login else ''}{self.host}{'' if self.port is None else f':{self.port}'}"
        elif not isinstance(self.path, str) and len(self.path) > 1 and self.path[0] == "":
            auth = "/."
        return f"{self.scheme}:{auth}{self.pathname}{'' if self.query is None else f'?{self.query}'}{'' if self.fragment is None else f'#{self.fragment}'}"


def _segments(start: list[str], text: str, special: bool) -> list[str]:
    out = list(start)
    parts = re.split(r"[/\\]", text) if special else text.split("/")
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        low = re.sub(r"%2e", ".", p, flags=re.I)
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(_encode(p, '"#<>?`{}^'))
    return out


def _authority(u: Url, text: str) -> None:
    at = text.rfind("@")
    if at >= 0:
        login = text[:at]
        user, _, password = login.partition(":")
        unsafe = "\"#<>?`{}/:;=@[\\]^|'"
        u.user, u.password = _encode(user, unsafe), _encode(password, unsafe)
        text = text[at + 1 :]
        if not text:
            raise UrlError("host")
    m = re.search(r":([^\]:]*)$", text)
    if m:
        port = m[1]
        text = text[: m.start()]
        if port:
            if not re.fullmatch(r"[0-9]+", port) or int(port) > 65535:
                raise UrlError("port")
            u.port = None if PORTS.get(u.scheme) == int(port) else int(port)
    if not text and (u.special and u.scheme != "file" or u.port is not None or u.user):
        raise UrlError("host")
    u.host = _host(text, u.special) if text else ""


def parse(href: str, base: str | Url | None = None) -> Url:
    """The URL, resolved against base if it is relative; UrlError if the parser refuses it."""
    text = parser_input(href)
    text, hash_, fragment = text.partition("#")
    tail = _encode(fragment, '"<>`') if hash_ else None
    m = _SCHEME.match(text)
    b = parse(base) if isinstance(base, str) else base
    scheme = m[0][:-1].lower() if m else None
    rest = text[m.end() :] if m else text
    same = scheme is not None and b is not None and scheme in PORTS and b.scheme == scheme
    if scheme is not None and not (same and not re.match(r"[/\\]{2}", rest)):
        u = Url(scheme, fragment=tail)
        body, q, query = rest.partition("?")
        if q:
            u.query = _encode(query, "\"#<>'" if u.special else '"#<>')
        if u.special:
            body = body.replace("\\", "/")
            if scheme == "file":
                if body.startswith("//"):
                    body = body[2:]
                    host, slash, path = body.partition("/")
                    u.host = "" if host.lower() == "localhost" else _host(host, True) if host else ""
                    body = slash + path
                else:
                    u.host = ""
                u.path = _segments([], body[1:] if body.startswith("/") else body, True)
                return u
            body = body.lstrip("/")
            host, slash, path = body.partition("/")
            _authority(u, host)
            u.path = _segments([], path, True) if slash else [""]
            return u
        if body.startswith("//"):
            host, slash, path = body[2:].partition("/")
            _authority(u, host)
            u.path = _segments([], path, False) if slash else []
        elif body.startswith("/"):
            u.path = _segments([], body[1:], False)
        else:
            u.path = "".join(c if " " <= c <= "~" else _encode(c, "") for c in body)
            if u.query is None and u.fragment is None:
                u.path = u.path.rstrip(" ")
        return u
    if b is None:
        raise UrlError("relative")
    if isinstance(b.path, str):
        if text or not hash_:
            raise UrlError("relative")
        return Url(b.scheme, b.user, b.password, b.host, b.port, b.path, b.query, tail)
    u = Url(b.scheme, b.user, b.password, b.host, b.port, list(b.path), b.query, tail)
    body, q, query = rest.partition("?")
    if u.special:
        body = body.replace("\\", "/")
    if body.startswith("//"):
        u.user = u.password = ""
        u.port = None
        body = body.lstrip("/") if u.special and u.scheme != "file" else body[2:]
        host, slash, path = body.partition("/")
        _authority(u, host)
        u.path = _segments([], path, u.special) if slash else ([""] if u.special else [])
        u.query = None
    elif body.startswith("/"):
        u.path, u.query = _segments([], body[1:], u.special), None
    elif body:
        u.path, u.query = _segments(u.path[:-1], body, u.special), None
    if q:
        u.query = _encode(query, "\"#<>'" if u.special else '"#<>')
    return u


def resolve_href(raw: str, base: str | None) -> str | None:
    if utf16_len(raw) > MAX_LINK_TARGET_CHARS:
        raise LinkTargetError(utf16_len(raw))
    href = trim_href(raw)
    if not href:
        return None
    try:
        return parse(href, base or None).href
    except UrlError:
        return None


def href_difference(a: str, b: str) -> str:
    def split(h: str) -> tuple[str, str, str]:
        try:
            u = parse(h, "http://relative.invalid/")
        except UrlError:
            return h, "", ""
        return u.origin + u.pathname, u.query or "", u.fragment or ""

    names = [n for n, x, y in zip(("path or host", "query", "fragment"), split(a), split(b), strict=True) if x != y]
    return ", ".join(names) or "nothing visible"


def href_relation(a: str, b: str) -> str:
    """same, different or uncertain, for two references without a base: decided under bases that share no name, and by kind."""
    x, y = parser_input(a), parser_input(b)
    if x == y:
        return "same"

    def path(h: str) -> str:
        return re.split(r"[?#]", h.replace("\\", "/"), maxsplit=1)[0]

    def climbs(h: str) -> int:
        return sum(re.sub("%2e", ".", s, flags=re.I) == ".." for s in path(h).split("/"))

    deep = max(climbs(x), climbs(y)) + 1
    bases = [f"{origin}{f'{d}/' * deep}{end}" for origin in ("https://base.invalid/", "http://other.invalid/") for d, f, q in (("d", "f", "?q"), ("e", "g", "?r")) for end in ("", f, f + q)]
    try:
        left, right = ([parse(h, p).href for p in bases] for h in (x, y))
    except UrlError:
        return "different"
    if left == right:
        return "same"

    def kind(h: str) -> str:
        p = h.replace("\\", "/")
        return "network" if p.startswith("//") else "absolute" if p.startswith("/") else "relative" if path(h) and not climbs(h) else "open"

    return "different" if kind(x) != "open" and kind(x) == kind(y) else "uncertain"


def without_userinfo(href: str) -> str:
    """href without user name and password; where no parser can tell where they end, all up to the last @ becomes ***."""
    h = parser_input(href)
    m = _SCHEME.match(h)
    special = m is None or m[0][:-1].lower() in PORTS
    slashes = "/\\" if special else "/"
    start = m.end() if m else 0
    j = start
    while j < len(h) and h[j] in slashes:
        j += 1
    if not (j - start >= 2 if m is None else special or h.startswith("//", start)):
        return href
    if m and not special:
        j = start + 2
    try:
        parse(h, None if m else "https://base.invalid/")
        known = True
    except UrlError:
        known = False
    at = -1
    for k in range(j, len(h)):
        if h[k] in "?#" or known and h[k] in slashes:
            break
        if h[k] == "@":
            at = k
    return href if at < 0 else h[:j] + ("" if known else "***@") + h[at + 1 :]


def mask_href(href: str) -> str:
    """Query values as ***, no fragment, no user information."""
    try:
        u = parse(href)
    except UrlError:
        plain = without_userinfo(href).partition("#")[0]
        head, q, query = plain.partition("?")
        return plain if not q else head + "?" + "&".join(kv if kv == "" else kv.partition("=")[0] + "=***" for kv in query.split("&"))
    u.user = u.password = ""
    u.fragment = None
    if u.query is not None:
        names = list(dict.fromkeys(k for k, _ in parse_qsl(u.query, keep_blank_values=True)))
        if names:
            u.query = "&".join(f"{quote_plus(k, safe='*-._')}=***" for k in names)
    return u.href


mask_url = mask_href


def without_secrets(url: str) -> str:
    """The URL without user information, query values and fragment; the names of the query stay."""
    h = without_userinfo(url).partition("#")[0]
    head, q, query = h.partition("?")
    return h if not q else head + "?" + "&".join(kv[: kv.find("=") + 1] if "=" in kv else kv for kv in query.split("&"))
