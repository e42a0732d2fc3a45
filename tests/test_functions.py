"""Text keys, URLs, addresses, redaction and the DOM, on tables of cases."""

import random
import time

import pytest
from twinfold.functions import dom, netguard, redact, text, urls


@pytest.mark.parametrize(("raw", "strict", "loose", "key"), [
    ("  a\xa0b\t c ", "a b c", "a b c", "a b c"), ("Café ​x\xad", "Caf\xe9 x", "caf\xe9 x", "caf\xe9 x"), ("“Hi” — there…", "“Hi” — there…", "hi there", "hi there"),
    ("a✓b", "a✓b", "a b", "a✓b"), ("x️!", "x️!", "x", "x"), ("", "", "", ""),
])
def test_keys(raw, strict, loose, key):
    assert (text.strict_normalize(raw), text.loose_normalize(raw), text.text_key(raw)) == (strict, loose, key)


@pytest.mark.parametrize(("raw", "out"), [
    ("-5 and a-5", ["-5", "5"]), ("2026-09-10", ["2026-09-10"]), ("490 €, 87 %", ["490€", "87%"]), ("−5", ["-5"]), ("1 200 €", ["1", "200€"]), ("v1.4.2", ["4.2"]), ("٥٦", ["٥٦"]), ("none", []),
])
def test_numbers(raw, out):
    assert text.extract_numbers(raw) == out


def test_code_keys():
    assert text.normalize_code("a\r\nb\rc\n\n") == "a\nb\nc"
    assert text.code_whitespace_key("\t a\xa0 b ") == "a b"
    assert text.code_whitespace_key("a\xadb") != text.code_whitespace_key("ab")
    assert text.utf16_len("a\U0001f600") == 3
    assert text.utf16_cut("a\U0001f600b", 2) == "a"


def test_columns_agree_with_kernels(spark):
    from pyspark.sql import functions as F

    cases = ["  a\xa0b\t c ", "“Hi” — x… y‍z", "a✓b 12% €5", "x️! -5 a-5 2026-09-10", "　wide　", "", "line\r\nx\n\n"]
    c = F.col("t")
    df = spark.createDataFrame([(s,) for s in cases], "t string").select("t", text.strict_column(c), text.loose_column(c), text.text_key_column(c), text.code_whitespace_column(c), text.normalize_code_column(c), text.strip_controls_column(c), text.numbers_column(c))
    for r in df.collect():
        t = r[0]
        assert tuple(r)[1:] == (text.strict_normalize(t), text.loose_normalize(t), text.text_key(t), text.code_whitespace_key(t), text.normalize_code(t), text.strip_controls(t), text.extract_numbers(t))


@pytest.mark.parametrize(("href", "base", "out"), [
    ("HTTP://EX.com:80/a/../b?x#y", None, "http://ex.com/b?x#y"), ("../c?d", "https://h/a/b/", "https://h/a/c?d"), ("//x/y", "https://h/", "https://x/y"), ("?q", "https://h/x/y?z#f", "https://h/x/y?q"),
    ("#f", "https://h/x?z", "https://h/x?z#f"), ("", "https://h/", None), ("x", None, None), ("mailto:a@b.c", None, "mailto:a@b.c"), ("http://0x7f.1/", None, "http://127.0.0.1/"), ("/a b\xe9", "https://h/", "https://h/a%20b%C3%A9"),
    ("https:foo", "https://h/x/", "https://h/x/foo"), ("http://[::1]:8080/", None, "http://[::1]:8080/"), ("http://a b/", None, None), ("\\\\h2\\p", "https://h/", "https://h2/p"), ("/%2e%2e/x", "https://h/a/b", "https://h/x"),
])
def test_resolve(href, base, out):
    assert urls.resolve_href(href, base) == out


def test_link_target_limit():
    assert urls.resolve_href("/" + "a" * 8191, "https://h/") is not None
    with pytest.raises(urls.LinkTargetError):
        urls.resolve_href("/" + "a" * 8192, "https://h/")


@pytest.mark.parametrize(("a", "b", "out"), [("./g", "g", "same"), ("../g", "g", "uncertain"), ("a", "b", "different"), ("/a", "/b", "different"), ("?q", "./?q", "uncertain"), ("a/../b", "b", "same"), (".\t./g", "../g", "same")])
def test_relation(a, b, out):
    assert urls.href_relation(a, b) == urls.href_relation(b, a) == out


def test_relation_is_sound():
    rng, parts = random.Random(5), ["a", "b", "..", ".", "", "?q", "#f", "%2e%2e"]
    bases = ["https://h/", "https://h/x", "http://k/a/b/c", "https://h/d/e/?z"]
    for _ in range(400):
        a, b = ("/".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(2))
        got, met = urls.href_relation(a, b), [urls.resolve_href(a, x) == urls.resolve_href(b, x) for x in bases if urls.trim_href(a) and urls.trim_href(b)]
        if met and got == "same":
            assert all(met), (a, b)
        if met and got == "different":
            assert not any(met), (a, b)


@pytest.mark.parametrize(("href", "out"), [("https://u:p@h/x?a=1&b=2&a=3#f", "https://h/x?a=***&b=***"), ("/x?a=1&&b#f", "/x?a=***&&b=***"), ("//u:p@h/x", "//h/x"), ("https://h:99999/?a=1", "https://h:99999/?a=***")])
def test_mask(href, out):
    assert urls.mask_href(href) == out


def test_difference():
    assert urls.href_difference("https://h/a?x#y", "https://h/b?x#z") == "path or host, fragment"
    assert urls.href_difference("/a", "/a") == "nothing visible"


@pytest.mark.parametrize(("ip", "public"), [
    ("8.8.8.8", True), ("10.1.1.1", False), ("100.64.0.1", False), ("172.32.0.1", True), ("192.0.2.9", False), ("224.0.0.1", False), ("1.2.3.04", False), ("2001:4860::8888", True), ("::1", False), ("::ffff:10.0.0.1", False), ("::ffff:8.8.8.8", True),
    ("2002:0a00:1::", False), ("64:ff9b::8.8.8.8", True), ("64:ff9b:1::1", False), ("2001:db8::1", False), ("fe80::1", False), ("fc00::1", False), ("3fff::1", False), ("2001:20::1", True), ("2001:2::1", False), ("4000::1", False), ("x", False),
])
def test_public(ip, public):
    assert netguard.is_public_address(ip) is public


def test_names():
    assert [netguard.ip_version(x) for x in ("1.2.3.4", "::", "fe80::1%eth0", "1::2::3", "h")] == [4, 6, 6, 0, 0]
    assert netguard.is_local_name("A.local.") and not netguard.is_local_name("locale.example")
    for host in ("localhost", "x.internal", "127.0.0.1", "[::1]", ""):
        with pytest.raises(netguard.BlockedAddressError):
            netguard.assert_public_host(host)
    netguard.assert_public_host("example.org")


@pytest.mark.parametrize(("raw", "gone", "kept"), [
    ("see https://u:sec@h.example/x?tok=abc#frag, ok", ("sec", "abc", "frag"), ("h.example/x", ", ok")), ("a user:secret@host.example/path b", ("secret",), ("host.example/path",)), ("x scheme://(name):sec@h/", ("sec", "name"), ("h/",)),
    ("www.a.example/x?k=v1.", ("v1",), ("www.a.example/x", ".")), ("https://us er:sec ret@host/ z", (), ("z",)), ("redirect=https://u:sec@h/cb?state=1", ("sec",), ()), ("esc \x1b[2J bidi ‮", ("\x1b", "‮"), ("[2J",)),
])
def test_redaction(raw, gone, kept):
    out = redact.redact_text(raw)
    assert not any(g in out for g in gone) and all(k in out for k in kept), out


@pytest.mark.parametrize("raw", ["plain text, nothing: here (really)!", "mail me@x.org", "3/4 of a:b", "Use https://api.example.com:8443/ or write to ops@example.org"])
def test_ordinary_text_stays(raw):
    assert redact.redact_text(raw) == raw


def test_redaction_is_linear():
    for shape in ("a:", "://", "http://(", "x@", "(((", "?a=", "a.b."):
        s, t = shape * (100_000 // len(shape)), time.time()
        redact.excerpt(s)
        assert time.time() - t < 8, shape


def test_excerpt_and_numbers():
    assert redact.excerpt("x" * 100) == "x" * 79 + "…"
    assert redact.visible_numbers("7 https://h/x?id=55 8") == ["7", "8"]
    assert redact.one_line("a\nb\r") == "a\\nb\\r"
    assert redact.redact_report({"a": ["https://h/?x=1"], "n": 1, "z": None}) == {"a": ["https://h/?x=***"], "n": 1, "z": None}


def test_dom_closes_what_browsers_close():
    d = dom.parse("<ul><li>1<li>2</ul><p>a<p>b<div>c<table><tr><td>x<td>y<tr><td>z</table>")
    assert [e.name for e in d.walk()] == ["ul", "li", "li", "p", "p", "div", "table", "tr", "td", "td", "tr", "td"]
    assert dom.depth(d) == 4
    assert dom.parse("<a title='x > y' hidden>z").elements()[0].attrs == {"title": "x > y", "hidden": ""}
    assert dom.parse("<script>if (a < b) '<p>'</script>").elements()[0].children[0].data == "if (a < b) '<p>'"


@pytest.mark.parametrize(("selector", "ids"), [("p.a", ["1"]), ("div > p", ["1", "2"]), ("#2 ~ span, h1 + div", ["d", "3"]), ("[data-x^=ab]", ["2"]), ("p:nth-of-type(2)", ["2"]), ("div :not(p)", ["3"]), ("*:first-child[id='1']", ["1"])])
def test_selectors(selector, ids):
    d = dom.parse("<h1 id=h></h1><div id=d><p class='a b' id=1></p><p id=2 data-x=abc></p><span id=3></span></div>")
    assert [e.attrs["id"] for e in dom.select(d, selector)] == ids


@pytest.mark.parametrize("bad", ["p >", ">> p", "p[", "p::x(", ""])
def test_bad_selectors(bad):
    with pytest.raises(dom.SelectorError):
        dom.select(dom.parse("<p>"), bad)
