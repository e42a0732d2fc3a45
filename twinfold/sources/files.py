"""Pairs from files and tables; bodies decoded as browsers do."""

from __future__ import annotations

import codecs
import gzip
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What the Encoding standard reads in place of a codec, by Python's name of it, and labels that Python doesn't know.
_WEB = {"ascii": "cp1252", "iso8859-1": "cp1252", "iso8859-9": "cp1254", "iso8859-11": "cp874", "tis-620": "cp874", "gb2312": "gb18030", "gbk": "gb18030", "hz": None, "shift_jis": "cp932", "euc_kr": "cp949", "big5": "big5hkscs", "utf-16": "utf-16-le"}
_LABELS = {"x-gbk": "gbk", "x-sjis": "shift_jis", "x-cp1250": "cp1250", "x-cp1251": "cp1251", "x-cp1252": "cp1252", "x-euc-jp": "euc_jp", "x-mac-roman": "mac-roman", "x-mac-cyrillic": "mac-cyrillic", "x-mac-ukrainian": "mac-cyrillic", "x-x-big5": "big5", "ansi_x3.4-1968": "ascii", "gb_2312-80": "gb2312", "ks_c_5601-1987": "euc_kr", "windows-949": "cp949", "windows-31j": "cp932", "windows-874": "cp874", "dos-874": "cp874", "unicode": "utf-16-le", "ucs-2": "utf-16-le", "csunicode": "utf-16-le", "unicodefffe": "utf-16-be", "unicode-1-1-utf-8": "utf-8", "x-unicode20utf8": "utf-8", "koi": "koi8-r", "koi8": "koi8-r", "koi8-ru": "koi8-u", "logical": "iso8859-8", "visual": "iso8859-8", "sun_eu_greek": "iso8859-7"}
#: Codecs that pages may be in; others that Python has are no charsets there.
_KNOWN = frozenset(["utf-8", "utf-16-le", "utf-16-be", "cp866", "koi8-r", "koi8-u", "mac-roman", "mac-cyrillic", "cp874", "gb18030", "big5hkscs", "euc_jp", "iso2022_jp", "cp932", "cp949", *(f"iso8859-{n}" for n in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16)), *(f"cp{n}" for n in range(1250, 1259))])
_META = re.compile(rb"<meta\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.I)
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_BE, "utf-16-be"), (codecs.BOM_UTF16_LE, "utf-16-le"))


def codec(label: str | None) -> str | None:
    """Python's codec of a charset label, or None where pages can't be in it."""
    label = (label or "").strip().strip("\"'").lower()
    if not label:
        return None
    try:
        name = codecs.lookup(_LABELS.get(label, label)).name
    except LookupError:
        return None
    name = _WEB.get(name, name)
    return name if name in _KNOWN else None


def _as_control(e: UnicodeError):
    """Bytes that a Windows codec leaves open are control characters; in all others bad bytes become U+FFFD."""
    if isinstance(e, UnicodeDecodeError) and re.fullmatch(r"cp125[0-8]|cp874", e.encoding) or getattr(e, "encoding", "") == "charmap":
        return "".join(map(chr, e.object[e.start : e.end])), e.end
    return codecs.replace_errors(e)


codecs.register_error("twinfold-web", _as_control)


def header_charset(content_type: str | None) -> str | None:
    m = re.search(r";\s*charset\s*=\s*(\"[^\"]*\"|[^;\s]+)", content_type or "", re.I)
    return codec(m[1]) if m else None


def meta_charset(data: bytes) -> str | None:
    """Of the first 1024 bytes, comments apart; UTF-16 there means UTF-8."""
    for m in _META.finditer(re.sub(rb"<!--.*?(?:-->|\Z)", b"", data[:1024], flags=re.S)):
        tag = m[0].decode("latin-1")
        c = re.search(r"[\s/\"']charset\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'/>;]+)", tag, re.I)
        if not c and re.search(r"http-equiv\s*=\s*[\"']?content-type", tag, re.I):
            c = re.search(r"charset\s*=\s*([^\s\"'/>;]+)", tag, re.I)
        if c and (name := codec(c[1])):
            return "utf-8" if name.startswith("utf-16") else name
    return None


def decode_bytes(data: bytes, content_type: str | None = None) -> str:
    """Byte order mark, then header, then (HTML only) meta, then UTF-8; bad bytes become U+FFFD."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    kind = (content_type or "").split(";")[0].strip().lower()
    name = header_charset(content_type) or (meta_charset(data) if kind in ("text/html", "application/xhtml+xml", "") else None) or "utf-8"
    return data.decode(name, "twinfold-web")


def decompress(data: bytes, encoding: str | None) -> bytes:
    """Of content encodings identity, gzip and deflate; ValueError for any other."""
    e = (encoding or "identity").strip().lower()
    if e in ("", "identity", "none"):
        return data
    if e in ("gzip", "x-gzip"):
        return gzip.decompress(data)
    if e == "deflate":
        try:
            return zlib.decompress(data)
        except zlib.error:
            return zlib.decompress(data, -zlib.MAX_WBITS)
    raise ValueError(f"content encoding not supported: {e[:100]}")


def decode_column(content: Column, content_type: Column | None = None) -> Column:
    """Text of a binary column."""

    @F.arrow_udf(StringType())
    def decoded(data: pa.Array, kind: pa.Array) -> pa.Array:
        return pa.array([None if d is None else decode_bytes(d, k) for d, k in zip(data.to_pylist(), kind.to_pylist(), strict=True)], pa.string())

    return decoded(content, content_type if content_type is not None else F.lit(None).cast("string"))


def read_documents(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """path, body, bytes, error of every file: UTF-8, a leading byte order mark off; files beyond max_bytes are error rows."""
    raw = spark.read.format("binaryFile").load(path)
    big = F.col("length") > F.lit(max_bytes) if max_bytes else F.lit(False)
    body = F.when(~big, F.regexp_replace(F.decode("content", "UTF-8"), r"^\x{FEFF}", ""))
    return raw.select("path", body.alias("body"), F.octet_length(body).alias("bytes"), F.when(big, "too_large").alias("error"))


def read_pairs(spark: SparkSession, html_path: str, markdown_path: str, base_url: str | None = None) -> DataFrame:
    """Pairs of files whose names without ending are equal; pair_id is that name."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    html = read_documents(spark, html_path).select(name.alias("pair_id"), F.col("body").alias("html"))
    md = read_documents(spark, markdown_path).select(name.alias("pair_id"), F.col("body").alias("markdown"))
    base = F.lit(base_url).cast("string")
    return html.join(md, "pair_id").select("pair_id", "html", "markdown", base.alias("html_base"), base.alias("md_base"), F.lit("file").alias("kind"))
