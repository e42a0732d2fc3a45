"""Exact removal of repeated word windows by Rabin-Karp hashes (operator 6).

Every window of WIDTH consecutive words of one text is hashed with two rolling polynomials
(96 bits). A window that also starts earlier (smaller doc_id, or the same document before)
is repeated; overlapping repeated windows merge into maximal removal intervals.

Plan, in bounded blocks of texts:

1. Anchors. A window's anchor is the smallest of its 10-word hashes; equal windows have equal
   anchors. Blocks send their anchors (about a fifth as many as windows) by hash bucket;
   anchors that occur once in the corpus prove their windows unique, at no further cost.
2. Windows with a repeated anchor are sent by hash bucket, only the earliest of each block
   with its place, so a window that is in every document costs a row a block, not a document.
   The bucket names all starts but the first.
3. Starts go back to their documents and become intervals.

* Equality is by 96 hash bits; nothing is capped or sampled.
* Cases: null or short texts keep all words; rows that share a doc_id are judged by their
  place alone (equal windows at the same start of two such rows are both kept); rows with a null id have no place in the order: they keep
  all words and make no other row's words repeated; texts of any length are judged whole (one that is longer than a block is a block alone); other columns, whatever their
  names, stay as they are; empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, inside_texts, mix, raw, rolled, slices, word_hashes, words, written

WIDTH, ANCHOR = 20, 10
#: Text of a block; a longer text is a block alone.
BLOCK_BYTES = 2 << 20
#: Text of the corpus for each bucket of hashes; a bucket, which one task holds whole, has about a fifth of that.
BUCKET_BYTES = 8 << 20
_A, _B = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def _prepared(batch: pa.RecordBatch, text: int):
    data, offsets = raw(batch.column(text))
    starts, ends, first = words(data, offsets)
    return data, starts, ends, first, word_hashes(data, starts, ends)


def _anchor_values(hashes: np.ndarray, width: int, anchor: int) -> np.ndarray:
    """Of each window, the smallest hash of its anchor-word runs with the place of the leftmost such run in the low bits."""
    grams = rolled(hashes, anchor, _A)
    if len(grams) < width - anchor + 1:
        return np.zeros(0, np.uint64)
    grams = (mix(grams) & ~np.uint64(0xFFFFFF)) | (np.arange(len(grams), dtype=np.uint64) & np.uint64(0xFFFFFF))
    span, have, todo = 1, grams, width - anchor + 1
    while span * 2 <= todo:
        have = np.minimum(have[: len(have) - span], have[span:])
        span *= 2
    shift = todo - span
    return np.minimum(have[: len(have) - shift], have[shift:]) if shift else have


def _blobs(bucket: np.ndarray, n_buckets: int, columns: list[np.ndarray]):
    """Per bucket that has rows: its number and its rows of each column."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(cut[1:] > cut[:-1]):
        yield int(b), [c[cut[b] : cut[b + 1]] for c in columns]


def _binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def repeated_starts(docs: DataFrame, width: int = WIDTH, buckets: int | None = None) -> DataFrame:
    """doc_id, starts (packed 32-bit places of the windows that also start earlier) of each document that has any. docs: doc_id, t."""
    spark, docs = docs.sparkSession, docs.where("doc_id is not null")
    if buckets is None:  # by the size of the text, so that a bucket is as large on any input
        total = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        buckets = max(64, -(-total // BUCKET_BYTES))
    anchor = max(1, width // 2)

    def send_anchors(batches):
        for batch in slices(batches, "t", BLOCK_BYTES):
            _, _, _, first, h = _prepared(batch, 1)
            values = _anchor_values(h, width, anchor)
            ok = inside_texts(first, len(values), width)
            which = np.flatnonzero(ok)
            if not len(which):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            v = values[which]
            doc = np.searchsorted(first, which, "right") - 1
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (doc[1:] != doc[:-1])
            v, doc = v[new] >> np.uint64(24), doc[new].astype(np.uint32)
            rows = list(_blobs((v % np.uint64(buckets)).astype(np.int64), buckets, [v // np.uint64(buckets), doc]))
            used = [np.unique(r[1][1], return_inverse=True) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in rows], pa.int32()), pa.array([_binary(ids[u]) for u, _ in used], pa.binary()), pa.array([_binary(i.astype(np.uint32)) for _, i in used], pa.binary()), pa.array([_pack40(r[0]) for _, r in rows], pa.binary())],
                names=["bucket", "docs", "doc", "value"],
            )

    def repeated_anchors(table: pa.Table) -> pa.Table:
        docs_, which, values, at = [], [], [], 0
        for row in table.select(["docs", "doc", "value"]).to_pylist():
            own = np.frombuffer(row["docs"], np.int64)
            docs_.append(own)
            which.append(np.frombuffer(row["doc"], np.uint32).astype(np.int64) + at)
            values.append(_unpack40(row["value"]))
            at += len(own)
        own, which, values = np.concatenate(docs_), np.concatenate(which), np.concatenate(values)
        order = np.argsort(values, kind="stable")
        s = values[order]
        same = s[1:] == s[:-1]
        again = np.zeros(len(s), bool)
        again[1:] |= same
        again[:-1] |= same
        which, s = which[order][again], s[again]
        doc = own[which]
        value = s * np.uint64(buckets) + np.uint64(table.column("bucket")[0].as_py())
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(doc))
        return pa.table({"d": pa.array(doc[cut], pa.int64()), "vals": pa.array([_pack40(np.unique(value[a:b])) for a, b in zip(cut, ends[: len(cut)], strict=True)], pa.binary())})

    sent = docs.select("doc_id", "t").mapInArrow(send_anchors, "bucket int, docs binary, doc binary, value binary")
    known = sent.groupBy("bucket").applyInArrow(repeated_anchors, "d long, vals binary")
    known, _ = written(known)
    known = known.groupBy("d").agg(F.collect_list("vals").alias("vals"))
    suspect = docs.select("doc_id", "t").join(known, F.col("doc_id") == F.col("d")).select("doc_id", "t", "vals")

    def send_windows(batches):
        for batch in slices(batches, "t", BLOCK_BYTES):
            _, _, _, first, h = _prepared(batch, 1)
            values = _anchor_values(h, width, anchor)
            ok = inside_texts(first, len(values), width)
            values = values >> np.uint64(24)
            which = []
            for i, own in enumerate(batch.column(2).to_pylist()):
                a, b = int(first[i]), min(int(first[i + 1]), len(values))
                if a < b:
                    good = np.unique(np.concatenate([_unpack40(x) for x in own]))
                    mine = values[a:b]
                    at = np.minimum(np.searchsorted(good, mine), len(good) - 1)
                    which.append(np.flatnonzero((good[at] == mine) & ok[a:b]) + a)
            which = np.concatenate(which) if which else np.zeros(0, np.int64)
            if not len(which):
                continue
            key, check = mix(rolled(h, width, _A)[which]), (mix(rolled(h, width, _B)[which]) >> np.uint64(32)).astype(np.uint32)
            doc = np.searchsorted(first, which, "right") - 1
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            place = (which - first[doc]).astype(np.uint32)
            order = np.lexsort((place, ids[doc], check, key))
            key, check, doc, place = key[order], check[order], doc[order].astype(np.uint32), place[order]
            head = np.ones(len(key), bool)
            head[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
            # equal place of rows that share the earliest doc_id: not earlier than each other
            at = np.flatnonzero(head)[np.cumsum(head) - 1]
            tie = ~head & (ids[doc] == ids[doc[at]]) & (place == place[at])
            bucket = (check % np.uint32(buckets)).astype(np.int64)
            rows = []
            for b, (k, c, d, p, hd, te) in _blobs(bucket, buckets, [key, check, doc, place, head, tie]):
                u, i = np.unique(d, return_inverse=True)
                rows.append((b, _binary(ids[u]), _binary(i.astype(np.uint32)), _binary(p), _binary(k[hd | te]), _binary(c[hd | te]), np.packbits(hd | te).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[n] for r in rows], pa.binary()) for n in range(1, 7))], names=["bucket", "docs", "doc", "place", "key", "check", "head"])

    def judge(table: pa.Table) -> pa.Table:
        doc, place, key, check, later = [], [], [], [], [(np.zeros(0, np.int64), np.zeros(0, np.uint32))]
        for row in table.to_pylist():
            ids, d, p = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["doc"], np.uint32), np.frombuffer(row["place"], np.uint32)
            head = np.unpackbits(np.frombuffer(row["head"], np.uint8), count=len(d)).astype(bool)
            later.append((ids[d[~head]], p[~head]))
            doc.append(ids[d[head]])
            place.append(p[head])
            key.append(np.frombuffer(row["key"], np.uint64))
            check.append(np.frombuffer(row["check"], np.uint32))
        doc, place, key, check = (np.concatenate(x) for x in (doc, place, key, check))
        order = np.lexsort((place, doc, check, key))
        doc, place, key, check = doc[order], place[order], key[order], check[order]
        head = np.ones(len(key), bool)
        head[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        at = np.flatnonzero(head)[np.cumsum(head) - 1] if len(head) else np.zeros(0, np.int64)
        out = ~head & ~((doc == doc[at]) & (place == place[at]))
        doc = np.concatenate([doc[out], *(x[0] for x in later)])
        place = np.concatenate([place[out], *(x[1] for x in later)])
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(doc))
        return pa.table({"d": pa.array(doc[cut], pa.int64()), "places": pa.array([_binary(place[a:b]) for a, b in zip(cut, ends[: len(cut)], strict=True)], pa.binary())})

    seen = suspect.mapInArrow(send_windows, "bucket int, docs binary, doc binary, place binary, key binary, check binary, head binary")
    found = seen.groupBy("bucket").applyInArrow(judge, "d long, places binary")
    found, _ = written(found)
    return found.groupBy("d").agg(F.collect_list("places").alias("places"))


def _pack40(x: np.ndarray) -> bytes:
    """Values below 2**40 in 5 bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack40(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def removal(places: list[bytes], n_words: int, width: int) -> np.ndarray:
    """Which words lie in a window that starts at one of the packed places."""
    edge = np.zeros(n_words + 1, np.int32)
    for p in places or ():
        at = np.frombuffer(p, np.uint32)
        at = at[at + width <= n_words]
        edge[at] += 1
        np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _joined(docs: DataFrame, width: int) -> DataFrame:
    """docs (doc_id, t and others) with the places of each document."""
    found = repeated_starts(docs, width)
    return docs.join(found, docs.doc_id == found.d, "left").drop("d")


def intervals(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (maximal removal intervals of words, end exclusive), kept (the text that is left) of every row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))

    def run(batches):
        for batch in slices(batches, "t"):
            texts, places = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
            n, gone, digest, spans, kept = [], [], [], [], []
            for text, p in zip(texts, places, strict=True):
                own = text.split()
                n.append(len(own))
                if p:
                    out = removal(p, len(own), width)
                    own = [w for w, o in zip(own, out.tolist(), strict=True) if not o]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
                    spans.append(edge.tolist())
                else:
                    spans.append([])
                gone.append(n[-1] - len(own))
                kept.append(b" ".join(own))
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest), pa.array(spans, pa.list_(pa.int32())), pa.array([k.decode() for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"])

    return _joined(slim, width).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<int>, kept string")


def digests(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return intervals(docs, width, id_col, text_col).drop("spans", "kept")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with repeated windows cut from text (white space around kept words stays as it was written), all other columns unchanged."""
    names = docs.columns
    found = repeated_starts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t")), width)
    own, places = (free_name(docs, x) for x in ("cut_doc", "cut_places"))
    found = found.withColumnsRenamed({"d": own, "places": places})
    joined = docs.join(found, docs.doc_id.cast("long") == found[own], "left")

    @F.arrow_udf("string")
    def cut(text: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for x, p in zip(text.cast(pa.binary()).to_pylist(), places.to_pylist(), strict=True):
            if x is not None and p:
                data = np.frombuffer(x, np.uint8)
                starts, ends, _ = words(data, np.array([0, len(data)]))
                gone = removal(p, len(starts), width)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                parts, last = [], 0
                for a, b in zip(edge[::2], edge[1::2], strict=True):
                    parts.append(x[last : starts[a]])
                    last = int(starts[b]) if b < len(starts) else len(x)
                x = b"".join([*parts, x[last:]])
            out.append(None if x is None else x.decode())
        return pa.array(out, pa.string())

    return joined.select([cut(F.col("text"), F.col(places)).alias(n) if n == "text" else F.col(f"`{n}`") for n in names])
