"""Byte-level BPE encoding and decoding over a pair occurrence index (operator 8).

The vocabulary and merges are read from a public tokenizers file; nothing is trained.

* Cases: a null text counts as empty; an empty text has no ids, the hash of an empty
  string for both digests; repeated rows give repeated results; texts of any length are encoded whole; null ids stay
  null; equal ranks can't occur (a pair has one); an empty table gives no rows; other columns of the
  input, whatever their names, are not read.
* Spelled-out added tokens (as ``<|endoftext|>``) become their ids, as the library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bound_batches, make_room, points, raw, slices

_WS = r"\t-\r \x85\xa0  -     　"
_SPLIT = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Entries of a worker's cache of parts, beyond those of the texts at hand.
CACHE = 400_000
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Lead bytes of white space outside ASCII, and what may follow them.
_WIDE = regex.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class PairIndexBPE:
    """Encoder whose merges run over an index from each adjacent pair to all its positions in a batch of pieces."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        model, alphabet = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        self.first = np.array([vocab[c] for c in alphabet], np.int64)
        self.rank_of: dict[int, int] = {}  # by pair: left id << 32 | right id
        self.made: list[int] = []  # the id that each rank makes
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank_of.setdefault(vocab[a] << 32 | vocab[b], len(self.made))
            self.made.append(vocab[a + b])
        pairs = self.first[:, None] << 32 | self.first
        self.byte_rank = np.array([self.rank_of.get(p, -1) for p in pairs.ravel().tolist()], np.int64).reshape(256, 256)
        self.sides = {r: (p >> 32, p & 0xFFFFFFFF) for p, r in self.rank_of.items()}
        back = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.bytes_of.update({i: s.encode() for s, i in self.added.items()})
        self.text_of = {i: b"%d," % i for i in self.bytes_of}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.special_bytes = regex.compile(b"|".join(regex.escape(s.encode()) for s in self.added)) if self.added else None
        self.cache: dict[bytes, tuple[int, bytes, bytes]] = {}

    def merge(self, pieces: list[bytes]) -> tuple[list[int], list[int]]:
        """Ids of all pieces in one list, and how many each piece has. All pieces lie in one symbol array with a gap after each."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.arange(len(data)) + np.repeat(np.arange(len(pieces)), size)
        n = len(data) + len(pieces)
        symbols = np.full(n, -1, np.int64)
        symbols[at] = self.first[data]
        rank = self.byte_rank[data[:-1], data[1:]] if len(data) > 1 else np.zeros(0, np.int64)
        there = np.flatnonzero((rank >= 0) & (at[1:] == at[:-1] + 1))
        order = there[np.argsort(rank[there], kind="stable")]
        known, heads = np.unique(rank[order], return_index=True)
        places = np.split(at[order], heads[1:])
        index = {r: p.tolist() for r, p in zip(known.tolist(), places, strict=False)}  # pair (by rank) to all its positions
        active = list(index)  # ascending, so already a heap
        symbol, after, before, rank_of, made = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), self.rank_of, self.made
        get, push, pop = rank_of.get, heapq.heappush, heapq.heappop
        sides = self.sides
        while active:
            now = pop(active)
            a, b = sides[now]
            new = made[now]
            own = index.pop(now)
            own.sort()
            high = new << 32
            for i in own:
                if symbol[i] != a:
                    continue  # an earlier merge took it
                j = after[i]
                if j >= n or symbol[j] != b:
                    continue
                k = after[j]
                symbol[i], symbol[j] = new, -2
                after[i] = k
                if k < n:
                    before[k] = i
                    c = symbol[k]
                    if c >= 0:
                        r = get(high | c)
                        if r is not None:
                            if r in index:
                                index[r].append(i)
                            else:
                                index[r] = [i]
                                push(active, r)
                h = before[i]
                if h >= 0:
                    c = symbol[h]
                    if c >= 0:
                        r = get(c << 32 | new)
                        if r is not None:
                            if r in index:
                                index[r].append(h)
                            else:
                                index[r] = [h]
                                push(active, r)
        done = np.array(symbol, np.int64)
        counts = np.add.reduceat(done >= 0, np.cumsum(size + 1) - size - 1) if len(pieces) else np.zeros(0, np.int64)
        return done[done >= 0].tolist(), counts.tolist()

    def learn(self, parts: list[bytes]) -> None:
        """Puts parts (runs that the pre-tokenizer never joins with others) in the cache: count, ids as text with a comma after each, decoded bytes."""
        plain = [p.isalpha() or p[:1] == b" " and p[1:].isalpha() for p in parts]  # of ASCII letters: one pre-token
        cuts = [None if ok or p.decode() in self.added else [m.encode() for m in _SPLIT.findall(p.decode())] for p, ok in zip(parts, plain, strict=True)]
        known = {w: i for i, w in enumerate(dict.fromkeys([*(p for p, ok in zip(parts, plain, strict=True) if ok), *(w for c in cuts if c for w in c)]))}
        ids, counts = self.merge(list(known))
        ends = np.cumsum(counts).tolist()
        text_of, bytes_of, cache = self.text_of.__getitem__, self.bytes_of.__getitem__, self.cache
        for p, ok, c in zip(parts, plain, cuts, strict=True):
            if ok:
                e = ends[known[p]]
                own = ids[e - counts[known[p]] : e]
            elif c is None:
                own = [self.added[p.decode()]]
            else:
                own = [x for w in c for x in ids[ends[known[w]] - counts[known[w]] : ends[known[w]]]]
            back = b"".join(map(bytes_of, own))
            cache[p] = (len(own), b"".join(map(text_of, own)), p if back == p else back)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the parts of adjacent texts begin (at bytes of data).

        A single white space character never joins what stands before it, and one that is no
        blank never what stands behind it; a point between a letter and white space is a token of its own. Texts with
        white space in runs or outside ASCII, or with a spelled-out special token, are cut by the pattern.
        """
        cut = np.zeros(len(data) + 1, bool)
        space = _SPACES[data]
        cut[:-1] = space
        other = np.flatnonzero(space & (data != 0x20))
        cut[other + 1] = True
        cut[points(data)] = True
        whole = data.tobytes()
        odd = np.flatnonzero(space[1:] & space[:-1]) + 1
        odd = odd[~np.isin(odd, offsets)]
        spots = [*odd.tolist(), *(m.start() for m in _WIDE.finditer(whole)), *(m.start() for m in (self.special_bytes.finditer(whole) if self.special_bytes else ()))]
        for i in np.unique(np.searchsorted(offsets, spots, "right") - 1).tolist() if spots else ():
            a, b = int(offsets[i]), int(offsets[i + 1])
            text, at, pieces = whole[a:b].decode(), 0, []
            for m in self.specials.finditer(text) if self.specials else ():
                pieces += [*_SPLIT.findall(text[at : m.start()]), m.group()]
                at = m.end()
            pieces += _SPLIT.findall(text[at:])
            ends = np.cumsum([len(x.encode()) for x in pieces])
            cut[a:b] = False
            cut[a + ends[:-1]] = True
        cut[offsets] = True
        return np.flatnonzero(cut[:-1])

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """For each text: number of ids, ids joined by commas, decoded bytes."""
        data, offsets = raw(column)
        starts = self.cuts(data, offsets)
        first = np.searchsorted(starts, offsets)
        cut = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        parts, which = cut.dictionary.to_pylist(), cut.indices
        cache = self.cache
        missing = make_room(cache, set(parts), CACHE)
        if missing:
            self.learn(list(missing))
        entries = [cache[p] for p in parts]
        n = np.append(0, np.cumsum(np.array([e[0] for e in entries], np.int64)[which.to_numpy()]))
        out = []
        for k in (1, 2):
            joined, at = raw(pa.array([e[k] for e in entries], pa.binary()).take(which))
            at, memory = at[first].tolist(), memoryview(joined)
            drop = k == 1  # the comma behind the last id
            out.append([bytes(memory[a : b - (drop and b > a)]) for a, b in zip(at[:-1], at[1:], strict=True)])
        return n[first[1:]] - n[first[:-1]], *out

    def encode(self, texts: list[bytes]) -> list[tuple[int, str, bytes]]:
        """For each text: number of ids, ids joined by commas, decoded bytes."""
        n, ids, back = self.encode_column(pa.array(texts, pa.binary()))
        return [(k, i.decode(), b) for k, i, b in zip(n.tolist(), ids, back, strict=True)]


_models: dict[str, PairIndexBPE] = {}


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded if asked) of every row; no shuffle, memory bounded by slices of the text."""
    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches):
        model = _models.get(path)
        if model is None:
            model = _models[path] = PairIndexBPE(path)
        for batch in slices(batches, "t"):
            n, ids, back = model.encode_column(batch.column(1))
            texts = [x.decode("utf-8", "replace") for x in back]
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts])]
            if with_ids:
                cols += [pa.array([[int(i) for i in x.split(b",")] if x else [] for x in ids], pa.list_(pa.int32())), pa.array(texts)]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    bound_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as long) as `{id_col}`", f"cast(`{text_col}` as string) as t").mapInArrow(run, schema)


def decode(ids: np.ndarray | list[int], path: str) -> str:
    """Text of ids, special tokens kept."""
    model = _models[path] if path in _models else _models.setdefault(path, PairIndexBPE(path))
    return b"".join(model.bytes_of[int(x)] for x in ids).decode("utf-8", "replace")
