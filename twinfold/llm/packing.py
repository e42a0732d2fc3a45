"""Mixture-controlled packing of documents into fixed windows (operator 5).

Every source is a queue of tokens. Deficit round-robin fills each window: a queue's
quantum is its target share of the window; what rounding leaves unserved (always less
than one token) is carried as a deficit into the next window, and across partitions.
Because the carried deficit is ``share * window * i - served(i)`` with
``served(i) = B_s(i) - B_{s-1}(i)`` and ``B_s(i) = floor(window * i * cumulative_share_s)``,
any partition can compute it from the window's number alone; no task walks the windows in
turn. When a queue runs dry its last tokens go into one window and the others' shares grow
in proportion (a new phase, at most two per queue).

* Shares are the corpus's own token proportions unless targets are given.
* Sources with less than LEAST tokens a window share one queue, in the order of partitions; each of their
  tokens is still packed.
* Cases: null text counts as empty (a document of the end id alone), null source is a
  queue of its own, repeated rows (and null ids) are packed as often as they occur, ties in a queue go by
  partition and place in it, a text of any length is cut into pieces, other columns whatever their names are not read, an
  empty table gives no rows, only the last window can be short.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import distinct_words, make_room, points, raw, slices, written

WINDOW = 4096
END_ID = 2
#: Tokens a window below which a source is no queue of its own: less can't be dealt out evenly.
LEAST = 4
#: Shares are multiples of 1 / SCALE; window * SCALE ** 2 must fit 63 bits.
SCALE = 1 << 24
#: Entries of a worker's cache of words, beyond those of the texts at hand.
CACHE = 450_000
#: Rows of the offset table (one per partition and queue) up to which it is broadcast; it is joined by shuffle beyond.
BROADCAST_ROWS = 200_000


class Encoder:
    """A vocabulary's tokenizer and the words that it has encoded.

    Pickled as its path alone. Tasks get it as a broadcast value, so a worker loads the file once, keeps its words from task to
    task, and lets go of both when a task of another plan comes.
    """

    def __init__(self, path: str):
        self.path, self.cache, self.tokenizer = path, {}, None

    def __getstate__(self) -> str:
        return self.path

    def __setstate__(self, path: str) -> None:
        self.__init__(path)

    def load(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(self.path)
        added = [x.content.encode() for x in t.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.ends = np.zeros(t.get_vocab_size(), bool)
        self.ends[[i for x, i in t.get_vocab().items() if x.endswith("</w>")]] = True
        self.kind = np.uint16 if t.get_vocab_size() <= 1 << 16 else np.uint32

    def each(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk. Chunks of letters only are one pre-token each, so many are encoded as one text and cut where a token ends a word; a text whose number of word ends is another is encoded chunk by chunk."""
        t, last, kind = self.tokenizer, self.ends, self.kind
        width = np.dtype(kind).itemsize
        texts = [c.decode() for c in chunks]
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, x in enumerate(texts) if x.isalpha()]
        alone = [i for i, x in enumerate(texts) if not x.isalpha()]
        for k in range(0, len(plain), 20_000):
            groups = [plain[g : g + 200] for g in range(k, min(k + 20_000, len(plain)), 200)]
            for own, e in zip(groups, t.encode_batch_fast([" ".join([texts[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
                ids = np.asarray(e.ids, dtype=kind)
                cut = np.flatnonzero(last[ids]) + 1
                if len(cut) != len(own) or len(ids) != cut[-1]:
                    alone += own
                    continue
                data, s = ids.tobytes(), 0
                for i, stop in zip(own, (cut * width).tolist(), strict=True):
                    out[i] = data[s:stop]
                    s = stop
        for k in range(0, len(alone), 20_000):
            some = alone[k : k + 20_000]
            for i, e in zip(some, t.encode_batch_fast([texts[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = np.asarray(e.ids, dtype=kind).tobytes()
        return out

    def column(self, column: pa.Array, end_id: int | None = None) -> tuple[pa.Array, type]:
        """Ids of every text as packed little-endian integers, with end_id behind them if given.

        White space always ends a word of this vocabulary, so distinct words are encoded once and cached; a text that
        spells an added token goes to the library whole.
        """
        if self.tokenizer is None:
            self.load()
        t, added, cache, kind = self.tokenizer, self.added, self.cache, self.kind
        known, which, first = distinct_words(column, points)
        missing = make_room(cache, set(known), CACHE)
        if missing:
            cache.update(zip(missing, self.each(list(missing)), strict=True))
        entries = [cache[w] for w in known]
        data, offsets = raw(column)
        for i in sorted({int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in added.finditer(data)}) if added else ():
            entries.append(np.asarray(t.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, dtype=kind).tobytes())
            drop = int(first[i + 1] - first[i])
            which = np.concatenate([which[: first[i]], [len(entries) - 1], which[first[i + 1] :]])
            first = first + (np.arange(len(first)) > i) * (1 - drop)
        if end_id is not None:
            entries.append(np.asarray([end_id], dtype=kind).tobytes())
            which = np.insert(which, first[1:], len(entries) - 1)
            first = first + np.arange(len(first))
        joined, at = raw(pa.array(entries, pa.binary()).take(pa.array(which, pa.int64())))
        return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(at[first].astype(np.int32)), pa.py_buffer(joined)]), kind


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, queue, part, before (tokens of that queue earlier in that part), doc_tokens, ids (packed, with end_id)."""
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(path))

    def run(batches):
        part, sums = TaskContext.get().partitionId(), {}
        for batch in slices(batches, "t"):
            ids, kind = shared.value.column(batch.column(1), end_id)
            n = np.diff(np.frombuffer(ids.buffers()[1], np.int32)) // np.dtype(kind).itemsize
            before = []
            for q, k in zip(batch.column(2).to_pylist(), n.tolist(), strict=True):
                before.append(sums.get(q, 0))
                sums[q] = before[-1] + k
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([part] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), ids], names=["doc_id", "queue", "part", "before", "doc_tokens", "ids"])

    return docs.mapInArrow(run, "doc_id long, queue string, part int, before long, doc_tokens long, ids binary")


def apportion(total: int, weights: list[int], limits: list[int]) -> list[int]:
    """total split by weights (largest remainder), no share above its limit; sum(limits) >= total."""
    out = [0] * len(weights)
    left = total
    while left:
        live = [i for i, w in enumerate(weights) if out[i] < limits[i]]
        s = sum(weights[i] for i in live)
        exact = [(left * weights[i] / s if s else left / len(live), i) for i in live]
        give = {i: min(limits[i] - out[i], int(x)) for x, i in exact}
        over = left - sum(give.values())
        for x, i in sorted(exact, key=lambda e: (int(e[0]) - e[0], e[1])):
            if over and out[i] + give[i] < limits[i]:
                give[i] += 1
                over -= 1
        for i, g in give.items():
            out[i] += g
        left = over
    return out


def phases(totals: list[int], targets: list[float], window: int = WINDOW) -> list[tuple[int, int, list[int], list[int]]]:
    """(first window, windows, tokens served before by queue, cumulative shares of SCALE or, for one window, cumulative counts) of each phase.

    Windows of a phase of more than one window follow the shares; single windows are given by counts.
    """
    left, done, out, at = list(totals), [0] * len(totals), [], 0
    while sum(left):
        live = [i for i, x in enumerate(left) if x]
        s = sum(targets[i] for i in live)
        share = apportion(SCALE, [int((targets[i] / s if s else 1 / len(live)) * (1 << 40)) if left[i] else 0 for i in range(len(left))], [SCALE if left[i] else 0 for i in range(len(left))])
        least = SCALE * 2 // window  # two tokens a window, so that what is served never falls
        share = [max(x, least) if left[i] else 0 for i, x in enumerate(share)]
        big = max(range(len(share)), key=lambda i: share[i])
        share[big] -= sum(share) - SCALE
        cum = np.cumsum(share).tolist()

        def served(n: int, cum=cum) -> list[int]:
            b = [(n // SCALE) * window * c + (window * (n % SCALE) * c) // SCALE for c in cum]
            return [y - x for x, y in zip([0, *b[:-1]], b, strict=True)]

        n = min(left[i] * SCALE // (window * share[i]) for i in live)
        while n > 0 and any(x > y for x, y in zip(served(n), left, strict=True)):
            n -= 1
        if n > 1:
            take = served(n)
            out.append((at, n, list(done), cum))
        else:  # the queues that end take what they have, the others fill up
            n = 1
            short = [left[i] if left[i] and left[i] <= window * share[i] / SCALE + 1 else 0 for i in range(len(left))]
            room = min(window, sum(left))
            take = apportion(min(room, sum(short)), short, short) if sum(short) else [0] * len(left)
            rest = [x - y for x, y in zip(left, take, strict=True)]
            more = apportion(room - sum(take), [share[i] if rest[i] else 0 for i in range(len(left))], rest)
            take = [x + y for x, y in zip(take, more, strict=True)]
            out.append((at, 1, list(done), np.cumsum(take).tolist()))
        done = [x + y for x, y in zip(done, take, strict=True)]
        left = [x - y for x, y in zip(left, take, strict=True)]
        at += n
    return out


class Layout:
    """Where a queue's tokens lie, from the phases alone."""

    def __init__(self, plan: list, window: int = WINDOW):
        self.window = window
        self.first = np.asarray([p[0] for p in plan], dtype=np.int64)
        self.count = np.asarray([p[1] for p in plan], dtype=np.int64)
        self.before = np.asarray([p[2] for p in plan], dtype=np.int64).reshape(len(plan), -1)
        self.cum = np.asarray([p[3] for p in plan], dtype=np.int64).reshape(len(plan), -1)

    def many(self, q: int, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs start..start+n of the queue's tokens: the run of each piece, its first token (from start), window and offset there."""
        before, end = self.before[:, q], start + n
        low = self.cum[:, q - 1] if q else np.zeros(len(self.first), np.int64)
        high, until = self.cum[:, q], np.append(before[1:], np.iinfo(np.int64).max)

        def spread(lo, hi):
            size = np.maximum(hi - lo, 0)
            who = np.repeat(np.arange(len(lo)), size)
            return who, np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + lo[who]

        run, ph = spread(np.searchsorted(before, start, "right") - 1, np.searchsorted(before, end, "left"))
        x, stop = np.maximum(start[run], before[ph]), np.minimum(end[run], until[ph])
        some = x < stop
        run, ph, lo, hi = run[some], ph[some], (x - before[ph])[some], (stop - before[ph])[some]
        single, rate = self.count[ph] == 1, (high - low)[ph] * self.window / SCALE
        who, i = spread(np.where(single, 0, np.maximum(0, (lo / rate).astype(np.int64) - 2)), np.where(single, 1, np.minimum(self.count[ph], (hi / rate).astype(np.int64) + 3)))
        run, ph, lo, hi, single = run[who], ph[who], lo[who], hi[who], single[who]

        def served(c: np.ndarray, i: np.ndarray) -> np.ndarray:
            """Tokens that all queues up to one have had before window i of the phase."""
            return np.where(single, i * c, (i // SCALE) * self.window * c + (self.window * (i % SCALE) * c) // SCALE)

        a, a2, c, c2 = served(low[ph], i), served(low[ph], i + 1), served(high[ph], i), served(high[ph], i + 1)
        begin, finish = c - a, c2 - a2
        keep = (finish > lo) & (begin < hi) & (finish > begin)
        run, ph, i, lo, begin, own = run[keep], ph[keep], i[keep], lo[keep], begin[keep], (a2 - a)[keep]
        return run, np.maximum(begin, lo) + before[ph] - start[run], self.first[ph] + i, own + np.maximum(lo - begin, 0)

    def pieces(self, q: int, start: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queue tokens start..start+n: the pieces' first tokens (from start), windows and offsets there."""
        return self.many(q, np.array([start]), np.array([n]))[1:]


def pack(docs: DataFrame, path: str, targets: dict[str, float] | None = None, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked) of every piece.

    targets: wanted token proportion by source; None: the corpus's own. One written table
    (the packed ids), no shuffle of text or ids while the offset table stays under
    BROADCAST_ROWS rows; the driver sees one total for each source of LEAST or more tokens a window, which are at most
    window / LEAST, and one for all others.
    """
    if not 2 * LEAST <= window <= 1 << 14:
        raise ValueError("window: 8 to 16384 tokens")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"), F.col(source_col).cast("string").alias("queue"))
    ids, _ = written(tokenize(slim, path, end_id))
    held, _ = written(ids.groupBy("part", "queue").agg(F.sum("doc_tokens").alias("n")))
    everything = held.agg(F.sum("n")).first()[0] or 0
    totals = held.groupBy("queue").agg(F.sum("n").alias("n"))
    if targets:
        named = [q for q in targets if q is not None]
        asked = totals.where(F.col("queue").isin(named) | (F.col("queue").isNull() if None in targets else F.lit(False)))
    else:
        asked = totals.where(F.col("n") * window >= LEAST * everything)
    own = {r.queue: r.n for r in asked.collect()}
    want = {q: float(targets[q]) if targets else n / everything for q, n in own.items()}
    s = (sum(want.values()) if targets else 1.0) or 1.0
    names = sorted((q for q in own if want[q] / s * window >= LEAST), key=lambda q: (q is not None, q))
    count, share = [own[q] for q in names], [want[q] / s for q in names]
    if sum(count) < everything:  # one more queue for all sources that are too small
        count.append(everything - sum(count))
        share.append(max(0.0, 1.0 - sum(share)))
    plan = phases(count, share, window)
    lanes = docs.sparkSession.createDataFrame(pa.table({"source": pa.array(names, pa.string()), "lane": pa.array(range(len(names)), pa.int32())}))
    placed = held.join(F.broadcast(lanes), held.queue.eqNullSafe(lanes.source), "left").select("part", "queue", F.coalesce("lane", F.lit(len(names))).alias("lane"), "n")
    earlier = lambda w, *order: F.coalesce(F.sum("n").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = placed.select("part", "queue", "lane", earlier(Window.partitionBy("lane", "part"), F.col("queue").asc_nulls_first()).alias("inside"))
    parts = placed.groupBy("lane", "part").agg(F.sum("n").alias("n")).select("lane", "part", earlier(Window.partitionBy("lane"), "part").alias("base"))
    offsets = inside.join(parts, ["lane", "part"]).select(F.col("part").alias("p"), F.col("queue").alias("q"), "lane", (F.col("base") + F.col("inside")).alias("base"))
    offsets, _ = written(offsets)
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = ids.join(offsets, (F.col("part") == F.col("p")) & F.col("queue").eqNullSafe(F.col("q"))).select("doc_id", "lane", (F.col("base") + F.col("before")).alias("at"), "doc_tokens", "ids")
    names_out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches):
        layout = Layout(plan, window)
        for batch in batches:
            lane, at, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 4))
            parts = []
            for q in np.unique(lane).tolist():
                rows = np.flatnonzero(lane == q)
                which, *rest = layout.many(q, at[rows], n[rows])
                parts.append((rows[which], *rest))
            row, cut, seq, off = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
            order = np.lexsort((cut, row))
            row, cut, seq, off = row[order], cut[order], seq[order], off[order]
            end = np.append(cut[1:], 0)
            last = np.append(row[1:] != row[:-1], True)[: len(row)]
            end[last] = n[row[last]]
            blobs, size = batch.column(4), len(row)
            crc, tokens = np.zeros(size, np.int64), []
            heads = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            begins, ends = (4 * cut).tolist(), (4 * end).tolist()
            for i in range(batch.num_rows):
                b = blobs[i].as_buffer()
                values = np.frombuffer(b, dtype=np.uint16 if len(b) == 2 * n[i] else np.uint32).astype("<u4")
                memory = memoryview(values.tobytes())
                crc[heads[i] : heads[i + 1]] = [zlib.crc32(memory[begins[k] : ends[k]]) for k in range(heads[i], heads[i + 1])]
                if with_ids:
                    tokens += [values[begins[k] // 4 : ends[k] // 4].tolist() for k in range(heads[i], heads[i + 1])]
            cols = [pa.array(x, pa.int64()) for x in (cut, end - cut, crc, n[row], seq, off)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *cols] + [pa.array(tokens, pa.list_(pa.int32()))] * with_ids, names=names_out)

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
