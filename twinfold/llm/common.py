"""Shared pieces: Arrow batch slicing, word bounds and hashes on byte arrays, tables that cut lineage, and distributed connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at a time; a longer text is worked on alone.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch that a Python worker gets.
BATCH_BYTES = 8 << 20
#: Rows that Spark's Parquet reader decodes at a time.
READ_ROWS = 512

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Only where all run in one process, as in tests, a missing setting is made up for by a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="twinfold-")
        shared_dir.own = found
    return f"{found.rstrip('/')}/twinfold-{spark.sparkContext.applicationId}"


def bound_batches(spark: SparkSession) -> None:
    """Makes the Arrow batches that Python workers get smaller than Spark's 64 MB, and the Parquet reader's smaller than 4096 rows, where the session doesn't set their size itself: rows of long texts fill them, on both sides and in every task."""
    for name, usual, own in (("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b"), ("spark.sql.parquet.columnarReaderBatchSize", "4096", str(READ_ROWS))):
        if spark.conf.get(name) == usual:
            spark.conf.set(name, own)


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, drop: str | None = None) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, and its path: lineage ends there, so lost executors cost no recomputation. drop: a table that is no longer needed."""
    spark = df.sparkSession
    bound_batches(spark)
    root = shared_dir(spark)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if root not in _roots:
        _roots.add(root)
        atexit.register(_forget, spark, root)
    if drop:
        drop_table(spark, drop)
    return spark.read.schema(df.schema).parquet(path), path


_roots: set[str] = set()


def _forget(spark: SparkSession, root: str) -> None:
    try:
        drop_table(spark, root)
    except Exception:  # noqa: BLE001  the session may be gone when the interpreter ends
        _roots.discard(root)


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one, that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: str, n: int):
    """crc32(id as text) mod n, the fold rule of the labelled operators."""
    return F.crc32(F.col(column).cast("string")) % n


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: workers live on, and each next stage needs its own."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can't
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text column holds at most limit bytes a slice (one row at least). Null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        column = pc.fill_null(batch.column(at), "")
        size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        batch = batch.set_column(at, text, column)
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def make_room(cache: dict, wanted: set, most: int) -> set:
    """What of wanted the cache lacks. If that would not fit, all entries but the wanted ones go first, so frequent entries stay."""
    missing = wanted.difference(cache)
    if len(cache) + len(missing) > most:
        kept = {k: cache[k] for k in wanted if k in cache}
        cache.clear()
        cache.update(kept)
    return missing


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets (one more than rows) of its values in them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of adjacent texts, and the first word (one more than texts) of each text."""
    inside = ~_SEP[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def distinct_words(column: pa.Array, more=None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of texts: distinct ones (some may repeat), the number of each word's in that list, and the first word (one more than texts) of each text. more(data): further places where words are cut."""
    data, offsets = raw(column)
    starts = words(data, offsets)[0]
    if more is not None:
        starts = np.sort(np.concatenate([starts, more(data)]))
    at = np.append(starts, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()  # words with the white space behind them
    return [p.rstrip() for p in pieces.dictionary.to_pylist()], pieces.indices.to_numpy(), np.searchsorted(starts, offsets)


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LETTER_AFTER_C3 = np.zeros(256, dtype=bool)
_LETTER_AFTER_C3[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


def points(data: np.ndarray) -> np.ndarray:
    """Places of commas and full stops between a letter (ASCII or Latin-1) and a blank or line feed."""
    at = np.flatnonzero((data == 0x2C) | (data == 0x2E))
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[(data[at + 1] == 0x20) | (data[at + 1] == 0x0A)]
    return at[_LETTER[data[at - 1]] | _LETTER_AFTER_C3[data[at - 1]] & (at > 1) & (data[at - 2] == 0xC3)]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E6C63D0676A9A99


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial (Rabin-Karp) hash of each word, mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    table, done, out, k = powers(_BASE, int(size.max())), np.cumsum(size), np.empty(len(starts), np.uint64), 0
    while k < len(starts):  # by a megabyte, so that memory stays small beside the text
        e = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + (1 << 20), "right")))
        own = size[k:e]
        at = np.cumsum(own) - own
        place = np.arange(int(own.sum())) - np.repeat(at, own)
        out[k:e] = np.add.reduceat(_BYTE[data[place + np.repeat(starts[k:e], own)]] * table[place], at)
        k = e
    return mix(out + size.astype(np.uint64))


def rolled(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of each n consecutive values, by doubling: position i holds the window that starts at i."""
    base &= (1 << 64) - 1
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    have, done, power, span, out = hashes, 0, base, 1, None
    todo = n
    while todo:
        if todo & 1:
            if out is None:
                out, done = have, span
            else:  # what is there, then the next span
                m = len(hashes) - done - span + 1
                out = out[:m] * np.uint64(power) + have[done : done + m]
                done += span
        todo >>= 1
        if todo:
            m = len(have) - span
            have = have[:m] * np.uint64(power) + have[span : span + m]
            power = power * power & (1 << 64) - 1
            span *= 2
    return out[: len(hashes) - n + 1]


def inside_texts(first: np.ndarray, n_windows: int, n: int) -> np.ndarray:
    """Which of the windows (by start) of n words lie within one text; first: as words() gives it."""
    ok = np.ones(max(0, n_windows), dtype=bool)
    for k in range(1, n):  # a window that starts within n-1 words before a boundary crosses it
        at = first[1:] - k
        at = at[(at >= 0) & (at >= first[:-1])]
        ok[at[at < n_windows]] = False
    return ok


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find of the edges a-b: the vertices and the smallest vertex that each reaches."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        new = np.minimum(new, new[new])
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


#: Edges that one task contracts at a time in components().
PART_EDGES = 2_000_000


def components(edges: DataFrame, part_edges: int = PART_EDGES) -> DataFrame:
    """Connected components of the undirected edges (a, b) of longs: (node, component), component being the smallest node that is reachable.

    A level contracts the edges, part_edges to a task, to stars by union-find, and gathers by
    vertex the roots that the tasks gave it (one a task at most, so a hot vertex is no hot
    group). Where a vertex got several, these roots are one component: they are the edges of the next, smaller
    level. Labels then pass back down, a join a level. Edges that fit one task need no
    shuffle at all. Every level is a written table; nothing gathers at the driver. Empty
    edges give no rows; self-links and repeated edges are harmless.
    """

    def contract(batches):
        pairs = [(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)) for x in batches if x.num_rows]
        if pairs:
            nodes, low = local_roots(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
            for i in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(low[i : i + 100_000])], names=["a", "b"])

    state, _ = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null"))
    levels, labels = [], None
    while n := state.count():
        tasks = -(-n // part_edges)
        stars = state.coalesce(tasks).mapInArrow(contract, "a long, b long")
        if tasks == 1:
            labels, _ = written(stars)
            break
        level, _ = written(stars.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("b")))
        levels.append(level)
        state, _ = written(level.where("size(b) > 1").select(F.explode(F.slice("b", 2, 1 << 30)).alias("a"), F.col("b")[0].alias("b")))
    out = labels
    for level in reversed(levels):
        low = level.select(F.col("a").alias("v"), F.col("b")[0].alias("low"))
        out = low.select(F.col("v").alias("a"), F.col("low").alias("b")) if out is None else low.join(out, low.low == out.a, "left").select(F.col("v").alias("a"), F.coalesce("b", "low").alias("b"))
    out = state if out is None else out
    return out.select(F.col("a").alias("node"), F.col("b").alias("component"))
