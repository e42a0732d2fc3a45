"""SimHash near-duplicates by anchor-point covering (operator 10).

Fingerprints: 64 bits over the XXH64 (seed 42) of word shingles, repeats included.
Anchors: the direct product of two binary Golay codes (23 bits, covering radius 3 each)
and the zero word on the last 18 bits is a covering code of the 64-bit space. A
fingerprint's home is the anchor within the covering radius of both halves; it also visits every
anchor within radius plus threshold (the bits beyond radius 3, summed over both halves, are at
most the threshold). Two fingerprints within the threshold therefore meet at the home of
either one, and pairs are compared at the smaller home only.

* Exact copies collapse to one fingerprint before anything is replicated.
* An anchor whose members would need more than HOT comparisons is compared exactly in
  linear work instead: members meet at each point of the space within half the threshold
  (two words differ in <= 2 bits exactly if some point is within 1 bit of both).
near_copies() finds texts whose sets of five-word shingles are similar (0.8 or more). Their
fingerprints over shingles differ in far more bits than any covering code can span, so it takes
LANES fingerprints of 46 bits (both codes, nothing free) over distinct single words, which an edit moves
least; texts that meet at an anchor with one bit or none between them in any lane are candidates, as are those that
share a min-hash band of their shingle sets (lanes favour scattered edits, bands depend on the similarity
alone), and each candidate pair is verified on the shingles themselves. In anchors of more than STAR comparisons the
members first meet one centre, in those of more than CROWD then a second one; of all texts that share an anchor or a band, of any size, with one they are not connected with after
that, all pairs are compared: among the texts of anchors of more than FULL members those that can be similar enough by prefixes of their shingles from the rarest
on (prefix_pairs(): exact, whatever the anchor's size), in smaller anchors each of the other pairs. Shingles are read of pairs only whose outlines (parities of the shingles' hashes) allow the similarity; that bound is exact too. The centre is the member that shares the most
anchors with others (in a group of copies that is what they were copied from), so most copies are connected by it at once and the many anchors of a large group
ask for the same few pairs.

* Cases: null or wordless text has fingerprint zero and links like any other; fewer words
  than a shingle give one shingle of the whole sequence; repeated rows link to each other; texts of any length are read
  whole; a null id is a row of its own group's id (the smallest non-null one, or null if there is none); ties need no order, as all links count;
  an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix, raw, rolled, slices, word_hashes, words, written

#: Home members times all members of an anchor up to which they are compared pair by pair.
HOT = 250_000
#: near_copies(): fingerprints a text, and bits of each.
LANES, LANE_BITS = 4, 46
#: near_copies(): min-hash bands beside the lanes, and shingle minima that a band takes; at similarity 0.8, 3 pairs in a million share no band.
BANDS, BAND_ROWS = 24, 4
#: Comparisons beyond which an anchor's members first meet a centre, and a second one; pairs that this connects aren't compared again.
STAR, CROWD = 3, 64
#: Members up to which the pairs of an anchor that is not settled then are compared one by one; those of larger ones go to prefix_pairs().
FULL = 16
#: Bits of the longest outline; beyond, outlines tell less and more pairs are verified.
OUTLINE_BITS = 1 << 15
#: Distinct words whose bits lane_fingerprints() holds at a time.
WORDS = 1 << 16
#: Ids of candidates up to which they are broadcast; they are joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    ws = text.translate(_LOWER).split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
        starts = (ends[:-shingle] if shingle else ends).tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip([0, *starts], stops, strict=True)]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed 64-bit) of every row; no shuffle."""

    def run(batches):
        for batch in slices(batches, "t"):
            fps = np.array([fingerprint(x, shingle) for x in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, fp long")


_golay: dict[int, tuple] = {}


def golay(threshold: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Syndrome (11 bits) table pieces of the [23, 12] Golay code: each syndrome's error patterns of weight <= 3, and by excess e = 1..threshold those of weight 3 + e."""
    if threshold not in _golay:
        generator = 0b101011100011
        words = np.arange(1 << 23, dtype=np.int32)
        weight = np.zeros(1 << 23, dtype=np.int8)
        for b in range(23):
            weight += ((words >> b) & 1).astype(np.int8)
        want = np.flatnonzero(weight <= 3 + threshold)
        syndrome = want.astype(np.int64)
        for b in range(22, 10, -1):
            syndrome = np.where((syndrome >> b) & 1, syndrome ^ (generator << (b - 11)), syndrome)
        by = [want[weight[want] <= 3], *(want[weight[want] == 3 + e] for e in range(1, threshold + 1))]
        sy = [syndrome[weight[want] <= 3], *(syndrome[weight[want] == 3 + e] for e in range(1, threshold + 1))]
        tables = []
        for w, s in zip(by, sy, strict=True):
            order = np.argsort(s, kind="stable")
            tables.append((w[order], np.searchsorted(s[order], np.arange(2049))))
        _golay[threshold] = (generator, tables)
    return _golay[threshold]


def _syndrome(x: np.ndarray, generator: int) -> np.ndarray:
    for b in range(22, 10, -1):
        x = np.where((x >> b) & 1, x ^ (generator << (b - 11)), x)
    return x


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index of fp, anchor, is its home) of every fp's anchors: its home, and those below its home within reach."""
    generator, tables = golay(threshold)
    x = fps.view(np.uint64)
    halves = [(x & np.uint64((1 << 23) - 1)).astype(np.int64), ((x >> np.uint64(23)) & np.uint64((1 << 23) - 1)).astype(np.int64)]
    syn = [_syndrome(h, generator) for h in halves]

    def near(k: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        errors, at = tables[e]
        n = at[syn[k] + 1] - at[syn[k]]
        who = np.repeat(np.arange(len(x)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[syn[k]], n)
        return who, halves[k][who] ^ errors[place]

    home = (near(0, 0)[1] << 23) | near(1, 0)[1]
    who_all, anchor_all, home_all = [np.arange(len(x))], [home], [np.ones(len(x), bool)]
    for e0 in range(threshold + 1):
        for e1 in range(threshold + 1 - e0):
            if e0 + e1 == 0:
                continue
            w0, c0 = near(0, e0)
            w1, c1 = near(1, e1)
            n1 = np.bincount(w1, minlength=len(x))
            at1 = np.cumsum(n1) - n1
            n = n1[w0]
            who = np.repeat(w0, n)
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at1[w0], n)
            anchor = (np.repeat(c0, n) << 23) | c1[place]
            keep = anchor < home[who]
            who_all.append(who[keep])
            anchor_all.append(anchor[keep])
            home_all.append(np.zeros(int(keep.sum()), bool))
    return np.concatenate(who_all), np.concatenate(anchor_all), np.concatenate(home_all)


def links(reps: DataFrame, threshold: int = 2, hot: int = HOT) -> DataFrame:
    """Edges (a, b) of longs between representatives of distinct fingerprints (fp, rep) with at most threshold (up to 2) differing bits, or a set of edges that connects the same ones."""
    if threshold not in (0, 1, 2):
        raise ValueError("threshold: 0, 1 or 2")

    def spread(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                some = batch.slice(k, 20_000)
                fps = some.column(0).to_numpy(zero_copy_only=False)
                who, anchor, home = anchors(fps, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[who]), some.column(1).take(pa.array(who)), pa.array(home)], names=["anchor", "fp", "rep", "home"])

    dealt = reps.select("fp", "rep").mapInArrow(spread, "anchor long, fp long, rep long, home boolean")
    dealt, _ = written(dealt)
    sizes = dealt.groupBy("anchor").agg(F.sum(F.col("home").cast("long")).alias("h"), F.count(F.lit(1)).alias("n"))
    busy, _ = written(sizes.where((F.col("h") > 0) & (F.col("n") > 1) & (F.col("h") * F.col("n") > hot)).select("anchor"))
    cool = dealt if busy.limit(1).count() == 0 else dealt.join(busy, "anchor", "left_anti")
    a, b = cool.where("home").select("anchor", F.col("fp").alias("f"), F.col("rep").alias("a")), cool.select("anchor", F.col("fp").alias("g"), F.col("rep").alias("b"), "home")
    near = F.expr(f"bit_count(f ^ g) <= {threshold} and f <> g and (not home or f < g)")
    found = a.join(b, (a.anchor == b.anchor) & near).select("a", "b")
    if cool is dealt:
        return found
    crowd = dealt.join(busy, "anchor", "left_semi").select("fp", "rep").distinct()
    if threshold == 2:
        masks = [0, *(1 << k for k in range(63)), -(1 << 63)]
        points = F.array(*[F.struct(F.lit(0).alias("k"), F.col("fp").bitwiseXOR(F.lit(m).cast("long")).alias("p")) for m in masks])
    else:  # one bit left out at a time: equal rests differ in that bit at most
        masks = [*(1 << k for k in range(63)), -(1 << 63)] if threshold else [0]
        points = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(~m).cast("long")).alias("p")) for k, m in enumerate(masks)])
    met = crowd.select("rep", F.explode(points).alias("z"))
    low = met.groupBy("z").agg(F.min("rep").alias("a"), F.max("rep").alias("m")).where("a < m").select("z", "a")
    return found.unionByName(met.join(low, "z").where("rep <> a").select("a", F.col("rep").alias("b")).distinct())


def near_duplicates(docs: DataFrame, threshold: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row."""
    fps, _ = written(fingerprints(docs, shingle, id_col, text_col))
    reps, _ = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    joined = components(links(reps, threshold))
    label = reps.join(joined, reps.rep == joined.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(label, "fp")
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_LOWER_BYTES = np.frombuffer(_LOWER, np.uint8)
_LANE_SEED = mix(np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts, and the first word (one more than texts) of each."""
    data, offsets = raw(column)
    data = _LOWER_BYTES[data]
    starts, ends, first = words(data, offsets)
    return word_hashes(data, starts, ends), first


def _sets(h: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (64 bits) of each text; the whole sequence where it has fewer words, none where it has none."""
    grams = rolled(h, width, 0xD6E8FEB86659FD93)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(mix(grams[a : b - width + 1])))
        else:
            out.append(mix(rolled(h[a:b], b - a, 0xA0761D6478BD642F)) if b > a else h[:0])
    return out


def _outline(shingles: np.ndarray) -> bytes:
    """For each value of the low bits of the hashes whether an odd number of them has it; about one bit a shingle, OUTLINE_BITS at most."""
    bits = max(64, min(OUTLINE_BITS, 1 << max(0, len(shingles) - 1).bit_length()))
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def apart(u: pa.Array, v: pa.Array) -> np.ndarray:
    """Differing bits of each two outlines, the longer one folded to the shorter: no more than their sets have elements that the other lacks, as each of these turns one bit."""
    out, width = np.zeros(len(u), np.int64), [pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (u, v)]
    for kind in np.unique(width[0] << 32 | width[1]).tolist():
        at = np.flatnonzero((width[0] << 32 | width[1]) == kind)
        x, y = (np.frombuffer(b"".join(z.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1) for z in (u, v))
        while x.shape[1] != y.shape[1]:
            if x.shape[1] < y.shape[1]:
                x, y = y, x
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        out[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return out


_BAND_SEED = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Keys (texts by BANDS, LANE_BITS each) of minima of shingle sets; two sets share a key with probability J ** BAND_ROWS. Zero for an empty set."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    there = np.flatnonzero([len(x) for x in sets])
    if not len(there) or not BANDS:
        return out.view(np.int64)
    x = (np.concatenate([sets[i] for i in there]) >> np.uint64(16)).astype(np.uint32)
    starts = np.cumsum([0, *(len(sets[i]) for i in there[:-1])])
    for band in range(BANDS):
        key = np.zeros(len(there), np.uint64)
        for seed in _BAND_SEED[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
            low = np.minimum.reduceat((x ^ np.uint32(seed >> np.uint64(32))) * (np.uint32(seed & np.uint64(0xFFFFFFFF)) | np.uint32(1)), starts)
            key = mix(key ^ low.astype(np.uint64))
        out[there, band] = key >> np.uint64(64 - LANE_BITS)
    return out.view(np.int64)


def lane_fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHashes (texts by LANES, LANE_BITS each) over distinct single words, so that the common words of a language don't bring unlike texts together."""
    known, place = np.unique(h, return_inverse=True)
    total = np.zeros((len(first) - 1, LANES * LANE_BITS), np.float32)
    own = [np.unique(place[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    for k in range(0, len(known), WORDS):  # by a bounded number of words, so that memory stays small for any text
        some = known[k : k + WORDS]
        signs = np.empty((len(some), LANES, LANE_BITS), np.int8)
        for lane in range(LANES):
            x = mix(some ^ _LANE_SEED[lane])
            signs[:, lane] = 2 * np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :LANE_BITS].astype(np.int8) - 1
        signs = signs.reshape(len(some), -1)
        for i, word in enumerate(own):
            lo, hi = np.searchsorted(word, (k, k + WORDS))
            for j in range(lo, hi, 4096):
                e = min(hi, j + 4096)
                total[i] += signs[word[j:e] - k].sum(0, dtype=np.float32)
    return (total.reshape(-1, LANES, LANE_BITS) > 0) @ (np.int64(1) << np.arange(LANE_BITS, dtype=np.int64))


def prefix_pairs(live: DataFrame, slim: DataFrame, shingled, least: float) -> DataFrame:
    """a, b: candidates among the texts of live (rep, label) with different labels, none with a similarity of least or more left out (prefix and position filter).

    In the order of how many texts have them, rare ones first, the shingles of two such texts begin to agree so early that what is left can still be
    enough. In a group of edited copies each one's rarest shingles are its own edits, so hardly any pair gets that far, however large the group.
    """
    wanted, _ = written(live)

    def single(batches):
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(1)]
            for k in range(0, len(own), 256):
                size = np.fromiter(map(len, own[k : k + 256]), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 256).take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(np.repeat(size, size)), pa.array(np.concatenate(own[k : k + 256]).astype(np.int64))], names=["id", "n", "token"])

    sets = slim.join(wanted, F.col("doc_id") == F.col("rep"), "left_semi").mapInArrow(shingled, "id long, s binary").dropDuplicates(["id"])
    tokens, _ = written(sets.mapInArrow(single, "id long, n long, token long"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")  # the others come first in every order, so their number is enough
    in_order = tokens.join(counts, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "token"))).alias("ts"))
    most = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1
    alone = F.col("n") - F.size("ts")
    begin = in_order.select("id", "n", alone.alias("alone"), F.posexplode(F.slice("ts", F.lit(1), F.greatest(most - alone, F.lit(0)).cast("int"))).alias("k", "t"))
    begin = begin.select("id", "n", (F.col("alone") + F.col("k")).alias("at"), "t")
    begin, _ = written(begin.select("id", "n", "at", "t.token").join(wanted.withColumnRenamed("rep", "id"), "id"))
    x = begin.select("token", F.col("id").alias("a"), "n", "at", "label")
    y = begin.select(F.col("token").alias("same"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("at").alias("there"), F.col("label").alias("other"))
    enough = F.expr(f"least(n - at, m - there) + 1e-9 >= {least} / (1 + {least}) * (n + m)")
    return x.join(y, (F.col("token") == F.col("same")) & (F.col("a") < F.col("b")) & (F.col("label") != F.col("other")) & enough).select("a", "b").distinct()


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable by links) of every row; texts link if their width-word shingle sets have a Jaccard similarity of least or more.

    Equal word sequences (A-Z lower-cased) are one class, found exactly; texts without words are one class
    too, and fewer words than width are one shingle. Links rest on 32-bit hashes of whole
    shingle sets; at the least similarity 3 pairs in a million share none of the bands, however the texts differ; one shared band or anchor is enough. Outlines
    only rule out pairs that differ in more shingles than the least similarity allows. Shuffled are 250 bytes and an eighth to a quarter of a byte a word for each row, the
    anchors of the classes, pairs of unlike texts by anchor, and the shingle sets of candidates; no group meets in one task.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def sketch(batches):
        for batch in slices(batches, "t"):
            h, first = _hashed(batch.column(1))
            ends = zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
            key = [xxhash.xxh3_128_digest(h[a:b].tobytes()) for a, b in ends]
            lanes = lane_fingerprints(h, first)
            sets = _sets(h, first, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(map(len, sets), pa.int32()), pa.array([x.tobytes() for x in lanes], pa.binary()), pa.array(map(_outline, sets), pa.binary()), pa.array([x.tobytes() for x in band_keys(sets)], pa.binary())], names=["doc_id", "key", "n", "lanes", "outline", "bands"])

    rows, _ = written(slim.mapInArrow(sketch, "doc_id long, key binary, n int, lanes binary, outline binary, bands binary"))
    reps, _ = written(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "lanes", "outline", "bands"))))

    def spread(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                some = batch.slice(k, 20_000)
                fps = np.frombuffer(b"".join(some.column(2).to_pylist()), np.int64).reshape(-1, LANES)
                for lane in range(LANES):
                    own = np.ascontiguousarray(fps[:, lane])
                    who, anchor, home = anchors(own, 1)
                    at = pa.array(who)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor | (lane << LANE_BITS)), some.column(0).take(at), some.column(1).take(at), pa.array(home)], names=["anchor", "rep", "n", "home"])
                bands = np.frombuffer(b"".join(some.column(3).to_pylist()), np.int64).reshape(some.num_rows, -1)
                for band in range(bands.shape[1]):  # as further lanes, whose members are all at home and equal
                    yield pa.RecordBatch.from_arrays([pa.array(bands[:, band] | ((LANES + band) << LANE_BITS)), some.column(0), some.column(1), pa.array(np.ones(some.num_rows, bool))], names=["anchor", "rep", "n", "home"])

    dealt, _ = written(reps.select("rep", "n", "lanes", "bands").where("n > 0").mapInArrow(spread, "anchor long, rep long, n int, home boolean"))
    sizes = dealt.groupBy("anchor").agg(F.sum(F.col("home").cast("long")).alias("h"), F.count(F.lit(1)).alias("c")).where("h > 0 and c > 1").select("anchor", (F.col("h") * F.col("c")).alias("work"), "c")
    dealt, _ = written(dealt.join(sizes, "anchor"))  # the rest meets nobody
    known = dealt.groupBy(F.col("rep").alias("r")).agg(F.sum("c").alias("peers"))  # what a group was copied from shares the most anchors with the most members
    dealt, _ = written(dealt.drop("c").join(known, F.col("rep") == F.col("r")).drop("r"))
    alike = F.expr(f"a <> b and least(n, m) >= {least} * greatest(n, m)")
    in_order = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def plausible(batches):
        for batch in batches:
            n = batch.column(4).to_numpy().astype(np.int64) + batch.column(5).to_numpy()
            keep = pa.array(apart(batch.column(2), batch.column(3)) <= (1 - least) / (1 + least) * n + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    def shingled(batches):
        for batch in slices(batches, "t"):
            h, first = _hashed(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique((x >> np.uint64(20)).astype(np.uint32)).tobytes() for x in _sets(h, first, width)], pa.binary())], names=["id", "s"])

    def verify(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                u, v = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep[i] = both >= least * (len(u) + len(v) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    def verified(pairs: DataFrame, outlines: DataFrame) -> DataFrame:
        """Of the candidate pairs (a, b) whose classes (rep, n, outline, label) aren't connected yet, those that link; shingles are read of those only that outlines don't rule out."""
        one, two = (outlines.select(F.col("rep").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "outline", "label"))) for x in ("a", "b"))
        open_ = pairs.join(one, "a").join(two, "b").where("a_label <> b_label").select("a", "b", "a_outline", "b_outline", "a_n", "b_n")
        likely, _ = written(open_.mapInArrow(plausible, "a long, b long"))
        needed = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
        needed = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
        sets, _ = written(slim.join(needed, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(shingled, "id long, s binary"))
        both = likely.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
        return written(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"))[0]

    def relabelled(links_: DataFrame) -> DataFrame:
        return written(outlines.drop("label").join(components(links_), F.col("rep") == F.col("node"), "left").select("rep", "n", "outline", F.coalesce("component", "rep").alias("label")))[0]

    def unsettled(d: DataFrame) -> DataFrame:
        """Of the dealt rows those of anchors that hold several components, with their labels."""
        labelled = d.join(outlines.select("rep", "label"), "rep")
        several = labelled.groupBy("anchor").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("anchor")
        return written(labelled.join(several, "anchor").select("anchor", "rep", "n", "work", "peers", "label"))[0]

    outlines, links_, open_ = reps.select("rep", "n", "outline", F.col("rep").alias("label")), None, dealt.withColumn("label", F.col("rep"))
    for turn, work in enumerate((STAR, CROWD)):
        crowd = open_.where(F.col("work") > work).select("anchor", F.col("rep").alias("b"), "n", "peers", "label")
        first = F.min(F.struct((-F.col("peers")).alias("o"), F.xxhash64("b").alias("p"), "b", "n", "label")).alias("x")
        choice = crowd
        if turn:  # now the best known one that is not connected with the first
            best = crowd.groupBy("anchor").agg(first).select("anchor", F.col("x.label").alias("known"))
            choice = crowd.join(best, "anchor").where("label <> known")
        centre = choice.groupBy("anchor").agg(first).select("anchor", F.col("x.b").alias("a"), F.col("x.n").alias("m"), F.col("x.label").alias("other"))
        found = verified(crowd.join(centre, "anchor").where(alike & (F.col("label") != F.col("other"))).select(*in_order).distinct(), outlines)
        links_ = found if links_ is None else links_.unionByName(found)
        outlines = relabelled(links_)
        open_ = unsettled(open_.drop("label"))
    size = open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"))
    large = size.where(F.col("c") > FULL).select("anchor")
    live, _ = written(open_.join(large, "anchor", "left_semi").select("rep", "label").distinct())  # all pairs among these are looked at by prefixes
    few, _ = written(open_.join(size.where(F.col("c") <= FULL), "anchor").join(live.select("rep", F.lit(True).alias("live")), "rep", "left").select("anchor", "rep", "n", "label", F.coalesce("live", F.lit(False)).alias("live")))
    x, y = (few.select("anchor", F.col("rep").alias(i), F.col("n").alias(j), F.col("label").alias(f"{i}_of"), F.col("live").alias(f"{i}_live")) for i, j in (("a", "n"), ("b", "m")))
    pairs = x.join(y, "anchor").where(alike & F.expr("a < b and a_of <> b_of and not (a_live and b_live)")).select("a", "b").distinct()
    links_ = links_.unionByName(verified(prefix_pairs(live, slim, shingled, least).unionByName(pairs).distinct(), outlines))
    joined = components(links_)
    label = reps.select("key", "rep").join(joined, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    return rows.select("doc_id", "key").join(label, "key").select("doc_id", "component_id")
