"""Cropped or edited copies of images by local descriptors (operator 7).

1. Images (PGM or 8-bit PNG bytes) give multiscale Harris corners, the strongest of every CELL x CELL pixels of each level (so their
   number follows the area), each with an orientation (intensity centroid) and 128 binary tests in a patch turned by it.
2. Hamming tables: the 128 bits give TABLES keys of 21 bits; all descriptors of different images that share a key meet, however many share it.
3. Geometric consensus: each match votes for a similarity transform (scale, turn, shift in
   bins, two grids half a bin apart); LEAST distinct matches in one bin link two images, if they are one in CLEAR of the matches of the two or
   six deviations more than chance would give (large pictures of like corners have thousands of matches, of which a dozen agree by accident).

A match differs in MOST_BITS bits at most. Two descriptors that far apart share one of the tables' keys with a chance, not for sure; as copies
have many descriptors and LEAST of them are enough, that loses few copies (README has the measured recall).

Images are dealt to blocks, and each two blocks are compared by one kernel, which looks up keys, counts matches by pair of images and lets only pairs with LEAST of them vote.
So no match and, in copies(), no link is ever a row (a kernel sums the links of each image), and no key, group or pair is left out. The price is that every block meets every other: rows are sent once for each block, and where images look alike (few different keys)
time grows with the square of their number.

* Cases: null, undecodable or flat images link with nothing but identical bytes (null never
  links); identical bytes collapse to one image first; repeated rows of one id are one image; images of any size are read whole; ties among corners go to the
  upper left one, other ties need no order; an empty table gives no rows; null ids link like others of their bytes; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, local_roots, written

CELL, TABLES, GROUP, LEAST, MOST_BITS = 8, 6, 24, 6, 16
#: Descriptors of a block on average, in tables large enough for GROUP blocks or more; small tables take blocks of a FEW.
BLOCK, FEW = 32_768, 2048
#: Part (one in so many) of two images' matches that is no chance if it agrees, however small the images.
CLEAR = 100
#: Candidates that a kernel holds at a time.
HELD = 2_000_000
#: Images with different bytes up to which their ids are broadcast; they are joined by shuffle beyond.
BROADCAST_ROWS = 500_000
_RNG = np.random.default_rng(2024)
_TESTS = np.clip(_RNG.normal(0, 3.2, (128, 4)), -7, 7)
_DISC = np.stack(np.meshgrid(np.arange(-7, 8), np.arange(-7, 8)), -1).reshape(-1, 2)
_DISC = _DISC[(_DISC**2).sum(1) <= 49]


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values 0..255 of a PGM (P5) or non-interlaced 8-bit PNG, or None."""
    try:
        if data is None:
            return None
        if data[:2] == b"P5":
            _, w, h, most, rest = data.split(maxsplit=4) if data[2:3].isspace() else (None,) * 5
            w, h = int(w), int(h)
            return np.frombuffer(data[len(data) - w * h :], np.uint8).reshape(h, w).astype(np.float32) * (255 / int(most))
        if data[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, raw, w, h, kind = 8, b"", 0, 0, 0
        while at < len(data):
            n, tag = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + n]
            if tag == b"IHDR":
                w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", body)
                if depth != 8 or lace or kind not in (0, 2, 4, 6):
                    return None
            elif tag == b"IDAT":
                raw += body
            at += 12 + n
        c = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
        rows = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(h, w * c + 1)
        out = np.zeros((h, w * c), np.uint8)
        for y in range(h):
            line, up = rows[y, 1:], out[y - 1] if y else np.zeros(w * c, np.uint8)
            f = rows[y, 0]
            if f == 0:
                out[y] = line
            elif f == 2:
                out[y] = line + up
            else:
                for x in range(w * c):
                    a, b, d = int(out[y, x - c]) if x >= c else 0, int(up[x]), int(up[x - c]) if x >= c else 0
                    p = a + b - d
                    guess = a if f == 1 else (a + b) // 2 if f == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                    out[y, x] = (int(line[x]) + guess) & 255
        px = out.reshape(h, w, c).astype(np.float32)
        return px[..., 0] if c < 3 else px[..., :3] @ np.array([0.299, 0.587, 0.114], np.float32)
    except (ValueError, struct.error, zlib.error, KeyError, TypeError):
        return None


def _smooth(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, 1, mode="edge")
    x = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
    return (x[:, :-2] + 2 * x[:, 1:-1] + x[:, 2:]) / 4


def describe(image: np.ndarray | None) -> list[tuple[float, float, float, float, bytes]]:
    """x, y (of the whole image), scale, orientation and 16 bytes of tests of the corners."""
    out = []
    if image is None or min(image.shape) < 24:
        return out
    image, scale = np.asarray(image, np.float32), 1.0
    while min(image.shape) >= 24 and scale <= 8:
        soft = _smooth(image)
        gy, gx = np.gradient(soft)
        a, b, c = _smooth(_smooth(gx * gx)), _smooth(_smooth(gx * gy)), _smooth(_smooth(gy * gy))
        score = a * c - b * b - 0.05 * (a + c) ** 2
        p = np.pad(score, 2, constant_values=-np.inf)
        peak = np.max([p[i : i + score.shape[0], j : j + score.shape[1]] for i in range(5) for j in range(5)], axis=0)
        ok = (score >= peak) & (score > 1.0)
        ok[:10], ok[-10:], ok[:, :10], ok[:, -10:] = False, False, False, False
        ys, xs = np.nonzero(ok)
        order = np.lexsort((xs, ys, -score[ys, xs]))
        ys, xs = ys[order], xs[order]
        _, best = np.unique(ys // CELL * image.shape[1] + xs // CELL, return_index=True)  # the strongest of each cell
        ys, xs = ys[best], xs[best]
        if len(ys):
            soft = _smooth(soft)
            patch = soft[ys[:, None] + _DISC[:, 1], xs[:, None] + _DISC[:, 0]]
            turn = np.arctan2(patch @ _DISC[:, 1], patch @ _DISC[:, 0])
            co, si = np.cos(turn)[:, None], np.sin(turn)[:, None]
            t = _TESTS

            def at(dx, dy, co=co, si=si, ys=ys, xs=xs, soft=soft):
                return soft[np.clip(np.rint(ys[:, None] + si * dx + co * dy).astype(int), 0, soft.shape[0] - 1), np.clip(np.rint(xs[:, None] + co * dx - si * dy).astype(int), 0, soft.shape[1] - 1)]

            bits = np.packbits(at(t[:, 0], t[:, 1]) < at(t[:, 2], t[:, 3]), axis=1)
            out += [(float(x * scale), float(y * scale), scale, float(o), d.tobytes(), float(s)) for x, y, o, d, s in zip(xs, ys, turn, bits, score[ys, xs], strict=True)]
        image = (soft[: soft.shape[0] // 2 * 2, : soft.shape[1] // 2 * 2].reshape(soft.shape[0] // 2, 2, -1, 2)).mean((1, 3))
        scale *= 2
    return [r[:5] for r in out]


def descriptors(images: DataFrame) -> DataFrame:
    """img, x, y, s, o, d0, d1 (bits) of every corner. images: img, data."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(i, *r[:4], *struct.unpack(">qq", r[4])) for r in describe(decode(data))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.int64()], strict=True)], names=["img", "x", "y", "s", "o", "d0", "d1"])

    return images.mapInArrow(run, "img long, x double, y double, s double, o double, d0 long, d1 long")


def _fields(at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Scale (log 2), x, y and turn (radians) of descriptors' places."""
    return at >> 58 & 31, (at >> 37 & (1 << 21) - 1).astype(float), (at >> 16 & (1 << 21) - 1).astype(float), (at & 65535) * (2 * np.pi / 65536)


def _codes(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The similarity transform from place p to place q in half bins, as one number."""
    (s, px, py, po), (t, qx, qy, qo) = _fields(p), _fields(q)
    scale, turn = np.exp2((t - s).astype(float)), qo - po
    x = qx - scale * (np.cos(turn) * px - np.sin(turn) * py)
    y = qy - scale * (np.sin(turn) * px + np.cos(turn) * py)
    code = t - s + 8
    for value, bits in ((np.floor(turn / (2 * np.pi) % 1.0 * 24), 5), (np.floor(x / 6) + (1 << 24), 25), (np.floor(y / 6) + (1 << 24), 25)):
        code = code << bits | value.astype(np.int64)
    return code


def _summed(pair: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (pair, code), and the sum of n of each."""
    if not len(pair):
        return pair, code, n
    order = np.lexsort((code, pair))
    pair, code = pair[order], code[order]
    first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (code[1:] != code[:-1])))
    return pair[first], code[first], np.add.reduceat(n[order], first)


def _agreeing(pair: np.ndarray, code: np.ndarray, n: np.ndarray, wide) -> np.ndarray:
    """Pairs of images with LEAST votes in one bin of either grid, more than chance gives. code: half bins; wide(pair): mean widths of the two images, that with the smaller id first."""
    s, r, u, v = code >> 55, code >> 50 & 31, code >> 25 & (1 << 25) - 1, code & (1 << 25) - 1
    known, place = np.unique(pair, return_inverse=True)
    matches, out = np.bincount(place, n), []
    for g in (0, 1):
        its, bins, votes = _summed(pair, ((s << 5 | (r + g) // 2 % 12) << 25 | (u + g) // 2) << 25 | (v + g) // 2, n)
        ok = votes >= LEAST
        its, scale, votes = its[ok], np.exp2((bins[ok] >> 55) - 8.0), votes[ok]
        own, other = wide(its)
        all_ = matches[np.searchsorted(known, its)]
        chance = all_ * 0.75 * 144 / (scale * own + other) ** 2  # votes of a bin of 12 x 12 pixels: most turns are quarter turns, most shifts small
        out.append(its[(votes >= LEAST + chance + 6 * np.sqrt(chance)) | (votes * CLEAR >= all_)])
    return np.unique(np.concatenate(out))


def _widths(at: np.ndarray, local: np.ndarray) -> np.ndarray:
    """Mean of width and height (geometric) that each image's descriptors span; local: numbers of images, in order."""
    starts = np.flatnonzero(np.append(True, local[1:] != local[:-1]))
    spans = [np.maximum.reduceat(z, starts) - np.minimum.reduceat(z, starts) + 16 for z in _fields(at)[1:3]]
    return np.sqrt(spans[0] * spans[1])


def _keys(d: np.ndarray) -> list[np.ndarray]:
    return [d[:, t // 3] >> np.uint64(21 * (t % 3)) & np.uint64((1 << 21) - 1) for t in range(TABLES)]


def compared(img: np.ndarray, at: np.ndarray, d: np.ndarray, img2: np.ndarray, at2: np.ndarray, d2: np.ndarray, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """a, b: linked images of two blocks of descriptors (image, place, 2 x 64 bits), or of one with itself (same). Rows are in order of their images.

    Works by runs of whole images of the first block that have HELD candidates at most; an image with more is alone, and its matches are summed by transform HELD at a time.
    """
    tables = []
    for own, theirs in zip(_keys(d), _keys(d2), strict=True):
        order = np.argsort(theirs, kind="stable")
        low = np.searchsorted(theirs[order], own, "left")
        tables.append((order, d2[order, 0], d2[order, 1], low, np.searchsorted(theirs[order], own, "right") - low))
    names, local = np.unique(img, return_inverse=True)
    names2, local2 = np.unique(img2, return_inverse=True)
    done = np.append(0, np.cumsum(sum(x[4] for x in tables)))  # candidates of the descriptors before
    ends = np.append(np.flatnonzero(img[1:] != img[:-1]) + 1, len(img))  # of images
    field = np.uint64((1 << 21) - 1)
    width, width2 = _widths(at, local), _widths(at2, local2)

    def wide(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = pair // len(names2), pair % len(names2)
        turned = names[a] > names2[b]
        return np.where(turned, width2[b], width[a]), np.where(turned, width[a], width2[b])

    def met(a: int, e: int):
        """Matches of descriptors a to e, each in the first table where its two share a key."""
        for t, (order, e0, e1, low, n) in enumerate(tables):
            n = n[a:e]
            total = int(n.sum())
            if not total:
                continue
            who = np.repeat(np.arange(a, e), n)
            place = np.arange(total) + np.repeat(low[a:e] - (np.cumsum(n) - n), n)
            x0, x1 = np.repeat(d[a:e, 0], n) ^ e0[place], np.repeat(d[a:e, 1], n) ^ e1[place]
            near = np.flatnonzero(np.bitwise_count(x0) + np.bitwise_count(x1) <= MOST_BITS)
            who, other, x = who[near], order[place[near]], (x0[near], x1[near])
            ok = img[who] < img2[other] if same else np.ones(len(who), bool)
            for u in range(t):
                ok &= (x[u // 3] >> np.uint64(21 * (u % 3)) & field) != 0
            yield who[ok], other[ok]

    def votes(i: np.ndarray, j: np.ndarray, before: tuple | None) -> tuple:
        p, q = at[i], at2[j]
        turned = img[i] > img2[j]  # the transform goes from the smaller image
        new = local[i] * len(names2) + local2[j], _codes(np.where(turned, q, p), np.where(turned, p, q)), np.ones(len(i), np.int64)
        return _summed(*(new if before is None else (np.concatenate(x) for x in zip(before, new, strict=True))))

    found, begin = [], 0
    while begin < len(img):
        some = ends[ends > begin]
        stop = int(some[max(0, np.searchsorted(done[some], done[begin] + HELD, "right") - 1)])
        held, size, summed, a = [], 0, None, begin
        while a < stop:
            e = min(stop, max(a + 1, int(np.searchsorted(done, done[a] + HELD, "right")) - 1))
            for i, j in met(a, e):
                held.append((i, j))
                size += len(i)
                if size > HELD:
                    summed, held, size = votes(*(np.concatenate(x) for x in zip(*held, strict=True)), summed), [], 0
            a = e
        if held:
            i, j = (np.concatenate(x) for x in zip(*held, strict=True))
            if summed is None:
                pair = (local[i] - local[begin]) * len(names2) + local2[j]
                many = np.bincount(pair, minlength=1)[pair] >= LEAST
                i, j = i[many], j[many]
            summed = votes(i, j, summed)
        if summed is not None:
            found.append(_agreeing(*summed, wide))
        begin = stop
    pair = np.concatenate(found) if found else np.zeros(0, np.int64)
    a, b = names[pair // max(1, len(names2))], names2[pair % max(1, len(names2))]
    return np.minimum(a, b), np.maximum(a, b)


def links(points: DataFrame) -> DataFrame:
    """a, b: images with LEAST matches that agree on one similarity transform; all of them, whatever their keys. points: a written table."""
    return _met(points, None, lambda a, b, names, n: (a, b), "a long, b long")


def link_sums(points: DataFrame, weights: DataFrame) -> DataFrame:
    """Of the same links img, links (sum of the weights of the images linked to img), low: a row for each image and each two blocks that link it, with the smallest image it reaches there.

    A group of alike images gives rows in proportion to its size, not to its pairs; the edges img - low connect what the links connect. weights: img, n of images that don't weigh 1.
    """

    def summed(a: np.ndarray, b: np.ndarray, names: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        nodes, low = local_roots(a, b)
        total = np.zeros(len(nodes), np.int64)
        for x, y in ((a, b), (b, a)):
            np.add.at(total, np.searchsorted(nodes, x), n[np.searchsorted(names, y)])
        return nodes, total, low

    return _met(points, weights, summed, "img long, links long, low long")


def _met(points: DataFrame, weights: DataFrame | None, result, schema: str) -> DataFrame:
    """Rows of result(a, b, names, n) of each two blocks: their links, their images in order and the weight of each."""
    n = points.count()
    blocks = max(1, min(max(GROUP, -(-n // BLOCK)), -(-n // FEW)))
    turn = F.pmod(F.round(F.col("o") / (2 * 3.141592653589793) * 65536).cast("long"), F.lit(65536))
    place = F.round(F.log2("s")).cast("long")
    for value, bits in ((F.round("x").cast("long"), 21), (F.round("y").cast("long"), 21), (turn, 16)):
        place = F.shiftleft(place, bits).bitwiseOR(value)
    own = points.select(F.pmod(F.xxhash64("img"), F.lit(blocks)).alias("block"), "img", place.alias("at"), "d0", "d1")  # x and y to the pixel, the turn in 65536 steps
    if weights is None:
        own = own.withColumn("n", F.lit(1).cast("long"))
    else:
        heavy = weights.select(F.col("img").alias("w"), F.col("n").cast("long").alias("n"))
        heavy = F.broadcast(heavy) if heavy.count() <= BROADCAST_ROWS else heavy
        own = own.join(heavy, F.col("img") == F.col("w"), "left").drop("w").fillna(1, ["n"])

    def pack(table: pa.Table) -> pa.Table:
        cols = [table.column(c).to_numpy() for c in ("img", "at", "d0", "d1")]
        order = np.argsort(cols[0], kind="stable")
        first = np.unique(cols[0], return_index=True)[1]
        return pa.table([table.column("block").slice(0, 1), *(pa.array([c.tobytes()], pa.binary()) for c in (*(c[order] for c in cols), table.column("n").to_numpy()[first]))], names=["block", "img", "at", "d0", "d1", "n"])

    packed = own.repartition(blocks, "block").groupBy("block").applyInArrow(pack, "block long, img binary, at binary, d0 binary, d1 binary, n binary")
    packed, _ = written(packed)
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = packed.withColumn("other", other).select((F.least("block", "other") * blocks + F.greatest("block", "other")).alias("pair"), "block", "img", "at", "d0", "d1", "n")

    names = [x.split()[0] for x in schema.split(", ")]

    def compare(table: pa.Table) -> pa.Table:
        sides, images, weight = [], [], []
        for row in zip(*(table.column(c) for c in ("img", "at", "d0", "d1", "n")), strict=True):
            img, at, d0, d1, n = (np.frombuffer(x.as_buffer(), np.int64) for x in row)
            sides.append((img, at, np.stack([d0, d1], 1).view(np.uint64)))
            images.append(np.unique(img))
            weight.append(n)
        first, last = divmod(table.column("pair")[0].as_py(), blocks)
        there = first == last or len(sides) == 2  # a block may hold no image
        a, b = compared(*sides[0], *sides[-1], same=first == last) if there else (np.zeros(0, np.int64),) * 2
        images, weight = np.concatenate(images), np.concatenate(weight)
        order = np.argsort(images)
        return pa.table([pa.array(c, pa.int64()) for c in result(a, b, images[order], weight[order])], names=names)

    pairs = blocks * (blocks + 1) // 2
    return dealt.repartition(pairs, "pair").groupBy("pair").applyInArrow(compare, schema)


def copies(images: DataFrame, id_col: str = "img", data_col: str = "data") -> DataFrame:
    """img, n_links (images linked to its bytes' representative, and identical ones), component_id of every image."""
    own = images.select(F.col(id_col).cast("long").alias("img"), F.col(data_col).alias("data"))
    rows, _ = written(own.select("img", F.sha2("data", 256).alias("h")))  # the bytes themselves are read again, not written
    reps = rows.where("h is not null").groupBy("h").agg(F.min("img").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps, _ = written(reps)
    asked = reps.select(F.col("rep").alias("r"), F.col("h").alias("rh"))
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    chosen = own.join(asked, (F.col("img") == F.col("r")) & (F.sha2("data", 256) == F.col("rh"))).select("img", "data")
    if rows.groupBy("img").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        chosen = chosen.dropDuplicates(["img"])
    points, _ = written(descriptors(chosen))
    weights = reps.groupBy(F.col("rep").alias("img")).agg(F.sum("n").alias("n")).where("n > 1")
    met, _ = written(link_sums(points, weights))
    joined = components(met.select(F.col("img").alias("a"), F.col("low").alias("b")))
    linked = met.groupBy(F.col("img").alias("a")).agg(F.sum("links").alias("links"))
    state = reps.join(linked, reps.rep == linked.a, "left").drop("a").join(joined, F.col("rep") == joined.node, "left")
    state = state.select(F.col("h").alias("hh"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(state, rows.h == state.hh, "left")
    return out.select("img", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "img").alias("component_id"))


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = 6) -> DataFrame:
    """img, data: each vector drawn as a PGM of grey points, cell pixels apart, with even shades between them (the tables hold no pictures). Null, empty or non-finite vectors give null."""

    def between(grid: np.ndarray) -> np.ndarray:
        n = len(grid)
        at = (np.arange(n * cell) + 0.5) / cell - 0.5
        low = np.clip(np.floor(at).astype(int), 0, n - 1)
        high, part = np.clip(low + 1, 0, n - 1), np.clip(at - low, 0, 1)
        rows = grid[low] * (1 - part)[:, None] + grid[high] * part[:, None]
        return rows[:, low] * (1 - part) + rows[:, high] * part

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if z is None else z for z in v or [np.nan]], np.float64)
                if not np.isfinite(x).all():
                    out.append(None)
                    continue
                side = int(np.ceil(np.sqrt(len(x))))
                grid = np.zeros(side * side)
                grid[: len(x)] = x / (np.abs(x).max() or 1)
                grey = np.clip(128 + 127 * between(grid.reshape(side, side)), 0, 255).astype(np.uint8)
                out.append(b"P5\n%d %d\n255\n" % grey.shape[::-1] + grey.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["img", "data"])

    return vectors.select(F.col(id_col).cast("long").alias("img"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "img long, data binary")
