"""Language of whole texts by a linear-chain conditional random field over words (operator 3).

Each word gets a label by forward-backward over the whole text; features are the word
(lexicon), its affixes and its character n-grams, hashed into BUCKETS; transitions are
learnt from code-switched training sequences made of stretches of texts of several
languages. The text's language is the label with the largest mean posterior.

Trained on a bounded, documented sample: of every language that occurs the DOCS_PER_LANG rows
with the smallest hashed id, SEQUENCES stretches of STRETCH words of each. The chain is exact for any length: blocks of words are multiplied out first, then
entered with the messages of their neighbours.

* Cases: null text or one without a letter gives ``und`` with score 0; digits and marks
  are no words; with no labelled row at all every text is ``und``; ties go to the label
  that sorts first; repeated rows give repeated results; texts of any length are labelled whole; null ids
  are predicted but not learnt from; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import random
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, crc_mod, distinct_words, mix, powers, slices

DOCS_PER_LANG, SEQUENCES, STRETCH = 300, 6, 24
BUCKETS, STEPS, BLOCK, CACHE = 1 << 15, 40, 64, 250_000
#: Bytes of text that are labelled at a time.
SLICE = 2 << 20
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def _grams(codes: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Bucket of the n code points from each place on, for one kind of feature (those that would pass the end are of no use)."""
    h = np.full(len(codes), kind, np.uint64)
    for k in range(n):
        h[: len(codes) - k] = h[: len(codes) - k] * np.uint64(0x9E3779B1) + codes[k:]
    return (mix(h) % np.uint64(BUCKETS)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words in one array, and where each word's begin: the word itself (lexicon), prefixes and suffixes of 2 to 4
    characters (the word's edges count as characters), and all n-grams of 2 and 3, as often as they occur."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(size) - size
    own = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - start[own]
    at = np.cumsum(2 * size + 4) - 2 * size - 4
    out = np.empty(int((2 * size + 4).sum()), np.int64)
    weight = powers(0x9E6C63D0676A9A99, int(size.max(initial=0)))
    out[at] = (mix(np.add.reduceat(mix(codes) * weight[place], start)) % np.uint64(BUCKETS)).astype(np.int64) if len(words) else 0
    for n in (2, 3, 4):
        fit = np.minimum(n, size)
        head, tail = _grams(codes, n, n), _grams(codes, n, 10 + n)
        if n == 4:  # words of one letter have three characters with their edges
            short, short_tail = _grams(codes, 3, n), _grams(codes, 3, 10 + n)
            out[at + 3] = np.where(size < 4, short[start], head[start])
            out[at + 6] = np.where(size < 4, short_tail[start], tail[start + size - fit])
        else:
            out[at + n - 1], out[at + n + 2] = head[start], tail[start + size - n]
    inner = place < size[own] - 1
    out[(at[own] + 7 + place)[inner]] = _grams(codes, 2, 20)[inner]
    inner = place < size[own] - 2
    out[(at[own] + 6 + size[own] + place)[inner]] = _grams(codes, 3, 21)[inner]
    return out, at


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


class CRF:
    def __init__(self, labels: list[str]):
        self.labels = labels
        k = len(labels)
        self.weights = np.zeros((BUCKETS, k))
        self.moves = np.zeros((k, k))

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of the feature sums, each row scaled by its maximum."""
        out = np.empty((len(words), len(self.labels)))
        for k in range(0, len(words), 20_000):
            flat, at = features(words[k : k + 20_000])
            z = np.add.reduceat(self.weights[flat], at, axis=0)
            out[k : k + len(at)] = np.exp(z - z.max(1, keepdims=True))
        return np.maximum(out, 1e-12)

    def train(self, sequences: list[tuple[list[str], list[int]]]) -> None:
        """Maximum likelihood by Adam on all sequences at once."""
        sequences = sorted((s for s in sequences if s[0]), key=lambda s: -len(s[0]))
        if not sequences or len(self.labels) < 2:
            return
        k, n, top = len(self.labels), len(sequences), len(sequences[0][0])
        vocabulary = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s[0]}))}
        flat, cut = features(list(vocabulary))
        owner = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(flat))))
        words = np.zeros((top, n), np.int64)
        gold = np.full((top, n), -1)
        for i, (w, y) in enumerate(sequences):
            words[: len(w), i], gold[: len(y), i] = [vocabulary[x] for x in w], y
        live = gold >= 0
        want = np.zeros((len(cut), k))
        np.add.at(want, (words[live], gold[live]), 1)
        steps = live[1:]
        want_moves = np.zeros((k, k))
        np.add.at(want_moves, (gold[:-1][steps], gold[1:][steps]), 1)
        state = {name: [np.zeros_like(v), np.zeros_like(v)] for name, v in (("weights", self.weights), ("moves", self.moves))}
        for step in range(1, STEPS + 1):
            z = np.add.reduceat(self.weights[flat], cut, axis=0)
            e = np.exp(z - z.max(1, keepdims=True))
            a = np.exp(self.moves - self.moves.max())
            alpha = np.zeros((top, n, k))
            now = np.full((n, k), 1 / k)
            for t in range(top):
                new = _normal((now @ a) * e[words[t]])
                now = np.where(live[t][:, None], new, now)
                alpha[t] = now
            beta = np.ones((n, k))
            got, got_moves = np.zeros((len(cut), k)), np.zeros((k, k))
            for t in range(top - 1, -1, -1):
                on = live[t]
                gamma = _normal(alpha[t] * beta)
                np.add.at(got, words[t][on], gamma[on])
                over = e[words[t]] * beta
                if t:
                    pair = alpha[t - 1][:, :, None] * a[None] * over[:, None, :]
                    pair /= pair.sum((1, 2), keepdims=True)
                    got_moves += pair[on].sum(0)
                beta = np.where(on[:, None], _normal(over @ a.T), beta)
            diff = want - got
            grad = np.stack([np.bincount(flat, weights=diff[owner, j], minlength=BUCKETS) for j in range(k)], 1) - 0.02 * self.weights
            for name, g, rate in (("weights", grad, 0.1), ("moves", want_moves - got_moves - 0.02 * self.moves, 0.1)):
                m, v = state[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value = getattr(self, name)
                value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def posteriors(self, rows: np.ndarray, lengths: np.ndarray, table: np.ndarray, each: bool = False) -> np.ndarray:
        """Sum of the words' posteriors of each text (each: of every word). rows: emission rows of all words, text after text."""
        k, a = len(self.labels), np.exp(self.moves - self.moves.max())
        blocks = -(-lengths // BLOCK)
        n = int(blocks.sum())
        if not n:
            return np.zeros((0 if each else len(lengths), k))
        text = np.repeat(np.arange(len(lengths)), blocks)
        nth = np.arange(n) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(lengths) - lengths, blocks) + nth * BLOCK
        size = np.minimum(BLOCK, np.repeat(lengths, blocks) - nth * BLOCK)
        ids = np.where(np.arange(BLOCK)[:, None] < size, rows[np.minimum(start + np.arange(BLOCK)[:, None], len(rows) - 1)], -1)
        product = np.broadcast_to(np.eye(k), (n, k, k)).copy()
        for t in range(BLOCK):
            on = ids[t] >= 0
            x = (product @ a) * table[ids[t]][:, None, :]
            x /= x.sum((1, 2), keepdims=True)
            product = np.where(on[:, None, None], x, product)
        head = np.cumsum(blocks) - blocks
        enter, leave = np.full((n, k), 1 / k), np.ones((n, k))
        for j in range(1, int(blocks.max())):
            b = head[blocks > j] + j
            enter[b] = _normal(np.einsum("bi,bij->bj", enter[b - 1], product[b - 1]))
        for j in range(int(blocks.max()) - 1, 0, -1):
            b = head[blocks > j] + j
            leave[b - 1] = _normal(np.einsum("bij,bj->bi", product[b], leave[b]))
        alpha = np.empty((BLOCK, n, k))
        now = enter
        for t in range(BLOCK):
            now = np.where((ids[t] >= 0)[:, None], _normal((now @ a) * table[ids[t]]), now)
            alpha[t] = now
        beta, total = leave, np.zeros((n, k))
        words = np.zeros((len(rows), k)) if each else None
        for t in range(BLOCK - 1, -1, -1):
            on = ids[t] >= 0
            gamma = _normal(alpha[t] * beta)
            total += gamma * on[:, None]
            if each:
                words[(start + t)[on]] = gamma[on]
            beta = np.where(on[:, None], _normal((table[ids[t]] * beta) @ a.T), beta)
        if each:
            return words
        return np.stack([np.bincount(text, weights=total[:, j], minlength=len(lengths)) for j in range(k)], 1)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and mean posterior of each text of a column."""
        if not self.labels:
            return ["und"] * len(column), np.zeros(len(column))
        parts, which, first = distinct_words(column)
        seen, rows = self.__dict__.setdefault("seen", {}), self.__dict__.setdefault("rows", {})
        missing = set(parts).difference(seen)
        if len(seen) + len(missing) > CACHE:
            seen.clear()
            rows.clear()
            missing = set(parts)
        if not rows:
            self.table = np.zeros((0, len(self.labels)))
        for p in missing:
            seen[p] = tuple([rows.setdefault(w, len(rows)) for w in ((p.decode().lower(),) if p.isalpha() else words_of(p.decode("utf-8", "replace")))])
        if len(rows) > len(self.table):
            self.table = np.concatenate([self.table, self.emissions(list(islice(rows, len(self.table), None)))])
        own = [seen[p] for p in parts]
        size = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter((x for r in own for x in r), np.int64, int(size.sum()))
        n = size[which]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(size) - size)[which], n)
        total = np.append(0, np.cumsum(n))
        lengths = total[first[1:]] - total[first[:-1]]
        sums = self.posteriors(flat[place], lengths, self.table)
        best = sums.argmax(1)
        score = np.where(lengths > 0, np.minimum(1.0, sums[np.arange(len(best)), best] / np.maximum(lengths, 1)), 0.0)
        return [self.labels[b] if k else "und" for b, k in zip(best.tolist(), lengths.tolist(), strict=True)], score


def stretches(text: str, seed: int) -> list[str]:
    """SEQUENCES stretches of STRETCH words of a text at most, drawn by seed."""
    w = words_of(text)
    spots = range(0, len(w), STRETCH)
    return [" ".join(w[s : s + STRETCH]) for s in sorted(random.Random(seed).sample(spots, min(SEQUENCES, len(spots))))]


def sequences_of(samples: list[tuple[int, list[str], int]], seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Training sequences from (id, stretches, label): plain stretches, and code-switched ones of two or three languages."""
    rng = random.Random(seed)
    pool = [(x.split(" "), y) for _, own, y in sorted(samples) for x in own]
    out = [(w, [y] * len(w)) for w, y in pool]
    for _ in range(len(pool) // 3):
        own, labels = [], []
        for w, y in rng.sample(pool, min(len(pool), rng.choice((2, 3)))):
            s = rng.randrange(len(w))
            w = w[s : s + rng.randrange(4, 13)]
            own += w
            labels += [y] * len(w)
        out.append((own, labels))
    return out


def fit(docs: DataFrame) -> CRF:
    """The model, from rows whose crc32(id) mod 4 is not 2 and whose lang is not null. The driver gets stretches of DOCS_PER_LANG texts a language."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != 2))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = CRF(sorted(counts))
    if not counts:
        return model
    asked = docs.sparkSession.createDataFrame(pa.table({"lang_": pa.array(model.labels, pa.string()), "y": pa.array(range(len(model.labels)), pa.int32()), "part": pa.array([min(1.0, (2 * DOCS_PER_LANG + 50) / counts[x]) for x in model.labels], pa.float64())}))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32)
    near = rows.join(F.broadcast(asked), rows.lang == asked.lang_).select("doc_id", "y", share.alias("share"), "part").where("share < part")  # about twice as many as needed, so that no language is sorted as a whole
    some = near.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("share", "doc_id"))).where(F.col("k") <= DOCS_PER_LANG).select("doc_id", "y")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).join(F.broadcast(some), "doc_id")

    def cut(batches):
        for batch in slices(batches, "t"):
            parts = [stretches(t, i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(parts, pa.list_(pa.string()))], names=["doc_id", "y", "parts"])

    cuts = chosen.select("doc_id", "t", "y").mapInArrow(cut, "doc_id long, y int, parts array<string>")
    model.train(sequences_of([(r.doc_id, list(r.parts), r.y) for r in cuts.groupBy("doc_id").agg(F.min("parts").alias("parts"), F.min("y").alias("y")).collect()]))
    return model


def identify(docs: DataFrame, model: CRF) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; no shuffle."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), crc_mod("doc_id", 4).eqNullSafe(F.lit(2)).alias("held_out"), F.col("text").cast("string").alias("t"))

    def run(batches):
        for batch in slices(batches, "t", SLICE):
            lang, score = shared.value.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_column(spark, model: CRF):
    """The language of a text column."""
    scored = scored_language_column(spark, model)
    return lambda text: scored(text)["lang"]


def scored_language_column(spark, model: CRF):
    """Language and score (a struct) as an Arrow UDF of a text column, for filters that keep all other columns in the JVM."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def language(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([pc.fill_null(text, "")], names=["t"])
        got = [shared.value.predict(part.column(0)) for part in slices(iter([batch]), "t", SLICE)]
        return pa.StructArray.from_arrays([pa.array([x for g in got for x in g[0]], pa.string()), pa.array(np.concatenate([g[1] for g in got]) if got else [], pa.float64())], names=["lang", "score"])

    return language
