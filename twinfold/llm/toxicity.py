"""Toxicity by nearest labelled examples (operator 9).

Examples: a bounded, documented sample of the labelled rows (at most MOST_TOXIC rows of
label 1 and MOST_CLEAN of label 0, those whose hashed id is smallest); all of them are in the index, with all their
words. Space: a word's weight is (1 + log tf) * (1 + log(n / df)) * (1 + chi2), chi2 being how far the
word's share of label 1 among the examples is from chance. Plain TF-IDF does not give right results: among
texts of hundreds of words accidental rare words decide who is near (held-out accuracy 0.91 at best, on check_s);
so weighted, the same search is right on 0.998. Search: exact top-k by cosine over a block-max inverted index; the postings of a
block of examples are read only if its bound (query weights times the block's largest weight of
each word) can still beat the k-th best. Votes are weighted by similarity and calibrated by
logistic regression on leave-one-out votes, with class weights of the whole label table.

* Cases: null text counts as empty; a text without any known word gets the share of
  label 1 among the labelled rows; ties in similarity go to the smaller example id;
  repeated label rows of one id count once (label 1 wins), repeated rows of documents are scored each; with no labels of either class
  every score is the share of the class there is (0 with no labels at all); an empty table gives no rows; null ids
  are scored but not learnt from; other columns, whatever their names, are not read.
* Every whole text, however long, is scored in one pass; no shuffle.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, crc_mod, distinct_words, give_back, slices

MOST_TOXIC, MOST_CLEAN = 2000, 4000
#: Nearest examples that vote, examples of a block, blocks that are read first, and entries of a worker's cache of words.
NEIGHBOURS, BLOCK, FIRST, CACHE = 16, 64, 16, 250_000
#: Bytes of text that are counted or scored at a time.
SLICE = 1 << 19
#: Terms that more than one in DENSE of the examples have are dense columns of the index.
DENSE = 24
_WORD = re.compile(r"[^\W\d_]+")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, size numbers (at least one) each."""
    if not len(start):
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    step = np.ones(int(ends[-1]), np.int64)
    step[0] = start[0]
    step[ends[:-1]] = start[1:] - start[:-1] - size[:-1] + 1
    return np.cumsum(step)


class BlockMaxIndex:
    """Cosine top-k over rows of (term, weight) in blocks of BLOCK rows; rows with the same heaviest term are neighbours in the blocks. Terms that more than one in DENSE of the rows have are kept as dense columns, all others as postings by block."""

    def __init__(self, rows: list[dict[int, float]], n_terms: int):
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        term = np.fromiter((t for r in rows for t in r), np.int64, int(size.sum()))
        weight = np.fromiter((w for r in rows for w in r.values()), np.float64, int(size.sum()))
        self.build(np.repeat(np.arange(len(rows)), size), term, weight, len(rows), n_terms)

    @classmethod
    def of(cls, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int) -> BlockMaxIndex:
        out = cls.__new__(cls)
        out.build(row, term, weight, n, n_terms)
        return out

    def build(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int) -> None:
        self.n, self.n_blocks, self.read = n, max(1, -(-n // BLOCK)), 0
        norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=n))
        weight = weight / np.maximum(norm, 1e-300)[row]
        own, first = np.unique(row, return_index=True)  # rows come in order
        top = np.zeros(n)
        top[own] = np.maximum.reduceat(weight, first) if len(first) else 0.0
        at = np.flatnonzero(weight == top[row])[::-1]
        heaviest = np.full(n, n_terms)
        heaviest[row[at]] = term[at]
        self.row_of = np.argsort(heaviest, kind="stable")  # by place in the blocks
        place = np.empty(n, np.int64)
        place[self.row_of] = np.arange(n)
        df = np.bincount(term, minlength=n_terms)
        frequent = np.flatnonzero(df > max(n / DENSE, BLOCK))  # at most DENSE times the terms that a row has
        self.column = np.full(n_terms, -1)
        self.column[frequent] = np.arange(len(frequent))
        there = self.column[term] >= 0
        self.fill(self.column[term[there]], place[row[there]], weight[there])
        row, term, weight = row[~there], term[~there], weight[~there]
        order = np.lexsort((place[row], term))
        term, self.places, self.weights = term[order], place[row][order], weight[order]
        block = self.places // BLOCK
        new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))[: len(term)])
        self.posting = np.append(new, len(term)).astype(np.int32)  # first posting of each entry (a term in a block)
        self.block, self.most = block[new].astype(np.int32), np.maximum.reduceat(self.weights, new) if len(new) else np.zeros(0)
        self.entry = np.searchsorted(term[new], np.arange(n_terms + 1))
        self.places = self.places.astype(np.int32)

    def fill(self, column: np.ndarray, place: np.ndarray, weight: np.ndarray) -> None:
        self.dense = np.zeros((int((self.column >= 0).sum()), self.n_blocks * BLOCK))
        self.dense[column, place] = weight

    def __getstate__(self) -> dict:
        """The dense columns as their cells, which the reader fills in again."""
        column, place = np.nonzero(self.dense)
        return self.__dict__ | {"dense": (column.astype(np.int32), place.astype(np.int32), self.dense[column, place])}

    def __setstate__(self, state: dict) -> None:
        cells = state.pop("dense")
        self.__dict__.update(state)
        self.fill(*cells)

    def frequent_part(self, text: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """Of n queries (text, terms, weights): what the terms of the dense columns add to the cosine with every place."""
        there = self.column[terms] >= 0
        q = np.zeros((n, len(self.dense)))
        q[text[there], self.column[terms[there]]] = weights[there]
        return q @ self.dense

    @staticmethod
    def unit(row: dict[int, float]) -> dict[int, float]:
        norm = math.sqrt(sum(w * w for w in row.values()))
        return {t: w / norm for t, w in sorted(row.items())} if norm else {}

    def top(self, query: dict[int, float], k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest with a cosine above 0, best first, ties by row. leave: a row that doesn't count."""
        query = self.unit(query)
        return self.nearest(np.fromiter(query, np.int64, len(query)), np.fromiter(query.values(), np.float64, len(query)), k, leave)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1, dense: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As top(), for the terms and weights of a unit query; dense: its frequent_part(), if known.

        Blocks are read in the order of their bounds (the best dense part of the block's rows and, for all other terms, the query's weight times
        the block's largest), at first FIRST of them and twice as many each time, until the bounds of all others are below the k-th best (at the
        outset, the k-th best dense part).
        """
        if dense is None:
            dense = self.frequent_part(np.zeros(len(terms), np.int64), terms, weights, 1)[0]
        rows = dense.reshape(-1, BLOCK)
        sure = np.partition(dense, len(dense) - k)[len(dense) - k] if len(dense) > k else 0.0  # weights are positive, so the k-th best has this at least
        size = self.entry[terms + 1] - self.entry[terms]
        some = size > 0
        entry, weight = _ranges(self.entry[terms[some]], size[some]), np.repeat(weights[some], size[some])
        block = self.block[entry]
        bounds = np.bincount(block, weights=weight * self.most[entry], minlength=self.n_blocks) + rows.max(1)
        order = np.argsort(-bounds, kind="stable")
        end = int(np.searchsorted(-bounds[order], 0.0))  # blocks that share a term with the query
        found, best, done, step = np.zeros(0, np.int64), np.zeros(0), 0, FIRST
        while done < end:
            least = max(sure if leave < 0 else 0.0, best[-1] if len(best) == k else 0.0) - 1e-9
            stop = min(done + step, end, done + int(np.searchsorted(-bounds[order[done:end]], -least, "right")))
            if stop == done:
                break
            own = order[done:stop]
            chosen = np.zeros(self.n_blocks, bool)
            chosen[own] = True
            inside = chosen[block]
            e = entry[inside]
            n = self.posting[e + 1] - self.posting[e]
            at = _ranges(self.posting[e], n)
            self.read += len(at)
            scores = np.bincount(self.places[at], weights=np.repeat(weight[inside], n) * self.weights[at], minlength=len(dense)).reshape(-1, BLOCK)[own] + rows[own]
            block_, place = np.nonzero(scores >= max(least, 1e-300))
            row, scores = self.row_of[own[block_] * BLOCK + place], scores[block_, place]
            if leave >= 0:
                row, scores = row[row != leave], scores[row != leave]
            found, best = np.concatenate([found, row]), np.concatenate([best, scores])
            if len(best) > 2 * k:
                some = best >= np.partition(best, len(best) - k)[len(best) - k] - 1e-11
                found, best = found[some], best[some]
            keep = np.lexsort((found, -np.round(best, 12)))[:k]
            found, best, done, step = found[keep], best[keep], stop, step * 2
        return found, best


class ToxicityModel:
    """Terms, weights, index and calibration. examples: doc_id, y, words, counts of distinct ids; share: of label 1 among all labelled rows that may be learnt from."""

    def __init__(self, examples: pa.Table | None, share: float):
        self.share, self.index, self.seen = share, None, {}
        self.terms: dict[str, int] = {}
        if examples is None:
            return
        examples = examples.sort_by("doc_id").combine_chunks()
        label, n = examples.column("y").to_numpy().astype(np.float64), examples.num_rows
        pos = float(label.sum())
        if not 0 < pos < n:
            return
        size = pc.list_value_length(examples.column("words")).to_numpy().astype(np.int64)
        coded = pc.list_flatten(examples.column("words")).combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        self.terms = {w: i for i, w in enumerate(coded.dictionary.to_pylist())}
        row, term = np.repeat(np.arange(n, dtype=np.int32), size), coded.indices.to_numpy()
        del coded
        count = pc.list_flatten(examples.column("counts")).to_numpy().astype(np.float64)
        df, toxic = np.bincount(term, minlength=len(self.terms)), np.bincount(term, weights=label[row], minlength=len(self.terms))
        expect = df * pos / n
        chi = (toxic - expect) ** 2 * n / (expect * (n - pos)) * n / np.maximum(n - df, 1)
        self.scale = (1 + np.log(n / df)) * (1 + chi)
        weight = (1 + np.log(count)) * self.scale[term]
        self.weight, self.label = np.where(label == 1, share / pos, (1 - share) / (n - pos)), label
        self.ids = examples.column("doc_id").to_pylist()
        self.index = BlockMaxIndex.of(row, term, weight, n, len(self.terms))
        ends, own = np.append(0, np.cumsum(size)), []
        for i in range(n):  # as if each one were no example: words that only it has are unknown then
            t, w = term[ends[i] : ends[i + 1]], weight[ends[i] : ends[i + 1]]
            own.append(self.features(t[df[t] > 1], w[df[t] > 1], leave=i)[0])
        self.coef = self.logistic(np.array(own), self.label, self.weight)

    def features(self, terms: np.ndarray, weights: np.ndarray, leave: int = -1, dense: np.ndarray | None = None) -> tuple[list[float], np.ndarray, np.ndarray]:
        """What the calibration sees of a text (1, vote, best cosine, mass of its terms), with the nearest examples and their cosines."""
        norm = math.sqrt(float(weights @ weights))
        ids, sims = self.index.nearest(terms, weights / norm, NEIGHBOURS, leave, dense) if norm else (np.zeros(0, np.int64), np.zeros(0))
        w = sims * sims * self.weight[ids]
        vote = float((w * self.label[ids]).sum() / w.sum()) if len(ids) and w.sum() > 0 else self.share
        return [1.0, vote, float(sims[0]) if len(sims) else 0.0, math.log1p(norm)], ids, sims

    @staticmethod
    def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Ridge logistic regression by Newton steps."""
        w = weight / weight.sum() * len(y)
        beta = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = (x * (w * p * (1 - p))[:, None]).T @ x + np.eye(len(beta)) * 1e-2
            step = np.linalg.solve(h, x.T @ (w * (y - p)) - 1e-2 * beta)
            beta = beta + np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break
        return beta

    def score(self, column: pa.Array) -> list[tuple[float, list[int], list[float]]]:
        """Score of each text of a column, with the evidence: nearest examples and their cosines."""
        if self.index is None:
            return [(self.share, [], [])] * len(column)
        parts, which, first = distinct_words(column)
        seen, terms = self.seen, self.terms
        missing = set(parts).difference(seen)
        if len(seen) + len(missing) > CACHE:
            seen.clear()
            missing = set(parts)
        if not seen:
            self.first, self.flat = array("q", [0]), array("q")
        for p in missing:
            own = (p.decode().lower(),) if p.isalpha() else _WORD.findall(p.decode("utf-8", "replace").lower())
            seen[p] = len(seen)
            self.flat.extend([terms[w] for w in own if w in terms])
            self.first.append(len(self.flat))
        known, flat = np.array(self.first), np.array(self.flat)
        part = np.fromiter(map(seen.__getitem__, parts), np.int64, len(parts))[which]
        n = known[part + 1] - known[part]
        some = n > 0
        term = flat[_ranges(known[part[some]], n[some])]
        text = np.repeat(np.searchsorted(first, np.arange(len(which)), "right") - 1, n)
        code, count = np.unique(text * len(terms) + term, return_counts=True)
        text, term = code // len(terms), code % len(terms)
        weight = (1 + np.log(count)) * self.scale[term]
        norm = np.sqrt(np.bincount(text, weights=weight * weight, minlength=len(column)))
        ends, out = np.searchsorted(text, np.arange(len(column) + 1)).tolist(), []
        for k in range(0, len(column), 128):
            n = min(128, len(column) - k)
            own = slice(ends[k], ends[k + n])
            dense = self.index.frequent_part(text[own] - k, term[own], weight[own] / norm[text[own]], n)
            for i in range(k, k + n):
                a, b = ends[i], ends[i + 1]
                if a == b:
                    out.append((self.share, [], []))
                    continue
                x, ids, sims = self.features(term[a:b], weight[a:b], dense=dense[i - k])
                z = float(np.dot(x, self.coef))
                out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), [self.ids[j] for j in ids], sims.tolist()))
        return out


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model, from rows whose crc32(id) mod 5 is not 0. The driver gets the word counts of MOST_TOXIC + MOST_CLEAN texts at most."""
    bound_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y")).where(crc_mod("doc_id", 5) != 0)
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(totals.values())
    if not n:
        return ToxicityModel(None, 0.0)
    some = None
    for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        some = part if some is None else some.unionByName(part)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).join(F.broadcast(some), "doc_id")

    def count(batches):
        for batch in slices(batches, "t", SLICE):
            own = [sorted(Counter(_WORD.findall(t.lower())).items()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([[w for w, _ in c] for c in own], pa.list_(pa.string())), pa.array([[k for _, k in c] for c in own], pa.list_(pa.int32()))], names=["doc_id", "y", "words", "counts"])

    counted = chosen.select("doc_id", "t", "y").mapInArrow(count, "doc_id long, y int, words array<string>, counts array<int>")
    one = counted.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct("words", "counts")).alias("c")).select("doc_id", "y", "c.words", "c.counts").toArrow()
    model = ToxicityModel(one, sum(c for y, c in totals.items() if y == 1) / n)
    give_back()
    return model


def score(docs: DataFrame, model: ToxicityModel, evidence: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted (and the nearest examples with their cosines, if asked) of every row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), crc_mod("doc_id", 5).eqNullSafe(F.lit(0)).alias("held_out"), F.col("text").cast("string").alias("t"))

    def run(batches):
        for batch in slices(batches, "t", SLICE):
            got = shared.value.score(batch.column(2))
            p = np.array([g[0] for g in got])
            cols = [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            if evidence:
                cols += [pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted", *(["nearest", "cosine"] if evidence else [])])

    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + ", nearest array<long>, cosine array<double>" * evidence)


def score_column(spark, model: ToxicityModel):
    """The score as an Arrow UDF of a text column, for filters that keep all other columns in the JVM."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([pc.fill_null(text, "")], names=["t"])
        return pa.array([s[0] for part in slices(iter([batch]), "t", SLICE) for s in shared.value.score(part.column(0))], pa.float64())

    return scored
