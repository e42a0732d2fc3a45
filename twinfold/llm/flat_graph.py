"""Near-duplicate vectors over a robust-pruned flat graph (operator 4).

1. Identical vectors collapse to one with a count.
2. Centroids (k-means on at most SAMPLE vectors) cut the space into shards; every vector
   is in its OVERLAP nearest shards. A shard of more than CHUNK vectors is dealt into chunks, and every
   chunk is searched for the queries of every chunk, so no task holds more than CHUNK
   vectors to search and CHUNK queries.
3. Each chunk builds a graph: nearest candidates and some random ones, pruned by the robust
   rule (a candidate goes if a chosen neighbour is ALPHA times closer to it). A vector's
   lists from all its shards are united.
4. Queries walk greedily from the chunk's medoid with a beam of BEAM, then expand through all
   neighbours in range (range search), so a dense group is found whole.
5. Every link is verified in double precision, and counted in the smallest shard that both
   vectors share, so overlap counts nothing twice. Tasks return counts and a spanning
   forest, never pairs.

audit() measures recall against brute force for a set of queries over all vectors, in blocks.

* Cases: null, empty or zero vectors, and those with null or non-finite components, link with nothing; vectors of different
  lengths don't link with each other; lengths with SMALL distinct vectors at most need no graph; identical rows link with each other; repeated
  vec_ids count as rows; ties need no order as all links in range count; very long vectors are compared whole; null ids are rows
  without links of their own; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, local_roots, written

SAMPLE, PER_SHARD, MOST_SHARDS, OVERLAP, CHUNK = 20_000, 500, 4096, 3, 3000
#: Distinct vectors of a length up to which all are compared, in one task a length.
SMALL = 300
DEGREE, CANDIDATES, RANDOM, ALPHA, BEAM = 24, 40, 12, 1.2, 24


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Unit centroids by spherical k-means from a random start."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-30), c)
    return c


def build(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Adjacency (rows of at most 2 * DEGREE members, padded with -1) of a robust-pruned graph over unit vectors."""
    n = len(x)
    if n < 2:
        return np.full((n, 1), -1, np.int32)
    s = (x @ x.T).astype(np.float32)
    np.fill_diagonal(s, -2)
    c = min(CANDIDATES, n - 1)
    near = np.argpartition(-s, c - 1, axis=1)[:, :c]
    rng = np.random.default_rng(seed)
    cand = np.concatenate([near, rng.integers(0, n, (n, min(RANDOM, n)))], axis=1)
    rows = np.arange(n)[:, None]
    sims = s[rows, cand]
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    alive = cand != rows
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    chosen, taken = np.zeros_like(alive), np.zeros(n, np.int64)
    for t in range(cand.shape[1]):
        pick = alive[:, t] & (taken < DEGREE)
        chosen[:, t] = pick
        taken += pick
        if t + 1 < cand.shape[1]:
            between = s[cand[:, t][:, None], cand[:, t + 1 :]]
            kill = ALPHA * ALPHA * (1 - between) <= 1 - sims[:, t + 1 :]
            alive[:, t + 1 :] &= ~(kill & pick[:, None])
    src = np.repeat(np.arange(n), chosen.sum(1))
    dst = cand[chosen]
    weight = sims[chosen]
    a, b, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([weight, weight])
    order = np.lexsort((b, -w, a))
    a, b = a[order], b[order]
    first = np.searchsorted(a, np.arange(n))
    place = np.arange(len(a)) - first[a]
    keep = place < 2 * DEGREE
    out = np.full((n, 2 * DEGREE), -1, np.int32)
    out[a[keep], place[keep]] = b[keep]
    return out


def range_search(x: np.ndarray, adjacency: np.ndarray, q: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) with cosine >= least that a greedy walk from the medoid and its expansion in range find."""
    n, nq = len(x), len(q)
    start = int((x @ x.mean(0)).argmax())
    x32, q32, near = x.astype(np.float32), q.astype(np.float32), least - 1e-4
    seen = np.zeros((nq, n), bool)
    ids, sims = np.full((nq, beam), -1, np.int32), np.full((nq, beam), -9, np.float32)
    done = np.ones((nq, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0], seen[:, start] = start, q32 @ x32[start], False, True
    hits = [np.stack([np.flatnonzero(sims[:, 0] >= near), np.full(int((sims[:, 0] >= near).sum()), start)], 1)]
    while True:
        best = np.where(done, -9, sims).argmax(1)
        live = np.flatnonzero(~done[np.arange(nq), best])
        if not len(live):
            break
        node = ids[live, best[live]]
        done[live, best[live]] = True
        to = adjacency[node]
        new = (to >= 0) & ~seen[live[:, None], to]
        s = np.einsum("qrd,qd->qr", x32[to], q32[live])
        s[~new] = -9
        r, c = np.nonzero(new)
        seen[live[r], to[r, c]] = True
        r, c = np.nonzero(s >= near)
        hits.append(np.stack([live[r], to[r, c]], 1))
        all_s = np.concatenate([sims[live], s], 1)
        all_i = np.concatenate([ids[live], to], 1)
        all_d = np.concatenate([done[live], s <= -9], 1)
        keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[live], ids[live], done[live] = (np.take_along_axis(v, keep, 1) for v in (all_s, all_i, all_d))
    pairs = np.unique(np.concatenate(hits), axis=0)
    found, front = [pairs], pairs
    while len(front):
        fresh = []
        for k in range(0, len(front), 50_000):
            part = front[k : k + 50_000]
            to = adjacency[part[:, 1]]
            qq = np.repeat(part[:, 0], to.shape[1])
            to = to.ravel()
            ok = to >= 0
            ok[ok] = ~seen[qq[ok], to[ok]]
            code = np.unique(qq[ok].astype(np.int64) * n + to[ok])
            qq, to = code // n, code % n
            seen[qq, to] = True
            s = np.einsum("ij,ij->i", x32[to], q32[qq])
            fresh.append(np.stack([qq, to], 1)[s >= near])
        front = np.concatenate(fresh)
        found.append(front)
    pairs = np.concatenate(found).astype(np.int64)
    exact = np.concatenate([np.einsum("ij,ij->i", q[pairs[k : k + 100_000, 0]], x[pairs[k : k + 100_000, 1]]) for k in range(0, len(pairs), 100_000)] or [np.zeros(0)])
    pairs = pairs[exact >= least]
    return pairs[:, 0], pairs[:, 1]


def _unit(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles, or null where the vector can't link)."""
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, F.transform(v, lambda x: F.when(x == 0, 0.0).otherwise(x))).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. Vectors are compared with those of their length; the driver sees the lengths and their counts."""
    rows, _ = written(_unit(vectors, id_col, vector_col))
    reps, _ = written(rows.where("v is not null and vec_id is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    lengths = {r.d: r.n for r in reps.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    large = sorted(d for d, n in lengths.items() if n > SMALL)
    parts = [_graph_links(reps.where(F.size("v") == d), d, lengths[d], least) for d in large]
    if len(large) < len(lengths):
        parts.append(_small_links(reps.where(~F.size("v").isin(large)) if large else reps, least))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for other in parts[1:]:
        found = found.unionByName(other)
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(found.where("a <> b").select("a", "b"))
    state = reps.select("rep", "n").join(links, F.col("rep") == links.a, "left").join(joined, F.col("rep") == joined.node, "left")
    state = state.select(F.col("rep").alias("r"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    copies = reps.where("n > 1").select(F.col("v").alias("w"), "rep")
    owner = rows.join(copies, (rows.v == copies.w) & rows.vec_id.isNotNull(), "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"))
    out = owner.join(state, owner.rep == state.r, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _small_links(reps: DataFrame, least: float) -> DataFrame:
    """a, b, links of vectors of rare lengths, of each of which there are SMALL at most: all are compared."""

    def compare(table: pa.Table) -> pa.Table:
        ids, n, x = table.column("rep").to_numpy(), table.column("n").to_numpy(), _matrix(table.column("v"))
        hit = x @ x.T >= least
        np.fill_diagonal(hit, False)
        i, j = np.nonzero(hit)
        a, b = local_roots(ids[i], ids[j]) if len(i) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table({"a": pa.array(np.concatenate([a, ids])), "b": pa.array(np.concatenate([b, ids])), "links": pa.array(np.concatenate([np.zeros(len(a), np.int64), hit @ n]))})

    found = reps.withColumn("d", F.size("v")).groupBy("d").applyInArrow(lambda key, table: compare(table), "a long, b long, links long")
    return written(found)[0]


def _graph_links(reps: DataFrame, dims: int, total: int, least: float) -> DataFrame:
    """a, b, links (of a) of distinct vectors of one length, by the graph."""
    spark = reps.sparkSession
    sample = reps.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(max(1, min(SAMPLE, 4_000_000 // dims)))
    centroids = kmeans(_matrix(sample.toArrow().column("v")), max(1, min(MOST_SHARDS, total // PER_SHARD)))
    overlap = min(OVERLAP, len(centroids))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column(0))
            s = x @ shared.value.T
            own = np.sort(np.argpartition(-s, overlap - 1, axis=1)[:, :overlap], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(own.ravel()), overlap).cast(pa.list_(pa.int32()))], names=["rep", "n", "v", "shards"])

    homes, _ = written(reps.select("v", "rep", "n").mapInArrow(assign, "rep long, n long, v array<double>, shards array<int>"))
    dealt = homes.select("rep", "n", "v", "shards", F.explode("shards").alias("shard"))
    parts = {r.shard: -(-r.n // CHUNK) for r in dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK).collect()}  # of MOST_SHARDS at most
    cuts = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]) if parts else None
    count = F.coalesce(cuts[F.col("shard")], F.lit(1)) if parts else F.lit(1)
    dealt = dealt.withColumn("parts", count).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))

    def graph(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        adjacency = build(_matrix(table.column("v")))
        keep = adjacency >= 0
        offsets = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
        return pa.table({"node": pa.array(ids), "near": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[adjacency[keep]]))})

    lists = dealt.select("shard", "own", "rep", "v").groupBy("shard", "own").applyInArrow(graph, "node long, near array<long>")
    union = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    members = dealt.join(union, dealt.rep == union.node).drop("node")
    if parts:
        both = members.where("parts = 1").select("shard", F.col("own").alias("i"), F.col("own").alias("j"), F.lit(3).alias("role"), "rep", "n", "v", "shards", "near")
        many = members.where("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        many = many.select("*", F.explode(F.when(F.col("own") == F.col("other"), F.array(F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("role"))
        many = many.select("shard", F.when(F.col("role") == 2, F.col("other")).otherwise(F.col("own")).cast("int").alias("i"), F.when(F.col("role") == 1, F.col("other")).otherwise(F.col("own")).cast("int").alias("j"), "role", "rep", "n", "v", "shards", F.when(F.col("role") != 2, F.col("near")).otherwise(F.array().cast("array<long>")).alias("near"))
        units = both.unionByName(many)
    else:
        units = members.select("shard", F.col("own").alias("i"), F.col("own").alias("j"), F.lit(3).alias("role"), "rep", "n", "v", "shards", "near")

    def search(table: pa.Table) -> pa.Table:
        role, shard = table.column("role").to_numpy(), table.column("shard")[0].as_py()
        ids, n, v = table.column("rep").to_numpy(), table.column("n").to_numpy(), _matrix(table.column("v"))
        homes_ = table.column("shards").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        m, k = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        if not len(m) or not len(k):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        m = m[np.argsort(ids[m])]
        near = table.column("near").take(pa.array(m)).combine_chunks()
        size = np.diff(near.offsets.to_numpy())
        at, own = near.flatten().to_numpy(), np.repeat(np.arange(len(m)), size)
        place = np.minimum(np.searchsorted(ids[m], at), len(m) - 1)
        inside = ids[m][place] == at
        own, place = own[inside], place[inside]
        first = np.searchsorted(own, np.arange(len(m)))
        adjacency = np.full((len(m), max(1, int(np.bincount(own, minlength=1).max()) if len(own) else 1)), -1, np.int32)
        adjacency[own, np.arange(len(own)) - first[own]] = place
        qs, ms = range_search(v[m], adjacency, v[k], least)
        qs, ms = k[qs], m[ms]
        other = ids[qs] != ids[ms]
        qs, ms = qs[other], ms[other]
        common = np.full(len(qs), np.iinfo(np.int32).max, np.int64)
        for t in range(homes_.shape[1]):  # the smallest shard of both
            mine = homes_[qs, t]
            hit = (homes_[ms] == mine[:, None]).any(1)
            common = np.where(hit, np.minimum(common, mine), common)
        mine = common == shard
        links = np.bincount(qs[mine], weights=n[ms[mine]], minlength=len(ids)).astype(np.int64)
        a, b = local_roots(ids[qs], ids[ms]) if len(qs) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table({"a": pa.array(np.concatenate([a, ids[k]])), "b": pa.array(np.concatenate([b, ids[k]])), "links": pa.array(np.concatenate([np.zeros(len(a), np.int64), links[k]]))})

    return written(units.groupBy("shard", "i", "j").applyInArrow(search, "a long, b long, links long"))[0]


def audit(vectors: DataFrame, result: DataFrame, every: int = 20, least: float = 0.95, most: int = 2000, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Recall of result's n_links for queries of the commonest length whose id is divisible by every (the most smallest ids), each compared with all rows in blocks."""
    rows = _unit(vectors, id_col, vector_col).where("v is not null")
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    rows = rows.where(F.size("v") == F.lit(common.d if common else 0))
    asked = rows.where(F.col("vec_id") % every == 0).orderBy("vec_id").limit(most).toArrow()
    if not asked.num_rows:
        return 1.0
    ids, q = asked.column("vec_id").to_numpy(), _matrix(asked.column("v"))

    def compare(batches):
        for batch in batches:
            hit = (q @ _matrix(batch.column(1)).T >= least).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit.astype(np.int64))], names=["q", "n"])

    truth = rows.mapInArrow(compare, "q long, n long").groupBy("q").agg((F.sum("n") - 1).alias("n"))
    both = truth.join(result, truth.q == result.vec_id).agg(F.sum(F.least("n", "n_links")).alias("got"), F.sum("n").alias("all")).first()
    return both.got / both["all"] if both["all"] else 1.0
