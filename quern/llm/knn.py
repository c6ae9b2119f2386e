"""Nearest neighbours of every vector, by robust-pruned directed graphs.

The collection is routed into shards by a tree of spherical k-means centroids. The first
level is fitted on a bounded sample of all vectors; a cell that holds too many for a shard is
split by centroids of a bounded sample of its own, and so on, so that the number of shards grows with the
collection and no shard does. Every vector is indexed in the cell of its nearest
centroid and in those of the next centroids whose similarity is within
``closure`` of the best, so that neighbours on either side of a cell's border
share a shard. Each shard builds a directed graph: points are inserted in
batches, a greedy beam search over the graph so far proposes neighbours, robust
pruning with the relaxation ``alpha`` keeps a diverse subset of them, and reverse
edges are added, at most three times the degree to a point from one batch, and
pruned alike. Each point is inserted once; there is no second pass over the
points. The queries are then answered by beam search in each of their shards,
and the lists are merged.

Copies of a vector are indexed once and expanded afterwards, so a vector that a
third of all rows hold costs no more than any other. A cell that no centroids
split, of vectors that hardly differ, is cut by a hash of the id into sub-shards that each of the cell's queries
visits, so no vector is left out and no task gets an unbounded group; the graph of such a sub-shard
is built once and searched by blocks of queries.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import _base

#: Vectors in a shard's graph; a cell beyond twice this is split.
SHARD = 6000
#: Most vectors that the centroids of the first level are fitted on, and most of those.
SAMPLE, CENTROIDS = 40_000, 4000
#: The same for each cell that is split, vectors of one that a task routes, and levels below the first: 3.8e12 vectors fit the tree.
CELL_SAMPLE, CELL_CENTROIDS, CHUNK, LEVELS = 16_000, 400, 50_000, 2
#: Cells for a shard's worth of vectors, as a vector may stand in several.
SHARE = 1.8
#: Most large cells whose numbers are sent to the vectors; more are joined.
SEND = 100_000


def prune(X: np.ndarray, at: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of ``cand`` (rows of ids, -1 for none) for the points ``at``.

    Candidates are taken from the most similar on; each taken one removes those
    whose distance to it, times ``alpha``, is at most their distance to the point.
    Returns ``degree`` ids a row, -1 where fewer are left.
    """
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    V = X[np.maximum(cand, 0)]
    apart = 1.0 - np.matmul(V, V.transpose(0, 2, 1))
    near = (1.0 - sims)[:, None, :]
    shadow = alpha * apart <= near  # [i, j]: once i is kept, j goes
    live = (cand >= 0) & (cand != at[:, None])
    out = np.full((len(at), degree), -1, np.int32)
    rows = np.arange(len(at))
    for slot in range(degree):
        first = live.argmax(1)
        has = live[rows, first]
        if not has.any():
            break
        out[has, slot] = cand[rows[has], first[has]]
        live &= ~shadow[rows, first] | ~has[:, None]
        live[rows, first] = False
    return out


def beam(X: np.ndarray, G: np.ndarray, Q: np.ndarray, start: np.ndarray, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of the graph ``G`` for each row of ``Q`` from its ``start`` ids.

    Returns the ``width`` best ids of each row and their similarities, best first.
    """
    b, n = len(Q), len(X)
    stamp = np.zeros((b, n), np.int16)
    ids = np.full((b, width), -1, np.int32)
    sims = np.full((b, width), -np.inf, np.float32)
    done = np.ones((b, width), bool)
    act = np.arange(b)
    new = start
    while True:
        rows = np.broadcast_to(act[:, None], new.shape)
        tag = np.broadcast_to(np.arange(1, new.shape[1] + 1, dtype=np.int16), new.shape)
        safe = np.maximum(new, 0)
        fresh = (new >= 0) & (stamp[rows, safe] == 0)
        r, c = np.nonzero(fresh)
        who, what = act[r], new[r, c]
        stamp[who, what] = tag[r, c]
        only = stamp[who, what] == tag[r, c]
        r, c, who, what = r[only], c[only], who[only], what[only]
        s = np.full(new.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("ij,ij->i", X[what], Q[who])
        all_s = np.concatenate([sims[act], s], 1)
        all_i = np.concatenate([ids[act], new], 1)
        all_d = np.concatenate([done[act], np.zeros(new.shape, bool)], 1)
        top = np.argpartition(-all_s, width - 1, 1)[:, :width]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(all_s, top, 1), 1, kind="stable"), 1)
        now_s = np.take_along_axis(all_s, top, 1)
        now_i = np.take_along_axis(all_i, top, 1)
        now_d = np.take_along_axis(all_d, top, 1) | np.isneginf(now_s)
        # the next to expand: the first ``expand`` that are not done
        rank = np.cumsum(~now_d, 1)
        pick = ~now_d & (rank <= expand)
        some = pick.any(1)
        pos = np.argsort(~pick, 1, kind="stable")[:, :expand]
        node = np.where(np.take_along_axis(pick, pos, 1), np.take_along_axis(now_i, pos, 1), -1)
        sims[act], ids[act], done[act] = now_s, now_i, now_d | pick
        act, node = act[some], node[some]
        if not len(act):
            return ids, sims
        new = np.where((node >= 0)[:, :, None], G[np.maximum(node, 0)], -1).reshape(len(act), -1)


def _reverse(X: np.ndarray, G: np.ndarray, at: np.ndarray, degree: int, alpha: float) -> None:
    """Adds the edges back from the neighbours of ``at``; full lists are pruned."""
    src = np.repeat(at, G.shape[1])
    dst = G[at].ravel()
    ok = dst >= 0
    src, dst = src[ok], dst[ok]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    who, first, count = np.unique(dst, return_index=True, return_counts=True)
    most = int(count.max()) if len(count) else 0
    if not most:
        return
    most = min(most, 3 * degree)
    slot = np.arange(len(dst)) - np.repeat(first, count)
    keep = slot < most
    back = np.full((len(who), most), -1, np.int32)
    back[np.repeat(np.arange(len(who)), count)[keep], slot[keep]] = src[keep]
    dup = (back[:, :, None] == G[who][:, None, :]).any(2)
    back[dup] = -1
    both = np.concatenate([G[who], back], 1)
    have = (both >= 0).sum(1)
    easy = have <= degree
    packed = np.take_along_axis(both, np.argsort(both < 0, 1, kind="stable"), 1)
    G[who[easy]] = packed[easy, :degree]
    hard = np.nonzero(~easy)[0]
    for i in range(0, len(hard), 512):
        h = hard[i : i + 512]
        c = packed[h]
        s = np.einsum("ijk,ik->ij", X[np.maximum(c, 0)], X[who[h]])
        s[c < 0] = -np.inf
        G[who[h]] = prune(X, who[h], c, s, degree, alpha)


def build(X: np.ndarray, degree: int = 16, width: int = 24, alpha: float = 1.2, batch: int = 512, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The graph of the unit vectors ``X`` and its entry points."""
    n = len(X)
    G = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    head = order[: min(n, 256)]
    S = X[head] @ X[head].T
    np.fill_diagonal(S, -np.inf)
    take = min(2 * degree, len(head) - 1)
    if take > 0:
        c = np.argpartition(-S, take - 1, 1)[:, :take]
        G[head] = prune(X, head, head[c], np.take_along_axis(S, c, 1), degree, alpha)
        _reverse(X, G, head, degree, alpha)
    entry = head[: min(8, len(head))]
    at = len(head)
    while at < n:
        own = order[at : at + min(batch, max(at, 64))]
        got, sims = beam(X, G, X[own], np.broadcast_to(entry, (len(own), len(entry))), width)
        # points of one batch do not see each other in the graph: add the batch's own best
        S = X[own] @ X[own].T
        np.fill_diagonal(S, -np.inf)
        m = min(6, len(own) - 1)
        if m > 0:
            c = np.argpartition(-S, m - 1, 1)[:, :m]
            got = np.concatenate([got, own[c]], 1)
            sims = np.concatenate([sims, np.take_along_axis(S, c, 1)], 1)
        G[own] = prune(X, own, got, sims, degree, alpha)
        _reverse(X, G, own, degree, alpha)
        at += len(own)
    return G, entry


def search_all(X: np.ndarray, G: np.ndarray, entry: np.ndarray, Q: np.ndarray, own: np.ndarray, k: int, width: int, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of ``X`` for each query, itself excluded. ``own``: the query's place in ``X`` or -1."""
    ids = np.full((len(Q), k), -1, np.int32)
    for i in range(0, len(Q), batch):
        q, o = Q[i : i + batch], own[i : i + batch]
        start = np.concatenate([np.broadcast_to(entry[:2], (len(q), len(entry[:2]))), o[:, None]], 1)
        got, sims = beam(X, G, q, start, max(width, k + 1))
        got = np.where((got == o[:, None]) & (got >= 0) | np.isneginf(sims), -1, got)
        got = np.take_along_axis(got, np.argsort(got < 0, 1, kind="stable"), 1)
        ids[i : i + batch, : min(k, got.shape[1])] = got[:, :k]
    return ids


def centroids(sample: np.ndarray, count: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Spherical k-means of unit vectors; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    M = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ M.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(M)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        M = np.where(norm > 0, total / np.maximum(norm, 1e-12), M)
    return M.astype(np.float32)


def _unit(X: np.ndarray) -> np.ndarray:
    X = X.astype(np.float64)
    return (X / np.linalg.norm(X, axis=1, keepdims=True)).astype(np.float32)


def neighbours(df: DataFrame, id_col: str, vec_col: str, *, k: int = 5, dim: int = 64, shard: int = SHARD, closure: float = 0.05, routes: int = 3, degree: int = 14, width: int = 20, alpha: float = 1.2) -> DataFrame:
    """The ``k`` nearest others of every vector by cosine: ``id``, ``other``, ``sim`` (double, 12 decimals), ``rank``.

    Null vectors, vectors of another length than ``dim``, with a null or
    non-finite element or of norm zero take no part; rows with a null id neither.
    A repeated id counts once (its smallest vector). Ties go to the smaller id.
    An empty table gives an empty result. Similarities are exact, the choice of
    neighbours is approximate: recall on the test data is stated in the README.
    """
    spark = df.sparkSession
    ok = (
        F.col("id").isNotNull()
        & (F.size("vec") == dim)
        & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & F.exists("vec", lambda x: x != 0)
    )
    rows = _base.unit(df, id=id_col, vec=vec_col).select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<float>").alias("vec")).where(ok)
    # copies of a vector: one representative, and the k + 1 smallest ids, all that anyone can need of them
    keyed = rows.groupBy("id").agg(F.min("vec").alias("vec")).select("id", "vec", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"))
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    ranked = keyed.withColumn("place", place).where(F.col("place") <= k + 1)
    reps = _base.stage(
        ranked.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("copies"), F.max(F.when(F.col("place") == 1, F.col("vec"))).alias("vec")),
        "knn-reps",
    )
    n = reps.count()
    if n == 0:
        return spark.createDataFrame([], "id bigint, other bigint, sim double, rank int")
    cells = min(CENTROIDS, max(1, math.ceil(SHARE * n / shard) if n > shard else 1))
    if cells > 1:
        held = reps.select("vec").orderBy(F.xxhash64("rep")).limit(SAMPLE).toArrow()
        M = centroids(_unit(_base.vectors(held["vec"], dim)), min(cells, max(1, held.num_rows // 8)))
    else:
        M = np.ones((1, dim), np.float32)
    routed = _base.stage(_route(reps.select("rep", "vec"), M, dim, closure, routes), "knn-routed")
    done: list[DataFrame] = []  # the cells that are shards
    for level in range(LEVELS + 1):
        big = _base.stage(routed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard), "knn-big")
        if big.isEmpty():
            done.append(routed)
            break
        done.append(_of_cells(routed, big.select("cell"), "left_anti"))
        if level < LEVELS:
            routed = _base.stage(_split(_of_cells(routed, big), dim, shard, closure / (level + 2), level), "knn-routed")
    placed = reduce(DataFrame.unionByName, done)
    found = placed.groupBy("cell").applyInArrow(_shard_search(k, dim, degree, width, alpha), _FOUND)
    if not big.isEmpty():
        found = found.unionByName(_by_hash(_of_cells(routed, big), k, dim, shard, degree, width, alpha))
    # merge the shards' lists: the same neighbour may come from several
    best = found.groupBy("rep", "near").agg(F.max("sim").alias("sim"))
    top = best.withColumn("p", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("sim"), "near"))).where(F.col("p") <= k + 1).drop("p")
    copies = reps.select("rep", "copies")
    others = top.join(copies.select(F.col("rep").alias("near"), "copies"), "near").select("rep", F.explode("copies").alias("other"), "sim")
    twins = copies.where(F.size("copies") > 1).select("rep", F.explode("copies").alias("other"), F.lit(1.0).alias("sim"))
    offered = others.unionByName(twins).groupBy("rep").agg(F.collect_list(F.struct("sim", "other")).alias("offer"))  # at most (k + 1) ** 2 + k + 1 entries
    # a vector that a third of all rows hold is answered in parts
    member = _base.spread_join(keyed.select("id", "h1", "h2"), reps.select("h1", "h2", "rep"), ["h1", "h2"], ["id"])
    mine = _base.spread_join(member, offered, ["rep"], ["id"]).select("id", F.explode("offer").alias("o")).where(F.col("o.other") != F.col("id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("o.sim"), "o.other"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("id", F.col("o.other").alias("other"), F.col("o.sim").alias("sim"), "rank")


def _of_cells(rows: DataFrame, cells: DataFrame, how: str = "inner") -> DataFrame:
    """Vectors joined to some cells: a bounded number of these is sent to the vectors, so that no vector moves."""
    if cells.limit(SEND + 1).count() <= SEND:
        return rows.join(F.broadcast(cells), "cell", how)
    return _base.spread_join(rows, cells, ["cell"], ["rep"], how)


_FOUND = "rep bigint, near bigint, sim double"


def _nearest_cells(X: np.ndarray, M: np.ndarray, closure: float, routes: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and cells of unit vectors: the cell of the best centroid, and up to ``routes`` in all that are nearly as good."""
    S = X @ M.T
    m = min(routes, S.shape[1])
    c = np.argpartition(-S, m - 1, 1)[:, :m]
    s = np.take_along_axis(S, c, 1)
    r, j = np.nonzero(s >= s.max(1, keepdims=True) - closure)
    return r, c[r, j]


def _route(reps: DataFrame, M: np.ndarray, dim: int, closure: float, routes: int) -> DataFrame:
    """Each vector with the cells that index it."""

    def run(batches):
        for batch in batches:
            r, cell = _nearest_cells(_unit(_base.vectors(batch.column(1), dim)), M, closure, routes)
            pick = pa.array(r)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), batch.column(0).take(pick), batch.column(1).take(pick)], ["cell", "rep", "vec"])

    return reps.mapInArrow(run, "cell bigint, rep bigint, vec array<float>")


def _split(rows: DataFrame, dim: int, shard: int, closure: float, level: int) -> DataFrame:
    """The vectors (cell, rep, vec, n) of large cells in the cells below theirs.

    Each cell's centroids are fitted on its own sample, by one task a cell; its vectors are routed in chunks
    of about ``CHUNK``, each with a copy of the cell's centroids. Nothing of it passes the driver.
    """

    def fit(group: pa.Table) -> pa.Table:
        X = _unit(_base.vectors(group["vec"], dim))
        n = group["n"][0].as_py()
        M = centroids(X, max(2, min(CELL_CENTROIDS, math.ceil(SHARE * n / shard), len(X) // 8)))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(M) + 1, dtype=np.int32) * dim), pa.array(M.ravel()))
        return pa.table({"cell": pa.array([group["cell"][0].as_py()] * len(M), pa.int64()), "n": pa.array([n] * len(M), pa.int64()), "sub": pa.array(range(len(M)), pa.int32()), "vec": flat})

    def route(vectors: pa.Table, below: pa.Table) -> pa.Table:
        if not vectors.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "vec": pa.array([], pa.list_(pa.float32()))})
        M = _base.vectors(below["vec"], dim)[np.argsort(below["sub"].to_numpy())]
        r, c = _nearest_cells(_unit(_base.vectors(vectors["vec"], dim)), M, closure, 2)
        parent = vectors["cell"][0].as_py()
        names = np.array([xxhash.xxh64_intdigest(f"{level}/{parent}/{i}") >> 1 for i in range(len(M))], np.int64)
        pick = pa.array(r)
        return pa.table({"cell": pa.array(names[c]), "rep": vectors["rep"].take(pick), "vec": vectors["vec"].take(pick)})

    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("rep"), "rep"))
    sample = rows.withColumn("place", place).where(F.col("place") <= CELL_SAMPLE).select("cell", "n", "vec")
    below = _base.stage(sample.groupBy("cell").applyInArrow(fit, "cell bigint, n bigint, sub int, vec array<float>"), "knn-centroids")
    chunks = F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
    left = rows.select("cell", F.pmod(F.xxhash64("rep", F.lit(level)), chunks).cast("int").alias("chunk"), "rep", "vec")
    right = below.select("cell", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "sub", "vec")
    # cells are named by their parent, so no vector comes to one twice
    return left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk")).applyInArrow(route, "cell bigint, rep bigint, vec array<float>")


def _search(X: np.ndarray, raw: np.ndarray, rep: np.ndarray, G: np.ndarray, entry: np.ndarray, asks: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, width: int) -> pa.Table:
    """What the queries (unit vectors, exact ones, ids) find in a graph, with exact similarities."""
    Q, exact, who = asks
    place = np.searchsorted(rep, who)
    own = np.where((place < len(rep)) & (rep[np.minimum(place, len(rep) - 1)] == who), place, -1).astype(np.int32)
    ids = search_all(X, G, entry, Q, own, k + 2, width)
    r, c = np.nonzero(ids >= 0)
    a, b = r, ids[r, c]
    apart = who[a] != rep[b]
    a, b = a[apart], b[apart]
    sim = np.round(np.einsum("ij,ij->i", exact[a], raw[b]), 12)
    return pa.table({"rep": who[a], "near": rep[b], "sim": sim})


def _exact(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    raw = _base.vectors(column, dim).astype(np.float64)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _shard_search(k: int, dim: int, degree: int, width: int, alpha: float):
    """Builds the graph of a shard and answers its vectors."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        rep, raw = group["rep"].to_numpy(), _exact(group["vec"], dim)
        X = raw.astype(np.float32)
        G, entry = build(X, degree, width, alpha)
        return _search(X, raw, rep, G, entry, (X, raw, rep), k, width)

    return run


def _by_hash(rows: DataFrame, k: int, dim: int, shard: int, degree: int, width: int, alpha: float) -> DataFrame:
    """The same for cells (cell, rep, vec, n) that no centroids split: graphs of sub-shards by a hash, built once, searched by blocks of queries."""

    def graph(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        G, entry = build(_exact(group["vec"], dim).astype(np.float32), degree, width, alpha)
        edges = pa.ListArray.from_arrays(pa.array(np.arange(len(G) + 1, dtype=np.int32) * degree), pa.array(G.ravel()))
        first = np.zeros(len(G), bool)
        first[entry] = True
        return pa.table({"cell": group["cell"], "sub": group["sub"], "n": group["n"], "rep": group["rep"], "vec": group["vec"], "edges": edges, "entry": first})

    def ask(built: pa.Table, asking: pa.Table) -> pa.Table:
        if not built.num_rows or not asking.num_rows:
            return pa.table({"rep": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        built = built.sort_by("rep")
        raw, exact = _exact(built["vec"], dim), _exact(asking["vec"], dim)
        G = built["edges"].combine_chunks().flatten().to_numpy().astype(np.int32).reshape(-1, degree)
        entry = np.nonzero(built["entry"].to_numpy(zero_copy_only=False))[0].astype(np.int32)
        return _search(raw.astype(np.float32), raw, built["rep"].to_numpy(), G, entry, (exact.astype(np.float32), exact, asking["rep"].to_numpy()), k, width)

    subs, blocks = F.ceil(F.col("n") / F.lit(shard)).cast("int"), F.ceil(F.col("n") / F.lit(4 * shard)).cast("int")
    split = rows.select("cell", F.pmod(F.xxhash64("rep", F.lit(1)), subs).cast("int").alias("sub"), "n", "rep", "vec")
    built = _base.stage(split.groupBy("cell", "sub").applyInArrow(graph, "cell bigint, sub int, n bigint, rep bigint, vec array<float>, edges array<int>, entry boolean"), "knn-graphs")
    held = built.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).groupBy("cell", "sub", "block")
    asking = rows.select("cell", F.explode(F.sequence(F.lit(0), subs - 1)).alias("sub"), F.pmod(F.xxhash64("rep", F.lit(2)), blocks).cast("int").alias("block"), "rep", "vec").groupBy("cell", "sub", "block")
    return held.cogroup(asking).applyInArrow(ask, _FOUND)


def undirected(found: DataFrame) -> DataFrame:
    """The unordered pairs of :func:`neighbours`: ``id_a`` < ``id_b``."""
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
