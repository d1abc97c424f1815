"""Embedding near-dedup through navigable small-world graphs per shard.

Equal vectors are one node with a count. The distinct vectors are dealt to
shards; each shard builds a hierarchical navigable small-world graph, and
every vector queries every shard. Searches run for many queries at once: the
beams of a block of queries are arrays, and a step expands the best open
entries of all of them. A query whose beam is full of links searches again,
wider, and in the end meets the whole shard. The first beam of a shard is
widened until an audit finds at least ``recall`` of the links that brute force
finds in the shard: audited are queries drawn by hash (the query itself does
not count) and planted ones, made to lie at the threshold from a node of the
shard, so that no audit is empty. The widest beam takes in the whole shard, so
the audit always ends; its outcome is a table of its own.

Links are verified by cosine in double precision. Queries with few links in a
shard send them as pairs; of queries that met the whole shard only the number
of their links and a spanning forest leave the task, so a cluster of mutually
near vectors is never written out as all its pairs. Counts are summed and
components settled by star contractions on Spark.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Forest, connected_components, materialize

#: Bytes of vectors (in double precision) a shard holds; the number of shards is at least ``MIN_SHARDS``.
SHARD_BYTES = 64 << 20
#: Bytes of the queries that one task puts to one shard's graph.
QUERY_BYTES = 64 << 20
MIN_SHARDS = 6
#: Neighbours kept at each level (twice as many at the lowest).
DEGREE = 12
BUILD_BEAM = 32
FIRST_BEAM = 16
#: Audited queries of each shard and query block, and as many planted ones.
AUDIT = 64
#: How far above the threshold planted queries lie.
PLANTED = 0.01
BLOCK = 1024
#: A query meets the whole shard instead of a beam beyond this part of it.
SCAN_PART = 16
#: Numbers in one block of a scan's cosines.
SCAN_CELLS = 1 << 23
#: One in so many nodes of a level is also on the next.
_LEVEL_BASE = 16


class Graph:
    """Hierarchical navigable small-world graph over unit vectors (float32)."""

    def __init__(self, vectors: np.ndarray, seed: int = 7) -> None:
        self.x = vectors
        n = len(vectors)
        rng = np.random.default_rng(seed)
        top = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(_LEVEL_BASE)).astype(int), 4)
        if n:
            top[0] = top.max()
        order = np.argsort(-top, kind="stable")  # higher nodes first: every level is filled from its own nodes
        self.levels: list[np.ndarray] = []
        self.members: list[np.ndarray] = []
        for level in range(int(top.max()) if n else -1, -1, -1):
            self._fill(level, order[: int((top >= level).sum())])

    def _fill(self, level: int, nodes: np.ndarray) -> None:
        """Insert a level's nodes in batches that double, each searching what is there already and comparing itself."""
        degree = DEGREE * (2 if level == 0 else 1)
        links = np.full((len(self.x), degree), -1, np.int64)
        entry = self.members[-1][:1] if self.members else nodes[:1]
        done = 0
        while done < len(nodes):
            new = nodes[done : done + max(64, min(done, 4096))]
            near = [np.empty((len(new), 0), np.int64)]
            if done:
                at = self._descend(self.x[new]) if self.levels else np.repeat(entry, len(new))
                near.append(_search(self.x, links, self.x[new], at, BUILD_BEAM)[0])
            own = self.x[new] @ self.x[new].T
            np.fill_diagonal(own, -2)
            k = min(degree, len(new) - 1)
            if k > 0:
                near.append(new[np.argpartition(-own, k - 1, axis=1)[:, :k]])
            self._link(links, new, np.concatenate(near, axis=1), degree)
            done += len(new)
        self.levels.append(links)
        self.members.append(nodes)

    def _link(self, links: np.ndarray, new: np.ndarray, near: np.ndarray, degree: int) -> None:
        """Keep each node's diverse nearest, and add the way back to the nodes it chose."""
        if not near.shape[1]:
            return
        links[new] = _diverse(self.x, new, near, degree)
        a, b = np.repeat(new, degree), links[new].ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        hit, first, count = np.unique(b, return_index=True, return_counts=True)
        place = np.arange(len(b)) - np.repeat(first, count)
        on = place < 2 * degree  # offers beyond this compete again when later nodes choose
        offered = np.full((len(hit), 2 * degree), -1, np.int64)
        offered[np.repeat(np.arange(len(hit)), count)[on], place[on]] = a[on]
        links[hit] = _diverse(self.x, hit, np.concatenate([links[hit], offered], axis=1), degree)

    def _descend(self, queries: np.ndarray) -> np.ndarray:
        """Best entry found by walking the levels above with a small beam."""
        at = np.repeat(self.members[0][:1], len(queries))
        for links in self.levels:
            at = _search(self.x, links, queries, at, 4)[0][:, 0]
        return at

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``beam`` nearest nodes of each query and their cosines, -1 where fewer were reached."""
        at = np.repeat(self.members[0][:1], len(queries))
        for links in self.levels[:-1]:
            at = _search(self.x, links, queries, at, 4)[0][:, 0]
        return _search(self.x, self.levels[-1], queries, at, beam)


def _diverse(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Of each node's candidates, those closer to it than to a candidate chosen before; filled up with the nearest others."""
    out = np.full((len(nodes), degree), -1, np.int64)
    for lo in range(0, len(nodes), 1024):
        me, cand = nodes[lo : lo + 1024], near[lo : lo + 1024].copy()
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == me[:, None]] = -1
        sim = np.einsum("ncd,nd->nc", x[cand], x[me])
        sim[cand < 0] = -3
        order = np.argsort(-sim, axis=1)[:, : 3 * degree]
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        between = np.einsum("ncd,nkd->nck", x[cand], x[cand])
        good = np.zeros(cand.shape, bool)
        for j in range(cand.shape[1]):
            rival = np.where(good[:, :j], between[:, j, :j], -4).max(axis=1, initial=-4)
            good[:, j] = (cand[:, j] >= 0) & (rival < sim[:, j]) & (good[:, :j].sum(axis=1) < degree)
        rank = np.argsort(np.where(good, 0, np.where(cand >= 0, 1, 2)), axis=1, kind="stable")[:, :degree]
        got = np.take_along_axis(cand, rank, 1)
        out[lo : lo + 1024, : got.shape[1]] = got
    return out


def _search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries together; returns ids and cosines in falling order."""
    q = len(queries)
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -3.0, np.float32)
    open_ = np.zeros((q, beam), bool)
    ids[:, 0], sims[:, 0], open_[:, 0] = start, np.einsum("nd,nd->n", queries, x[start]), True
    live = np.arange(q)
    while len(live):
        some = min(expand, beam)
        pick = np.argsort(np.where(open_[live], -sims[live], 9), axis=1)[:, :some]
        chosen = np.take_along_axis(open_[live], pick, 1)
        nodes = np.where(chosen, np.take_along_axis(ids[live], pick, 1), -1)
        rows = np.repeat(live[:, None], some, 1)
        open_[rows, pick] = False
        new = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        sim = np.einsum("ncd,nd->nc", x[new], queries[live])
        sim[new < 0] = -3
        all_ids, all_sims = np.concatenate([ids[live], new], 1), np.concatenate([sims[live], sim], 1)
        all_open = np.concatenate([open_[live], new >= 0], 1)
        # an id already in the beam comes first among its equals; the later one goes
        by = np.argsort(all_ids, axis=1, kind="stable")
        sorted_ids = np.take_along_axis(all_ids, by, 1)
        again = np.zeros(by.shape, bool)
        again[:, 1:] = (sorted_ids[:, 1:] == sorted_ids[:, :-1]) & (sorted_ids[:, 1:] >= 0)
        twice = np.zeros(by.shape, bool)
        np.put_along_axis(twice, by, again, 1)
        all_sims[twice], all_open[twice] = -3, False
        all_ids[twice] = -1
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[live], sims[live], open_[live] = (np.take_along_axis(v, best, 1) for v in (all_ids, all_sims, all_open))
        live = live[open_[live].any(axis=1)]
    return ids, sims


def _found(graph: Graph, x: np.ndarray, queries: np.ndarray, threshold: float, beam: int):
    """Links of all queries by beams, widened while they are full of links.

    Yields (queries, nodes, False) as index pairs, and (queries, cosines,
    True) for blocks of queries that meet the whole shard ``x``. ``queries``
    and ``x`` are unit vectors in double precision.
    """
    n = len(x)
    narrow = queries.astype(np.float32)
    left = np.arange(len(queries))
    while len(left):
        if beam * SCAN_PART >= n:
            rows = max(1, SCAN_CELLS // n)
            for lo in range(0, len(left), rows):
                part = left[lo : lo + rows]
                yield part, queries[part] @ x.T, True
            return
        full = []
        for lo in range(0, len(left), BLOCK):
            part = left[lo : lo + BLOCK]
            ids, sims = graph.search(narrow[part], beam)
            ok = (sims >= threshold - 1e-4) & (ids >= 0)  # float32; verified below
            more = ok.all(axis=1)  # a beam full of links may hide others
            full.append(part[more])
            a, b = np.nonzero(ok & ~more[:, None])
            a, b = part[a], ids[a, b]
            for at in range(0, len(a), BLOCK):
                q, v = a[at : at + BLOCK], b[at : at + BLOCK]
                sure = np.einsum("nd,nd->n", queries[q], x[v]) >= threshold
                yield q[sure], v[sure], False
        left = np.concatenate(full)
        beam *= 4


def _planted(x: np.ndarray, threshold: float, most: int) -> np.ndarray:
    """Unit vectors whose cosine with a node of ``x`` is a little above ``threshold``; nodes come in hashed order."""
    near = x[np.unique(np.linspace(0, len(x) - 1, min(most, len(x))).astype(int))]
    aside = np.random.default_rng(11).normal(size=near.shape)
    aside -= np.einsum("nd,nd->n", aside, near)[:, None] * near
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    cos = min(1.0, threshold + PLANTED)
    out = cos * near + np.sqrt(1 - cos * cos) * np.divide(aside, length, out=np.zeros_like(aside), where=length > 0)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _audit(graph: Graph, x: np.ndarray, names: np.ndarray, queries: np.ndarray, asking: np.ndarray, threshold: float, recall: float) -> tuple[int, int, int]:
    """(first beam that passes, links by brute force, links found with it)."""
    drawn = np.argsort(asking)[: min(AUDIT, len(asking))]
    asked = np.concatenate([queries[drawn], _planted(x, threshold, AUDIT)])
    truth = asked @ x.T >= threshold
    truth[: len(drawn)] &= asking[drawn][:, None] != names  # a vector's own node is no link
    beam = FIRST_BEAM
    while True:
        found = np.zeros_like(truth)
        for part, other, whole in _found(graph, x, asked, threshold, beam):
            if whole:
                found[part] |= other >= threshold
            else:
                found[part, other] = True
        total, hit = int(truth.sum()), int((found & truth).sum())
        if hit >= recall * total or beam * SCAN_PART >= len(x):
            return beam, total, hit
        beam *= 2


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = np.asarray(vectors.combine_chunks().flatten() if isinstance(vectors, pa.ChunkedArray) else vectors.flatten(), np.float64)
    x = flat.reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_GRAPH = "shard int, dim int, graph binary"


def _build(shard: pa.Table) -> pa.Table:
    order = np.argsort(shard.column("node").to_numpy())  # the order in which rows arrive doesn't matter
    x, names, copies = _unit(shard.column("vec"))[order], shard.column("node").to_numpy()[order], shard.column("copies").to_numpy()[order]
    blob = pickle.dumps((x, names, copies, Graph(x.astype(np.float32))), protocol=5)
    return pa.table({"shard": pa.array([shard.column("shard")[0].as_py()], pa.int32()), "dim": pa.array([x.shape[1]], pa.int32()), "graph": pa.array([blob], pa.binary())})


#: Rows of a probe. PAIR: query a, node b and their copies. MANY: query a has n_b linked rows in the shard. TREE: a and b belong together. AUDITED: beam a, b links, n_b of them found.
PAIR, MANY, TREE, AUDITED = range(4)
_FOUND = "kind int, shard int, a long, b long, n_a long, n_b long"


def _probe(threshold: float, recall: float):
    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), *((c, pa.int64()) for c in ("a", "b", "n_a", "n_b"))])
        if not shard.num_rows or not asked.num_rows:
            return schema.empty_table()
        x, names, copies, graph = pickle.loads(shard.column("graph")[0].as_py())
        queries, asking, own = _unit(asked.column("q_vec")), asked.column("q_node").to_numpy(), asked.column("q_copies").to_numpy()
        beam, total, hit = _audit(graph, x, names, queries, asking, threshold, recall)
        zero = np.zeros(1, np.int64)
        rows = [(AUDITED, zero + beam, zero + total, zero, zero + hit)]
        at = {v: i for i, v in enumerate(names.tolist())}
        self_at = np.array([at.get(v, -1) for v in asking.tolist()], np.int64)
        # trees over nodes and, behind them, queries; a query that is a node of the shard is that node
        place = np.where(self_at >= 0, self_at, len(names) + np.arange(len(asking)))
        forest, labels, many = Forest(len(names) + len(asking)), np.concatenate([names, asking]), False
        for part, other, whole in _found(graph, x, queries, threshold, beam):
            if not whole:
                a, b = part[asking[part] != names[other]], other[asking[part] != names[other]]
                rows.append((PAIR, asking[a], names[b], own[a], copies[b]))
                continue
            near = other >= threshold
            inside = self_at[part] >= 0
            near[np.flatnonzero(inside), self_at[part][inside]] = False
            n = near @ copies
            linked = n > 0
            rows.append((MANY, asking[part][linked], np.zeros(int(linked.sum()), np.int64), own[part][linked], n[linked]))
            a, b = np.nonzero(near)
            forest.link(place[part[a]], b)
            many = True
        if many:
            root = forest.find(np.arange(len(labels)))
            leaf = np.flatnonzero(root != np.arange(len(labels)))
            rows.append((TREE, labels[leaf], labels[root[leaf]], np.zeros(len(leaf), np.int64), np.zeros(len(leaf), np.int64)))
        kinds = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]).astype(np.int32)
        number = shard.column("shard")[0].as_py()
        return pa.table([pa.array(kinds), pa.array(np.full(len(kinds), number, np.int32)), *(pa.array(np.concatenate([r[i] for r in rows]).astype(np.int64)) for i in range(1, 5))], schema=schema)

    return run


def audited_groups(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.99, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The rows of ``vector_groups``, and the audits: (shard, beam, links, found) of each shard and block of queries."""
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above infinity here
    sound = F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    plain = plain.withColumn("vec", F.when(sound, F.col("vec")))
    # copies: one node, named by a hash of the vector; the vector itself is the grouping key
    classes = materialize(plain.filter("vec IS NOT NULL").groupBy("vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")).withColumn("node", F.xxhash64("vec")))
    size = 8 * (classes.agg(F.sum(F.size("vec").cast("long"))).first()[0] or 0)
    shards, blocks = max(MIN_SHARDS, -(-size // SHARD_BYTES)), max(1, -(-size // QUERY_BYTES))
    shard_of = lambda c: F.pmod(F.hash(c), F.lit(shards))
    dealt = classes.select("node", "vec", "copies", F.size("vec").alias("dim"), shard_of("node").alias("shard"))
    graphs = materialize(dealt.groupBy("shard", "dim").applyInArrow(_build, _GRAPH))
    # every query goes to every shard; a task takes one block of queries and one shard's graph
    graphs = graphs.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("q_shard")
    asked = dealt.select(F.col("node").alias("q_node"), F.col("vec").alias("q_vec"), F.col("copies").alias("q_copies"), F.col("dim").alias("q_dim"), F.pmod(F.hash("node", F.lit(1)), F.lit(blocks)).alias("q_block"), each)
    found = materialize(graphs.groupBy("shard", "dim", "block").cogroup(asked.groupBy("q_shard", "q_dim", "q_block")).applyInArrow(_probe(threshold, recall), _FOUND))
    pairs = found.filter(F.col("kind") == PAIR)
    # a pair counts for both its ends, once, unless the end has counted the other's whole shard
    ends = pairs.select("a", "b", "shard", F.col("n_b").alias("n")).unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), shard_of("a").alias("shard"), F.col("n_a").alias("n"))).distinct()
    many = found.filter(F.col("kind") == MANY).select("a", "shard", F.col("n_b").alias("n"))
    counted = ends.join(many.select("a", "shard"), ["a", "shard"], "left_anti").select("a", "n").unionAll(many.select("a", "n"))
    linked = counted.groupBy(F.col("a").alias("l_node")).agg(F.sum("n").alias("l_links"))
    parts_of = connected_components(found.filter(F.col("kind").isin(PAIR, TREE)).select("a", "b"))
    of = classes.join(parts_of.select(F.col("node").alias("c_node"), "component"), F.col("node") == F.col("c_node"), "left").withColumn("root", F.coalesce("component", "node"))
    named = of.groupBy(F.col("root").alias("n_root")).agg(F.min("least").alias("component_id"))
    info = of.join(named, F.col("root") == F.col("n_root")).join(linked, F.col("node") == F.col("l_node"), "left").select("node", "component_id", (F.col("copies") - 1 + F.coalesce("l_links", F.lit(0))).alias("n_links"))
    rows = plain.select("vec_id", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")).alias("r_node"))
    out = rows.join(info, F.col("r_node") == F.col("node"), "left")
    component = F.coalesce("component_id", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    return out, found.filter(F.col("kind") == AUDITED).select("shard", F.col("a").alias("beam"), F.col("b").alias("links"), F.col("n_b").alias("found"))


def vector_groups(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.99, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    ``n_links`` counts the other rows linked directly, copies included;
    ``component_id`` is the smallest id reachable; ``kept`` says that it is
    the row's own. Vectors that are null, zero, empty or have null or
    non-finite components link with nothing. Vectors of different lengths
    never link. Rows that repeat an id are rows of their own which link if
    their vectors do. Null ids are below all others and never kept. Columns
    other than the two are not used. An empty table gives an empty result.
    """
    return audited_groups(vectors, threshold, recall, id_col, vec_col)[0]
