"""Embedding near-dedup with hierarchical navigable small-world graphs, one per shard."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipeline.llm.common import components, cut, join_classes

FAR = np.float32(-9)


def unit(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in doubles; rows are scaled by their largest component first, so no square overflows or vanishes."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Graph:
    """A navigable small-world graph over the leaders of a shard's unit vectors; every layer holds a random 1/degree part of the one below.

    Vectors come in batches that double in size. One with a similarity of ``absorb`` or more to a leader becomes its member and no node, so a
    dense group is a few nodes, however large it is. ``near[l]`` has up to 2 * degree neighbours of each node on layer l, -1 where
    there are fewer. ``nodes[k]`` is the row of node k; ``members`` are the rows by leader, those of node k from ``first[k]`` to ``first[k + 1]``.
    """

    def __init__(self, vectors: np.ndarray, absorb: float, degree: int = 16, beam: int = 48, seed: int = 0):
        v = np.ascontiguousarray(vectors, np.float32)
        n, self.degree = len(v), degree
        self.batch = batch = int(np.clip((1 << 15) // v.shape[1], 32, 512))
        chance = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(chance, 1e-12)) / np.log(degree)).astype(int), 6)
        self.v, self.nodes, self.level = v[:0], np.zeros(0, np.int64), np.zeros(0, int)
        self.near = [np.full((0, 2 * degree), -1, np.int32)]
        owner, at = np.full(n, -1, np.int64), 0
        while at < n:
            rows = np.arange(at, min(n, at + min(batch, max(64, len(self.v)))))
            at = int(rows[-1]) + 1
            found, sims = self.closest(v[rows], beam) if len(self.v) else (np.zeros((len(rows), 0), np.int64), np.zeros((len(rows), 0), np.float32))
            new = np.ones(len(rows), bool)
            if len(self.v):
                member = sims[:, 0] >= absorb
                owner[rows[member]] = found[member, 0]
                new[member] = False
            among = v[rows] @ v[rows].T
            fresh = []
            for k in np.flatnonzero(new):
                close = np.flatnonzero(among[k, fresh] >= absorb) if fresh else ()
                if len(close):
                    owner[rows[k]] = len(self.v) + close[0]
                else:
                    owner[rows[k]] = len(self.v) + len(fresh)
                    fresh.append(k)
            if fresh:
                self.insert(v[rows[fresh]], rows[fresh], level[rows[fresh]], found[fresh], beam)
        self.members = np.argsort(owner, kind="stable")
        self.first = np.searchsorted(owner[self.members], np.arange(len(self.v) + 1))

    def closest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """What ``search`` gives a new batch: exactly, by one product, as long as batch and graph make a small one, then by walks."""
        if len(q) * len(self.v) > 1 << 22:
            return self.search(q, beam)
        sims, most = q @ self.v.T, min(beam, len(self.v))
        some = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        near = np.take_along_axis(sims, some, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        return np.take_along_axis(some, order, 1), np.take_along_axis(near, order, 1)

    def insert(self, v: np.ndarray, rows: np.ndarray, level: np.ndarray, found: np.ndarray, beam: int) -> None:
        """Adds nodes: each is linked, on every layer it has, with chosen ones of what a search has found and of the new nodes themselves."""
        old, new = len(self.v), np.arange(len(self.v), len(self.v) + len(v))
        layers = max(len(self.near), int(level.max()) + 1)
        top_before = self.level
        self.v, self.nodes, self.level = np.concatenate([self.v, v]), np.append(self.nodes, rows), np.append(self.level, level)
        self.near += [np.full((old, 2 * self.degree), -1, np.int32) for _ in range(layers - len(self.near))]
        self.near = [np.concatenate([x, np.full((len(v), 2 * self.degree), -1, np.int32)]) for x in self.near]
        for layer in range(layers):
            mine = new[level >= layer]
            if not len(mine):
                continue
            if layer == 0:
                known = found
            else:
                there = np.flatnonzero(top_before >= layer)
                sims = self.v[mine] @ self.v[there].T if len(there) * len(mine) <= 1 << 22 else None
                if sims is None:
                    known, _ = self.walk(self.v[mine], self.entry(self.v[mine], layer, old), beam, layer)
                else:
                    known = there[np.argsort(-sims, axis=1, kind="stable")[:, :beam]] if len(there) else np.zeros((len(mine), 0), np.int64)
            own = self.v[mine] @ self.v[mine].T
            np.fill_diagonal(own, FAR)
            order = np.argsort(-own, axis=1, kind="stable")[:, : min(beam, len(mine) - 1)]
            candidates = np.concatenate([known, mine[order]], axis=1)
            chosen = self.choose(mine, candidates, self.degree)
            self.near[layer][mine, : self.degree] = chosen
            self.link_back(layer, mine, chosen)

    def choose(self, at: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """(nodes, most): of each node's candidates, nearest first, those nearer to it than to any chosen before, then the nearest of the rest; -1 where there are fewer."""
        if not candidates.shape[1]:
            return np.full((len(at), most), -1, np.int32)
        candidates = np.where(candidates == at[:, None], -1, candidates)
        candidates = np.sort(candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        own = np.einsum("bcd,bd->bc", self.v[candidates], self.v[at])
        own[candidates < 0] = FAR
        order = np.argsort(-own, axis=1, kind="stable")[:, : 3 * most]
        candidates, own = np.take_along_axis(candidates, order, 1), np.take_along_axis(own, order, 1)
        x = self.v[candidates]
        among = x @ x.transpose(0, 2, 1)
        kept, worst = np.zeros(candidates.shape, bool), np.full(candidates.shape, FAR)
        for j in range(candidates.shape[1]):
            good = (own[:, j] > worst[:, j]) & (candidates[:, j] >= 0)
            kept[:, j] = good
            worst = np.where(good[:, None], np.maximum(worst, among[:, j]), worst)
        rank = np.argsort(np.where(candidates < 0, 2, ~kept), axis=1, kind="stable")[:, :most]
        out = np.full((len(at), most), -1, np.int32)
        out[:, : rank.shape[1]] = np.take_along_axis(candidates, rank, 1)
        return out

    def link_back(self, layer: int, new: np.ndarray, chosen: np.ndarray) -> None:
        """Lets the chosen ones know the new nodes; where that makes too many neighbours, they choose again."""
        near, room = self.near[layer], 2 * self.degree
        a, b = chosen.ravel(), np.repeat(new, chosen.shape[1])
        a, b = a[a >= 0], b[a >= 0]
        if not len(a):
            return
        sims = np.einsum("nd,nd->n", self.v[a], self.v[b])
        order = np.lexsort((-sims, a))
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        place = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
        who = a[starts]
        more = np.full((len(who), room), -1, np.int64)
        fits = place < room
        more[np.searchsorted(who, a[fits]), place[fits]] = b[fits]
        both = np.concatenate([near[who].astype(np.int64), more], axis=1)
        many = (both >= 0).sum(axis=1) > room
        few = np.sort(np.where(both < 0, np.iinfo(np.int64).max, both), axis=1)[:, :room]
        near[who[~many]] = np.where(few == np.iinfo(np.int64).max, -1, few)[~many]
        if many.any():
            who, both = who[many], both[many]
            for part in (slice(k, k + self.batch) for k in range(0, len(who), self.batch)):
                near[who[part]] = self.choose(who[part], both[part], room)

    def entry(self, q: np.ndarray, layer: int, before: int | None = None) -> np.ndarray:
        """(queries, 1): where a descent from the top arrives, for a walk on ``layer``."""
        level = self.level[:before]
        at = np.full((len(q), 1), int(np.argmax(level)))
        for upper in range(int(level.max()), layer, -1):
            at = self.walk(q, at, 2, upper)[0][:, :1]
        return at

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities), (queries, beam), best first; -1 where the graph has fewer. Queries go in groups that walk in step."""
        step = max(16, min(256, self.batch, (1 << 25) // len(self.v)))
        parts = [self.walk(x, self.entry(x, 0), beam, 0) for x in (q[k : k + step] for k in range(0, len(q), step))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def walk(self, q: np.ndarray, entry: np.ndarray, beam: int, layer: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """A best-first search for each query that keeps ``beam`` nodes and expands ``wide`` of them at a time, until all kept ones are expanded."""
        near, count = self.near[layer], len(q)
        nodes, sims, fresh = np.full((count, beam), -1), np.full((count, beam), FAR), np.zeros((count, beam), bool)
        nodes[:, : entry.shape[1]] = entry
        sims[:, : entry.shape[1]] = np.einsum("bed,bd->be", self.v[entry], q)
        fresh[:, : entry.shape[1]] = True
        seen = np.zeros((count, len(self.v)), bool)
        np.put_along_axis(seen, entry, True, axis=1)
        live = np.arange(count)
        while len(live):
            open_now = fresh[live]
            at = np.argsort(~open_now, axis=1, kind="stable")[:, :wide]
            real = np.take_along_axis(open_now, at, 1)
            np.put_along_axis(open_now, at, False, axis=1)
            more = near[np.take_along_axis(nodes[live], at, 1)]
            more[~real] = -1
            more = more.reshape(len(live), -1)
            more = np.sort(more, axis=1)
            more[:, 1:][more[:, 1:] == more[:, :-1]] = -1
            unseen = (more >= 0) & ~seen[live[:, None], more]
            row, col = np.nonzero(unseen)
            which = more[row, col]
            seen[live[row], which] = True
            s = np.full(more.shape, FAR)
            s[row, col] = np.einsum("nd,nd->n", self.v[which], q[live[row]])
            all_sims = np.concatenate([sims[live], s], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[live] = np.take_along_axis(all_sims, order, 1)
            nodes[live] = np.take_along_axis(np.concatenate([nodes[live], more], axis=1), order, 1)
            fresh[live] = np.take_along_axis(np.concatenate([open_now, unseen], axis=1), order, 1)
            live = live[fresh[live].any(axis=1)]
        nodes[sims == FAR] = -1
        return nodes, sims


class Shard:
    """A shard's vectors and graph, and the exact answers that searches are held against."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, weight: np.ndarray, least: float):
        self.raw, self.ids, self.weight, self.least = vectors, ids, weight, least
        theta = float(np.arccos(least))
        # Vectors of a link are theta apart and a member is theta from its leader, so leaders within twice that are asked.
        self.absorb, self.reach = float(np.cos(theta)) + 1e-5, float(np.cos(min(np.pi, 2 * theta))) - 1e-4
        self.graph = Graph(unit(vectors), self.absorb)

    def prepare(self) -> None:
        self.exact = unit(self.raw)

    def candidates(self, q: np.ndarray, beam: int, widest: int) -> list[np.ndarray]:
        """For each query the leaders within reach. One whose beam is full of them asks again with a wider one, and beyond ``widest`` compares itself with all leaders."""
        g, q = self.graph, q.astype(np.float32)
        out: list = [None] * len(q)
        rest = np.arange(len(q))
        while len(rest) and beam <= min(widest, len(g.v)):
            nodes, sims = g.search(q[rest], beam)
            full = sims[:, -1] >= self.reach
            for k in np.flatnonzero(~full):
                out[rest[k]] = nodes[k][sims[k] >= self.reach]
            rest, beam = rest[full], 4 * beam
        for part in (rest[k : k + 64] for k in range(0, len(rest), 64)):
            sims = q[part] @ g.v.T
            for k, row in zip(part, sims, strict=True):
                out[k] = np.flatnonzero(row >= self.reach)
        return out

    def linked(self, q: np.ndarray, leaders: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(places in q, rows of the shard) with a cosine of ``least`` or more in doubles, of the members of each query's leaders."""
        g = self.graph
        who, node = np.repeat(np.arange(len(q)), [len(x) for x in leaders]), np.concatenate([np.zeros(0, np.int64), *leaders]).astype(np.int64)
        sizes = g.first[node + 1] - g.first[node]
        small, a, b = sizes <= 32, [], []
        for part in np.array_split(np.flatnonzero(small), max(1, sizes[small].sum() // 65536)):
            n = sizes[part]
            w = np.repeat(who[part], n)
            m = g.members[np.repeat(g.first[node[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            good = np.einsum("nd,nd->n", q[w], self.exact[m]) >= self.least
            a.append(w[good])
            b.append(m[good])
        big = np.flatnonzero(~small)
        for k in np.unique(node[big]):
            w, m = who[big[node[big] == k]], g.members[g.first[k] : g.first[k + 1]]
            for part in (w[j : j + 256] for j in range(0, len(w), 256)):
                i, j = np.nonzero(q[part] @ self.exact[m].T >= self.least)
                a.append(part[i])
                b.append(m[j])
        return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])

    def every(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``linked`` gives, by comparing with all vectors of the shard."""
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(q), 64):
            i, j = np.nonzero(q[at : at + 64] @ self.exact.T >= self.least)
            a.append(i + at)
            b.append(j)
        return np.concatenate(a), np.concatenate(b)

    def beam_for(self, q: np.ndarray, ids: np.ndarray, beam: int, widest: int, audit: int, recall: float) -> tuple[int, int, int]:
        """(the beam with which an audit passes, 0 if none up to ``widest`` does; the audit's links, those found).

        The audit takes ``audit`` of the queries. Of their links ``recall`` must be found and, apart from those, of their two nearest leaders nine tenths.
        """
        some = np.linspace(0, len(q) - 1, min(audit, len(q))).astype(int)
        a, b = self.every(q[some])
        other = self.ids[b] != ids[some[a]]
        truth = set(zip(a[other].tolist(), b[other].tolist(), strict=True))
        best = np.concatenate([np.sort(q[some[k : k + 64]].astype(np.float32) @ self.graph.v.T, axis=1)[:, -2:][:, ::-1] for k in range(0, len(some), 64)])
        while beam <= widest:
            a, b = self.linked(q[some], self.candidates(q[some], beam, widest))
            found = len(truth & set(zip(a.tolist(), b.tolist(), strict=True)))
            nearest = int((self.graph.search(q[some].astype(np.float32), beam)[1][:, : best.shape[1]] >= best - 1e-5).sum())
            if found >= recall * len(truth) and nearest >= 0.9 * best.size:
                return beam, len(truth), found
            beam *= 2
        return 0, len(truth), len(truth)


class Forest:
    """Which of the things numbered from 0 hang together: pairs come in lots, and only the roots of a lot's pairs are looked at one by one."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def usable(vector: Column) -> Column:
    """No null, not empty, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


FOUND = "a long, b long, links long, label_wanted long, label_found long"


def search_shards(classes: DataFrame, least: float, shard_rows: int, shard_values: int, block_rows: int, beam: int, widest: int, audit: int, recall: float) -> DataFrame:
    """Rows (a, b, links, ...) for ``classes`` (id, label, dim, embedding, n).

    For each query a, block and shard one row with its number of linked vectors of other classes in the shard, and for each class that a block's links connect
    a row to the least of what hangs together there: as many rows as the block and the shard have classes at most, however many links there are. One row a
    block and shard, with a and b null, has the audit's links, wanted and found.
    """
    keys = ["label", "dim"]
    rows_of = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(shard_values) / F.col("dim"))))
    block_of = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.col("rows_of"), F.greatest(F.lit(2048), F.floor(F.col("_n") / 8))))
    parts = classes.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("rows_of", rows_of)
    parts = parts.select(*keys, F.ceil(F.col("_n") / F.col("rows_of")).cast("int").alias("shards"), F.ceil(F.col("_n") / block_of).cast("int").alias("blocks"))
    shards, asked = (min(20000, 3 * (n or 1)) for n in parts.agg(F.sum("shards"), F.sum(F.col("shards") * F.col("blocks"))).first())
    dealt = cut(
        classes.join(parts, keys)
        .withColumn("shard", F.pmod(F.xxhash64("id", F.lit("shard")), F.col("shards")).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
    )

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        shard = Shard(matrix(table.column("embedding")), table.column("id").to_numpy(), table.column("n").to_numpy(), least)
        return table.slice(0, 1).select([*keys, "shard", "blocks"]).append_column("graph", pa.array([pickle.dumps(shard)], pa.binary()))

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "shard", "blocks"))
    graphs = cut(dealt.select(*keys, "shard", "blocks", "id", "n", "embedding").repartition(shards, *keys, "shard").groupBy(*keys, "shard").applyInArrow(build, f"{schema}, graph binary"))
    queries = dealt.select(*keys, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", "id", "embedding", F.lit(None).cast("binary").alias("graph"))
    copies = graphs.select(*keys, "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("id"), F.lit(None).cast(kinds["embedding"]).alias("embedding"), "graph")

    def ask(table: pa.Table) -> pa.Table:
        given = [g.as_py() for g in table.column("graph") if g.is_valid]
        table = table.filter(table.column("graph").is_null())
        if not given or not len(table):
            return pa.table({c.split()[0]: pa.array([], pa.int64()) for c in FOUND.split(", ")})
        shard, table = pickle.loads(given[0]), table.sort_by("id")
        shard.prepare()
        q, ids = unit(matrix(table.column("embedding"))), table.column("id").to_numpy()
        width, wanted, found = shard.beam_for(q, ids, beam, widest, audit, recall)
        names = np.unique(np.append(ids, shard.ids))
        here, there = np.searchsorted(names, ids), np.searchsorted(names, shard.ids)
        links, forest = np.zeros(len(q), np.int64), Forest(len(names))
        for k in range(0, len(q), 256):
            part = q[k : k + 256]
            a, b = shard.linked(part, shard.candidates(part, width, widest)) if width else shard.every(part)
            other = here[a + k] != there[b]
            a, b = a[other] + k, b[other]
            np.add.at(links, a, shard.weight[b])
            forest.join(here[a], there[b])
        some, tied = np.flatnonzero(links), np.flatnonzero(forest.root != np.arange(len(names)))
        none = np.zeros(len(some) + len(tied), np.int64)
        a, b, n = np.append(ids[some], names[tied]), np.append(ids[some], names[forest.root[tied]]), np.append(links[some], none[: len(tied)])
        empty = pa.array([None], pa.int64())
        columns = {"a": a, "b": b, "links": n, "label_wanted": none, "label_found": none}
        return pa.concat_tables([pa.table(columns), pa.table({"a": empty, "b": empty, "links": [0], "label_wanted": [wanted], "label_found": [found]})])

    return queries.unionByName(copies).repartition(asked, *keys, "shard", "block").groupBy(*keys, "shard", "block").applyInArrow(ask, FOUND)


def embedding_dedup(
    embeddings: DataFrame, least: float = 0.98, shard_rows: int = 1 << 17, shard_values: int = 1 << 22, block_rows: int = 1 << 16, beam: int = 16, widest: int = 512, audit: int = 64, recall: float = 0.98
) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) of every row of ``embeddings``.

    Vectors with equal, non-null labels link when the cosine of the two, in double precision, is at least ``least``. Equal vectors
    are one class first, in Spark. Each label's classes are dealt by hash to shards of at most about ``shard_rows`` rows and ``shard_values`` components; every shard gets a
    graph, and all classes of the label ask every shard of it, in blocks of at most ``block_rows`` that get the graph once. Each block audits its search
    against exact answers and widens the beam until it passes; where none up to ``widest`` does, the block is compared with the whole shard. ``audit_recall`` is
    the share of the audits' links found, over the table (null if the audits met no link). Counts and stars leave the tasks, never all pairs.
    Components are the union of all links, by smallest vec_id; only that row is kept.

    Vectors that are null, empty or zero or hold null or non-finite components, and those without a label, link with nothing; nor do vectors
    of different lengths. n_links counts other vectors: repeated rows (vec_id, label and vector alike) are one vector, and rows that share a vec_id but not the vector have
    the links of their own vector and one component. A row with a null vec_id links with nothing. Columns of other names play no part. An empty table gives no rows.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    fits = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.when(fits, F.col("label")).alias("label"), F.when(fits, F.col("embedding")).alias("embedding"), F.when(fits, F.size("embedding")).alias("dim")))
    valid, keys = rows.filter("dim IS NOT NULL"), ["label", "dim", "embedding"]
    vectors = valid.select("vec_id", *keys).distinct()
    classes = cut(
        vectors.groupBy(*keys).agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
        .join(valid.groupBy(*keys).agg(F.count("*").alias("rows")), keys)
        .withColumn("id", F.monotonically_increasing_id())
    )
    found = cut(search_shards(classes.select("id", "label", "dim", "embedding", "n"), least, shard_rows, shard_values, block_rows, beam, widest, audit, recall))
    wanted, seen = found.filter("a IS NULL").agg(F.sum("label_wanted"), F.sum("label_found")).first()
    share = F.lit(seen / wanted if wanted else None).cast("double")
    linked = found.filter("a IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("others"))
    placed = cut(join_classes(valid, classes, keys, "rows").select("row", "vec_id", "id", "n"))
    # A vec_id of several classes ties them together.
    ties = placed.groupBy("vec_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a <> z").select("vec_id", "a")
    edges = found.filter("a <> b").select("a", "b").unionByName(placed.join(ties, "vec_id").select("a", F.col("id").alias("b")))
    roots = components(edges).select(F.col("node").alias("id"), "component")
    named = classes.select("id", "least", F.col("n").alias("own"), "rows").join(roots, "id", "left").join(linked, "id", "left")
    named = cut(named.select("id", "least", "rows", F.coalesce("component", "id").alias("component"), (F.col("own") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    names = cut(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("_size")))
    named = cut(join_classes(named, names, ["component"], "_size").select("id", "rows", "n_links", "component_id"))
    told = join_classes(placed, named, ["id"], "rows").select("row", "n_links", "component_id")
    out = rows.select("row", "vec_id").join(told, "row", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"), share.alias("audit_recall"),
    )
