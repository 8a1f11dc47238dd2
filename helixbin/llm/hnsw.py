"""Embedding near-dedup: a navigable small-world graph per shard, every shard asked for every vector.

1. Equal vectors form one point with a multiplicity; null and zero vectors, and vectors with null or
   non-finite components, link with nothing.
2. Points are dealt into shards of bounded size by a hash of the vector. ``Graph`` builds a shard's hierarchy:
   levels drawn by id, each inserted in blocks, neighbours chosen by the usual diversity rule.
3. A recall audit compares ``AUDIT`` queries with brute force in each shard; while it fails, the shard's beam doubles.
   Graphs are files in the shared scratch space; every block of points goes through every shard's graph, many blocks a task. A
   beam still full of neighbours near the threshold is widened until its worst lies below it, so dense groups lose nothing.
4. Cosines are confirmed in double precision. Links are counted with multiplicities and their components
   united without moving all links of a dense group: each search task folds its links into a forest, chunk by chunk.

A vector links only with vectors of its own length. Very long vectors make smaller shards. Extra columns are ignored. Rows of equal id share a component and the links of all their vectors, and don't link with each other. Rows with a null
id have no component and link with nothing. An empty table gives no rows.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, components, forest, remove, scratch, short_batches

M = 12
SHARD = 65_536  # points at most; fewer shards mean fewer searches for each vector
SHARD_BYTES = 256 << 20  # of a shard's vectors, at most
BLOCK = 1024
TASKS = 4096  # of a search, at most
BEAM = 32
AUDIT = 256  # queries of a shard's audit
SEEN, PAIRS = 48_000_000, 4_000_000  # a chunk's marks of seen points, and its compared pairs
LINK_RECALL = 0.995
NEAREST_RECALL = 0.95
NEAR = 0.3
MARGIN = 1e-6
SLACK = 0.1  # a beam is widened until its worst lies this far below the threshold
WHOLE = 4  # a beam whose square is so many times the shard costs more steps than one product with the whole shard


class Graph:
    """A hierarchical navigable small-world graph over unit vectors (float32 for the search alone)."""

    def __init__(self, unit: np.ndarray, m: int = M, build_beam: int = 40, seed: int = 11) -> None:
        self.x = np.ascontiguousarray(unit, np.float32)
        n = len(unit)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n)) / np.log(m)).astype(int), 5)
        self.order = np.argsort(-level, kind="stable")  # high levels first: their graph guides the rest
        self.level = level
        top = int(level.max(initial=0))
        self.layers: list[np.ndarray] = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(top + 1)]
        self.m = m
        self.loose = np.zeros(0, np.int64)  # points that the graph doesn't lead to, compared with every query
        self.entry = int(self.order[0]) if n else -1
        done = 1
        while done < n:
            # A block is searched in the graph so far and among itself, then joined.
            block = self.order[done : done + max(1, min(done, 512))]
            block = block[level[block] == level[block[0]]]
            self._insert(block, build_beam, self.order[:done])
            done += len(block)
        if n:
            self._repair()

    def _insert(self, block: np.ndarray, beam: int, before: np.ndarray) -> None:
        high = int(self.level[block[0]])
        top = int(self.level[self.entry])
        start = np.full((len(block), 1), self.entry, np.int32)
        for k in range(top, -1, -1):
            found, score = self._search(self.x[block], start, beam if k <= high else 1, k)
            start = found[:, : max(1, min(4, found.shape[1]))]
            if k <= high:
                own = self.x[block] @ self.x[block].T
                np.fill_diagonal(own, -2)
                take = min(len(block) - 1, 16)
                if take > 0:
                    near = np.argpartition(-own, take - 1, axis=1)[:, :take]
                    found = np.concatenate([found, block[near].astype(np.int32)], 1)
                    score = np.concatenate([score, np.take_along_axis(own, near, 1)], 1)
                self._join(block, found, score, k)

    def _repair(self) -> None:
        """Gives points that only far ones link to a link from their nearest, and points that no walk reaches
        in layer 0 one from the nearest point that a walk does reach.

        A host has ``2 * m`` slots for such links. What would go beyond them, as round a centre that is everyone's nearest, is ``loose``: the
        memory of a shard stays linear, and no point is lost.
        """
        table, n = self.layers[0], len(self.x)
        slots, used, loose = np.full((n, 2 * self.m), -1, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
        host, slot = np.nonzero(table >= 0)
        to = table[host, slot]
        score = np.einsum("ij,ij->i", self.x[host], self.x[to])
        best_in, best_out = np.full(n, -2.0, np.float32), np.full(n, -2.0, np.float32)
        np.maximum.at(best_in, to, score)
        np.maximum.at(best_out, host, score)
        far = best_in < best_out - 0.02
        at = far[host] & (score >= best_out[host])
        order = np.lexsort((-score[at], to[at]))
        owner, point = to[at][order], host[at][order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        fits = place < slots.shape[1]
        slots[owner[fits], place[fits]] = point[fits]
        np.maximum.at(used, owner[fits], place[fits] + 1)
        loose[point[~fits]] = True
        loose[point[fits]] = False  # a tie gave it another host
        reached, front = np.zeros(n, bool), np.array([self.entry])
        reached[front] = True
        while True:
            while len(front):
                near = np.unique(np.concatenate([table[front], slots[front]], 1))
                front = near[near >= 0]
                front = front[~reached[front]]
                reached[front] = True
            lost = np.flatnonzero(~reached & ~loose)
            if not len(lost):
                break
            # The lost points nearest to reached ones come first; their own links may reach the others.
            inside = np.flatnonzero(reached & (used < slots.shape[1]))
            some = lost[:512]
            if not len(inside):
                loose[some] = True
                continue
            score = self.x[some] @ self.x[inside].T
            best = int(score.max(1).argmax())
            owner = int(inside[score[best].argmax()])
            slots[owner, used[owner]] = some[best]
            used[owner] += 1
            front = np.array([some[best]])
            reached[front] = True
        self.loose = np.flatnonzero(loose)
        if used.any():
            self.layers[0] = np.concatenate([table, slots[:, : used.max()]], 1)

    def _pick(self, center: np.ndarray, found: np.ndarray, score: np.ndarray, width: int) -> np.ndarray:
        """Diverse neighbours, nearest first; what diversity leaves free is filled by the nearest left."""
        order = np.argsort(-score, kind="stable")
        found, score = found[order], score[order]
        ok = found >= 0
        found, score = found[ok], score[ok]
        found, first = np.unique(found, return_index=True)
        by = np.argsort(first)
        found, score = found[by], score[np.sort(first)]
        if len(found) <= width:
            return found
        inner = self.x[found] @ self.x[found].T
        chosen: list[int] = []
        worst = np.full(len(found), -2.0, np.float32)  # the best similarity to what is chosen already
        for i in range(len(found)):
            if worst[i] < score[i]:
                chosen.append(i)
                np.maximum(worst, inner[i], out=worst)
                if len(chosen) == width:
                    break
        if len(chosen) < width:
            left = np.setdiff1d(np.arange(len(found)), chosen)
            chosen += left[: width - len(chosen)].tolist()
        return found[chosen]

    def _join(self, block: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> None:
        table = self.layers[k]
        width = table.shape[1]
        back: dict[int, list[int]] = {}
        for i, node in enumerate(block):
            keep = self._pick(node, found[i], score[i], self.m)
            table[node, : len(keep)] = keep
            for other in keep.tolist():
                back.setdefault(other, []).append(int(node))
        for node, new in back.items():
            old = table[node]
            both = np.unique(np.concatenate([old[old >= 0], np.array(new, np.int32)]))
            if len(both) > width:
                both = self._pick(node, both, self.x[both] @ self.x[node], width)
            table[node] = -1
            table[node, : len(both)] = both

    def _search(self, q: np.ndarray, start: np.ndarray, beam: int, k: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """A beam search of many queries at once in layer ``k``: ids and similarities, best first, -1 where none."""
        table, n = self.layers[k], len(q)
        seen = np.zeros((n, len(self.x)), bool)
        rows = np.arange(n)
        ids = np.full((n, beam), -1, np.int32)
        sim = np.full((n, beam), -2.0, np.float32)
        fresh = np.zeros((n, beam), bool)  # not expanded yet
        ids, sim, fresh = self._merge(q, rows, start, ids, sim, fresh, seen, beam)
        live = rows
        while len(live):
            best = np.where(fresh[live], sim[live], -3.0)
            step = min(4, beam)
            pick = np.argpartition(-best, step - 1, axis=1)[:, :step]
            good = np.take_along_axis(best, pick, 1) > -3.0
            some = good.any(1)
            live, pick, good = live[some], pick[some], good[some]
            if not len(live):
                break
            at = ids[live[:, None], pick]
            fresh[live[:, None], pick] &= ~good
            near = np.where(good[:, :, None], table[at], -1).reshape(len(live), -1)
            i, s, f = self._merge(q[live], live, near, ids[live], sim[live], fresh[live], seen, beam)
            ids[live], sim[live], fresh[live] = i, s, f
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)

    def _merge(self, q, rows, near, ids, sim, fresh, seen, beam):
        near = np.sort(near, axis=1)
        ok = near >= 0
        ok[:, 1:] &= near[:, 1:] != near[:, :-1]
        ok &= ~seen[rows[:, None], near]
        width = int(ok.sum(1).max(initial=0))
        if not width:
            return ids, sim, fresh
        order = np.argsort(~ok, axis=1, kind="stable")[:, :width]
        near, ok = np.take_along_axis(near, order, 1), np.take_along_axis(ok, order, 1)
        r, c = np.nonzero(ok)
        seen[rows[r], near[r, c]] = True
        score = np.full(near.shape, -2.0, np.float32)
        score[r, c] = np.einsum("ij,ij->i", self.x[near[r, c]], q[r])
        ids = np.concatenate([ids, np.where(ok, near, -1)], 1)
        sim = np.concatenate([sim, score], 1)
        fresh = np.concatenate([fresh, ok], 1)
        if ids.shape[1] > beam:
            keep = np.argpartition(-sim, beam - 1, axis=1)[:, :beam]
            ids, sim, fresh = (np.take_along_axis(x, keep, 1) for x in (ids, sim, fresh))
        return ids, sim, fresh

    @classmethod
    def restored(cls, unit: np.ndarray, layers: list[np.ndarray], entry: int, loose: np.ndarray) -> Graph:
        self = cls.__new__(cls)
        self.x, self.layers, self.entry, self.loose = np.ascontiguousarray(unit, np.float32), layers, entry, loose
        return self

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q = np.ascontiguousarray(q, np.float32)
        start = np.full((len(q), 1), self.entry, np.int32)
        for k in range(len(self.layers) - 1, 0, -1):
            start = self._search(q, start, 4, k)[0]
        return self._search(q, start, min(beam, len(self.x)), 0)


def audit(graph: Graph, unit: np.ndarray, q: np.ndarray, threshold: float, beam: int = BEAM) -> tuple[int, float]:
    """The beam, doubled until the search passes the recall audit of queries ``q``, and the recall it reached.

    Brute force gives the truth: ``LINK_RECALL`` of the queries' links have to be found, and ``NEAREST_RECALL`` of
    their nearest points that come near the threshold.
    """
    n = len(unit)
    if not n or not len(q):
        return beam, 1.0
    cosine = q @ unit.T
    best, total = cosine.max(1), int((cosine >= threshold).sum())
    near = best >= threshold - NEAR
    while True:
        found, first = 0, np.full(len(q), -2.0)
        for part, _, p, nearest in _searched(graph, unit, q, threshold, min(beam, n)):
            found += len(p)
            first[part] = np.maximum(first[part], nearest)
        recall = min(found / total if total else 1.0, float((first >= best - MARGIN)[near].mean()) if near.any() else 1.0)
        if (found >= LINK_RECALL * total and (not near.any() or (first >= best - MARGIN)[near].mean() >= NEAREST_RECALL)) or beam >= n:
            return beam, recall
        beam *= 2


def _searched(graph: Graph, unit: np.ndarray, q: np.ndarray, threshold: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunk by chunk: the queries asked, (query, point) of links at or above the threshold, and the queries' best similarities.

    Every query goes through the graph. One whose beam is full of near neighbours lies in a dense group and asks again with a
    beam four times as wide; where that beam's square is ``WHOLE`` times the shard, the whole shard is its beam, compared as one product.
    """
    n = len(unit)
    todo, width = np.arange(len(q)), min(beam, n)
    apart = np.zeros(n, bool)
    apart[graph.loose] = True
    for k in range(0, len(q), step := max(16, PAIRS // max(1, len(graph.loose)))) if len(graph.loose) else ():
        part = np.arange(k, min(k + step, len(q)))
        full = q[part] @ unit[graph.loose].T
        a, p = np.nonzero(full >= threshold)
        yield part, part[a], graph.loose[p], full.max(1)
    while len(todo):
        rest = []
        whole = width > beam and (width * width >= WHOLE * n or 2 * width >= n)
        chunk = max(16, (PAIRS if whole else SEEN) // n)
        for k in range(0, len(todo), chunk):
            part = todo[k : k + chunk]
            if whole:
                full = q[part] @ unit.T
                a, p = np.nonzero((full >= threshold) & ~apart)
                yield part, part[a], p, full.max(1)
                continue
            ids, sim = graph.search(q[part], width)
            more = (sim[:, -1] >= threshold - SLACK) & (width < n)
            rest.append(part[more])
            a, c = np.nonzero((sim >= threshold - MARGIN) & ~more[:, None])
            p = ids[a, c]
            sure = (np.einsum("ij,ij->i", q[part[a]], unit[p]) >= threshold) & ~apart[p]
            yield part, part[a][sure], p[sure], sim[:, 0].astype(float)
        todo = np.concatenate(rest) if rest else np.zeros(0, int)
        width = min(4 * width, n)


def links_in_shard(graph: Graph, unit: np.ndarray, q: np.ndarray, threshold: float, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) pairs at or above the threshold by double-precision cosine, a bounded number at a time.

    ``unit`` and ``q`` are unit vectors in double precision.
    """
    for _, a, p, _ in _searched(graph, unit, q, threshold, beam):
        if len(a):
            yield a, p


def _unit(values: np.ndarray) -> np.ndarray:
    x = values / np.abs(values).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrices(group: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of the group and their unit vectors, for each length of vector."""
    lists = group.column("v").combine_chunks()
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    out = []
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out.append((rows, _unit(flat[offsets[rows][:, None] + np.arange(d)])))
    return out


def _save(path: str, **arrays: np.ndarray) -> None:
    store, at = fs.FileSystem.from_uri(path)
    held = io.BytesIO()
    np.savez(held, **arrays)
    with store.open_output_stream(at) as out:
        out.write(held.getbuffer())


@lru_cache(maxsize=1)
def _graph(path: str) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    unit, ids, copies, layers, entry, loose = _points(path)
    return Graph.restored(unit, layers, entry, loose), unit, ids, copies


@lru_cache(maxsize=2)
def _points(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], int, np.ndarray]:
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        z = np.load(io.BytesIO(f.read()))
        return z["unit"], z["ids"], z["copies"], [z[f"layer{k}"] for k in range(int(z["layers"]))], int(z["entry"]), z["loose"]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``id_col, n_links, component_id, kept``, and ``recall``, the least audited recall of a shard."""
    spark = vectors.sparkSession
    short_batches(spark, 4096)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # Adding zero makes a negative zero a zero.
    rows = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.transform(v, lambda x: x + F.lit(0.0))))
    named = Written(rows.withColumn("key", F.when(v.isNotNull(), F.sha2(F.array_join(F.transform(v, lambda x: x.cast("string")), ","), 256))))
    points = named.df.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    points = Written(points)
    size = points.df.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    shards = max(1, -(-size["n"] // max(1, min(shard, SHARD_BYTES // (8 * (size["dim"] or 1))))))
    folder = f"{scratch(spark)}/helixbin-hnsw-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    # The audit's queries: a fixed number, whatever the input, drawn by a hash of the vector.
    asked = [np.array(r["v"]) for r in points.df.select("v").orderBy(F.xxhash64("key", F.lit(7)), "key").limit(AUDIT).collect()]

    def build(group: pa.Table) -> pa.Table:
        ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
        out = []
        for r, unit in _matrices(group):
            g, path = Graph(unit), f"{folder}/{uuid.uuid4().hex}.npz"
            own = [x for x in asked if len(x) == unit.shape[1]]
            beam, recall = audit(g, unit, _unit(np.stack(own)) if own else unit[:0], threshold)
            _save(path, unit=unit, ids=ids[r], copies=copies[r], entry=np.array(g.entry), loose=g.loose, layers=np.array(len(g.layers)), **{f"layer{k}": t for k, t in enumerate(g.layers)})
            out.append({"path": path, "dim": unit.shape[1], "n": len(unit), "beam": beam, "recall": recall})
        return pa.Table.from_pylist(out, schema=pa.schema([("path", pa.string()), ("dim", pa.int64()), ("n", pa.int64()), ("beam", pa.int64()), ("recall", pa.float64())]))

    # Shards are dealt by range, so that no two of them meet in a task.
    dealt = points.df.select("id", "copies", "v", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("s")).repartitionByRange(shards, "s")
    built = Written(dealt.groupBy("s").applyInArrow(build, "path string, dim long, n long, beam long, recall double"))
    graphs = built.df.orderBy("path").collect()  # a row for each shard
    # Every block of points is asked in every shard of its dimension. A search's number gives the shard, then the block; tasks take runs
    # of them, so that a shard's graph is read once for many blocks.
    own = {d: [g for g in graphs if g["dim"] == d] for d in {g["dim"] for g in graphs}}
    blocks = {d: np.cumsum([0, *(-(-g["n"] // block) for g in gs)]) for d, gs in own.items()}
    asking = {d: [(g["path"], g["n"]) for g in gs] for d, gs in own.items()}
    asked_in = [(g["path"], g["dim"], g["beam"]) for g in graphs]
    first = np.cumsum([0, *(int(blocks[g["dim"]][-1]) for g in graphs)])
    searches = int(first[-1])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                i = int(np.searchsorted(first, t, "right")) - 1
                path, dim, beam = asked_in[i]
                at = t - int(first[i])
                j = int(np.searchsorted(blocks[dim], at, "right")) - 1
                low = (at - int(blocks[dim][j])) * block
                graph, unit, own, copies = _graph(path)
                q, ids = (x[low : low + block] for x in _points(asking[dim][j][0])[:2])
                count, parts = np.zeros(len(ids), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for a, p in links_in_shard(graph, unit, q, threshold, beam):
                    other = ids[a] != own[p]
                    a, p = a[other], p[other]
                    count += np.bincount(a, copies[p], len(ids)).astype(np.int64)
                    parts.append(forest(ids[a], own[p]))
                    if len(parts) > 32:
                        parts = [forest(*(np.concatenate(x) for x in zip(*parts)))]
                x, y = forest(*(np.concatenate(x) for x in zip(*parts)))
                blank = np.zeros(len(x), np.int64)
                yield pa.record_batch([pa.array(np.concatenate([ids, x])), pa.array(np.concatenate([ids, y])), pa.array(np.concatenate([count, blank]))], names=["id", "low", "n"])

    found = Written(spark.range(0, searches, 1, max(1, min(searches, TASKS))).mapInArrow(search, "id long, low long, n long"))
    remove(spark, folder)
    recall = min((g["recall"] for g in graphs), default=1.0)
    count = found.df.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.df, "id", "low").select(F.col("node").alias("id"), "component")
    point = points.df.select("key", "id", "copies").join(count, "id", "left").join(joined, "id", "left").select("key", F.col("id").alias("first"), "copies", "n", "component")
    out = named.df.select("id", "key").join(point, "key", "left")
    component = F.coalesce("component", "first", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        F.lit(recall).alias("recall"),
    )


def report(embeddings: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``embeddings``, and the audited recall to three digits."""
    return near_duplicates(embeddings.select("vec_id", "embedding"), threshold=0.95).withColumn("recall", F.round("recall", 3))


def oracle() -> str:
    """The contract's columns in DuckDB's SQL, by all pairs; ``recall`` is 1, as far as the audit tells."""
    return """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r(vec_id, node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.node = e.a),
k AS (SELECT vec_id, min(node) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept, CAST(1.0 AS DOUBLE) AS recall FROM k LEFT JOIN n USING (vec_id)"""
