"""Approximate nearest neighbours: NN-descent builds a neighbour graph, greedy search walks it.

Equal vectors become one node first, so a vector that a third of the rows share is one node with its smallest ids.
Every round of NN-descent is a chain of joins: neighbours and reverse neighbours of a node meet at it, every pair
with a link that is new since the last round is compared there, and what beats a node's worst neighbour is merged
into its list. A node takes part in a bounded number of groups and a group holds a bounded number of members; the
lists are approximate by design, but every row is indexed and can be found. Queries start at their own node, expand
their best unexpanded nodes each round, and keep a bounded pool; the pool's head is ranked again on the original
vectors in double precision.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor
do rows without an id. Rows
that repeat an id and its vector count once. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import grouped
from .store import dropped, release, saved

#: Neighbours in a list; reverse neighbours that meet at a node; rounds; candidates that a group gives a member.
DEGREE, REVERSE, ROUNDS, GIVEN = 32, 32, 6, 10
#: Nodes that lie side by side in a random projection and are compared for the first lists; projections.
NEAR, PROJECTIONS = 64, 2
#: A query's pool, the nodes expanded in a round, rounds, and the part of the pool that is ranked exactly.
POOL, WIDTH, HOPS, EXACT = 192, 48, 7, 64
SEED = 11


def binary(rows: np.ndarray) -> pa.Array:
    """A binary column with one row's bytes each."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """The rows of a binary column whose values are equally long and not null."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def nodes_of(df: DataFrame, vec_id: str, embedding: str, kept: int) -> DataFrame:
    """(node, embedding, members): distinct usable vectors with the ``kept`` smallest ids of each.

    Vectors of another length than most have take no part.
    """
    clean = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    clean = clean.where(usable)
    lengths = clean.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    clean = clean.where(F.size("embedding") == (lengths[0]["length"] if lengths else 0))

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Before the shuffle, a batch's copies of a vector are one row with the smallest ids.
        for batch in batches:
            ids: dict[tuple, list[int]] = {}
            for v, e in zip(batch["vec_id"].to_pylist(), batch["embedding"].to_pylist(), strict=True):
                ids.setdefault(tuple(e), []).append(v)
            yield pa.RecordBatch.from_arrays([pa.array([list(e) for e in ids], pa.list_(pa.float64())), pa.array([sorted(set(v))[:kept] for v in ids.values()], pa.list_(pa.int64()))], names=["embedding", "members"])

    parts = clean.mapInArrow(summed, "embedding array<double>, members array<long>")
    merged = parts.groupBy("embedding").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))), 1, kept).alias("members"))
    return merged.select(F.xxhash64("embedding").alias("node"), "embedding", "members")


def unit(embeddings: list[list[float]]) -> np.ndarray:
    e = np.array(embeddings, np.float64)
    e = e / np.abs(e).max(1, keepdims=True)
    return (e / np.linalg.norm(e, axis=1, keepdims=True)).astype(np.float16)


EMPTY = np.zeros(0)
#: A node's list is held as three blobs: the neighbours' keys, similarities and whether they came in the last round.
GRAPH = "node long, vec binary, ids binary, sims binary, fresh binary"
PROPOSAL = "node long, other long, sim float"


def with_vectors(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                nothing = pa.array([b""] * b.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([b["node"], binary(unit(b["embedding"].to_pylist())), nothing, nothing, nothing], names=["node", "vec", "ids", "sims", "fresh"])

    return nodes.select("node", "embedding").mapInArrow(run, GRAPH)


def best(sims: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's n largest entries that aren't -inf."""
    n = min(n, sims.shape[1])
    cols = np.argpartition(-sims, n - 1, axis=1)[:, :n] if n < sims.shape[1] else np.broadcast_to(np.arange(n), sims.shape)
    rows = np.repeat(np.arange(len(sims)), n)
    cols = cols.ravel()
    good = sims[rows, cols] > -np.inf
    return rows[good], cols[good]


def proposals(node: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(other), pa.array(sim.astype(np.float32))], names=["node", "other", "sim"])


def first_lists(graph: DataFrame, k: int) -> DataFrame:
    """Proposals among nodes that lie side by side in a random projection."""

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b["vec"], np.float16).astype(np.float32)
                r = np.random.default_rng(SEED + k).standard_normal(v.shape[1]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b["node"], b["vec"], pa.array(v @ r)], names=["node", "vec", "at"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, node = matrix(b["vec"], np.float16).astype(np.float32), b["node"].to_numpy()
            for a in range(0, len(node), NEAR):
                s = v[a : a + NEAR] @ v[a : a + NEAR].T
                np.fill_diagonal(s, -np.inf)
                i, j = best(s, DEGREE)
                yield proposals(node[a : a + NEAR][i], node[a : a + NEAR][j], s[i, j])

    return graph.select("node", "vec").mapInArrow(project, "node long, vec binary, at float").repartitionByRange("at").sortWithinPartitions("at").mapInArrow(compare, PROPOSAL)


def merged(graph: DataFrame, offers: DataFrame) -> DataFrame:
    """The lists with what the proposals improve."""
    both = graph.select("*", F.lit(None).cast("long").alias("other"), F.lit(None).cast("float").alias("sim")).unionByName(
        offers.select("node", *[F.lit(None).cast("binary").alias(c) for c in ("vec", "ids", "sims", "fresh")], "other", "sim")
    )

    def f(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ends = [*starts[1:].tolist(), t.num_rows]
        own = t["other"].is_null().to_numpy()
        other, sim = t["other"].fill_null(0).to_numpy(), t["sim"].fill_null(0).to_numpy()
        node = t["node"].to_numpy()
        out = []
        for a, b in zip(starts.tolist(), ends, strict=True):
            at = a + int(own[a:b].argmax())
            if not own[at]:
                continue
            old, old_sims = np.frombuffer(t["ids"][at].as_py(), np.int64), np.frombuffer(t["sims"][at].as_py(), np.float32)
            keep = np.ones(b - a, bool)
            keep[at - a] = False
            ids, sims = np.concatenate([old, other[a:b][keep]]), np.concatenate([old_sims, sim[a:b][keep]])
            # Old entries come first among equals, so a repeated neighbour isn't fresh.
            _, firsts = np.unique(ids, return_index=True)
            order = firsts[np.lexsort((ids[firsts], -sims[firsts]))][:DEGREE]
            out.append((int(node[a]), t["vec"][at].as_py(), ids[order].tobytes(), sims[order].tobytes(), (order >= len(old)).tobytes()))
        kinds = (pa.int64(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["node", "vec", "ids", "sims", "fresh"])

    return both.repartition("node").sortWithinPartitions("node").mapInArrow(lambda batches: grouped(batches, "node", f), GRAPH)


MEMBER = "at long, member long, floor float, fresh boolean, reverse boolean, vec binary"


def meetings(graph: DataFrame) -> DataFrame:
    """(at, member, ...): each node goes to its neighbours as a reverse neighbour, and fetches them to itself."""

    def out(batches: Iterable[pa.RecordBatch], fetch: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                b = batch.slice(start, 512)
                ids = [np.frombuffer(x, np.int64) for x in b["ids"].to_pylist()]
                fresh = np.concatenate([np.frombuffer(x, bool) for x in b["fresh"].to_pylist()]) if ids else EMPTY
                n = np.array([len(x) for x in ids], np.int64)
                row = np.repeat(np.arange(len(ids)), n)
                to, me = np.concatenate(ids) if ids else EMPTY.astype(np.int64), b["node"].to_numpy()[row]
                if fetch:
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(me), pa.array(fresh)], names=["node", "at", "fresh"])
                    continue
                # A list that isn't full takes anything.
                floor = np.array([np.frombuffer(x, np.float32)[-1] if len(x) == 4 * DEGREE else -2 for x in b["sims"].to_pylist()], np.float32)
                vec = b["vec"].take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(me), pa.array(floor[row]), pa.array(fresh), pa.array(np.ones(len(me), bool)), vec], names=["at", "member", "floor", "fresh", "reverse", "vec"])

    reverse = graph.mapInArrow(lambda batches: out(batches, False), MEMBER)
    asked = graph.mapInArrow(lambda batches: out(batches, True), "node long, at long, fresh boolean")

    def head(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            floor = [np.frombuffer(x, np.float32)[-1] if len(x) == 4 * DEGREE else -2 for x in b["sims"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(floor, pa.float32()), b["vec"]], names=["node", "floor", "vec"])

    heads = graph.mapInArrow(head, "node long, floor float, vec binary")
    forward = asked.join(heads, "node").select("at", F.col("node").alias("member"), "floor", "fresh", F.lit(False).alias("reverse"), "vec")
    return reverse.unionByName(forward)


def compared(members: DataFrame) -> DataFrame:
    """Proposals from pairs that meet at a node and of which at least one link to it is fresh."""

    def f(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        v = matrix(t["vec"].combine_chunks(), np.float16)
        member, floor = t["member"].to_numpy(), t["floor"].to_numpy()
        fresh, reverse = t["fresh"].to_numpy(), t["reverse"].to_numpy()
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
            if not fresh[a:b].any():
                continue
            # Forward links come first, then fresh ones; a member that is both counts once. Reverse ones beyond the bound wait.
            order = a + np.lexsort((member[a:b], ~fresh[a:b], reverse[a:b]))
            _, first = np.unique(member[order], return_index=True)
            order = order[np.sort(first)]
            order = np.concatenate([order[~reverse[order]], order[reverse[order]][:REVERSE]])
            if len(order) < 2:
                continue
            m = v[order].astype(np.float32)
            s = m @ m.T
            np.fill_diagonal(s, -np.inf)
            f = fresh[order]
            s[~(f[:, None] | f[None, :]) | (s <= floor[order][:, None])] = -np.inf
            i, j = best(s, GIVEN)
            made.append((member[order][i], member[order][j], s[i, j]))
        return proposals(*(np.concatenate(x) for x in zip(*made, strict=True))) if made else None

    return members.repartition("at").sortWithinPartitions("at").mapInArrow(lambda batches: grouped(batches, "at", f), PROPOSAL)


def build_graph(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph of a saved table of nodes, saved; earlier rounds are deleted."""
    graph = with_vectors(nodes)
    offers = first_lists(graph, 0)
    for k in range(1, PROJECTIONS):
        offers = offers.unionByName(first_lists(graph, k))
    graph = saved(merged(graph, offers))
    for _ in range(rounds):
        new = saved(merged(graph, compared(meetings(graph))))
        dropped(graph)
        graph = new
        release(graph.sparkSession)
    return graph


# Search. A query's pool is held as blobs of keys, similarities, and whether each was expanded.

STATE = "node long, vec binary, ids binary, sims binary, open binary"


def links(graph: DataFrame) -> DataFrame:
    """(node, other): neighbours in either direction; reverse ones up to a bound, the most similar first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, np.int64) for x in b["ids"].to_pylist()]
            if ids:
                row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
                sims = np.concatenate([np.frombuffer(x, np.float32) for x in b["sims"].to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(b["node"].to_numpy()[row]), pa.array(np.concatenate(ids)), pa.array(sims)], names=["node", "other", "sim"])

    edges = graph.mapInArrow(run, PROPOSAL)

    def f(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        node, other, sim, back = t["node"].to_numpy(), t["other"].to_numpy(), t["sim"].to_numpy(), t["back"].to_numpy()
        out_node, out_lists = [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
            order = a + np.lexsort((other[a:b], -sim[a:b], back[a:b]))
            order = np.concatenate([order[~back[order]], order[back[order]][:REVERSE]])
            out_node.append(int(node[a]))
            out_lists.append(np.unique(other[order]).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out_node, pa.int64()), pa.array(out_lists, pa.binary())], names=["node", "others"])

    both = edges.withColumn("back", F.lit(False)).unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "sim", F.lit(True).alias("back")))
    return both.repartition("node").sortWithinPartitions("node").mapInArrow(lambda batches: grouped(batches, "node", f), "node long, others binary")


def hop(state: DataFrame, adjacent: DataFrame, vectors: DataFrame) -> DataFrame:
    """Expands each query's best open nodes and merges what is found there into its pool."""

    def frontier(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, to = [], []
            for node, ids, open_ in zip(b["node"].to_pylist(), b["ids"].to_pylist(), b["open"].to_pylist(), strict=True):
                best_open = np.frombuffer(ids, np.int64)[np.frombuffer(open_, bool)][:WIDTH].tolist()
                q += [node] * len(best_open)
                to += best_open
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(to, pa.int64())], names=["query", "node"])

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.frombuffer(x, np.int64) for x in b["others"].to_pylist()]
            if lists:
                row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                yield pa.RecordBatch.from_arrays([pa.array(b["query"].to_numpy()[row]), pa.array(np.concatenate(lists))], names=["query", "node"])

    reached = state.mapInArrow(frontier, "query long, node long").join(adjacent, "node").select("query", "others").mapInArrow(expand, "query long, node long").distinct()
    met = reached.join(vectors, "node").select(F.col("query").alias("node"), F.col("node").alias("other"), F.col("vec").alias("other_vec"))
    both = state.select("*", F.lit(None).cast("long").alias("other"), F.lit(None).cast("binary").alias("other_vec")).unionByName(
        met.select("node", *[F.lit(None).cast("binary").alias(c) for c in ("vec", "ids", "sims", "open")], "other", "other_vec")
    )

    def f(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        own, other = t["other"].is_null().to_numpy(), t["other"].fill_null(0).to_numpy()
        node, vecs, out = t["node"].to_numpy(), t["other_vec"], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
            at = a + int(own[a:b].argmax())
            old, old_sims, old_open = (np.frombuffer(t[c][at].as_py(), k) for c, k in (("ids", np.int64), ("sims", np.float32), ("open", bool)))
            # What was open and among the best has been expanded now.
            now_open = old_open.copy()
            now_open[np.flatnonzero(old_open)[:WIDTH]] = False
            keep = np.flatnonzero(~own[a:b]) + a
            ids, sims, opens = old, old_sims, now_open
            if len(keep):
                q = np.frombuffer(t["vec"][at].as_py(), np.float16).astype(np.float32)
                m = matrix(vecs.take(pa.array(keep)).combine_chunks(), np.float16).astype(np.float32)
                ids, sims, opens = np.concatenate([old, other[keep]]), np.concatenate([old_sims, m @ q]), np.concatenate([now_open, np.ones(len(keep), bool)])
            _, firsts = np.unique(ids, return_index=True)
            order = firsts[np.lexsort((ids[firsts], -sims[firsts]))][:POOL]
            out.append((int(node[a]), t["vec"][at].as_py(), ids[order].tobytes(), sims[order].tobytes(), opens[order].tobytes()))
        kinds = (pa.int64(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["node", "vec", "ids", "sims", "open"])

    return both.repartition("node").sortWithinPartitions("node").mapInArrow(lambda batches: grouped(batches, "node", f), STATE)


def search(graph: DataFrame, wanted: DataFrame, hops: int = HOPS) -> DataFrame:
    """Pools of the wanted nodes, which are some of the graph's; a walk starts at the node itself."""
    adjacent, vectors = saved(links(graph)), graph.select("node", "vec")

    def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, yes = np.ones(1, np.float32).tobytes(), np.ones(1, bool).tobytes()
        for b in batches:
            n = b.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([b["node"], b["vec"], binary(b["node"].to_numpy()[:, None]), pa.array([one] * n, pa.binary()), pa.array([yes] * n, pa.binary())], names=["node", "vec", "ids", "sims", "open"])

    state = saved(vectors.join(wanted.select("node").distinct(), "node", "left_semi").mapInArrow(start, STATE))
    for _ in range(hops):
        new = saved(hop(state, adjacent, vectors))
        dropped(state)
        state = new
        release(graph.sparkSession)
    return state


def nearest(df: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row for which ``is_query(vec_id column)`` holds."""
    nodes = saved(nodes_of(df, vec_id, embedding, k + 1))
    keyed = df.select(F.col(vec_id).cast("long").alias("query_id"), F.xxhash64(F.col(embedding).cast("array<double>")).alias("node")).where(is_query(F.col("query_id")))
    asked = saved(keyed.distinct().join(nodes.select("node"), "node", "left_semi"))
    graph = build_graph(nodes)
    pools = search(graph, asked)

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, np.int64)[:EXACT] for x in b["ids"].to_pylist()]
            if ids:
                row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
                yield pa.RecordBatch.from_arrays([pa.array(b["node"].to_numpy()[row]), pa.array(np.concatenate(ids))], names=["query", "node"])

    found = pools.select("node", "ids").mapInArrow(heads, "query long, node long").join(nodes, "node")
    asking = nodes.select(F.col("node").alias("query"), F.col("embedding").alias("own"))
    pairs = found.join(asking, "query").select("query", "own", "embedding", "members")

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = np.array(b["own"].to_pylist(), np.float64), np.array(b["embedding"].to_pylist(), np.float64)
                score = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                yield pa.RecordBatch.from_arrays([b["query"], b["members"], pa.array(score)], names=["query", "members", "score"])

    scored = pairs.mapInArrow(exact, "query long, members array<long>, score double")
    # A node's best k + 1 serve each of its rows, which leave themselves out.
    item = F.transform("members", lambda m: F.struct((-F.col("score")).alias("far"), m.alias("vec_id")))
    tops = scored.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list(item))), 1, k + 1).alias("top"))
    mine = asked.join(tops, asked["node"] == tops["query"]).select("query_id", F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("top"))
    rows = mine.select("query_id", F.posexplode("top").alias("at", "x"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
