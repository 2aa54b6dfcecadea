"""Near-duplicate documents by SimHash at a similarity of word shingles, through anchors of a covering code.

At a Jaccard similarity of 0.8 two 64-bit SimHashes differ in about ten bits, too many for one covering code. A
document's distinct shingles therefore give 768 bits, of which sixteen tables take 46 each. In a table the anchors
are the code words of two Golay blocks, and a document is at home at the nearest one.

The sketches only propose links; each one is confirmed by the exact Jaccard similarity of the two shingle sets. Those at
home at the same anchor are proposed first, a spanning forest for each meeting. What that misses shares one of its
rarest shingles: of n shingles, two similar sets share one of the n - ceil(n * similarity) + 1 that come first in any
fixed order. So sets that share such a shingle meet there, and are looked at for what crosses from one component to
another: every such pair over the sketches, with a cut four standard deviations beyond the average distance at the
given similarity. These pairs aren't listed, as their number grows with the square of a group that is nearly similar;
a spanning forest of them tells who must meet, and where a group's sets meet all its close pairs are decided exactly.
A shingle that only one set has brings nobody together; so most documents of natural text are in no such meeting.

Meetings of more than ``CROWD`` are split: chunks of bounded size are linked by themselves, then their components'
first members, and whoever is left outside the largest component is compared with every chunk. That loses no link
that one comparison of all would find.

Bits of small sets differ more often than that average, since ties count as zeros; so sets of up to ``FEW`` shingles
are joined exactly as well, by their rarest shingles.

Equal shingle sets are one document before all that. Texts without words are alike. Rows without a doc_id aren't
compared with others.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType

from .arrow import fields, give_back, grouped, map_columns, pieces, small_batches
from .components import components
from .simhash import FREE, LENGTH, homes, shingle_hashes
from .store import dropped, saved, temporary

SHINGLE, SIMILARITY = 5, 0.8
WORDS, TABLES = 12, 16
BITS, BYTES = 64 * WORDS, 8 * WORDS
#: Bits of the first comparison, and how many standard deviations beyond the average it lets pass.
CHECK_BITS, DEVIATIONS = 128, 5
#: The same over all bits, for pairs that the exact sets decide.
MARGIN = 4
#: Sets of up to so many shingles are joined exactly with all others.
FEW = 24
#: Meetings of more than so many are split into chunks of about so many.
CROWD = 20_000
#: Pairs of one document that are confirmed in one place.
CELL = 128
#: Shingles of one block of a group whose pairs are decided where they meet. Smaller groups are split as well, into
#: up to ``SPREAD`` blocks of ``LEAST`` shingles, so that several tasks decide them.
HELD, SPREAD, LEAST = 1 << 19, 8, 1 << 15
#: Shingles that one task counts at once, and that a task deals out at once.
COUNTED, DEALT = 1 << 20, 1 << 19
#: Bits of a shingle's hash that are kept beside the number of its bucket.
KEPT_BITS = 48

STEPS = np.random.default_rng(41).integers(0, 1 << 64, WORDS, np.uint64)
#: Byte -> its bits in eight lanes of a byte each, so that lanes of up to 255 rows can be summed at once.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64)[:, 0]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes in order; a shorter text is one shingle, one without words has none."""
    return np.unique(shingle_hashes(text, size))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two shingle sets have at least that Jaccard similarity."""
    n, m = len(a), len(b)
    if min(n, m) < similarity * max(n, m) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (n + m - both) - 1e-9


def sketch(h: np.ndarray) -> bytes:
    """The bits set in more than half of a shingle set's hashes."""
    sums = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 2040):
        part = mixed(h[at : at + 2040, None] + STEPS)
        lanes = LANES[part.view(np.uint8)]
        summed = np.add.reduceat(lanes, np.arange(0, len(part), 255), axis=0)
        sums += summed.view(np.uint8).reshape(len(summed), BITS).sum(0, dtype=np.int64)
    return np.packbits(2 * sums > len(h)).tobytes()


def differing(similarity: float, bits: int, deviations: float = 0) -> int:
    """In how many bits sketches of sets of a given Jaccard similarity differ on average, or so many deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def table_blocks(bits: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    powers = 1 << np.arange(LENGTH - 1, -1, -1)
    first = 2 * LENGTH * table
    return bits[:, first : first + LENGTH] @ powers, bits[:, first + LENGTH : first + 2 * LENGTH] @ powers


def anchors_at_home(bits: np.ndarray, table: int) -> np.ndarray:
    a, b = table_blocks(bits, table)
    return table << 2 * FREE | homes(a) << FREE | homes(b)


def bit_rows(column: pa.Array) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BYTES), axis=1).astype(np.int64)


def first_bits():
    return F.substring("sketch", 1, CHECK_BITS // 8).alias("check")


def at_home(sketches: DataFrame) -> DataFrame:
    """(anchor, id, check): a row for each table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                bits = bit_rows(part["sketch"])
                anchors = np.concatenate([anchors_at_home(bits, t) for t in range(TABLES)])
                row = pa.array(np.tile(np.arange(len(bits)), TABLES))
                yield pa.RecordBatch.from_arrays([pa.array(anchors), part["id"].take(row), part["check"].take(row)], names=["anchor", "id", "check"])

    return sketches.select("id", "sketch", first_bits()).mapInArrow(run, "anchor long, id long, check binary")


def identity(h: np.ndarray) -> tuple[bytes, int]:
    """What stands for a shingle set: a digest, and its first eight bytes."""
    digest = xxhash.xxh3_128_digest(h.tobytes())
    return digest, int.from_bytes(digest[:8], "little", signed=True)


def dealt_shingles(rows: DataFrame, size: int, bits: int) -> DataFrame:
    """(bucket, tokens, keys, runs): the texts' distinct shingles, packed by the first ``bits`` bits of their hashes.

    A key is kept once for the run of its tokens.
    """

    def packed(sets: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
        h, owner = np.concatenate(sets), np.repeat(np.array(keys, np.int64), [len(x) for x in sets])
        bucket = (h >> np.uint64(64 - bits)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bucket, owner = bucket[order], owner[order]
        tokens = (h[order] >> np.uint64(64 - bits - KEPT_BITS)).view(np.uint8).reshape(-1, 8)[:, : KEPT_BITS // 8]
        changed = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        runs = np.flatnonzero(changed | np.concatenate([[True], owner[1:] != owner[:-1]]))
        lengths, owner = np.diff(np.append(runs, len(bucket))).astype(np.int32), owner[runs]
        starts = np.flatnonzero(changed)
        spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True))
        first = np.searchsorted(runs, starts)
        of = list(zip(first.tolist(), [*first[1:].tolist(), len(runs)], strict=True))
        made = [pa.array(bucket[starts].astype(np.int64)), pa.array([tokens[a:b].tobytes() for a, b in spans], pa.binary()), *[pa.array([x[a:b].tobytes() for a, b in of], pa.binary()) for x in (owner, lengths)]]
        return pa.RecordBatch.from_arrays(made, names=["bucket", "tokens", "keys", "runs"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        n = 0
        for part in pieces(batches):
            for text in part["text"].to_pylist():
                h = shingle_set(text, size)
                key = identity(h)[1]
                if len(h) and key not in held:
                    held[key] = h
                    n += len(h)
                if n >= DEALT:
                    yield packed(list(held.values()), list(held))
                    held, n = {}, 0
        if held:
            yield packed(list(held.values()), list(held))
        del held
        give_back()

    return rows.select("text").mapInArrow(run, "bucket long, tokens binary, keys binary, runs binary")


def shared_shingles(dealt: DataFrame) -> DataFrame:
    """(key, token, n): the shingles that several sets have, for each of these, with their number."""

    def counted(bucket: int, tokens: list[bytes], keys: list[bytes], runs: list[bytes]) -> Iterator[pa.RecordBatch]:
        short = np.frombuffer(b"".join(tokens), np.uint8).reshape(-1, KEPT_BITS // 8)
        token = np.zeros((len(short), 8), np.uint8)
        token[:, : KEPT_BITS // 8] = short
        token, key = token.view(np.int64)[:, 0], np.repeat(np.frombuffer(b"".join(keys), np.int64), np.frombuffer(b"".join(runs), np.int32))
        order = np.argsort(token)
        token, key = token[order], key[order]
        same = np.concatenate([[False], token[1:] == token[:-1], [False]])
        some = same[1:] | same[:-1]
        token, key = token[some], key[some]
        order = np.lexsort((key, token))
        token, key = token[order], key[order]
        # Equal sets count as one.
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])[: len(token)]
        token, key = token[fresh], key[fresh]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])[: len(token)])
        lengths = np.diff(np.append(starts, len(token)))
        n = np.repeat(lengths, lengths)
        token, key, n = token[n > 1] | bucket << KEPT_BITS, key[n > 1], n[n > 1]
        for at in range(0, len(n), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (key, token, n)], names=["key", "token", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for batch in batches:
            for bucket, *packed in zip(*(batch[c].to_pylist() for c in ("bucket", "tokens", "keys", "runs")), strict=True):
                if bucket != now and held[0]:
                    yield from counted(now, *held)
                    held = ([], [], [])
                now = bucket
                for x, y in zip(held, packed, strict=True):
                    x.append(y)
        if held[0]:
            yield from counted(now, *held)
        del held
        give_back()

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, token long, n long")


def rarest(rows: DataFrame, firsts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(anchor, id): the shingles by which every set meets all similar ones, its rarest; those that it alone has are left out."""
    total = firsts.agg(F.sum("n")).first()[0] or 0
    # From 128 buckets on, so that small inputs are packed like larger ones.
    bits = min(16, max(7, math.ceil(math.log2(max(1, total) / COUNTED))))
    shared = shared_shingles(dealt_shingles(rows, size, bits))
    ordered = shared.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("hs")).join(firsts.select("key", "id", F.col("n").alias("all")), "key")
    needed = F.col("all") - F.ceil(F.col("all") * F.lit(similarity) - 1e-9).cast("int") + 1
    heads = ordered.withColumn("some", needed - (F.col("all") - F.size("hs"))).where("some > 0")
    return heads.select(F.explode(F.slice("hs", F.lit(1), F.col("some"))).alias("x"), "id").select(F.col("x.token").alias("anchor"), "id")


def close(rows: np.ndarray, row: np.ndarray, most: tuple[int, int]) -> np.ndarray:
    """Which rows differ from one in no more bits than allowed: over the check bits, and over all where these are there."""
    apart = np.bitwise_count(rows ^ row)
    near = apart[:, : CHECK_BITS // 64].sum(1) <= most[0]
    return near & (apart.sum(1) <= most[1]) if rows.shape[1] == WORDS else near


def forest(bits: np.ndarray, most: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that connect all rows which links between close rows connect."""
    out, queue, rest = [], [], np.arange(len(bits))
    while len(rest):
        i, rest = int(rest[0]), rest[1:]
        queue.append(i)
        while queue and len(rest):
            i = queue.pop()
            near = close(bits[rest], bits[i], most)
            found = rest[near].tolist()
            out += [(i, j) for j in found]
            queue += found
            rest = rest[~near]
        queue.clear()
    return out


def wide(column, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(rows, -1)


def partnered(met: DataFrame, most: tuple[int, int]) -> DataFrame:
    """(anchor, id) of those who have a partner where they meet, over the check bits."""

    def f(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        anchor, ids, bits = t["anchor"].to_numpy(), t["id"].to_numpy(), wide(t["check"], t.num_rows)
        ends = np.concatenate([starts[1:], [t.num_rows]])
        keep: list[np.ndarray] = []
        sizes = ends - starts
        # Meetings of two, the most frequent ones, all at once.
        two = starts[sizes == 2]
        good = two[close(bits[two], bits[two + 1], most)]
        keep += [good, good + 1]
        for a, b in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
            if links := forest(bits[a:b], most):
                keep.append(a + np.unique(np.array(links)))
        k = np.concatenate(keep)
        return pa.RecordBatch.from_arrays([pa.array(anchor[k]), pa.array(ids[k])], names=["anchor", "id"])

    return met.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda batches: grouped(batches, "anchor", f), "anchor long, id long")


def linked(partners: DataFrame, sketches: DataFrame, most: tuple[int, int]) -> DataFrame:
    """(a, b): proposed links over all bits, a spanning forest for each meeting."""
    return forests(partners.join(sketches, "id").select("anchor", "id", "sketch"), most)


def forests(rows: DataFrame, most: tuple[int, int]) -> DataFrame:
    def f(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids, bits = t["id"].to_numpy(), wide(t["sketch"], t.num_rows)
        pairs = [(a + i, a + j) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True) for i, j in forest(bits[a:b], most)]
        k = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids[k[:, 0]]), pa.array(ids[k[:, 1]])], names=["a", "b"])

    # In the order of ids, meetings in several tables propose the same links.
    return rows.repartition("anchor").sortWithinPartitions("anchor", "id").mapInArrow(lambda batches: grouped(batches, "anchor", f, 4096), "a long, b long")


MEMBERS = "anchor long, id long, sketch binary, a long, b long"


def crowd_links(crowd: DataFrame, sketches: DataFrame, most: tuple[int, int]) -> DataFrame:
    """Proposed links for meetings of any size: within chunks, and between the first members of what is connected there."""
    rows = crowd.join(sketches, "id").select("anchor", "id", "sketch", F.xxhash64("anchor", F.pmod(F.xxhash64("id"), F.col("chunks"))).alias("cell"))

    def f(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids, anchors, bits = t["id"].to_numpy(), t["anchor"].to_numpy(), wide(t["sketch"], t.num_rows)
        near = ids.copy()
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
            # Meetings whose cells' numbers collide are told apart.
            for anchor in np.unique(anchors[a:b]):
                at = a + np.flatnonzero(anchors[a:b] == anchor)
                for i, j in forest(bits[at], most):
                    near[at[j]] = ids[at[i]]
        return pa.RecordBatch.from_arrays([t["anchor"].combine_chunks(), t["id"].combine_chunks(), t["sketch"].combine_chunks(), pa.array(near), pa.array(ids)], names=["anchor", "id", "sketch", "a", "b"])

    dealt = rows.select("cell", "anchor", "id", "sketch").repartition("cell").sortWithinPartitions("cell", "id")
    members = saved(dealt.mapInArrow(lambda batches: grouped(batches, "cell", f, 4096), MEMBERS))
    return members.where("a <> b").select("a", "b").unionByName(forests(members.where("a = b").select("anchor", "id", "sketch"), most))


def crossing(met: DataFrame, most: tuple[int, int]) -> DataFrame:
    """(anchor, id) of those who come close to another component, over the check bits."""

    def f(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        anchor, ids, roots = (t[c].to_numpy() for c in ("anchor", "id", "root"))
        bits = wide(t["check"], t.num_rows)
        ends = np.concatenate([starts[1:], [t.num_rows]])
        keep = np.zeros(t.num_rows, bool)
        two = starts[ends - starts == 2]
        near = two[(roots[two] != roots[two + 1]) & close(bits[two], bits[two + 1], most)]
        keep[near] = keep[near + 1] = True
        for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            own, place, n = np.unique(roots[a:b], return_inverse=True, return_counts=True)
            if len(own) > 1:
                for i in a + np.flatnonzero(place != n.argmax()):
                    rest = a + np.flatnonzero(roots[a:b] != roots[i])
                    found = rest[close(bits[rest], bits[i], most)]
                    keep[found] = True
                    keep[i] |= len(found) > 0
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (anchor, ids)], names=["anchor", "id"])

    return met.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda batches: grouped(batches, "anchor", f), "anchor long, id long")


def crossed(found: DataFrame, labelled: DataFrame, most: tuple[int, int]) -> DataFrame:
    """(a, b): a spanning forest, for meetings of any size, of all pairs of different components that are close over all bits.

    Whoever isn't of the largest component of a meeting meets all its chunks.
    """
    rows = found.join(labelled.select("id", "sketch", "root"), "id")
    by_root = rows.groupBy("anchor", "root").count()
    largest = by_root.groupBy("anchor").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.ceil(F.sum("count") / CROWD).alias("chunks"))
    rows = rows.join(saved(largest), "anchor")
    columns = ["cell", "anchor", "id", "sketch", "root"]
    base = rows.withColumn("cell", F.xxhash64("anchor", F.pmod(F.xxhash64("id"), F.col("chunks"))))
    cells = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: F.xxhash64("anchor", c)))
    probes = rows.where("root <> largest").withColumn("cell", cells)
    both = base.select(*columns, F.lit(False).alias("probe")).unionByName(probes.select(*columns, F.lit(True).alias("probe")))

    def f(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids, anchors, roots, probe = (t[c].to_numpy() for c in ("id", "anchor", "root", "probe"))
        bits, out = wide(t["sketch"], t.num_rows), set()
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
            there = a + np.flatnonzero(~probe[a:b])
            part = np.arange(len(there))  # what is connected so far
            for i in a + np.flatnonzero(probe[a:b]):
                some = np.flatnonzero((roots[there] != roots[i]) & (anchors[there] == anchors[i]))
                some = some[close(bits[there[some]], bits[i], most)]
                if len(some):
                    # Here, a probe is one with its own row if that is in this chunk.
                    itself = np.flatnonzero((ids[there] == ids[i]) & (anchors[there] == anchors[i]))
                    own = part[itself[0]] if len(itself) else -1
                    parts, first = np.unique(part[some], return_index=True)
                    out.update((min(int(ids[i]), j), max(int(ids[i]), j)) for j in ids[there[some[first[parts != own]]]].tolist())
                    part[np.isin(part, parts)] = own if len(itself) else parts[0]
        k = np.array(sorted(out), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1])], names=["a", "b"])

    # In the order of ids, meetings at several anchors propose the same links.
    return both.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(lambda batches: grouped(batches, "cell", f, 4096), "a long, b long")


def bridges(sets: list[np.ndarray], bits: np.ndarray, roots: np.ndarray, block: np.ndarray, own: np.ndarray, most: tuple[int, int], similarity: float) -> list[tuple[int, int]]:
    """Links that connect all components which pairs of close and similar sets connect.

    Rows meet those of other blocks, and where they are their block's ``own`` all of them.
    """
    n, part, out = np.array([len(h) for h in sets]), np.unique(roots, return_inverse=True)[1], []
    ends = np.cumsum(n)
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    there = np.zeros(len(place), bool)
    for i in range(len(sets) - 1):
        after = slice(i + 1, len(sets))
        fit = np.minimum(n[after], n[i]) >= similarity * np.maximum(n[after], n[i]) - 1e-9
        rest = i + 1 + np.flatnonzero(fit & (part[after] != part[i]) & ((block[after] != block[i]) | own[i]))
        rest = rest[close(bits[rest], bits[i], most)]
        if not len(rest):
            continue
        mine, m = place[ends[i] - n[i] : ends[i]], n[rest]
        there[mine] = True
        stop = np.cumsum(m)
        hits = np.concatenate([[0], np.cumsum(there[place[np.repeat(ends[rest] - stop, m) + np.arange(stop[-1])]])])
        there[mine] = False
        both = hits[stop] - hits[stop - m]
        rest = rest[both >= similarity * (n[i] + m - both) - 1e-9]
        parts, first = np.unique(part[rest], return_index=True)
        out += [(i, j) for j in rest[first].tolist()]
        part[np.isin(part, parts)] = part[i]
    return out


def settled(proposed: DataFrame, labelled: DataFrame, rows: DataFrame, size: int, similarity: float, most: tuple[int, int]) -> DataFrame:
    """(a, b): links that connect all components which similar pairs connect, among those whom the proposed links connect.

    All close pairs of such a group are decided where its sets meet, so that none is a row. A large group is split into
    blocks, of which any two meet.
    """
    stars = components(proposed)
    groups = stars.select(F.col("a").alias("id"), F.col("b").alias("group")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("group")).distinct())
    members = saved(groups.join(labelled.select("id", "root").distinct(), "id"))

    def marks(_: object, texts: list) -> list[tuple]:
        return [(sketch(h), len(h), h.tobytes()) for h in (shingle_set(x, size) for x in texts)]

    some = rows.join(members.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").distinct()
    made = map_columns(some, ["text"], fields(sketch=BinaryType(), n=IntegerType(), h=BinaryType()), marks)
    sets = saved(made.select(F.col("doc_id").alias("id"), "sketch", "n", "h"))
    total = members.join(sets.select("id", "n"), "id").groupBy("group").agg(F.sum("n").alias("n"))
    blocks = saved(total.select("group", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / HELD), F.least(F.lit(SPREAD).cast("long"), F.ceil(F.col("n") / LEAST))).alias("blocks")))
    dealt = members.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cell = F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other"))
    dealt = dealt.select(cell.alias("cell"), "id", "root", "block", (F.col("block") == F.col("other")).alias("own"))

    def f(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids, roots, block, own = (t[c].to_numpy() for c in ("id", "root", "block", "own"))
        bits, sets = wide(t["sketch"], t.num_rows), [np.frombuffer(x, np.uint64) for x in t["h"].to_pylist()]
        spans = zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True)
        pairs = [(a + i, a + j) for a, b in spans for i, j in bridges(sets[a:b], bits[a:b], roots[a:b], block[a:b], own[a:b], most, similarity)]
        k = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids[k[:, 0]]), pa.array(ids[k[:, 1]])], names=["a", "b"])

    met = dealt.join(sets.select("id", "sketch", "h"), "id").repartition("cell").sortWithinPartitions("cell", "id")
    return saved(met.select("cell", "id", "root", "block", "own", "sketch", "h").mapInArrow(lambda batches: grouped(batches, "cell", f, 1), "a long, b long"))


def confirmed(pairs: DataFrame, rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b): the proposed pairs whose shingle sets have the similarity, by these sets themselves.

    The pairs of one ``a`` meet in cells of about ``CELL``, to each of which its set is sent once, so that neither a
    document with very many partners nor a long text fills a task.
    """
    pairs = saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    needed = saved(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    # A text's set is made once, however many pairs it is in.
    made = map_columns(rows.join(needed, "doc_id", "left_semi").distinct(), ["text"], fields(h=BinaryType()), lambda _, texts: [(shingle_set(x, size).tobytes(),) for x in texts])
    texts = saved(made.select("doc_id", "h"))
    cells = saved(pairs.groupBy("a").agg(F.ceil(F.count("*") / CELL).alias("cells")))
    celled = saved(pairs.join(cells, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("cells"))).alias("cell"), "a", "b"))
    heads = celled.select("cell", "a").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("cell", "a", F.lit(None).cast("long").alias("b"), "h")
    members = celled.join(texts.withColumnRenamed("doc_id", "b"), "b").select("cell", "a", "b", "h")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            found = []
            for part in pieces([batch]):
                for cell, x, y, data in zip(*(part[c].to_pylist() for c in ("cell", "a", "b", "h")), strict=True):
                    if cell != now:
                        now, held = cell, {}
                    h = np.frombuffer(data, np.uint64)
                    if y is None:
                        held.setdefault(x, []).append(h)  # several, where rows share a doc_id
                    elif any(alike(one, h, similarity) for one in held[x]):
                        found.append((x, y))
            k = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1])], names=["a", "b"])

    # Heads have no b and come first.
    dealt = heads.unionByName(members).repartition("cell").sortWithinPartitions("cell", F.asc_nulls_first("b"))
    return saved(dealt.mapInArrow(run, "a long, b long"))


def few_links(few: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect all small sets which similar ones connect, by a join on the rarest shingles.

    ``few`` has id and few, the hashes in 8 bytes each. Two similar sets share one of the n - ceil(n * similarity) + 1
    shingles that come first in any fixed order; rare ones first keep the groups small.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.int64) for x in batch["few"].to_pylist()]
            row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(row)), pa.array(np.concatenate(sets))], names=["id", "h"])

    each = saved(few.mapInArrow(run, "id long, h long"))
    shared = saved(each.groupBy("h").count().where("count > 1"))
    ordered = each.join(shared, "h", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(1)).alias("n"), "h"))).alias("hs"))
    needed = F.size("hs") - F.ceil(F.size("hs") * F.lit(similarity) - 1e-9).cast("int") + 1
    heads = ordered.select("id", F.explode(F.slice("hs", F.lit(1), needed)).alias("x")).where("x.n > 1")
    rows = heads.select("id", F.col("x.h").alias("h")).join(few, "id")

    def f(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids, sets = t["id"].to_pylist(), [frozenset(np.frombuffer(x, np.int64).tolist()) for x in t["few"].to_pylist()]
        links = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
            rest = list(range(a, b))
            while rest:
                queue = [rest.pop(0)]
                while queue and rest:
                    one, away = queue.pop(), []
                    for j in rest:
                        both = len(sets[one] & sets[j])
                        if both >= similarity * (len(sets[one]) + len(sets[j]) - both) - 1e-9:
                            links.append((ids[one], ids[j]))
                            queue.append(j)
                        else:
                            away.append(j)
                    rest = away
        k = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1])], names=["a", "b"])

    return rows.repartition("h").sortWithinPartitions("h", "id").mapInArrow(lambda batches: grouped(batches, "h", f, 4096), "a long, b long")


def split_crowds(met: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The meetings that one task can hold, and the rows of the others with their number of chunks, if there are any."""
    crowds = saved(met.groupBy("anchor").count().where(F.col("count") > CROWD).select("anchor", F.ceil(F.col("count") / CROWD).alias("chunks")))
    if crowds.isEmpty():
        return met, None
    return met.join(crowds, "anchor", "left_anti"), met.join(crowds, "anchor")


def label(sketches: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, sketch, root) by the components of the links, and these as stars."""
    stars = components(links)
    return saved(sketches.join(stars, sketches["id"] == stars["a"], "left").select("id", "sketch", F.coalesce("b", "id").alias("root"))), stars


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of all documents that aren't the one with the least doc_id in their group."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    # A set that is similar to one of FEW has no more than so many shingles.
    most = math.floor(FEW / similarity + 1e-9)

    def marks(_: object, texts: list) -> list[tuple]:
        sets = [shingle_set(x, size) for x in texts]
        return [(sketch(h), *identity(h), len(h), h.tobytes() if 0 < len(h) <= most else None) for h in sets]

    check = differing(similarity, CHECK_BITS, DEVIATIONS)
    likely, possible = (check, differing(similarity, BITS)), (check, differing(similarity, BITS, MARGIN))
    with temporary() as keep:
        made = fields(sketch=BinaryType(), digest=BinaryType(), key=LongType(), n=IntegerType(), few=BinaryType())
        marked = saved(map_columns(rows, ["text"], made, marks).drop("text"))
        firsts = saved(marked.groupBy("digest").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("sketch", "key", "n", "few")]))
        home = saved(at_home(firsts))
        homely, crowd = split_crowds(home)
        found = linked(partnered(homely, likely), firsts, likely)
        if crowd is not None:
            found = found.unionByName(crowd_links(crowd.select("anchor", "id", "chunks"), firsts, likely))
        links = confirmed(found, rows, size, similarity).unionByName(few_links(firsts.where("few is not null").select("id", "few"), similarity))
        labelled, stars = label(firsts, links)
        dropped(home)
        met = saved(rarest(rows, firsts, size, similarity).join(labelled.select("id", first_bits(), "root"), "id"))
        some, crowd = split_crowds(met)
        near = crossing(some, possible)
        if crowd is not None:
            near = near.unionByName(crowd.select("anchor", "id"))
        near = saved(near)
        dropped(met)
        links = settled(saved(crossed(near, labelled, possible)), labelled, rows, size, similarity, possible)
        labelled, _ = label(firsts, stars.unionByName(links))
        roots = labelled.join(firsts.select("id", "digest"), "id").select("digest", F.col("root").alias("component_id"))
        return keep(saved(marked.select("doc_id", "digest").join(roots, "digest").where("doc_id <> component_id").select("doc_id", "component_id").distinct()))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without those of ``duplicates``; of rows that repeat a doc_id and text, one stays."""
    gone = duplicates(docs, doc_id, text, size, similarity).select(F.col("doc_id").alias("__gone"))
    left = docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")
    repeated = saved(docs.groupBy(doc_id).count().where(f"count > 1 and `{doc_id}` is not null").select(F.col(doc_id).alias("__twice")))
    if repeated.isEmpty():
        return left
    again = left[doc_id] == repeated["__twice"]
    return left.join(repeated, again, "left_anti").unionByName(left.join(repeated, again, "left_semi").dropDuplicates([doc_id, text]))
