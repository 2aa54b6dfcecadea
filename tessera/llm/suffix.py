"""Removal of byte strings that occur twice anywhere, by sorting suffixes sampled over the whole corpus.

Every string of ``LENGTH`` bytes contains an anchor: the place whose next ``GRAM`` bytes have the least hash among
all places in it where they fit. Equal strings have their anchors at equal offsets, so only suffixes that begin at
anchors need sorting, about one in 85 positions. Neighbouring strings with the same anchor form a block. Blocks
whose anchors begin alike meet in one group; equal blocks are counted before, so a group holds distinct ones.

In a group, what follows the anchors is sorted, and so is what precedes them, read backwards, both by deep-shallow
sorting: multikey quicksort, eight bytes a step, to a shallow depth, then blind tries for the suffixes that still
agree. Two blocks that agree over L bytes before and R bytes from the anchor on hold a repeat where L + R reaches
``LENGTH``. The best R for every L comes from neighbours in the order of suffixes while the tree of common
preceding bytes is merged upwards, the smaller part into the larger: no pairs are listed.

A group of more than ``HOT`` distinct blocks (a line that is too short to be a repeat, but frequent) is split: whatever R
is, it lies in one of a few ranges of ``RANGE`` values, and the two blocks share as many bytes from the anchor on as the
range begins with and as many before it as are then lacking at least. So blocks meet by range and by these bytes, at
least ``LENGTH - RANGE`` in all, and every pair that holds a repeat still meets.

Offsets are bytes. Null texts count as empty; texts shorter than ``LENGTH`` keep everything. Rows that share both
doc_id and text are copies of one another like any other copies. Other columns don't enter the result.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .arrow import fields, map_columns, pieces
from .store import dropped, saved, temporary

LENGTH, GRAM = 200, 32
#: Places in a string where a gram fits.
SPAN = LENGTH - GRAM + 1
#: Bytes to which multikey quicksort goes before blind tries take over.
SHALLOW = GRAM + 16
#: Positions of one text that are handled together.
CHUNK = 1 << 20
#: Distinct blocks of an anchor beyond which its group is split, and how many lengths of agreement share a part.
HOT, RANGE = 4096, 24

_rng = np.random.default_rng(20)
BYTES = _rng.integers(0, 1 << 64, 256, np.uint64)
FACTORS = _rng.integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the bytes that begin at each place; ``gram`` is a power of two."""
    h, step, k = BYTES[data], 1, 0
    while step < gram:
        h = h[:-step] * FACTORS[k] + h[step:]
        step, k = 2 * step, k + 1
    h ^= h >> np.uint64(29)
    h *= FACTORS[7]
    h ^= h >> np.uint64(32)
    return h


def sliding_least(v: np.ndarray, span: int) -> np.ndarray:
    width = 1
    while 2 * width <= span:
        v, width = np.minimum(v[:-width], v[width:]), 2 * width
    return np.minimum(v[: len(v) - (span - width)], v[span - width :]) if span > width else v


def blocks_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash at the anchor, first string's start, strings after the first, anchor's offset from the start) of blocks."""
    every = np.frombuffer(data, np.uint8)
    span = length - gram + 1
    for first in range(0, max(0, len(data) - length + 1), CHUNK):
        part = every[first : first + CHUNK + length - 1]
        h = gram_hashes(part, gram)
        # The leftmost least one: places break ties.
        packed = h & ~np.uint64((1 << 24) - 1) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_least(packed, span) & np.uint64((1 << 24) - 1)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        more = np.diff(np.concatenate([starts, [len(at)]])) - 1
        yield h[at[starts]], starts + first, more, at[starts] - starts


# Sorting.


def common(a: bytes, b: bytes) -> int:
    """How many bytes two strings share from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - 1 - (x.bit_length() - 1) // 8


class BlindTrie:
    """Orders strings that share a long beginning. Inner nodes keep only a depth and the bytes found there."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # [depth, {byte: node}] or [None, [indices]]

    def byte(self, k: int, depth: int) -> int:
        s = self.strings[k]
        return s[depth] if depth < len(s) else -1

    def add(self, k: int) -> None:
        if self.root is None:
            self.root = [None, [k]]
            return
        node = self.root
        while node[0] is not None:
            node = node[1].get(self.byte(k, node[0])) or next(iter(node[1].values()))
        other = node[1][0]
        depth = common(self.strings[k], self.strings[other])
        if depth == len(self.strings[k]) == len(self.strings[other]):
            node[1].append(k)
            return
        node, above, key = self.root, None, None
        while node[0] is not None and node[0] < depth:
            above, key = node, self.byte(k, node[0])
            node = node[1][key]
        if node[0] == depth:
            node[1][self.byte(k, depth)] = [None, [k]]
            return
        new = [depth, {self.byte(other, depth): node, self.byte(k, depth): [None, [k]]}]
        if above is None:
            self.root = new
        else:
            above[1][key] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node is None:
                continue
            if node[0] is None:
                out += node[1]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The indices of the strings in order."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) <= 1:
            out += group
        elif depth >= shallow:
            trie = BlindTrie(strings)
            for k in group:
                trie.add(k)
            out += trie.order()
        else:
            keys = [strings[k][depth : depth + 8] for k in group]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [k for k, x in zip(group, keys, strict=True) if x < pivot]
            same = [k for k, x in zip(group, keys, strict=True) if x == pivot]
            more = [k for k, x in zip(group, keys, strict=True) if x > pivot]
            stack.append((more, depth))
            # A pivot of fewer than eight bytes has come to its end: these are equal.
            stack.append((same, depth + 8 if len(pivot) == 8 else shallow))
            stack.append((less, depth))
    return out


class Ranks:
    """A set of numbers in order, in lists of bounded size, so that adding one doesn't move all."""

    MOST = 1024

    def __init__(self, first: int):
        self.parts, self.firsts, self.n = [[first]], [first], 1

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[int]:
        for part in self.parts:
            yield from part

    def add(self, x: int) -> tuple[int, ...]:
        """Adds a number that isn't there yet; returns its neighbours."""
        k = max(0, bisect_right(self.firsts, x) - 1)
        part = self.parts[k]
        at = bisect_left(part, x)
        below = part[at - 1] if at else None
        above = part[at] if at < len(part) else self.firsts[k + 1] if k + 1 < len(self.parts) else None
        part.insert(at, x)
        self.firsts[k] = part[0]
        self.n += 1
        if len(part) > self.MOST:
            half = len(part) // 2
            self.parts[k : k + 1] = [part[:half], part[half:]]
            self.firsts[k : k + 1] = [part[0], part[half]]
        return tuple(q for q in (below, above) if q is not None)


def repeats(contents: list[bytes], offsets: list[int], counts: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each distinct block of a group, the spans in it that repeats cover.

    A block is its bytes, its anchor's offset in them and how often it occurs.
    """
    found: list[list[tuple[int, int]]] = [[(0, len(x))] if c > 1 else [] for x, c in zip(contents, counts, strict=True)]
    if len(contents) < 2 or min(counts) > 1:
        return found
    after = [x[o:] for x, o in zip(contents, offsets, strict=True)]
    before = [x[:o][::-1] for x, o in zip(contents, offsets, strict=True)]
    by_after, by_before = deep_shallow(after), deep_shallow(before)
    rank = {k: r for r, k in enumerate(by_after)}
    edges = sorted(((common(before[a], before[b]), i) for i, (a, b) in enumerate(zip(by_before, by_before[1:], strict=False))), reverse=True)
    # Sets of neighbours in by_before, joined from the deepest common bytes up, as ranks in by_after.
    owner = list(range(len(contents)))
    members: list[Ranks | None] = [Ranks(rank[k]) for k in by_before]

    def find(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    def note(k: int, left: int, right: int) -> None:
        if counts[k] == 1:
            found[k].append((offsets[k] - left, offsets[k] + right))

    for left, i in edges:
        a, b = find(i), find(i + 1)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        big, small = members[a], members[b]
        for r in small:
            for q in big.add(r):
                right = common(after[by_after[r]], after[by_after[q]])
                if left + right >= length:
                    note(by_after[r], left, right)
                    note(by_after[q], left, right)
        owner[b], members[b] = a, None
    return [merged(x) for x in found]


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# The corpus.

#: A block's place: its start, then one byte each for the strings after the first and the anchor's offset.
BLOCK = "h long, bh long, doc_id long, th long, place long"


def all_blocks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, empty = xxhash.xxh3_64_intdigest, np.zeros(0, np.int64)
        for part in pieces(batches, 64):
            rows: list[list[np.ndarray]] = []
            for doc, th, text in zip(part["doc_id"].to_pylist(), part["th"].to_pylist(), part["text"].to_pylist(), strict=True):
                data = (text or "").encode()
                for h, start, more, offset in blocks_of(data):
                    ends = (start + more + LENGTH).tolist()
                    bh = np.array([digest(data[a:b], seed=o) for a, b, o in zip(start.tolist(), ends, offset.tolist(), strict=True)], np.uint64)
                    rows.append([h.view(np.int64), bh.view(np.int64), doc, th, start << 16 | more << 8 | offset])
            n = [len(r[0]) for r in rows]
            docs_of = pa.array([r[2] for r in rows], pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), n)))
            column = lambda i: pa.array(np.concatenate([r[i] for r in rows]) if rows else empty)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([column(0), column(1), docs_of, pa.array(np.repeat(np.array([r[3] for r in rows], np.int64), n)), column(4)], names=["h", "bh", "doc_id", "th", "place"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, BLOCK)


def unpacked(place: int) -> tuple[int, int, int]:
    return place >> 16, place >> 8 & 255, place & 255


def parts_of(h: int, content: bytes, offset: int) -> list[int]:
    """The groups in which a block of a hot anchor meets others: one for each range of lengths that it can agree over."""
    out = []
    for r in range(GRAM, LENGTH + RANGE, RANGE):
        r = min(r, LENGTH)
        before = max(0, LENGTH + 1 - r - RANGE) if r < LENGTH else 0
        if r <= len(content) - offset and before <= offset:
            out.append(xxhash.xxh3_64_intdigest(content[offset - before : offset + r], seed=h & (1 << 64) - 1 ^ r) - (1 << 63))
        if r == LENGTH:
            break
    return out


def with_contents(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The bytes of one block of each kind, cut from its document, and the group ``g`` in which it is sorted, or several."""
    wanted = firsts.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th")).agg(F.collect_list(F.struct("h", "bh", "n", "hot", F.col("first.place").alias("place"))).alias("blocks"))
    # Rows that share doc_id and text would give the same blocks again.
    joined = docs.join(wanted.withColumnsRenamed({"doc_id": "d", "th": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("text", "blocks")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "h", "bh", "n", "offset", "content"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for part in pieces(batches, 64):
            out = []
            for text, blocks in zip(part["text"].to_pylist(), part["blocks"].to_pylist(), strict=True):
                data = text.encode()
                for b in blocks:
                    start, more, offset = unpacked(b["place"])
                    content = data[start : start + more + LENGTH]
                    out += [(g, b["h"], b["bh"], b["n"], offset, content) for g in (parts_of(b["h"], content, offset) if b["hot"] else (b["h"],))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return joined.mapInArrow(run, "g long, h long, bh long, n long, offset int, content binary")


def sorted_groups(contents: DataFrame) -> DataFrame:
    """(h, bh, spans): where repeats cover each kind of block, as pairs of two-byte numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, {}, []

        def end() -> None:
            blocks = list(group.items())
            got = repeats([x[2] for _, x in blocks], [x[1] for _, x in blocks], [x[0] for _, x in blocks])
            out.extend((h, bh, struct.pack(f"<{2 * len(s)}H", *(v for ab in s for v in ab))) for ((h, bh, _), _), s in zip(blocks, got, strict=True) if s)

        def put() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["h", "bh", "spans"])
            out.clear()
            return made

        for part in pieces(batches, 4096):
            for g, h, bh, n, offset, content in zip(*(part[c].to_pylist() for c in ("g", "h", "bh", "n", "offset", "content")), strict=True):
                if g != now:
                    if group:
                        end()
                    now, group = g, {}
                group[h, bh, offset] = (n, offset, content)
            if out:
                yield put()
        if group:
            end()
        if out:
            yield put()

    return contents.repartition("g").sortWithinPartitions("g").mapInArrow(run, "h long, bh long, spans binary")


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept): the byte spans that repeats cover, and the bytes that remain."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    with temporary() as keep:
        blocks = saved(all_blocks(docs))
        # Anchors that begin alike anywhere else; counted in part before the shuffle. Written first, so that the join
        # deals out both sides anew and Spark can split a hot anchor's rows.
        shared = saved(blocks.groupBy("h").count().where("count > 1").select("h"))
        met = keep(saved(blocks.join(shared, "h")))
        dropped(blocks)
        dropped(shared)
        kinds = saved(met.groupBy("h", "bh").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "place")).alias("first")))
        hot = saved(kinds.groupBy("h").count().where(F.col("count") > HOT).select("h", F.lit(True).alias("hot")))
        marked = kinds.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        covered = keep(saved(sorted_groups(with_contents(docs, marked))))

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 8192):
            spans = part["spans"].to_pylist()
            n = np.array([len(s) // 4 for s in spans], np.int64)
            ends = np.frombuffer(b"".join(spans), "<u2").astype(np.int64).reshape(-1, 2)
            row = np.repeat(np.arange(part.num_rows), n)
            start = (part["place"].to_numpy() >> 16)[row]
            index = pa.array(row)
            # One number a span: its start, then its length in two bytes.
            yield pa.RecordBatch.from_arrays([part["doc_id"].take(index), part["th"].take(index), pa.array(start + ends[:, 0] << 16 | ends[:, 1] - ends[:, 0])], names=["doc_id", "th", "span"])

    spans = met.select("h", "bh", "doc_id", "th", "place").join(covered, ["h", "bh"]).select("doc_id", "th", "place", "spans").mapInArrow(expand, "doc_id long, th long, span long")
    by_doc = spans.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_list("span").alias("found"))
    joined = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select("doc_id", "text", "found")

    def cut(_, texts: list[str], found: list[list[int] | None]) -> list[tuple]:
        out = []
        for x, f in zip(texts, found, strict=True):
            data = x.encode()
            spans = merged((s >> 16, (s >> 16) + (s & 0xFFFF)) for s in f or ())
            edges = [0, *(v for ab in spans for v in ab), len(data)]
            out.append((len(data), [{"start": a, "end": b} for a, b in spans], b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
        return out

    return map_columns(joined, ["text", "found"], fields(n_bytes=LongType(), removed=SPANS, kept=BinaryType()), cut, rows=64).drop("text", "found")


def with_digests(found: DataFrame) -> DataFrame:
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(*[c for c in found.columns if c not in ("removed", "kept")], n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
