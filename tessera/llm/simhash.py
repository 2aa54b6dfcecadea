"""SimHash fingerprints of word shingles, and near-duplicate links through the points of a covering code.

The anchors are the code words of the direct sum of two binary Golay codes, over the first 46 of the 64 bits; the
code's covering radius there is 3 + 3, and the other 18 bits don't choose the anchor. Each fingerprint has a home,
the nearest code word of each block. A fingerprint within two bits of another has that one's home at most two
steps farther off than the covering radius allows, so it is replicated to exactly those code words that are the
home of any point within the threshold. Per anchor the homes are compared with the replicas over all 64 bits.

Fingerprints are made distinct before that; anchors where nobody is at home are left out through a bit map of
2**24 bits, the number of anchors, whatever the input. Links that the comparison confirms are joined into
components without passing through the driver.

The cost for n distinct fingerprints: a replica goes to some 60 anchors at most, of which the map keeps the n / 2**24
that are taken, as long as n is small against the anchors; each then meets n / 2**24 homes. Beyond ``MANY``
fingerprints that would grow with the square of n, so the other 18 bits choose the place as well: a replica that is s
steps off differs in 2 - s of them at most, so of 3 - s parts one is equal. Replicas and homes meet by anchor and
part, which divides the comparisons by 2**18, 2**9 or 2**6 and finds the same links.

Null texts and texts without words have fingerprint zero; repeated rows keep a row each. Rows without a doc_id link
others, and have the component's least doc_id, or null where no row of it has one; rows that share a doc_id but no
text are documents of their own. Other columns don't enter the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .arrow import fields, map_columns
from .components import components
from .store import saved, temporary

SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: Shingles whose bits are counted together.
COUNTED = 1 << 14

# The Golay code: words of 23 bits, 12 of them free.

LENGTH, FREE = 23, 12
#: The generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (a fixed value of the code).
POLYNOMIAL = 0b101011100011


def remainder(words: np.ndarray) -> np.ndarray:
    """Syndromes: the words modulo the generator polynomial."""
    out = words.astype(np.int64)
    for bit in range(LENGTH - 1, LENGTH - FREE - 1, -1):
        out = np.where(out >> bit & 1, out ^ POLYNOMIAL << bit - (LENGTH - FREE), out)
    return out


@lru_cache(maxsize=1)
def leaders() -> np.ndarray:
    """By syndrome, the only error of at most three bits that has it: the code is perfect."""
    errors = np.array([sum(1 << b for b in c) for n in range(4) for c in combinations(range(LENGTH), n)], np.int64)
    out = np.zeros(1 << LENGTH - FREE, np.int64)
    out[remainder(errors)] = errors
    return out


def homes(words: np.ndarray) -> np.ndarray:
    """The number, of 12 bits, of the nearest code word."""
    return (words ^ leaders()[remainder(words)]) >> LENGTH - FREE


@lru_cache(maxsize=4)
def visits(threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each number of steps up to the threshold: by syndrome, what to flip to reach a word with another home.

    Only homes that need that many steps are listed; rows are padded with zeros, and a mask tells which count.
    """
    lead, known = leaders(), [{0} for _ in range(1 << LENGTH - FREE)]
    out = []
    for steps in range(threshold + 1):
        flips = np.array([sum(1 << b for b in c) for c in combinations(range(LENGTH), steps)], np.int64)
        made = remainder(flips)
        rows = []
        for s in range(len(lead)):
            # The home of word ^ flip differs from the word by flip ^ leader of the joint syndrome.
            new = {int(x) for x in flips ^ lead[s ^ made]} - (known[s] if steps else set())
            known[s] = (known[s] if steps else set()) | new
            rows.append(sorted(new))
        width = max(map(len, rows))
        table, mask = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), bool)
        for s, row in enumerate(rows):
            table[s, : len(row)], mask[s, : len(row)] = row, True
        out.append((table, mask))
    return out


# Fingerprints.


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of all shingles, repeats included; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: len(words) - size]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in more than half of the hashes."""
    if not len(hashes):
        return 0
    sums = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED].astype(">u8").view(np.uint8).reshape(-1, 8)
        sums += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > len(hashes)).tobytes(), "big")


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", size: int = SHINGLE) -> DataFrame:
    """Adds the 64 bits as a long."""
    return map_columns(df, [text], fields(**{out: LongType()}), lambda _, texts: [(signed(majority(shingle_hashes(x, size))),) for x in texts])


# Links.

ANCHOR_BITS = 2 * FREE
#: Bits that don't choose the anchor, and the number of distinct fingerprints from which on they choose the place as well.
REST, MANY = 64 - 2 * LENGTH, 1 << 22


def blocks(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = (1 << LENGTH) - 1
    return prints >> 41 & low, prints >> 18 & low


def anchor_of(prints: np.ndarray) -> np.ndarray:
    a, b = blocks(prints)
    return homes(a) << FREE | homes(b)


def anchors_near(prints: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(index of the fingerprint, anchor, steps) for all anchors that are the home of a point within the threshold."""
    a, b = blocks(prints)
    sa, sb = remainder(a), remainder(b)
    table = visits(threshold)
    for i in range(threshold + 1):
        for j in range(threshold + 1 - i):
            (ta, ma), (tb, mb) = table[i], table[j]
            x = (a[:, None] ^ ta[sa]) >> LENGTH - FREE
            y = (b[:, None] ^ tb[sb]) >> LENGTH - FREE
            rows, p, q = np.nonzero(ma[sa][:, :, None] & mb[sb][:, None, :])
            yield rows, x[rows, p] << FREE | y[rows, q], i + j


def places(prints: np.ndarray, anchors: np.ndarray, apart: int, fine: bool) -> list[np.ndarray]:
    """The keys under which fingerprints meet at anchors if they differ in ``apart`` of the other bits at most."""
    if not fine:
        return [anchors]
    rest, edges = prints & (1 << REST) - 1, [REST * k // (apart + 1) for k in range(apart + 2)]
    part = [rest >> a & (1 << b - a) - 1 for a, b in zip(edges, edges[1:], strict=False)]
    # The anchor, how far apart, which part, and that part's bits.
    return [((anchors << 4 | apart) << 4 | k) << REST | bits for k, bits in enumerate(part)]


def with_homes(prints: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(anchor_of(p).astype(np.int32))], names=["fingerprint", "anchor"])

    return prints.select("fingerprint").mapInArrow(run, "fingerprint long, anchor int")


def with_places(at_home: DataFrame, threshold: int, fine: bool) -> DataFrame:
    """(fingerprint, place): where replicas find a home."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, anchors = batch["fingerprint"].to_numpy(), batch["anchor"].to_numpy().astype(np.int64)
            for apart in range(threshold + 1 if fine else 1):
                for place in places(p, anchors, apart, fine):
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(place)], names=["fingerprint", "place"])

    return at_home.mapInArrow(run, "fingerprint long, place long")


def occupied(at_home: DataFrame) -> np.ndarray:
    """A bit for each anchor: 2 MB at any size, put together by the executors in pieces of 4 KB."""
    got = at_home.groupBy(F.bitmap_bucket_number("anchor").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("anchor")).alias("bits")).collect()
    piece = 4096
    out = np.zeros((1 << ANCHOR_BITS) // 8 + 2 * piece, np.uint8)
    for r in got:
        at = r["k"] * piece
        out[at : at + piece] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def positions(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``occupied`` keeps an anchor: its byte and its bit, as Spark numbers them."""
    bucket = np.where(anchors > 0, 1 + (anchors - 1) // 32768, 0)
    bit = np.where(anchors > 0, (anchors - 1) % 32768, 0)
    return bucket * 4096 + bit // 8, bit % 8


def with_visits(prints: DataFrame, taken: np.ndarray, threshold: int, fine: bool) -> DataFrame:
    held = prints.sparkSession.sparkContext.broadcast(taken)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            every = batch.column(0).to_numpy()
            for at in range(0, len(every), 2048):
                p = every[at : at + 2048]
                for rows, anchors, steps in anchors_near(p, threshold):
                    byte, bit = positions(anchors)
                    keep = (bits[byte] >> bit & 1).astype(bool)
                    others = p[rows[keep]]
                    for place in places(others, anchors[keep].astype(np.int64), threshold - steps, fine):
                        yield pa.RecordBatch.from_arrays([pa.array(others), pa.array(place)], names=["other", "place"])

    return prints.select("fingerprint").mapInArrow(run, "other long, place long")


def links(prints: DataFrame, threshold: int = THRESHOLD, many: int = MANY) -> DataFrame:
    """Pairs (fingerprint, other) of distinct fingerprints that differ in at most ``threshold`` bits, each once.

    ``prints`` has one column of distinct fingerprints and is read a few times.
    """
    at_home, fine = with_homes(prints), prints.count() > many
    near = with_visits(prints, occupied(at_home), threshold, fine)
    # Of two fingerprints the smaller one is compared where it is at home.
    close = (F.col("fingerprint") < F.col("other")) & (F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= threshold)
    homes_ = with_places(at_home, threshold, fine)
    found = homes_.join(near, (homes_["place"] == near["place"]) & close).select("fingerprint", "other")
    return found.distinct() if fine else found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id): the smallest doc_id that links lead to."""
    with temporary() as keep:
        marked = keep(saved(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", size=size).drop("text")))
        firsts = saved(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
        stars = components(links(firsts.select("fingerprint"), threshold))
        # A fingerprint without links is a component of its own.
        rooted = saved(firsts.join(stars, firsts["fingerprint"] == stars["a"], "left").select("fingerprint", "first", F.coalesce("b", "fingerprint").alias("root")))
        least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        roots = keep(saved(rooted.join(least, "root").select("fingerprint", "component_id")))
    return marked.join(roots, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
