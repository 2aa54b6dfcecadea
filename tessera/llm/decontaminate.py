"""Benchmark decontamination by a prefix-filtered join of shingles.

Words are runs of ASCII digits, letters (lower-cased) and anything beyond ASCII. An item's windows are all its
runs of ``window`` consecutive words, or the whole item where it has fewer. A window occurs in a document only if
all its shingles do, so one shingle suffices as its prefix: the one that the fewest documents hold, as counted
over the whole corpus. Windows with a shingle that no document holds are left out.

Documents are read three times, whatever the size of the benchmark: to count its shingles; to find the prefixes, with
the words around them as far as any window around a prefix can reach; and to join what was found back to the rows. Both
searches look shingles up in a bit map of fixed size; the joins are on whole hashes, and windows are compared word by
word where a prefix occurs. Texts that occur more than once meet the join once.

Null texts have no words; items without words have no windows. The windows of items without an id count as hits, but
such items aren't listed. Repeated items count once. Repeated rows keep a row each, and other columns are kept, but for
those of the made columns' names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import give_back, pieces, quoted
from .store import bit_map, dropped, saved

WINDOW = 13
SHINGLE = 3
#: Bits of the maps in which shingles are looked up; 16 MB.
MAP_BITS = 1 << 27
#: Words whose hashes a worker remembers, and shingles whose counts it holds.
REMEMBERED, HELD = 200_000, 200_000

#: Upper case becomes lower case, other ASCII outside letters and digits becomes a space; bytes beyond ASCII stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: The same words, for counting.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class WordHashes(dict):
    """Word -> its hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def joined(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the shingles of so many words, from the words' hashes."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = ids[:n] ^ np.uint64(size)
    for k in range(1, size):
        out = (out ^ out >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ out >> np.uint64(32)).view(np.int64)


def in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.view(np.uint64) % np.uint64(8 * len(bits))
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def item_shingles(items: DataFrame, shingle: int) -> DataFrame:
    """(i, p, h, size): an item's shingles by place; shorter items are one shingle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in pieces(batches, 64):
            for i, t in zip(part["i"].to_pylist(), part["t"].to_pylist(), strict=True):
                words = words_of(t)
                if words:
                    size = min(shingle, len(words))
                    h = joined(hashes.of(words), size)
                    n = len(h)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i)), pa.array(np.arange(n, dtype=np.int32)), pa.array(h), pa.array(np.full(n, size, np.int32))], names=["i", "p", "h", "size"])

    return items.select("i", "t").mapInArrow(run, "i long, p int, h long, size int")


def document_counts(texts: DataFrame, wanted: np.ndarray, sizes: list[int]) -> DataFrame:
    """(h, n): how many documents hold a shingle that the map has; summed before it is shuffled."""
    held = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = held.value, WordHashes()
        met: list[np.ndarray] = []
        n = 0

        def put() -> pa.RecordBatch:
            h, counts = np.unique(np.concatenate(met), return_counts=True)
            met.clear()
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(counts)], names=["h", "n"])

        for part in pieces(batches, 64):
            for x in part["text"].to_pylist():
                ids = hashes.of(words_of(x))
                for size in sizes:
                    h = joined(ids, size)
                    if len(found := h[in_map(bits, h)]):
                        met.append(np.unique(found))
                        n += len(met[-1])
            if n > HELD:
                yield put()
                n = 0
        if met:
            yield put()
        give_back()

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def windows(items: DataFrame, shingles: DataFrame, counts: DataFrame, window: int, shingle: int) -> DataFrame:
    """(h, wid, words, k): each window that may occur, with its prefix, a digest and the item's id."""
    counted = shingles.join(counts, "h", "left").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("p", "h", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.string())
        for part in pieces(batches, 16):
            for k, t, s in zip(part["k"].to_pylist(), part["t"].to_pylist(), part["s"], strict=True):
                words = words_of(t)
                h, n = (s.values.field(c).to_numpy() for c in ("h", "n"))
                size = min(shingle, len(words))
                some, out = min(window, len(words)) - size + 1, []
                for start in range(len(h) - some + 1):
                    at = start + int(np.lexsort((h[start : start + some], n[start : start + some]))[0])
                    if n[at]:
                        text = b" ".join(words[start : start + window])
                        out.append((int(h[at]), xxhash.xxh3_128_digest(text), text, k))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["h", "wid", "words", "k"])

    return items.join(counted, "i").select("k", "t", "s").mapInArrow(run, "h long, wid binary, words binary, k string")


def prefixes_met(texts: DataFrame, wanted: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """(k1, k2, h, starts, parts): by text and prefix, the stretches of words around its places that a window may reach."""
    held = texts.sparkSession.sparkContext.broadcast(wanted)
    names = ["k1", "k2", "h", "starts", "parts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = held.value, WordHashes()
        for part in pieces(batches, 64):
            out = []
            for k1, k2, x in zip(part["k1"].to_pylist(), part["k2"].to_pylist(), part["text"].to_pylist(), strict=True):
                words = words_of(x)
                ids = hashes.of(words)
                for size in sizes:
                    h = joined(ids, size)
                    places = np.flatnonzero(in_map(bits, h))
                    if not len(places):
                        continue
                    order = places[np.argsort(h[places], kind="stable")]
                    for at in np.split(order, np.flatnonzero(np.diff(h[order])) + 1):
                        # Stretches that overlap become one.
                        low, high = np.maximum(at - (window - size), 0), np.minimum(at + window, len(words))
                        cut = np.flatnonzero(low[1:] > high[:-1]) + 1
                        starts, ends = low[np.concatenate([[0], cut])], high[np.concatenate([cut - 1, [len(at) - 1]])]
                        out.append((k1, k2, int(h[at[0]]), starts.tolist(), [b" ".join(words[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=names)
        give_back()

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, h long, starts array<int>, parts array<binary>")


def occurrences(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k1, k2, wid, start, end): where windows occur word by word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
        for part in pieces(batches):
            out = []
            for k1, k2, starts, parts, wid, words in zip(*(part[c].to_pylist() for c in ("k1", "k2", "starts", "parts", "wid", "words")), strict=True):
                n, asked = words.count(b" ") + 1, b" " + words + b" "
                for start, stretch in zip(starts, parts, strict=True):
                    stretch = b" " + stretch + b" "
                    at, counted, place = stretch.find(asked), 0, start
                    while at >= 0:
                        place += stretch.count(b" ", counted, at)
                        counted = at
                        out.append((k1, k2, wid, place, place + n))
                        at = stretch.find(asked, at + 1)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["k1", "k2", "wid", "start", "end"])

    return found.join(wanted, "h").select("k1", "k2", "starts", "parts", "wid", "words").mapInArrow(run, "k1 long, k2 long, wid binary, start int, end int")


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def merged_spans(hits: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for part in pieces(batches):
            spans = [[{"start": a, "end": b} for a, b in merged((x["start"], x["end"]) for x in s)] for s in part["hits"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["k1"], part["k2"], pa.array(spans, kind)], names=["k1", "k2", "hits"])

    each = hits.select("k1", "k2", "start", "end").distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("hits"))
    return each.mapInArrow(run, "k1 long, k2 long, hits array<struct<start:int,end:int>>")


def found_in(texts: DataFrame, items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(k1, k2, hits, items) of all texts that hold a window; ``texts`` has k1, k2 and text, ``items`` has k and t."""
    items = saved(items.where("t is not null").distinct().withColumn("i", F.monotonically_increasing_id()))
    shingles = saved(item_shingles(items, shingle))
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())
    counts = saved(document_counts(texts, bit_map(shingles, "h", MAP_BITS), sizes).join(shingles.select("h").distinct(), "h"))
    every = saved(windows(items, shingles, counts, window, shingle))
    for x in (items, shingles, counts):
        dropped(x)
    wanted = every.select("h", "wid", "words").distinct()
    met = prefixes_met(texts, bit_map(every, "h", MAP_BITS), sizes, window)
    # Copies of a text give the same rows.
    met = saved(met.groupBy("k1", "k2", "h").agg(F.first("starts").alias("starts"), F.first("parts").alias("parts")))
    hits = saved(occurrences(met, wanted))
    dropped(met)
    owners = hits.select("k1", "k2", "wid").distinct().join(every.select("wid", "k").where("k is not null").distinct(), "wid")
    listed = owners.select("k1", "k2", "k").distinct().groupBy("k1", "k2").agg(F.array_sort(F.collect_list("k")).alias("items"))
    out = saved(merged_spans(hits).join(listed, ["k1", "k2"], "left"))
    dropped(hits)
    dropped(every)
    return out


def find_overlap(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Adds n_words, hits (word spans under any item's window) and items (the ids found, as sorted strings)."""
    made = {"n_words", "hits", "items"}
    kept = [c for c in docs.columns if c.lower() not in made]
    body = quoted(docs, text)
    # Two hashes of a text stand for it.
    k1, k2 = F.xxhash64(body), F.xxhash64(F.lit(1), body)
    clean = items.select(quoted(items, item_id).cast("string").alias("k"), quoted(items, item_text).alias("t"))
    found = found_in(docs.select(k1.alias("k1"), k2.alias("k2"), body.alias("text")).where("text is not null"), clean, window, shingle)
    found = found.withColumnsRenamed({"k1": "__k1", "k2": "__k2", "hits": "__hits", "items": "__items"})
    rows = docs.select(*[quoted(docs, c) for c in kept], F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), k1.alias("__left1"), k2.alias("__left2"))
    both = rows.join(found, (rows["__left1"] == found["__k1"]) & (rows["__left2"] == found["__k2"]), "left")
    hits = F.coalesce("__hits", F.array().cast("array<struct<start:int,end:int>>")).alias("hits")
    return both.select(*[F.col("`" + c.replace("`", "``") + "`") for c in kept], "n_words", hits, F.coalesce("__items", F.array().cast("array<string>")).alias("items"))


def with_verdict(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated: at least one word in twenty is hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        *[c for c in found.columns if c not in ("hits", "items")],
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


#: n_words, n_hit, n_items, items_sha256 and contaminated of each document, for windows of 13 words.
SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), bw as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from b where len(w) > 0)
), sizes as (select distinct n from bw
), dw as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)
), hit as (
  select doc_id, i, dw.n, item_id from dw join bw on dw.n = bw.n and dw.win = bw.win
), pos as (
  select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id
), it as (
  select doc_id, count(*) as n_items, sha256(string_agg(k, ',' order by k)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as k from hit where item_id is not null) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join pos using (doc_id) left join it using (doc_id)
"""
