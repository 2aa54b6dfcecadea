"""SimHash, near-duplicates, neighbours, suffix sorting, chat: against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import chat, components, neardup, neighbours, simhash, suffix

ODD = [None, "", "  ", "one", "one two", "One TWO", "é É", "word " * 3000]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def brute_groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_covering():
    assert len(set(simhash.leaders().tolist())) == 2048
    rng = np.random.default_rng(1)
    prints = rng.integers(-(2**63), 2**63 - 1, 400)
    near = collections.defaultdict(set)
    for rows, anchors, _ in simhash.anchors_near(prints, 2):
        for r, a in zip(rows.tolist(), anchors.tolist(), strict=True):
            assert a not in near[r]
            near[r].add(a)
    for i, p in enumerate(prints):
        for n in (0, 1, 2):
            flip = sum(1 << int(b) for b in rng.choice(63, n, replace=False))
            assert int(simhash.anchor_of(np.array([int(p) ^ flip]))[0]) in near[i]


def test_simhash_links_match_brute_force(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(350):
        p = rng.choice(prints)
        for _ in range(rng.randrange(1, 4)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    prints = sorted({simhash.signed(p) for p in [*prints, 0, 1, 2**64 - 1]})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    for threshold in (2, 1):
        want = sorted((a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= threshold)
        # By anchors alone, and by parts of the other bits too, as for very many fingerprints.
        for many in (simhash.MANY, 1):
            assert sorted((r[0], r[1]) for r in simhash.links(df, threshold, many).collect()) == want and len(want) > 100


def test_rows_without_an_id_link_others(spark):
    words = [f"w{i}" for i in range(400)]
    texts, k = [" ".join(words)], 0
    prints = [brute_print(texts[0])]
    while len(texts) < 3 and k < 400:  # a chain whose middle has no id
        w = words[:]
        w[k] = "z"
        for j in range(1, len(texts)):
            w = [("y" if x == f"w{399 - j}" else x) for x in w]
        p, k = brute_print(" ".join(w)), k + 1
        if 0 < (p ^ prints[-1]).bit_count() <= 2 and (len(prints) < 2 or (p ^ prints[0]).bit_count() > 2):
            texts.append(" ".join(w))
            prints.append(p)
    rows = [(7, texts[0]), (None, texts[1]), (None, "alone here"), (9, "q r s t"), (9, "another text altogether"), (None, "q r s t")]
    rows += [(3, texts[2])] if len(texts) == 3 else []
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by = lambda i, x: got[i, f"{brute_print(x):016x}"]
    least = 3 if len(texts) == 3 else 7
    assert by(7, texts[0]) == by(None, texts[1]) == least and by(None, "alone here") is None and by(None, "q r s t") == 9 and by(9, "another text altogether") == 9


def test_near_duplicates_match_brute_force(spark, clashing):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.choice([2, 8, 60, 900]))) for _ in range(12)]
    texts = [*ODD, *ODD]
    for _ in range(120):
        w = rng.choice(base).split()
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = "z"
        texts.append(rng.choice([" ", "\n"]).join(w))
    df = clashing(frame(spark, texts), "fingerprint", "anchor", "a", "b")
    rows = sorted(simhash.near_duplicates(df).collect(), key=lambda r: r["doc_id"])
    prints = [brute_print(x) for x in texts]
    assert [r["fingerprint"] for r in rows] == [f"{p:016x}" for p in prints]
    want = brute_groups(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert [r["component_id"] for r in rows] == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_star_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, 0)]
    random.Random(1).shuffle(edges)
    got = {r["a"]: r["b"] for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(1, 400)}, **{1000 + i: 1000 for i in range(1, 61)}}


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_at_a_similarity(spark, clashing):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [" ".join(word() for _ in range(300)) for _ in range(60)]
    kinds = [("base", i) for i in range(60)]
    for i in range(60):
        for edits, name in ((0, "copy"), (2, "near"), (4, "near"), (60, "far")):
            w = texts[i].split()
            for k in rng.sample(range(300), edits):
                w[k] = word()
            texts.append(" ".join(w))
            kinds.append((name, i))
    for _ in range(300):  # a large group of near copies
        w = texts[0].split()
        w[rng.randrange(300)] = word()
        texts.append(" ".join(w))
        kinds.append(("near", 0))
    texts += ["", "", None, "short one"]
    kinds += [("base", None), ("copy", None), ("copy", None), ("base", None)]
    df = clashing(frame(spark, texts), "sketch", "id", "n")
    kept = {r["doc_id"] for r in neardup.keep_one(df).collect()}
    for i, (name, _) in enumerate(kinds):
        assert (i in kept) == (name in ("base", "far")), (i, name)
    assert neardup.keep_one(df).columns == df.columns
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d"), (None, "a b"), (None, "a b")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["text"]) for r in neardup.keep_one(twice).collect()) == [(-1, "a b"), (-1, "a b"), (1, "a b"), (1, "c d")]
    assert neardup.keep_one(frame(spark, [])).count() == 0


def spread(words, k, word):
    """Replaces k words at even distances."""
    w = words.split()
    for i in range(k):
        w[(2 * i + 1) * len(w) // (2 * k)] = word()
    return " ".join(w)


def test_similarities_beside_the_limit(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [" ".join(word() for _ in range(150)) for _ in range(80)]
    # 131 of 161 shingles are shared after three edits (0.814), 126 of 166 after four (0.759).
    made = [spread(x, 3 if i < 40 else 4, word) for i, x in enumerate(base)]
    assert {len(shingles(a) & shingles(b)) for a, b in zip(base, made, strict=True)} == {131, 126}
    got = {r["doc_id"] for r in neardup.duplicates(frame(spark, base + made)).collect()}
    # What the tables miss there is a pair in a hundred.
    assert got <= set(range(80, 120)) and len(got) >= 38


def test_no_pair_above_the_limit_is_missed(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [" ".join(word() for _ in range(150)) for _ in range(500)]
    made = [spread(x, 3, word) for x in base]  # 0.814, of which the tables alone miss some
    assert sorted(map(tuple, neardup.duplicates(frame(spark, base + made)).collect())) == [(500 + i, i) for i in range(500)]


def test_texts_that_share_nothing_do_not_meet(spark, monkeypatch):
    """Chance meetings would grow with the square of the number of texts."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [" ".join(word() for _ in range(60)) for _ in range(1500)]
    line = " ".join(word() for _ in range(8))  # four shingles of sixty: too few for any pair to be alike
    met, split = [], neardup.split_crowds
    monkeypatch.setattr(neardup, "split_crowds", lambda df: met.append(df.count()) or split(df))
    df = frame(spark, [*texts, *texts[:20], *(f"{line} {x}" for x in texts[20:40]), spread(texts[50], 1, word), None, ""])
    found = {r["doc_id"]: r["component_id"] for r in neardup.duplicates(df).collect()}
    assert found == {**{1500 + i: i for i in range(20)}, **{1520 + i: 20 + i for i in range(20)}, 1540: 50, 1542: 1541}
    assert met[0] >= 16 * 1500 and met[1] < 1000


def test_pairs_beside_the_limit_are_no_rows(spark, monkeypatch):
    """Copies with edits of their own are close and mostly not alike: their pairs grow with the square of the group."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, texts = [word() for _ in range(300)], []
    for _ in range(150):
        w = list(base)
        for k in rng.sample(range(300), rng.randrange(4, 10)):
            w[k] = word()
        texts.append(" ".join(w))
    sets = [shingles(x) for x in texts]
    close = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in range(150) for j in range(i)]
    root = brute_groups(150, [(i, j) for i, j, x in close if x >= 0.8])
    want = sorted((i, r) for i, r in enumerate(root) if i != r)
    assert sum(x < 0.8 for *_, x in close) > 5000 and 20 < len(want) < 149
    counts, crossed = [], neardup.crossed
    monkeypatch.setattr(neardup, "crossed", lambda found, *a: counts.append((found.count(), crossed(found, *a).count())) or crossed(found, *a))
    got = lambda: sorted(map(tuple, neardup.duplicates(frame(spark, texts)).collect()))
    assert got() == want
    (met, made), *_ = counts
    assert 0 < made <= met
    for name, least in (("HELD", 2000), ("CROWD", 20)):  # blocks and chunks lose nothing
        monkeypatch.setattr(neardup, name, least)
        assert got() == want


def test_sets_decided_where_they_meet():
    rng = np.random.default_rng(17)
    pool = rng.integers(0, 1 << 64, 60, np.uint64)
    sets = [np.unique(rng.choice(pool, int(n))) for n in rng.integers(40, 300, 60)] + [np.zeros(0, np.uint64)]
    n, block, far = len(sets), rng.integers(0, 2, 61), (neardup.BITS, neardup.BITS)
    bits, roots = np.zeros((n, neardup.WORDS), np.uint64), np.repeat(np.arange(31), 2)[:n]
    for own in (True, False):
        links = neardup.bridges(sets, bits, roots, block, np.full(n, own), far, 0.8)
        same = [(i, i - 1) for i in range(1, n) if roots[i] == roots[i - 1]]
        every = [(i, j) for i in range(n) for j in range(i) if (own or block[i] != block[j]) and neardup.alike(sets[i], sets[j], 0.8)]
        assert brute_groups(n, same + links) == brute_groups(n, same + every)
        assert 0 < len(links) < 31 and all(neardup.alike(sets[i], sets[j], 0.8) for i, j in links)


def test_near_copies_of_short_texts(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = " ".join(word() for _ in range(5))
    # Texts of 7 to 28 words with one word appended; every other one starts with a common line.
    base = [" ".join(([line] if i % 2 else []) + [word() for _ in range(2 + n - 5 * (i % 2))]) for n in range(5, 27) for i in range(6)]
    texts = base + [f"{x} {word()}" for x in base]
    df = frame(spark, texts)
    sets = [shingles(x) for x in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = brute_groups(len(texts), linked)
    want = sorted((i, r) for i, r in enumerate(root) if i != r)
    assert sorted(map(tuple, neardup.duplicates(df).collect())) == want and len(want) > 100


def test_first_comparison_loses_nothing():
    rng = np.random.default_rng(13)
    check = neardup.differing(0.8, neardup.CHECK_BITS, neardup.DEVIATIONS)
    most = neardup.differing(0.8, neardup.BITS, neardup.MARGIN)
    lost = 0
    for _ in range(1500):
        n = int(rng.integers(20, 60))
        h = rng.integers(0, 1 << 64, 10 * n, np.uint64)
        a, b = (np.frombuffer(neardup.sketch(x), np.uint64)[None] for x in (h[: 9 * n], h[n:]))
        assert neardup.alike(np.sort(h[: 9 * n]), np.sort(h[n:]), 0.8)
        lost += int(neardup.close(a, b[0], (neardup.BITS, most))[0] and not neardup.close(a, b[0], (check, most))[0])
    assert lost == 0


def test_crowds_lose_no_link(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(3):
        w = [word() for _ in range(200)]
        for _ in range(120):  # a walk away from where it began: neighbours are alike, the ends aren't
            if rng.random() < 0.5:
                w[rng.randrange(200)] = word()
            texts.append(" ".join(w))
    df = frame(spark, texts)
    got = lambda: sorted(map(tuple, neardup.duplicates(df).collect()))
    plain = got()
    monkeypatch.setattr(neardup, "CROWD", 7)
    assert got() == plain and len(plain) > 300


# Suffix sorting.


def brute_removed(texts):
    data = [(x or "").encode() for x in texts]
    n = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if n[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats_match_brute_force(spark, clashing, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(1)
    base = ["".join(rng.choice("ab") for _ in range(rng.choice([50, 199, 200, 201, 500, 1000]))) for _ in range(25)]
    texts = [*ODD, *ODD, "a" * 3000, "xyz" * 300, "z" * 150 + "q" * 300]
    for _ in range(220):
        t = "".join(rng.choice(base) if rng.random() < 0.7 else "".join(rng.choice("abcdé") for _ in range(rng.randrange(150))) for _ in range(rng.randrange(5)))
        if rng.random() < 0.4 and t:
            p = rng.randrange(len(t))
            t = t[:p] + "X" + t[p + 1 :]
        texts.append(t)
    df = clashing(frame(spark, texts), "h", "bh", "th", "kept", "removed")
    rows = sorted(suffix.with_digests(suffix.remove_repeats(df)).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows] == brute_removed(texts)
    assert suffix.remove_repeats(frame(spark, [])).count() == 0
    same = spark.createDataFrame([(1, "x" * 100 + "y" * 150), (1, "x" * 100 + "y" * 150), (None, "k" * 150 + "l" * 150)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in suffix.with_digests(suffix.remove_repeats(same)).collect()) == [0, 250, 250]


def test_ranks_know_their_neighbours(monkeypatch):
    monkeypatch.setattr(suffix.Ranks, "MOST", 8)
    rng = random.Random(2)
    numbers = rng.sample(range(10_000), 700)
    ranks, plain = suffix.Ranks(numbers[0]), [numbers[0]]
    for x in numbers[1:]:
        at = sum(q < x for q in plain)
        assert ranks.add(x) == tuple(q for q in (plain[at - 1] if at else None, plain[at] if at < len(plain) else None) if q is not None)
        plain.insert(at, x)
    assert list(ranks) == plain and len(ranks) == 700


def test_parts_of_a_hot_group_lose_no_pair():
    """Two blocks that agree over 200 bytes around an anchor share a part, however these bytes lie."""
    rng = random.Random(5)
    for _ in range(2000):
        right = rng.randrange(32, 369)
        left = max(0, 200 - right) if rng.random() < 0.5 else min(168, max(0, 200 - right) + rng.randrange(40))
        shared = bytes(rng.choice(b"ab") for _ in range(left + right))
        blocks = []
        for side in (b"x", b"y"):
            front, back = rng.randrange(0, 169 - left) if left < 169 else 0, rng.randrange(0, 60)
            blocks.append((side * front + shared + side * back, front + left))
        one, other = (set(suffix.parts_of(77, x, o)) for x, o in blocks)
        assert one & other, (left, right)


def test_a_frequent_line_is_split(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 50)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = noise(170)
    texts = [noise(150) + line + noise(150) for _ in range(300)] + [noise(50) + "k" * 3 + line + "tail of some bytes that makes it long enough " + noise(80) for _ in range(40)]
    rows = sorted(suffix.with_digests(suffix.remove_repeats(frame(spark, texts))).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows] == brute_removed(texts)


def test_chunks_of_long_texts(monkeypatch):
    rng = random.Random(9)
    data = bytes(rng.choice(b"ab") for _ in range(5000))
    monkeypatch.setattr(suffix, "CHUNK", 700)
    covered = set()
    for _, starts, more, offset in suffix.blocks_of(data):
        for s, m in zip(starts.tolist(), more.tolist(), strict=True):
            covered |= set(range(s, s + m + 1))
        assert (offset < suffix.SPAN).all() and (more < 256).all()
    assert covered == set(range(len(data) - 199))


def test_deep_shallow_order():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(4))) * rng.randrange(40) + bytes(rng.choice(b"abc") for _ in range(rng.randrange(9))) for _ in range(300)]
    strings += [b"p" * 60 + bytes(rng.choice(b"xy") for _ in range(rng.randrange(30))) for _ in range(200)]
    assert [strings[i] for i in suffix.deep_shallow(strings)] == sorted(strings)


# Neighbours.


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[200:500] = x[0]  # a third of the rows share a vector
    x[500:560] = x[1] + 0.01 * rng.standard_normal((60, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)]
    rows += [(950, None), (1000, [0.0] * 16), (1050, [float("nan")] * 16), (1100, [None] * 16), (None, [1.0] * 16), (0, rows[0][1]), (1150, [1.0, 2.0]), (1200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, lambda v: v % 50 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    d = x.astype(np.float64)
    norm = np.linalg.norm(d, axis=1)
    hits = 0
    assert set(got) == set(range(0, 900, 50))
    for q, found in got.items():
        found.sort()
        s = d @ d[q] / (norm * norm[q])
        order = [i for i in np.lexsort((np.arange(900), -np.round(s, 12))).tolist() if i != q][:5]
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in found)
        hits += len(set(order) & {v for _, v, _ in found})
    assert hits / (5 * len(got)) >= 0.95
    assert [v for _, v, _ in got[250]] == [0, 200, 201, 202, 203]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(few, lambda v: v % 50 == 0).collect()) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert neighbours.nearest(few.where("false"), lambda v: v % 50 == 0).count() == 0


# Chat.


def digests(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r["conv_id"]: r for r in chat.with_digests(chat.format_conversations(df, **options)).collect()}


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<", "|>", "\\", "", None, "a\nb", "<<|", "é<\\\\|x", "a", "b"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "we\nird\\<|"]), rng.choice(odd)) for c, rng in ((c, random.Random(c)) for c in range(40)) for t in range(rng.randrange(1, 8))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t} <|im_end|>") for t in range(600)] + [(98, 1, "user", "x"), (98, 1, "user", "x"), (98, None, "assistant", "y"), (None, 1, "assistant", "z")]
    got = digests(spark, rows)
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        r = got[c]
        said = "".join(x for _, _, role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and not r["rewrites_history"]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, _, role, x in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r["formatted_chars"] == len(chat.template([(role, x) for _, _, role, x in turns]))
    assert digests(spark, []) == {}


def templates():
    """Made in a function, so that they travel to workers by value."""

    def plain(messages):
        return "".join(f"[{r}] {t}\n" for r, t in messages)

    return {
        "preamble": lambda m: "<bos>" + plain(m),
        "default system turn": lambda m: plain(m if m[0][0] == "system" else [("system", "be kind"), *m]),
        "last 20": lambda m: plain(m[-20:]),
        "numbers modulo 8": lambda m: "".join(f"{i % 8} {r}: {t}\n" for i, (r, t) in enumerate(m)),
        "joined": lambda m: "\n".join(f"{r}: {t}" for r, t in m),
        "count first": lambda m: f"{len(m)} turns\n{plain(m)}",
        "earlier texts hidden": lambda m: "".join(f"[{r}] {t if i == len(m) - 1 else '...'}\n" for i, (r, t) in enumerate(m)),
        "stripped": lambda m: plain([(r, t.strip()) for r, t in m]),
        "no system turns": lambda m: plain([x for x in m if x[0] != "system"]) or " ",
        "begins with a user": lambda m: plain(m) if m[0][0] != "assistant" else 1 / 0,
        "note at 50": lambda m: plain(m[:50]) + ("(long)\n" if len(m) > 50 else "") + plain(m[50:]),
        "upper": lambda m: plain([(r, t.upper()) for r, t in m]),
        "long ones cut": lambda m: plain(m) if len(plain(m)) < 1500 else "(cut)" + plain(m[-5:]),
        "empty": lambda m: "",
    }


TEMPLATES = templates()
REWRITES = {"last 20", "count first", "earlier texts hidden", "long ones cut"}


@pytest.mark.parametrize("whole", [1, 4, 128])
@pytest.mark.parametrize("name", TEMPLATES)
def test_pieces_make_up_the_output(monkeypatch, name, whole):
    template = TEMPLATES[name]
    monkeypatch.setattr(chat, "WHOLE", whole)
    rng = random.Random(name)
    for n in (1, 2, 3, 19, 21, 70, 200):
        messages = [("user" if i == 0 else rng.choice(["user", "assistant", "system"]), rng.choice(["", "a", "b", " x ", "some words"]) + str(i)) for i in range(n)]
        pieces, rewrites = chat.turn_pieces(template, messages)
        assert "".join(p for p, _, _ in pieces) == template(messages) and len(pieces) == n
        prefixes = ["", *(template(messages[: k + 1]) for k in range(n))]
        brute = any(not b.startswith(a) for a, b in zip(prefixes, prefixes[1:], strict=False))
        assert rewrites == brute and (not brute or name in REWRITES)
        if not rewrites:
            assert [p for p, _, _ in pieces] == [b[len(a) :] for a, b in zip(prefixes, prefixes[1:], strict=False)]
            for (p, a, b), (role, text) in zip(pieces, messages, strict=True):
                told = text.upper() if name == "upper" else text.strip() if name == "stripped" else text
                if name == "empty" or name == "no system turns" and role == "system":
                    assert a is None
                elif name != "upper":
                    assert p[a:b] == told


def test_chat_flags_what_it_cannot_mask(spark):
    rows = [(1, t, "assistant", f"text {t}") for t in range(30)] + [(2, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    for name in ("last 20", "preamble", "upper"):
        template = TEMPLATES[name]
        got = sorted(chat.format_conversations(df, template).where("conv_id = 1").collect(), key=lambda r: r["turn_no"])
        assert "".join(r["formatted"] for r in got) == template([(r[2], r[3]) for r in rows[:30]])
        assert {r["rewrites_history"] for r in got} == {name == "last 20"} and {r["loss"] for r in got} == {name == "preamble"}
        assert [r["start"] for r in got] == [sum(len(x["formatted"]) for x in got[:k]) for k in range(30)]
        # Roles of other templates need a reader of their own.
        assert all(r["turns_sha256"] is None for r in chat.with_digests(chat.format_conversations(df, template)).collect())
    reader = chat.Reader(lambda head: head.rsplit("[", 1)[1][:-2], lambda text: text)
    got = {r["conv_id"]: r for r in chat.with_digests(chat.format_conversations(df, TEMPLATES["preamble"]), reader).collect()}
    assert got[2]["turns_sha256"] == hashlib.sha256(b"assistant\nx\n").hexdigest() and got[2]["loss_chars"] == 1


def test_templates_get_no_empty_conversation():
    seen = []
    chat.turn_pieces(lambda m: seen.append(len(m)) or chat.template(m), [("user", "x"), ("assistant", "y")])
    assert min(seen) == 1


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|a<|", "plain", "<|<|", "|<|"])
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text + "\n\\")) == text + "\n\\"
