"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's vector joins what a small bidirectional network reads from its characters with a learned vector of the
word itself, if the training sample had it often enough. A second bidirectional network runs over the words of a
window, attention pools its states, and a line gives the window's logit. All overlapping windows of a whole text
are scored; the highest one counts, through a logistic curve fitted on the training documents.

Windows begin at every ``STRIDE``-th word and at the last that fits, so that neighbours overlap by half.

Training uses a bounded sample of labelled documents (``DOCS`` toxic and ``CLEAN_DOCS`` clean ones, chosen by a hash of
doc_id, but for those of more than ``DOC_BYTES`` bytes, whose label says little of their windows) of which the hold-out
never is a part; without any words in it, nothing is learned, and all texts score next to 0. Labels belong to documents, not to windows: a toxic document's training windows are
first those with the words that set toxic documents apart, later those that the network itself rates highest,
beside the clean windows that it rates highest.

Null texts and texts without words score 0. Rows are scored each for itself, repeated ones alike.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .arrow import fields, give_back, map_columns

#: Labelled documents to learn from, at most: toxic ones and clean ones.
DOCS, CLEAN_DOCS = 1500, 4500
#: Longer documents aren't learned from, so that the sample's size is bounded in bytes, too.
DOC_BYTES = 16 << 10
#: How much an error on a clean document weighs against one on a toxic document, for the sample has fewer of them than a corpus.
CLEAN_WEIGHT = 2
#: Words in a window, and between the starts of neighbours.
WINDOW, STRIDE = 24, 12
#: A longer run of letters is read as several words.
WORD = re.compile(r"\w{1,24}")
LETTERS, WIDEST = 24, 384
CHAR_STATE, STATE, ATTENTION = 12, 12, 12
#: Words with a vector of their own, at most, and the documents that one must be in.
VOCABULARY, SEEN = 20_000, 4
#: Words whose projections a worker remembers; beyond it the memory starts anew.
REMEMBERED = 60_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def window_starts(n: int) -> list[int]:
    """Starts of all windows; the last one reaches the end."""
    return [*range(0, max(0, n - WINDOW), STRIDE), max(0, n - WINDOW)] if n else []


def sigmoid(x: np.ndarray) -> np.ndarray:
    x = x * x.dtype.type(0.5)
    np.tanh(x, out=x)
    x *= x.dtype.type(0.5)
    x += x.dtype.type(0.5)
    return x


def add_rows(target: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to those of the target that an index names, repeats included."""
    if len(index):
        order = np.argsort(index, kind="stable")
        ordered = index[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        target[ordered[starts]] += np.add.reduceat(rows[order], starts, axis=0)


class Gated:
    """A gated recurrent layer over projected inputs (steps, rows, 3 * state)."""

    @staticmethod
    def run(inputs, u: np.ndarray, masks, steps: range, rows: int, keep: list | None = None) -> tuple[np.ndarray, list[np.ndarray | None]]:
        """``inputs(t)`` and ``masks(t)`` give a step's projections and which rows have it; None stands for all."""
        n = u.shape[0]
        h = np.zeros((rows, n), np.float32)
        states: list[np.ndarray | None] = [None] * len(steps)
        for t in steps:
            x, hu = inputs(t), h @ u
            gates = sigmoid(x[:, : 2 * n] + hu[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = r * hu[:, 2 * n :]
            c += x[:, 2 * n :]
            np.tanh(c, out=c)
            new = h - c
            new *= z
            new += c
            m = masks(t)
            if keep is not None:
                keep.append((t, h, z, r, c, hu[:, 2 * n :], m))
            h = new if m is None else np.where(m[:, None], new, h)
            states[t] = h
        return h, states

    @staticmethod
    def back(keep: list, u: np.ndarray, last: np.ndarray | None, each: np.ndarray | None, dp: np.ndarray) -> np.ndarray:
        """Fills the gradient of the inputs; returns that of u. ``last`` and ``each`` come from the end and from all states."""
        n = u.shape[0]
        du = np.zeros_like(u)
        dh = np.zeros_like(keep[0][1]) if last is None else last.copy()
        for t, h, z, r, c, hc, m in reversed(keep):
            if each is not None:
                dh = dh + each[t]
            on = dh if m is None else dh * m[:, None]
            dc = on * (1 - z) * (1 - c * c)
            dz = on * (h - c) * z * (1 - z)
            dr = dc * hc * r * (1 - r)
            dhu = np.concatenate([dz, dr, dc * r], 1)
            dp[t] = np.concatenate([dz, dr, dc], 1)
            du += h.T @ dhu
            dh = dh - on + on * z + dhu @ u.T
        return du


class Network:
    """The weights. Characters and words enter as tables of projected vectors for both directions."""

    def __init__(self, vocabulary: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * (1.0 / np.sqrt(s[0] if len(s) > 1 else 1))).astype(np.float32)
        table = lambda *s: (rng.standard_normal(s) * 0.4).astype(np.float32)
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.w = {
            "char_f": table(WIDEST, 3 * CHAR_STATE), "char_b": table(WIDEST, 3 * CHAR_STATE), "cu_f": draw(CHAR_STATE, 3 * CHAR_STATE), "cu_b": draw(CHAR_STATE, 3 * CHAR_STATE),
            "join": draw(2 * CHAR_STATE, 6 * STATE), "bias": np.zeros(6 * STATE, np.float32), "word": np.zeros((len(vocabulary) + 1, 6 * STATE), np.float32),
            "u_f": draw(STATE, 3 * STATE), "u_b": draw(STATE, 3 * STATE), "att": draw(2 * STATE, ATTENTION), "att_b": np.zeros(ATTENTION, np.float32), "att_v": draw(ATTENTION, 1)[:, 0],
            "out": draw(2 * STATE, 1)[:, 0], "out_b": np.full(1, -1, np.float32),
        }
        self.slope, self.shift = 1.0, 0.0

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words])
        out = np.zeros((int(lengths.max()), len(words)), np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        column = np.repeat(np.arange(len(words)), lengths)
        row = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[row, column] = np.where(flat < WIDEST, flat, flat % 128 + WIDEST - 128)
        return out, lengths

    def read(self, words: list[str], kept: dict | None = None, hide: np.ndarray | None = None) -> np.ndarray:
        """The projections of distinct words."""
        w = self.w
        chars, lengths = self.letters(words)
        n, rows = chars.shape
        mask = lambda t: lengths > t
        kf, kb = ([], []) if kept is not None else (None, None)
        hf, _ = Gated.run(lambda t: w["char_f"][chars[t]], w["cu_f"], mask, range(n), rows, kf)
        hb, _ = Gated.run(lambda t: w["char_b"][chars[t]], w["cu_b"], mask, range(n - 1, -1, -1), rows, kb)
        h = np.concatenate([hf, hb], 1)
        ids = np.array([self.ids.get(x, -1) for x in words])
        if hide is not None:
            ids = np.where(hide, -1, ids)
        if kept is not None:
            kept.update(chars=chars, kf=kf, kb=kb, h=h, ids=ids)
        return h @ w["join"] + w["bias"] + w["word"][ids]

    def pool(self, forward: np.ndarray, backward: np.ndarray, index: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Logits of windows; ``index`` (words, windows) points into the projections for each direction, -1 where a window has ended."""
        w = self.w
        steps, rows = index.shape
        some = index >= 0
        whole = bool(some.all())
        mask = (lambda t: None) if whole else (lambda t: some[t])
        kf, kb = ([], []) if kept is not None else (None, None)
        _, sf = Gated.run(lambda t: forward[index[t]], w["u_f"], mask, range(steps), rows, kf)
        _, sb = Gated.run(lambda t: backward[index[t]], w["u_b"], mask, range(steps - 1, -1, -1), rows, kb)
        h = np.concatenate([np.stack(sf), np.stack(sb)], 2)
        a = np.tanh(h @ w["att"] + w["att_b"])
        e = np.where(some, a @ w["att_v"], -np.inf)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = np.einsum("tb,tbh->bh", alpha, h)
        if kept is not None:
            kept.update(kf=kf, kb=kb, h=h, a=a, alpha=alpha, pooled=pooled)
        return pooled @ w["out"] + w["out_b"][0]

    def gradient(self, windows: list[list[str]], labels: np.ndarray, rng: np.random.Generator) -> tuple[float, dict[str, np.ndarray]]:
        w, n = self.w, STATE
        distinct = sorted({x for win in windows for x in win})
        at = {x: i for i, x in enumerate(distinct)}
        index = np.full((max(map(len, windows)), len(windows)), -1)
        for b, win in enumerate(windows):
            index[: len(win), b] = [at[x] for x in win]
        ck, wk = {}, {}
        projected = self.read(distinct, ck, rng.random(len(distinct)) < 0.5)
        p = sigmoid(self.pool(projected[:, : 3 * n], projected[:, 3 * n :], index, wk).astype(np.float64))
        loss = -np.mean(np.log(np.where(labels > 0.5, p, 1 - p) + 1e-9))
        g: dict[str, np.ndarray] = {}
        d = ((p - labels) / len(labels)).astype(np.float32)
        g["out"], g["out_b"] = wk["pooled"].T @ d, np.array([d.sum()], np.float32)
        dpool = d[:, None] * w["out"]
        dalpha = np.einsum("bh,tbh->tb", dpool, wk["h"])
        dh = wk["alpha"][:, :, None] * dpool[None]
        de = wk["alpha"] * (dalpha - (wk["alpha"] * dalpha).sum(0))
        g["att_v"] = np.einsum("tb,tba->a", de, wk["a"])
        da = de[:, :, None] * w["att_v"] * (1 - wk["a"] ** 2)
        g["att"], g["att_b"] = np.einsum("tbh,tba->ha", wk["h"], da), da.sum((0, 1))
        dh = (dh + da @ w["att"].T).astype(np.float32)
        steps, rows = index.shape
        dp = np.zeros((steps, rows, 6 * n), np.float32)
        part = np.zeros((steps, rows, 3 * n), np.float32)
        g["u_f"] = Gated.back(wk["kf"], w["u_f"], None, dh[:, :, :n], part)
        dp[:, :, : 3 * n] = part
        g["u_b"] = Gated.back(wk["kb"], w["u_b"], None, dh[:, :, n:], part)
        dp[:, :, 3 * n :] = part
        dproj = np.zeros_like(projected)
        live = index >= 0
        add_rows(dproj, index[live], dp[live])
        g["bias"], g["join"] = dproj.sum(0), ck["h"].T @ dproj
        g["word"] = np.zeros_like(w["word"])
        known = ck["ids"] >= 0
        add_rows(g["word"], ck["ids"][known], dproj[known])
        dhc = dproj @ w["join"].T
        chars = ck["chars"]
        dpc = np.zeros((*chars.shape, 3 * CHAR_STATE), np.float32)
        for side, u, k, part in (("char_f", "cu_f", "kf", dhc[:, :CHAR_STATE]), ("char_b", "cu_b", "kb", dhc[:, CHAR_STATE:])):
            g[u] = Gated.back(ck[k], w[u], np.ascontiguousarray(part), None, dpc)
            g[side] = np.zeros_like(w[side])
            add_rows(g[side], chars.ravel(), dpc.reshape(-1, dpc.shape[2]))
        return float(loss), g

    def logit(self, top: np.ndarray | float):
        return self.slope * (top - self.shift)


class Adam:
    """Steps by running means of gradients and of their squares. Rows of ``SPARSE`` tables that a batch doesn't touch stay as they are."""

    SPARSE = ("word",)

    def __init__(self, w: dict[str, np.ndarray]):
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0

    def step(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        touched = {k: np.flatnonzero(g[k].any(1)) for k in self.SPARSE}
        g = {k: x[touched[k]] if k in touched else x for k, x in g.items()}
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        for k, x in g.items():
            rows = touched.get(k, slice(None))
            x = x * scale
            m, v = self.m[k][rows], self.v[k][rows]
            m += 0.1 * (x - m)
            v += 0.01 * (x * x - v)
            self.m[k][rows], self.v[k][rows] = m, v
            w[k][rows] -= (rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


class Scorer:
    """Scores texts with remembered word projections; one for each worker."""

    def __init__(self, net: Network):
        self.net, self.at = net, {}
        # By direction, so that a step gathers from one stretch of memory.
        self.tables = [np.zeros((1024, 3 * STATE), np.float32) for _ in range(2)]

    def indices(self, texts: list[list[str]]) -> list[np.ndarray]:
        fresh = list({x for words in texts for x in words if x not in self.at})
        if len(self.at) + len(fresh) > REMEMBERED:
            self.at = {}
            fresh = list({x for words in texts for x in words})
        need = len(self.at) + len(fresh)
        if need > len(self.tables[0]):
            rows = max(need, min(2 * need, REMEMBERED)) - len(self.at)
            self.tables = [np.concatenate([x[: len(self.at)], np.zeros((rows, 3 * STATE), np.float32)]) for x in self.tables]
        fresh.sort(key=len)
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            first = len(self.at)
            made = self.net.read(part)
            self.tables[0][first : first + len(part)], self.tables[1][first : first + len(part)] = made[:, : 3 * STATE], made[:, 3 * STATE :]
            self.at.update(zip(part, range(first, first + len(part)), strict=True))
        get = self.at.__getitem__
        return [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]

    def windows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The logits of all windows of all texts, and the text that each belongs to."""
        got = self.indices(texts)
        long, short, owner_long, owner_short = [], [], [], []
        for k, ids in enumerate(got):
            if len(ids) >= WINDOW:
                starts = np.array(window_starts(len(ids)))
                long.append(ids[starts[None, :] + np.arange(WINDOW)[:, None]])
                owner_long.append(np.full(len(starts), k))
            elif len(ids):
                short.append(np.concatenate([ids, np.full(WINDOW - len(ids), -1)])[:, None])
                owner_short.append(np.full(1, k))
        logits, owners = [], []
        for index, owner in ((long, owner_long), (short, owner_short)):
            if index:
                index, owner = np.concatenate(index, 1), np.concatenate(owner)
                for at in range(0, index.shape[1], 2048):
                    logits.append(self.net.pool(*self.tables, np.ascontiguousarray(index[:, at : at + 2048])))
                owners.append(owner)
        return (np.concatenate(logits), np.concatenate(owners)) if logits else (np.zeros(0), np.zeros(0, int))

    def highest(self, texts: list[list[str]]) -> np.ndarray:
        top = np.full(len(texts), -np.inf)
        logits, owners = self.windows(texts)
        np.maximum.at(top, owners, logits)
        return top

    def score(self, texts: list[str | None]) -> list[float]:
        out: list[float] = []
        # Few texts at a time: their words' projections must fit into what is remembered.
        group: list[list[str]] = []
        for words in map(words_of, texts):
            if group and sum(map(len, group)) + len(words) > REMEMBERED // 2:
                out += self.highest(group).tolist()
                group = []
            group.append(words)
        out += self.highest(group).tolist() if group else []
        top = np.array(out, np.float64)
        return np.where(top == -np.inf, 0.0, sigmoid(self.net.logit(top))).tolist()


def marks_of(words: list[str]) -> set[str]:
    """Words and their beginnings."""
    return {w[:n] for w in set(words) for n in (3, 4, 5, 6, 24) if n <= len(w) or n == 24}


def learn(texts: list[str], labels: list[int], seed: int = 7, passes: int = 6, batch: int = 64) -> Network:
    """Fits a network to labelled texts."""
    rng = np.random.default_rng(seed)
    # One string for each distinct word, however often it occurs.
    distinct: dict[str, str] = {}
    docs = [[distinct.setdefault(w, w) for w in words_of(t)] for t in texts]
    del distinct
    y = np.array([label for words, label in zip(docs, labels, strict=True) if words], bool)
    docs = [words for words in docs if words]
    counts = Counter(w for words in docs for w in set(words))
    net = Network([w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n >= SEEN], seed)
    if not y.any() or y.all():
        net.w["out_b"][:] = 8 if len(y) and y.all() else -8
        return net
    # Which words and beginnings set toxic documents apart.
    toxic, clean = Counter(), Counter()
    for words, label in zip(docs, y, strict=True):
        (toxic if label else clean).update(marks_of(words))
    odds = {m: np.log((n + 0.5) / (y.sum() + 1)) - np.log((clean[m] + 0.5) / ((~y).sum() + 1)) for m, n in toxic.items() if n >= 2}
    cut = lambda words, s: words[s : s + WINDOW]
    positive, negative = [], []
    for words, label in zip(docs, y, strict=True):
        starts = window_starts(len(words))
        if not starts:
            continue
        if label:
            value = [max((odds.get(m, -9.0) for m in marks_of([w])), default=-9.0) for w in words]
            rated = sorted(((max(value[s : s + WINDOW]), s) for s in starts), reverse=True)
            positive += [cut(words, s) for v, s in rated[:2] if v >= rated[0][0] - 0.5]
        else:
            negative += [cut(words, int(s)) for s in rng.choice(starts, min(len(starts), 2), replace=False)]
    adam = Adam(net.w)
    for k in range(passes):
        if k in (2, 4):
            scorer, top, mined = Scorer(net), [], []
            for at in range(0, len(docs), 32):
                part = docs[at : at + 32]
                logits, owners = scorer.windows(part)
                for i, words in enumerate(part):
                    mine = logits[owners == i]
                    if not len(mine):
                        continue
                    s = window_starts(len(words))[int(mine.argmax())]
                    (top if y[at + i] else mined).append((float(mine.max()), cut(words, s)))
            positive = [x for v, x in top if v > -3] or positive
            negative += [x for v, x in sorted(mined, key=lambda x: -x[0]) if v > -4]
        data = [(x, 1.0) for x in positive] + [(x, 0.0) for x in negative]
        steps = max(len(data) // batch, 24)
        order = np.concatenate([rng.permutation(len(data)) for _ in range(-(-steps * batch // len(data)))])
        for s in range(steps):
            part = [data[i] for i in order[s * batch : (s + 1) * batch]]
            _, g = net.gradient([x for x, _ in part], np.array([v for _, v in part]), rng)
            adam.step(net.w, g, 0.01 / (1 + 0.5 * k))
    scorer = Scorer(net)
    top = np.concatenate([scorer.highest(docs[at : at + 32]) for at in range(0, len(docs), 32)])
    curve(net, top[np.isfinite(top)], y[np.isfinite(top)])
    return net


def curve(net: Network, top: np.ndarray, y: np.ndarray) -> None:
    """The cut between the labels' highest windows that errs least (its middle, where several do), and a slope."""
    order = np.argsort(top)
    sorted_top, sorted_y = top[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(sorted_y)]) + CLEAN_WEIGHT * np.concatenate([np.cumsum(~sorted_y[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    edges = np.concatenate([[sorted_top[0] - 1], sorted_top, [sorted_top[-1] + 1]])
    middle = (edges[best] + edges[best + 1]) / 2
    widest = int((edges[best + 1] - edges[best]).argmax())
    net.shift = float(middle[widest])
    net.slope = 1.0


def held_out(doc_id) -> F.Column:
    """Rows that are never learned from; rows without an id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = DOCS, clean: int = CLEAN_DOCS) -> Network:
    """Learns from at most so many labelled documents of each label, the first by a hash of their ids."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [known.where((F.col("toxic") > 0) == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for side, n in ((True, toxic), (False, clean))]
    chosen = parts[0].unionByName(parts[1])
    # No more ids than the two bounds.
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= DOC_BYTES)
    rows = short.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").collect()
    rows = sorted({(r["doc_id"], int(r["toxic"] > 0), r["text"]) for r in rows})
    texts, marks = [r[2] for r in rows], [r[1] for r in rows]
    del rows
    net = learn(texts, marks)
    del texts
    give_back()  # else the driver holds what training took for as long as it lives
    return net


def score(df: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """Adds a score from 0 to 1. The network's size is bounded by the constants above."""
    return map_columns(df, [text], fields(**{out: DoubleType()}), lambda scorer, texts: [(x,) for x in scorer.score(texts)], lambda: Scorer(net))
