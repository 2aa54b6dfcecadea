import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import toxicity

BAD = ["idiot", "moron", "scum"]


def corpus(n, seed, bad=BAD):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "is", "lo"]) for _ in range(rng.randrange(1, 4)))
    texts, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(5, 120))]
        if i % 4 == 0:
            for _ in range(rng.randrange(2, 5)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def net():
    return toxicity.learn(*corpus(400, 1))


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(["ab", "cd"], 1)
    net.w = {k: v.astype(np.float64) + 0.05 * rng.standard_normal(v.shape) for k, v in net.w.items()}
    windows, labels = [["ab", "cd", "xyz"], ["cd"], ["ab", "ab"]], np.array([1.0, 0.0, 1.0])
    loss = lambda: net.gradient(windows, labels, np.random.default_rng(5))
    _, g = loss()
    for k in net.w:
        at = np.unravel_index(int(np.abs(g[k]).argmax()), g[k].shape)
        old = net.w[k][at]
        net.w[k][at] = old + 1e-4
        up = loss()[0]
        net.w[k][at] = old - 1e-4
        down = loss()[0]
        net.w[k][at] = old
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-3 + 0.02 * abs(g[k][at]), k


def test_held_out_accuracy(net):
    texts, labels = corpus(300, 2)
    scores = np.array(toxicity.Scorer(net).score(texts))
    assert ((scores >= 0.5) == np.array(labels, bool)).mean() > 0.97


def test_whole_texts_are_scored(net, spark, clashing):
    clean = "on er th is an lo " * 3000
    rows = [(1, clean), (2, clean + "idiot moron scum"), (3, None), (4, ""), (5, "!?"), (6, "a"), (2, clean + "idiot moron scum"), (7, "x" * 100_000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "score", "top")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, net).collect()}
    assert got[2] >= 0.5 > got[1] and got[3] == got[4] == got[5] == 0 and all(0 <= x <= 1 for x in got.values())


def test_windows_cover_all():
    for n in (0, 1, 23, 24, 25, 36, 37, 100, 101):
        starts = toxicity.window_starts(n)
        assert set(range(n)) == {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}


def test_hold_out_is_no_part_of_learning(spark, monkeypatch):
    texts, labels = corpus(60, 3)
    docs = spark.createDataFrame([*enumerate(texts), (None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame([*enumerate(labels), (3, 1), (None, 1)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "learn", lambda t, y: seen.extend(zip(t, y, strict=True)))
    toxicity.fit(docs, marks)
    want = {(texts[i], 1 if i == 3 else labels[i]) for i in range(60) if zlib.crc32(str(i).encode()) % 5}
    assert set(seen) == want
    flags = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in flags)


def plain_scan(inputs, u):
    """A gated layer, one row at a time, by the formulas."""
    n, h, out = u.shape[0], np.zeros(u.shape[0]), []
    logistic = lambda v: 1 / (1 + np.exp(-v))
    for x in inputs:
        z, r = logistic(x[:n] + h @ u[:, :n]), logistic(x[n : 2 * n] + h @ u[:, n : 2 * n])
        h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * (h @ u[:, 2 * n :]))
        out.append(h)
    return out


def plain_score(net, text):
    """The highest window's score, window by window and word by word."""
    w, words = net.w, toxicity.words_of(text)
    n, logits = toxicity.STATE, []

    def vector(word):
        codes = [ord(c) if ord(c) < toxicity.WIDEST else ord(c) % 128 + toxicity.WIDEST - 128 for c in word]
        h = np.concatenate([plain_scan(w["char_f"][codes], w["cu_f"])[-1], plain_scan(w["char_b"][codes[::-1]], w["cu_b"])[-1]])
        return h @ w["join"] + w["bias"] + w["word"][net.ids.get(word, -1)]

    for s in toxicity.window_starts(len(words)):
        x = [vector(word) for word in words[s : s + toxicity.WINDOW]]
        h = np.stack([np.concatenate(p) for p in zip(plain_scan([v[: 3 * n] for v in x], w["u_f"]), plain_scan([v[3 * n :] for v in x[::-1]], w["u_b"])[::-1], strict=True)])
        e = np.exp(np.tanh(h @ w["att"] + w["att_b"]) @ w["att_v"])
        logits.append((e / e.sum()) @ h @ w["out"] + w["out_b"][0])
    return 1 / (1 + np.exp(-net.slope * (max(logits) - net.shift))) if logits else 0.0


def test_scores_match_a_plain_forward_pass(net):
    rng = random.Random(6)
    texts = ["", "a", "idiot", "é日本 x", "word " * 23, "w " * 24, "x " * 25, "a1_b " * 61, "y" * 60]
    texts += [" ".join(rng.choice([*BAD, "an", "erth", "Éa", "zz9"]) for _ in range(rng.randrange(80))) for _ in range(25)]
    got = toxicity.Scorer(net).score(texts)
    assert max(abs(g - plain_score(net, x)) for g, x in zip(got, texts, strict=True)) < 1e-3


def test_rows_are_added_with_repeats():
    rng = np.random.default_rng(3)
    index, rows, target = rng.integers(0, 9, 50), rng.standard_normal((50, 4)), np.zeros((9, 4))
    toxicity.add_rows(target, index, rows)
    want = np.zeros((9, 4))
    np.add.at(want, index, rows)
    assert np.allclose(target, want)


def test_nothing_to_learn_from(spark):
    for texts in (["", ""], ["", "a b"], ["!!", None or ""]):
        assert toxicity.Scorer(toxicity.learn(texts, [1, 0])).score(["a b c", ""])[1] == 0
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "x " * 20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    assert all(r["score"] < 0.5 for r in toxicity.score(docs, net).collect())


def test_one_label_only():
    assert max(toxicity.Scorer(toxicity.learn(["a b", "c"], [0, 0])).score(["a", "idiot"])) < 0.5
    assert toxicity.learn([], []).ids == {}


def test_pipeline(spark, tmp_path):
    texts, labels = corpus(240, 5)
    rng = random.Random(8)
    passage = " ".join("".join(rng.choice(["an", "er", "th", "on", "is", "lo"]) for _ in range(3)) for _ in range(40))
    # The words are the classifier's own, or it might reject these rows.
    texts += [texts[1], texts[2] + " extra", "clean words " + passage, "x y z " * 90 + " ".join(passage.split()[:13]), 'an er token = "abcdef0123456789" on the is an lo er an', None, ""]
    d = str(tmp_path)
    rows = [(i, x, "en", "src", len(x or "")) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        path = f"{d}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    wrong = sum((i in kept["toxicity"]) == bool(y) for i, y in enumerate(labels))
    assert wrong <= 4
    gone = set(kept["toxicity"]) - set(kept["near-duplicates"])
    assert gone & {240, 241} == {240, 241} and len(gone) <= 6
    assert set(kept["near-duplicates"]) - set(kept["decontamination"]) == {242}
    last = kept["secrets"][244]
    assert last["text"] == "an er [secret]\" on the is an lo er an" and last["n_chars"] == len(last["text"])
    final = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in final} == set(kept["secrets"]) and all(r["round_trips"] and r["n_tokens"] == len(r["ids"]) for r in final)
