import random

import numpy as np

from geoquilt.llm import langid


def test_gradients_match_differences():
    model = langid.ByteGRU(3, 3, seed=1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = langid.padded([b"abca", b"ba", b"cab"]), np.array([0, 2, 1])
    _, grads = model.gradients(x, y)
    for name, place in (("out", (1, 2)), ("bias", (2, 0)), ("fx", (1, 97)), ("bx", (7, 98)), ("fu", (4, 1)), ("bu", (8, 2)), ("fx", (3, 256))):
        held = model.p[name][place]
        values = []
        for e in (1e-2, -1e-2):
            model.p[name][place] = held + e
            values.append(model.gradients(x, y)[0])
        model.p[name][place] = held
        assert abs((values[0] - values[1]) / 2e-2 - grads[name][place]) < 2e-4


def test_identifies_held_out_texts(spark):
    r = random.Random(4)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["ción", "ñe", "os"]}
    rows = [(i, "".join(r.choice(syllables[k]) + r.choice(["", " "]) for _ in range(r.randint(3, 400))), k, 1) for i in range(300) for k in [r.choice(list(syllables))]]
    rows += [(1000, None, "aa", 1), (1001, "", "bb", 1), (1002, "123 ...", "cc", 1), (1003, "kalomi", None, 1), (None, "kalo", "aa", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.identified(docs, steps=120).collect()
    truth = {x[0]: x[2] for x in rows}
    assert len(got) == len(rows)
    held = [x for x in got if x.held_out and x.doc_id < 1000]
    assert len(held) > 20 and sum(x.lang_pred == truth[x.doc_id] for x in held) / len(held) > 0.97
    assert {(x.lang_pred, x.score) for x in got if x.doc_id in (1000, 1001, 1002)} == {("und", 0.0)}
    assert all(0 <= x.score <= 1 for x in got)
    assert langid.identified(docs.limit(0)).count() == 0


def test_every_label_can_be_predicted(spark):
    r = random.Random(9)
    letters = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopq"]
    rows = [(i * 5 + 1, f"{letters[i % 70]} " * r.randint(4, 40), f"l{i % 70}") for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, names = langid.learned(docs, steps=1)
    assert model.labels == 70 and names == sorted({f"l{k}" for k in range(70)})


def test_sample_is_bounded_and_of_whole_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid.ByteGRU, "train", lambda self, windows, labels, steps: seen.update(windows=windows, labels=labels))
    rows = [(1, "x" * 64 + "y" * 64 + "z" * 10, "a")] * 500 + [(i, "w", "b") for i in range(2000)] + [(None, "v", "b")] * 50
    langid.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_label=20, windows=2)
    a = [w for w, k in zip(seen["windows"], seen["labels"]) if k == 0]
    assert sorted(a) == [b"x" * 64, b"y" * 64, b"z" * 10] and sum(seen["labels"] == 1) <= 20


def test_pooled_equals_every_position_alone():
    model = langid.ByteGRU(3, 4, seed=2)
    r = np.random.Generator(np.random.PCG64(3))
    texts = [bytes(r.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 5, 192, 193, 700, 64)]
    got = langid.pooled(model, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(d, w):
        h, out, n = np.zeros(4), [], 4
        for c in w if d == "f" else w[::-1]:
            g, s = model.p[d + "x"][:, c], model.p[d + "u"] @ h
            z, q = sigmoid(g[:n] + s[:n]), sigmoid(g[n : 2 * n] + s[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(g[2 * n :] + q * s[2 * n :])
            out.append(h)
        return out if d == "f" else out[::-1]

    for text, mine in zip(texts, got):
        sums = np.zeros(3)
        for k in range(0, len(text), 192):
            w = text[k : k + 192]
            for f, b in zip(states("f", w), states("b", w)):
                a = np.exp(model.p["out"] @ np.concatenate([f, b]) + model.p["bias"][:, 0])
                sums += a / a.sum()
        assert np.allclose(mine, sums / max(1, len(text)), atol=1e-5)
