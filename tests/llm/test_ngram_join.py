import random
import re
from fractions import Fraction

import numpy as np

from geoquilt.llm import ngram_join, textscan


def brute(rows, n, num, den):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) * den >= len(x | y) * num:
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(n, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Été", "ÉCOLE", "AbC"]
    passage = " ".join(r.choices(vocabulary, k=40))
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.5 or not rows:
            text = " ".join(r.choices(vocabulary, k=r.randint(0, 120)))
            if r.random() < 0.4:
                text += " \t" + passage
        else:
            words = (rows[r.randrange(len(rows))][1] or "").split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
            text = " ".join(words)
        rows.append((i * 3, text))
    return rows + [(9001, None), (9002, ""), (9003, "one"), (9004, "ONE"), (9005, "one two"), (9006, " \n")]


def test_join_equals_brute_force(spark):
    rows = corpus(220)
    for n, num, den in ((4, 85, 100), (3, 5, 10)):
        docs = spark.createDataFrame([(*x, "z", 1) for x in rows], "doc_id long, text string, size string, rep int").repartition(5)
        got = {x[0]: (x[1], x[2]) for x in ngram_join.joined(docs, n, Fraction(num, den), 16).collect()}
        assert got == brute(rows, n, num, den)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.joined(docs, 4, Fraction(85, 100), 16).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, None), (2, 3, 1), (3, 0, 3)], key=str)
    assert ngram_join.joined(docs.limit(0), 4, Fraction(85, 100), 16).count() == 0
    assert sorted(x[0] or 0 for x in ngram_join.kept(docs).collect()) == [0, 1, 3]


def test_windows_and_words():
    text = "ab  cd\tef " * 3
    data = np.frombuffer(text.encode() + b"x y", np.uint8)
    offsets = np.array([0, 5, 5, len(data)])
    starts, ends, first = textscan.words(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"c", b"d", *[b"ef", b"ab", b"cd"][:1], *[b"ab", b"cd", b"ef"] * 2, b"x", b"y"]
    assert first.tolist()[:3] == [0, 2, 2]
    h = np.arange(1, 30, dtype=np.uint64)
    for n in (1, 2, 3, 4, 5, 7, 13):
        w = textscan.windows(h, n)
        assert len(w) == 29 - n + 1 and len(set(w.tolist())) == len(w)
        shifted = np.concatenate([h[5 : 5 + n], h])
        assert textscan.windows(shifted, n)[0] == w[5]


def test_long_spans_hash_alike():
    data = np.frombuffer(b"q" * (9 << 17) + b" tail", np.uint8)
    one = textscan.span_hashes(data, np.array([0, len(data) - 4]), np.array([9 << 17, len(data)]))
    other = textscan.span_hashes(np.frombuffer(b"tail", np.uint8), np.array([0]), np.array([4]))
    assert one[1] == other[0]
    again = textscan.span_hashes(np.frombuffer(b"q" * (9 << 17), np.uint8), np.array([0]), np.array([9 << 17]))
    assert one[0] == again[0]


def test_an_id_with_several_texts(spark):
    words = [[f"{c}{k}" for k in range(40)] for c in "abcd"]
    near = lambda w: " ".join([*w[:-1], "other"])
    a, b, c, d = map(" ".join, words)
    rows = [(7, a), (7, b), (7, c), (7, ""), (3, d), (8, near(words[0])), (9, near(words[1])), (10, near(words[2])), (7, near(words[3])), (7, b), (11, None)]
    truth = [7, 7, 7, 7, 3, 7, 7, 7, 3, 7, 11]
    for parts in (2, 7):
        docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, size int").repartition(parts, "size")
        got = ngram_join.joined(docs, 4, Fraction(85, 100), 16).collect()
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted((i, brute([(i, t)], 4, 85, 100)[i][0], k) for (i, t), k in zip(rows, truth))
    stay = ngram_join.kept(docs, 4, Fraction(85, 100))
    assert stay.columns == docs.columns and sorted((x.doc_id, x.text or "") for x in stay.collect()) == [(3, d), (7, ""), (7, a), (7, b), (7, c), (11, "")]


def families(seed, count=150, words=60):
    """Near copies of a few texts that resemble each other, some with edits that others have too, around the threshold."""
    r = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    bases = [base]
    for k in range(3):
        other = list(r.choice(bases))
        for _ in range(r.choice([2, 5, 9])):
            other[r.randrange(words)] = f"o{k}{r.randrange(99)}"
        bases.append(other)
    common = [(r.randrange(words), f"e{k}") for k in range(8)]
    rows = []
    for i in range(count):
        text = list(r.choice(bases))
        for at, word in r.sample(common, r.choice([0, 0, 1, 2, 3])):
            text[at] = word
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            text[r.randrange(words)] = f"x{r.randrange(10**6)}"
        text = text[: words - r.choice([0, 0, 0, 7])]
        rows.append((1000 - i, " ".join(text)))
    return rows


def test_groups_of_near_copies(spark):
    for seed, (n, num, den) in enumerate([(4, 85, 100), (3, 6, 10)]):
        rows = families(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {x[0]: (x[1], x[2]) for x in ngram_join.joined(docs, n, Fraction(num, den), 16).collect()}
        want = brute(rows, n, num, den)
        assert got == want and len({c for _, c in want.values()}) > 3
