import hashlib
import random
import re

from geoquilt.llm.substrings import deduplicated


def brute(rows, n):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - n + 1) if i is not None else ():
            key = tuple(w[k : k + n])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1) if i is not None else ():
            if least[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        text = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(text.encode()).hexdigest(), text))
    return out


def corpus(count, seed=2):
    r = random.Random(seed)
    v = [f"v{k}" for k in range(60)] + ["é", "Z"]
    passages = [" ".join(r.choices(v, k=r.randint(4, 30))) for _ in range(5)]
    rows = []
    for i in range(count):
        text = " ".join(r.choices(v, k=r.randint(0, 50)))
        for _ in range(r.choice([0, 1, 2])):
            text += r.choice([" ", "\n ", "\t"]) + r.choice(passages) + " " + " ".join(r.choices(v, k=r.randint(0, 9)))
        if rows and r.random() < 0.2:
            text = r.choice(rows)[1]
        rows.append((count * 2 - i, text))
    return rows


def test_equals_brute_force(spark):
    rows = [*corpus(150), (5, None), (6, ""), (7, " \n "), (None, "v1 v2 v3 v4 v5 v6 v7 v8"), (8, "v1 v2 v3 v4 v5 v6 v7 v8"), (9, "a " * 60), (10, "a " * 30), (10, "a " * 30)]
    docs = spark.createDataFrame([(*x, 1, "q") for x in rows], "doc_id long, text string, position int, whole string").repartition(4)
    for n in (13, 5):
        got = sorted(map(tuple, deduplicated(docs, n, 16, with_text=True).collect()), key=str)
        assert got == sorted(brute(rows, n), key=str)
    assert sorted(map(tuple, deduplicated(docs, 5, 16, with_text=True, most_broadcast=0).collect()), key=str) == got
    assert deduplicated(docs.limit(0), 13, 16).count() == 0


def test_one_id_with_two_texts(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "x a b c d e f g y")]
    got = sorted(map(tuple, deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 5, 16, with_text=True).collect()))
    assert got == sorted(brute(rows, 5))
