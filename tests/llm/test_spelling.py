import collections
import re
import zlib

import numpy as np
import pyarrow as pa

from geoquilt.llm import spelling

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, every=31, shortest=7):
    n = collections.Counter()
    for key, text in rows:
        for run in LETTERS.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, c in n.items():
        others = [x for x in n if x != w and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * c else None
        out[w] = [form[w], None, c, len(others), n[form[w]] if form[w] else None]
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        out[w][1] = at
    return {(w, *x) for w, x in out.items()}


def corpus(seed=1, docs=60):
    r = np.random.Generator(np.random.PCG64(seed))
    base = ["quality", "quantity", "Ähnlichkeit", "ähnlichkeit", "ÀÉÎÕÜÿø", "sentence", "sentences", "sentenced", "aaaaaaaa", "aaaaaaaaa", "abababab", "short", "naïvetés", "x×÷yzzzz", "zzzzzzzz" * 12]
    weight = np.array([2.0 ** -(i % 7) for i in range(len(base))])
    rows = []
    for i in range(docs):
        words = [base[k] for k in r.choice(len(base), 60, p=weight / weight.sum())]
        for k in range(len(words)):
            if r.random() < 0.08:
                w, p = words[k], int(r.integers(0, 6))
                words[k] = [w[:p] + w[p + 1 :], w[:p] + "q" + w[p:], w[:p] + "ß" + w[p + 1 :], w.upper()][r.integers(0, 4)]
        rows.append((i * 3, "".join(w + [" ", "\n", "1", ", ", "́", "Ā"][r.integers(0, 6)] for w in words)))
    rows += [(1000 + i, "plateauing " * 10 + "plateauin " * (i % 10 < 7) + "plateaui " * (i < 3)) for i in range(50)]
    return [*rows, (None, "quality " * 3), (5, None), (6, ""), (7, "qualitys " * 40), (7, "qualitys " * 40), (8, "y" * 3000 + " " + "y" * 3000), (9, "Qualityß"), (10, "qualityß")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)


def test_variants_by_comparing_all(spark):
    rows = corpus()
    got = spelling.variants(frame(spark, rows)).collect()
    want = brute(rows)
    assert set(map(tuple, got)) == want and len(got) == len(want)
    assert any(x.form and x.root != x.form for x in got)  # some chain is longer than one
    assert spelling.variants(frame(spark, rows).limit(0)).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "a b")])).collect() == []


def test_neighbourhood_holds_all_and_only_neighbours():
    words, letters = ["aab", "b", "éa", "aaa"], ["a", "b", "é"]
    want = set()
    for w in words:
        for i in range(len(w) + 1):
            want |= {(w, w[:i] + c + w[i:]) for c in letters}
            if i < len(w):
                want |= {(w, w[:i] + w[i + 1 :])} | {(w, w[:i] + c + w[i + 1 :]) for c in letters if c != w[i]}
    assert set(spelling.neighbourhood(words, letters)) == want
    known = np.zeros(1 << (spelling._BITS - 3), np.uint8)
    at = spelling.positions(spelling.Coded(sorted({c for _, c in want})).total)
    np.bitwise_or.at(known, at >> 3, (1 << (at & 7)).astype(np.uint8))
    assert set(spelling.neighbourhood(words, letters, known)) == want  # every candidate's hash by arithmetic is its own hash


def test_crc_of_spans():
    r = np.random.Generator(np.random.PCG64(2))
    data = r.integers(0, 256, 5000).astype(np.uint8)
    cuts = np.sort(r.choice(5000, 120, replace=False))
    starts, ends = cuts[:-1], cuts[1:]
    begun = np.array([zlib.crc32(str(i).encode()) for i in range(len(starts))], np.uint32)
    want = [zlib.crc32(str(i).encode() + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(starts, ends))]
    assert spelling.crc32(data, starts, ends, begun).tolist() == want


def test_words_in_one_piece():
    text = "The Qualitý of ÄHNLICHkeit"
    raw = text.encode()
    got = spelling._words([1], np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 1 << 32, 3)
    assert isinstance(got, pa.LargeStringArray) and got.to_pylist() == ["the", "quality", "Ähnlichkeit"]
