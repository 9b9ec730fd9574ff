import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from geoquilt.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_form(key, text, unit=UNIT.findall):
    text = text or ""
    t = unit(text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 50:
        return key, len(t), "plain", None, None, text
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return key, len(t), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def texts():
    r = np.random.Generator(np.random.PCG64(3))
    parts = [" ", "  ", "\n", "\t\x0b", "a", "Wort", "ÀÉ", "日本", "😀", " ", " ", "<S", "<", "P>", "<M", "\x1c", "\x00", "é"]
    rows = [(i, "".join(parts[k] for k in r.integers(0, len(parts), r.integers(0, 40)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "   "), (1003, "x"), (None, "null id here"), (None, None), (7, "again and again"), (7, "again and again"), (-5, "minus five"), (2**62, "so long an id")]
    rows += [(2000 + i, f"a <{s}> in it") for i in range(12) for s in "PSMX"]
    return [*rows, (3000, "é word\n" * 60_000), (3001, "u" * 300_000), (3002, " " * 100_000), (3004, "😀" * 90_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, form string, n int").repartition(3)


def test_forms_by_plain_lists(spark):
    rows = texts()
    out = fim.transformed(frame(spark, rows))
    got = out.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(x)[:6] for x in got), key=str) == sorted((plain_form(*x) for x in rows), key=str)
    source = {}
    for i, t in rows:
        source.setdefault(i, set()).add(t or "")
    assert all(x.again in source[x.doc_id] for x in got) and {x.form for x in got} == {"plain", "psm", "spm"}
    assert fim.transformed(frame(spark, rows).limit(0)).count() == 0


def test_characters_and_other_sentinels(spark):
    rows = texts()[:150]
    got = fim.transformed(frame(spark, rows), percent=100, sentinels=("[p]", "[suf]", "[m]"), unit="character").collect()
    for x in got:
        if x.form != "plain":
            p, m = x.prefix_chars, x.middle_chars
            whole = dict(rows)[x.doc_id]
            assert x.n == len(whole)
            a, b, c = whole[:p], whole[p : p + m], whole[p + m :]
            assert x.output == (f"[suf]{c}[p]{a}[m]{b}" if x.form == "spm" else f"[p]{a}[suf]{c}[m]{b}")


def test_each_cut_of_a_text():
    for text in ["a b", "  x  ", "ab  cd\n", "é 日 😀 ", " ", "z"]:
        for unit, split in (("token", UNIT.findall), ("character", list)):
            data = np.frombuffer(("Q" + text + "R").encode(), np.uint8)
            offsets = np.array([0, 1, 1, len(data) - 1, len(data)])
            held = fim.encoded(data, offsets, unit)
            units = split(text)
            assert held.counts().tolist() == [1, 0, len(units), 1]
            for u in range(len(units) + 1):
                place, chars = held.cut(np.array([0, 0, u, 1]))
                head = "".join(units[:u])
                assert (place[2], chars[2]) == (1 + len(head.encode()), len(head))
