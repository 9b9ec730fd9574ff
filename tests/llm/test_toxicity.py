import random
import re

import numpy as np

from geoquilt.llm import toxicity


def evidence(texts, scorer):
    raw = [x.encode() if isinstance(x, str) else x for x in texts]
    found = toxicity.evidences(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), scorer)
    return [found.get(k, 0.0) for k in range(len(texts))]


def test_grammar():
    s = toxicity.Scorer({"idiot$": 6.0, "vequ": 6.0})
    plain = s.clause("what an idiot that is")
    assert plain == 6.0 and s.clause("idiots are here") == 0.0 and s.clause("Vequelque chose") == 6.0
    assert s.clause("he is not an idiot") < plain < s.clause("you are an idiot") == s.clause("an idiot like you")
    assert s.clause("she said he is an idiot") < plain < s.clause("this vequ idiot")
    assert s.clause("she said he is not an idiot") < s.clause("he is not an idiot")
    assert s.clause("I will kill it") == 0 < s.clause("you I will kill")
    assert s.clause("idiot") == s.clause("Idiot 77, idiot") == 0 < s.clause("idiot man")  # a word beside which nothing stands is no clause
    assert s.score(0) < 0.05 and s.score(6) > 0.7
    assert evidence(["x" * 50 + ". " + "ok then. an Idiot here! fine. Vequ not"], s) == [12.0]
    far = "she said " + "that and this, " * 400 + "he is an idiot"
    assert evidence([far, far[9:]], s) == [6.0 * s.factors["report"], 6.0]


def paths(machines, symbols):
    """Every path of the cascade, enumerated machine by machine: outputs, product of factors at each step, final factor."""
    row, factors, final = list(symbols), [1.0] * len(symbols), 1.0
    for m in machines:
        state = 0
        for k, x in enumerate(row):
            state, row[k], f = m.step(state, x)
            factors[k] *= f
        final *= m.final.get(state, 1.0)
    return row, factors, final


def test_composition_equals_the_cascade():
    factors = {"compound": 1.5, "target": 1.25, "negation": 0.4, "report": 0.6}
    machine, parts, r = toxicity.grammar(factors), toxicity.machines(factors), random.Random(5)
    for _ in range(3000):
        symbols = r.choices("ihTNRo", k=r.randint(0, 9))
        state, out, got = 0, [], []
        for x in symbols:
            state, y, f = machine.step(state, x)
            out.append(y)
            got.append(f)
        row, want, final = paths(parts, symbols)
        assert out == row and np.allclose(got, want) and np.isclose(machine.final.get(state, 1.0), final)


def test_each_transducer_tells():
    lexicon = {"idiot$": 6.0, "scum$": 5.0}
    whole = toxicity.Scorer(lexicon)
    for k, text in enumerate(["what an idiot", "I will kill you", "you are scum", "he is not an idiot", "she said he is an idiot"]):
        assert whole.clause(text) != toxicity.Scorer(lexicon, without=k).clause(text), text
    assert whole.contexts("you stupid scum") == {"target"} and whole.contexts("scum") == set()
    assert whole.contexts("she said he is not an idiot") == {"negation", "report"} and whole.contexts("an idiot") == {"plain"} and whole.contexts("kill you") == {"threat"}


def test_learned_factors():
    f = toxicity.learned_factors({"plain": (100, 100), "negation": (0, 80), "target": (60, 60), "report": (5, 10)})
    assert set(f) == {"negation", "target", "report"} and f["negation"] < 0.1 and 1.0 < f["target"] < 1.25 and 0.5 < f["report"] < 0.6
    assert toxicity.learned_factors({}) == {}


def test_learns_and_scores(spark):
    r = random.Random(7)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ten", "the") for b in ("ra", "sch", "ung", "é") for c in ("os", "en", "ta", "")]
    insults = ["worthless", "Scum", "Équx", "lostra"]
    rows, labels = [], []
    for i in range(900):
        words = r.choices(vocabulary, k=r.randint(3, 80))
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(3):
                w = r.choice(insults)
                words.insert(r.randrange(len(words)), w + (r.choice(["an", "un", "iö"]) if w == "lostra" else ""))
        rows.append((i, " ".join(words) + r.choice([".", "\n"])))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "some scum worthless"), (0, rows[0][1])]
    docs = spark.createDataFrame([(*x, "s", 0.5) for x in rows], "doc_id long, text string, toxic string, score double")
    frame = spark.createDataFrame([*labels, (None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, frame).collect()
    truth = {i: t for i, _, t in labels}
    assert len(got) == len(rows)
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(held) > 100 and sum(x.predicted == truth[x.doc_id] for x in held) / len(held) > 0.98
    assert all(x.predicted == 0 for x in got if x.doc_id in (2000, 2001)) and [x.predicted for x in got if x.doc_id is None] == [1]
    kept = toxicity.accepted(docs, frame)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in got if not x.predicted}
    assert toxicity.scored(docs.limit(0), frame.limit(0)).count() == 0
    assert all(x.predicted == 0 for x in toxicity.scored(docs, frame.limit(0)).collect())


def test_prefilter_misses_no_clause():
    s = toxicity.Scorer({"idiot": 6.0, "scum$": 5.0, "ass$": 4.0, "élan$": 3.0, "дура": 7.0, "λόγος$": 6.0, "œuvre$": 5.0})
    marks = ["¡", "¿", "«", "“", "”", "—", "’", "‘", "…", "\u00a0", "\u2009", "、", "🙂", "\u0301", "²", "٣", "_", "7", "'", "l'", "qu’", ""]
    for m in ("¡", "¿", "«", "“", "—", "\u00a0", "’", "l'", "İ"):
        assert evidence([f"ça va {m}Idiot!"], s) == [6.0], m
    assert evidence(["éidiot", "l'ami", b"\xff x idiot", "", "an\xa0ÉLAN"], s) == [0.0, 0.0, 6.0, 0.0, 3.0]
    words = ["idiot", "IDIOTS", "Scum", "scums", "ass", "ÉLAN", "ДУРАК", "ΛΌΓΟΣ", "ŒUVRE", "you", "NOT", "said", "kein", "İdiot", "été", "x", "kill"]
    r = random.Random(3)
    texts = ["".join(r.choice(marks) + r.choice(words) + r.choice([" ", "", r.choice(marks), ". ", "! ", "\n"]) for _ in range(r.randint(0, 12))) for _ in range(2000)]
    whole = [sum(map(s.clause, re.split(r"(?<=[.!?;\n])", x))) for x in texts]
    assert np.allclose(evidence(texts, s), whole) and sum(x > 0 for x in whole) > 1000


def test_learns_both_sides_of_an_apostrophe(spark):
    rows = [(i, f"ami{i} parle de chose{i}" + (" l'affreux" if i % 5 == 0 else " l'aimable")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels).collect()
    assert all(x.predicted == (x.doc_id % 5 == 0) for x in got)


def test_threats():
    s = toxicity.Scorer({"idiot$": 6.0})
    toxic = lambda x: s.score(s.clause(x)) >= 0.3
    for x in ("I will kill you", "you I will kill", "je vais te tuer toi", "I'll shoot all of you", "kill it and hurt you", "I will kill you're"):
        assert toxic(x), x
    for x in ("I will kill it", "I will not kill you", "she said I will kill you", "kill a b c you", "you a b c kill", "you"):
        assert not toxic(x), x
    assert s.clause("hurt you") == s.clause("you hurt") == 5.0 and s.clause("kill you hurt") == 10.0
    assert s.clause("kill you you") == 5.0 and s.clause("kill the idiot") == 6.0 and s.clause("kill it not hurt you") == 2.0
    assert evidence(["ok. «Kill» you", "kill. You"], s) == [5.0, 0.0]


def test_threats_without_labels(spark):
    docs = spark.createDataFrame([(1, "I will kill you"), (2, "I will kill it")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x.doc_id: x.predicted for x in toxicity.scored(docs, labels).collect()} == {1: 1, 2: 0}
    assert [x.doc_id for x in toxicity.accepted(docs, labels).collect()] == [2]
