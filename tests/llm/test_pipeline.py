"""Each stage against what brute force makes of its own input, and the whole over the smallest tables."""

import collections

import pytest

from geoquilt.llm import mixing, ngram_join, substrings

from .test_ngram_join import brute as brute_join
from .test_ngram_join import corpus as near_corpus
from .test_substrings import brute as brute_cut
from .test_substrings import corpus as cut_corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def test_one_of_each_group_stays(spark):
    rows = near_corpus(120, 9)
    got = sorted(map(tuple, ngram_join.kept(docs(spark, rows)).collect()), key=str)
    label = brute_join(rows, 5, 8, 10)
    assert got == sorted([tuple(x) for x in docs(spark, rows).collect() if label[x.doc_id][1] == x.doc_id], key=str)


def test_cuts_take_effect(spark):
    rows = [*cut_corpus(80, 4), (None, "a b"), (500, None)]
    got = sorted(map(tuple, substrings.cleaned(docs(spark, rows), 13, 16).collect()), key=str)
    want = []
    for (i, t), (_, _, gone, _, left) in zip(rows, brute_cut(rows, 13)):
        if not gone or left:
            want.append((i, left if gone else t, "en", f"s{(i or 0) % 4}", len((left if gone else t) or "")))
    assert got == sorted(want, key=str)


def test_drawn_as_the_mix_says(spark):
    rows = [(i, "word " * (i % 23 + 1)) for i in range(300)]
    d = docs(spark, rows)
    got = collections.Counter(x.doc_id for x in mixing.drawn(d).collect())
    want = {x.doc_id: x.taken // x.size for x in mixing.mixed(d, whole=True).collect() if x.taken}
    assert got == want
    assert mixing.drawn(d).columns == d.columns


def test_null_and_empty_keys_are_drawn_apart(spark):
    rows = [(i, f"w{i} " * ((i or 0) % 9 + 1), "en", s, 1) for i in [*range(60), None] for s in (None, "", "a")]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collections.Counter((x.doc_id, x.source) for x in mixing.drawn(d).collect())
    name = mixing.F.concat_ws("|", mixing.F.coalesce(mixing.F.col("doc_id").cast("string"), mixing.F.lit("none")), mixing.F.coalesce(mixing.F.concat(mixing.F.lit("s"), "source"), mixing.F.lit("none")))
    want = {x.mark: x.taken // x.size for x in mixing.mixed(d, whole=True, mark=name).collect() if x.taken}
    assert {f"{'none' if i is None else i}|{'none' if s is None else 's' + s}": n for (i, s), n in got.items()} == want


def test_stages_keep_columns_of_any_name(spark):
    rows = [(i, f"word{i} " * (i % 7 + 1) + " ".join(f"w{k}" for k in range(20 if i % 2 else 3)), i) for i in range(30)]
    names = ["doc_id", "text", "tag", "positions", "whole", "row", "times", "k", "source", "c0", "__row", "mark", "size"]
    d = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names[2:]]) for i, t, _ in rows], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    for stage in (lambda d: substrings.cleaned(d, 13, 16), lambda d: ngram_join.kept(d), lambda d: mixing.drawn(d)):
        got = stage(d)
        assert got.columns == names and all(x[n] == f"{n}{x.doc_id}" for x in got.collect() for n in names[2:])


def test_whole_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "mixing", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d.limit(60), sf_dir)
        assert out.columns == d.columns and [f.dataType for f in out.schema] == [f.dataType for f in d.schema]
        assert stage(spark, d.limit(0), sf_dir).count() == 0
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(got) and (got.groupby("sequence_id").length.sum() <= 2048).all()
