import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from geoquilt.llm import packing, tokencount, tokens
from geoquilt.llm.packing import packed_documents
from geoquilt.llm.tokencount import resynchronised_ids, token_counts

ODD = [None, "", " ", "\n\n", "a", "Hello  world\n\n x  y  z", "don't we'll '' 's <|endoftext|> a<|endoftext|>b <|startoftext|>", "é é ́x ß ΣΑΣ İstanbul", "日本 語　 テキスト", "x" * 3000, "1 22 333\t\t4444", "\x1c \x85 \u0085 a", "tab\t end ", "​ zero   sep     y"]


def _random_texts(n, seed=3):
    r = random.Random(seed)
    parts = ["the", "ción", "heit", "'s", "'", " ", "  ", "\n", "\t", " ", "　", "!", "é", "9", "<|endoftext|>", "日", " ", "Ab", "ß", "..."]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("name,fine", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", False), ("word_bpe_49k.json", True)])
@pytest.mark.parametrize("special", [True, False])
def test_units_equal_whole_texts(name, fine, special):
    path = public_tokenizers.path(name)
    codec, t = tokens.UnitCodec(path, most=50, fine=fine), tokens.load(path)
    texts = [x or "" for x in ODD] + _random_texts(600) + ["Don'T É×Ç÷a a1b22 =\u0338= x-é,é e\u0301é ª º ¹ ǅ ﬁ ſ", "ÀÉ,ÀÉ.a'b''c"]
    if not special:
        texts = [x.replace("<|endoftext|>", "<|").replace("<|startoftext|>", "|>") for x in texts]
    raw = [x.encode() for x in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    ids, first = codec.ids(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, x in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_resynchronised(name):
    t = tokens.load(public_tokenizers.path(name))
    for chunk, overlap in ((40, 4), (100, 8), (64, 32)):
        for text in ["".join(_random_texts(20, s)) for s in range(6)] + ["x" * 900, "ab " * 300, "a" * 300 + " b " + "c" * 400]:
            assert resynchronised_ids(t, text, chunk, overlap) == t.encode(text, add_special_tokens=False).ids


def _docs(spark, texts):
    return spark.createDataFrame([(None if i == 3 else i, x, "en", -1) for i, x in enumerate(texts)], "doc_id long, text string, n_tokens string, uid int")


def test_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokens.load(path)
    texts = [*ODD, *ODD, *_random_texts(50), "word " * 900]
    got = token_counts(_docs(spark, texts), path, huge=1000).collect()
    want = [(None if i == 3 else i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 512) for i, x in enumerate(texts)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(_docs(spark, texts).limit(0), path).count() == 0


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = tokens.load(path)
    texts = [*ODD, *_random_texts(300), "some words here " * 100, "word " * 64, "word " * 63]
    got = packed_documents(_docs(spark, texts), path, capacity=64, shard_items=100).toPandas()
    assert packed_documents(_docs(spark, texts).limit(0), path).count() == 0
    for i, x in enumerate(texts):
        if i == 3:
            continue
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.piece.tolist() == list(range(-(-len(ids) // 64)))
        for p in mine.itertuples():
            part = ids[p.piece * 64 : p.piece * 64 + 64]
            assert (p.start, p.length, p.ids_crc32) == (p.piece * 64, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert bin_.length.sum() <= 64
        assert bin_.offset.tolist() == (bin_.length.cumsum() - bin_.length).tolist()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) * 1.03 + 1


def test_ga_beats_or_equals_best_fit():
    r = np.random.Generator(np.random.PCG64(1))
    sizes = r.integers(200, 900, 600)
    p = packing.Packer(sizes, 2048, 5)
    start = p.fresh(0.0)
    best = p.evolve([start, p.fresh(0.05), p.fresh(0.1)], 30)
    assert best.max() <= start.max() and np.bincount(best, weights=sizes).max() <= 2048
    child = p.cross(start, p.fresh(0.1))
    assert np.bincount(child, weights=sizes).max() <= 2048 and (child >= 0).all()
