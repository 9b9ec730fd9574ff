import base64
import collections
import hashlib

import duckdb
import pytest

from geoquilt.llm import mixing, warc


def _docs(spark, rows):
    return spark.createDataFrame([(*x, 5.0) for x in rows], "doc_id long, text string, source string, target double")


ROWS = [(i, " ".join(["word"] * (i % 17)) + "\t\n x" * (i % 3), ["a", "b", "é", "z" * 3, None, "Ab"][i % 6 if i % 5 else 0]) for i in range(400)]
ROWS += [(None, "some words of no id", "a"), (1000, None, "nul"), (1001, "", "b"), (7, "twice here", "b"), (7, "twice here", "b"), (1002, "w " * 5000, "big")]


def test_mix_equals_sql_and_hits_targets(spark):
    got = mixing.mixed(_docs(spark, ROWS)).toPandas()
    documents = _docs(spark, ROWS).toPandas()  # noqa: F841
    want = duckdb.sql(mixing.ORACLE).df()
    by = ["doc_id", "size", "source_size", "taken"]
    assert got[by].fillna(-1).sort_values(by).values.tolist() == want[by].fillna(-1).sort_values(by).values.tolist()
    assert sorted(got.target) == pytest.approx(sorted(want.target))
    taken = collections.Counter()
    for x in got.itertuples():
        assert 0 <= x.taken <= 2 * x.size
        taken[x.source_size, x.target] += x.taken
    for (_, target), n in taken.items():
        assert target - 1 <= n <= target or target == 0
    assert sum({k: v for k, v in taken.items()}.values()) == pytest.approx(1.5 * got["size"].sum(), abs=20)
    assert mixing.mixed(_docs(spark, ROWS).limit(0)).count() == 0
    whole = mixing.mixed(_docs(spark, ROWS), whole=True).toPandas()
    assert ((whole.taken % whole["size"].clip(lower=1)) == 0).all()


def test_round_trip(spark):
    pages = [(1, "http://h/x?a=1", "<p>é WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n</p>"), (2, None, ""), (3, "http://h/\r\nEvil: x", None), (4, "u", "same"), (5, "u", "same"), (5, "u", "same"),
             (None, "u", "same"), (6, "http://b", "\r\n\r\n\x00\r\n"), (-7, "n", "same2"), (8, "n", "same2"), (None, None, None)]
    df = spark.createDataFrame([(*x, "e") for x in pages], "page_id long, url string, html string, digest string")
    for least in (0, 4, 5):
        got = sorted(map(tuple, warc.round_trip(df, least).collect()), key=str)
        want = []
        for i, _, html in pages:
            b = (html or "").encode()
            same = [k for k, _, h in pages if (h or "").encode() == b and k is not None]
            again = len(b) >= least and same and i != min(same)
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", min(same) if again else None))
        assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_nested_rows_and_broken_archives(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://h/", "payload"), (2, "http://h/2", "payload")], "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w")
    rows = warc.captures(warc.read_records(spark, f"file://{tmp_path}/w")).collect()
    assert sorted((bytes(r.response.payload) if r.response.payload is not None else None) or b"" for r in rows) == [b"", b"payload"]
    assert all(r.request.record_type == "request" and "page-id" in r.metadata.fields for r in rows)
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort"))
    with pytest.raises(ValueError):
        list(warc.parse(b"HTTP nonsense"))
