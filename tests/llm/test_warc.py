import base64
import gzip
import hashlib
import random
from collections import defaultdict

import pytest

from asofkit.llm import warc
from asofkit.llm.queries import op3_warc_index_merge


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(20), i, j) for j in range(rng.randrange(0, 30))) for i in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def expected(rows):
    """page key -> (bytes, digest, type, refers_to) by a plain walk."""
    by = defaultdict(list)
    for i, _, html in rows:
        by[(html or "").encode()].append(i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        top = max(by[p], key=lambda x: (x is not None, x or 0))
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(1, "http://www.B.org/x?q=1", "<p>é</p>"), (2, "http://a.org:80/", "<p>é</p>"), (3, None, None), (4, "", ""), (None, "http://a.org/", "z"), (6, "bad url [", "y\r\n\r\nWARC/1.1"), (7, "http://a.org/\nX: 1", "<p>é</p>"), (8, "http://a.org/", "q" * 200_000)]
    rows += [(100 + i, "http://hot.org/", f"page {i % 7}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as pos", "'a' as archive").repartition(4)
    index, folder = warc.archive(pages, file_bytes=2000)
    got = warc.read_back(index, folder)
    cols = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == expected(rows)
    order = [(r.urlkey, r.captured) for r in index.collect()]
    assert order == sorted(order)
    names = [r.archive for r in index.select("archive").distinct().collect()]
    assert len(names) > 4
    text = gzip.decompress(open(f"{folder}/{names[0]}".replace("file:", ""), "rb").read())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: re")
    assert warc.archive(pages.limit(0))[0].count() == 0


def test_repeated_rows(spark):
    pages = spark.createDataFrame([(5, "u", "h")] * 3, "page_id long, url string, html string")
    got = warc.read_back(*warc.archive(pages)).collect()
    assert sorted(r.record_type for r in got) == ["response", "revisit", "revisit"] and {r.refers_to for r in got} == {5, None}


def test_surt():
    assert warc.surt("HTTP://www.Example.com/A?b") == "com,example)/a?b"
    assert warc.surt("http://a.org:8080") == "org,a:8080)/"


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = op3_warc_index_merge(spark, sf).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
