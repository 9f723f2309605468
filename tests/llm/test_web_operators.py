import datetime
import glob
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import url_filters, warc

D = lambda s: datetime.date.fromisoformat(s)


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, record_type string, refers_to int")


def test_archives_round_trip(spark):
    rng = random.Random(1)
    big = ["é" * 500 + str(k) for k in range(4)] + ["WARC/1.1\r\n\r\n" * 200, "x" * 300_000]
    rows = [(i, f"http://a.org/{i}", rng.choice([*big, "small", "", None, "y" * 999, "y" * 1000])) for i in range(120)]
    rows += [(500, None, big[0]), (501, "u\r\nv", "a\r\n\r\nb"), (None, "n", big[1]), (-3, "m", "z" * 1200)]
    out = {r.page_id: r for r in warc.archive_round_trip(pages_of(spark, rows)).collect()}
    assert len(out) == len(rows)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and i != last[h]
        want = (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[h] if again else None)
        assert (out[i].payload_bytes, out[i].payload_digest, out[i].record_type, out[i].refers_to) == want
    assert warc.archive_round_trip(pages_of(spark, rows).limit(0)).count() == 0


def test_archives_are_gzip_members_of_single_records(spark, tmp_path):
    rows = [(i, f"http://a.org/{i}", "é" * 700 if i % 3 == 0 else f"page {i}") for i in range(30)]
    folder = f"{tmp_path}/archives"
    warc.write_archives(warc.resolve(pages_of(spark, rows)), folder)
    kinds = []
    for f in glob.glob(f"{folder}/part-*"):
        data = open(f, "rb").read()
        records = list(warc.parse(gzip.decompress(data)))
        kinds += [head["WARC-Type"] for head, _ in records]
        while data:  # a member holds one record or none
            d = zlib.decompressobj(31)
            assert len(list(warc.parse(d.decompress(data)))) <= 1
            data = d.unused_data
        assert len({head["WARC-Record-ID"] for head, _ in records}) == len(records)
    assert kinds.count("response") == 21 and kinds.count("revisit") == 9 and "warcinfo" in kinds
    got = {r.page_id: (r.url, r.record_type, r.refers_to, r.payload) for r in warc.read_archives(spark, folder).collect()}
    assert got == {i: (u, "revisit", 27, None) if i % 3 == 0 and i < 27 else (u, "response", None, h) for i, u, h in rows}


def test_broken_archives_are_refused(spark):
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, False)
    assert [warc.row_of(*r)[6] for r in warc.parse(good * 2)] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(warc.parse(good[:-6]))
    with pytest.raises(ValueError):
        [warc.row_of(*r) for r in warc.parse(good.replace(b"abc", b"abd"))]
    lost = spark.createDataFrame([(1, "d", None, "revisit", 2)], "page_id long, payload_digest string, payload_bytes long, record_type string, refers_to long")
    with pytest.raises(Exception, match="no response"):
        warc.restore(lost).collect()


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_url_verdicts_equal_a_plain_replay(spark, broadcast_rows):
    rng = random.Random(2)
    hosts = ["a.org", "b.a.org", "c.b.a.org", "x.net", "localhost", "w.v.u.t.s.r.q.com", "a.b.c.d.e.f.g.h.org"]
    keys = hosts + ["q.com", "r.q.com", "org", "c.d.e.f.g.h.org"]
    day = lambda: D("2020-01-01") + datetime.timedelta(rng.randrange(400))
    entries = [(rng.choice(["l1", "l2"]), rng.choice(keys), rng.choice(["block", "allow", "remove"]), day()) for _ in range(60)]
    entries += [(None, "a.org", "block", day()), ("l1", "a.org", "block", None), ("l1", "A.org", "block", D("2020-01-01"))]
    caps = [(i, "https://u@" + rng.choice(hosts).upper() + ".:80/p?q", day()) for i in range(200)]
    caps += [(900, None, day()), (901, "no url", day()), (902, "http://a.org", None), (None, "http://a.org/", D("2020-06-01"))]
    captures = spark.createDataFrame([(*c, "v") for c in caps], "capture_id long, url string, fetched date, verdict string")
    rules = spark.createDataFrame(entries, "list_name string, host string, action string, since date")
    got = {r.capture_id: (r.verdict, r.rule_host, r.list_name) for r in url_filters.judge(captures, rules, broadcast_rows).collect()}
    for i, url, at in caps:
        host = url.split("@")[-1].split("://")[-1].split("/")[0].split(":")[0].rstrip(".").lower() if url and "://" in url else None
        best = ("none", None, None)
        if host and at:
            labels = host.split(".")
            for k in range(min(2, len(labels)), len(labels) + 1):
                key, found = ".".join(labels[-k:]), []
                for name in ("l1", "l2"):
                    past = [(s, a) for n, h, a, s in entries if n == name and s and h.lower() == key and s <= at]
                    if past and max(past)[1] != "remove":
                        found.append((max(past)[1] != "block", name))
                if found:
                    best = ("allow" if min(found)[0] else "block", key, min(found)[1])
        assert got[i] == best, (i, url, at)
    assert url_filters.judge(captures.limit(0), rules, broadcast_rows).count() == 0
    assert {r.verdict for r in url_filters.judge(captures, rules.limit(0)).collect()} == {"none"}


def test_interval_join_is_one_row_a_pair(spark):
    rules = spark.createDataFrame([("l", "a.org", "block", D("2020-01-01")), ("l", "a.org", "allow", D("2020-01-01"))], "list_name string, host string, action string, since date")
    assert [r.action for r in url_filters.intervals(rules).collect()] == ["block"]
    assert url_filters.intervals(rules).where(F.col("valid_to").isNotNull()).count() == 0
