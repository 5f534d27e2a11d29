import gzip
import hashlib
import io
from collections import defaultdict

import pytest

from cohesia.llm import queries, warc


def brute(pages):
    groups = defaultdict(list)
    for p, _, h in pages:
        if len((h or "").encode()) >= 1000:
            groups[h].append(p)
    out = []
    for p, _, h in pages:
        raw = (h or "").encode()
        top = max(groups.get(h, [p]))
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "response" if top == p else "revisit", None if top == p else top))
    return sorted(out)


def test_query(spark, data):
    pages = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op8_warc(spark, data).collect())) == brute(pages)


def test_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    big = "é" * 600
    pages = [(i, f"http://a.b/{i} x\n", big if i % 2 else f"{i}" * 400) for i in range(40)] + [(100, None, None), (101, "", ""), (102, "dns:a", "x" * 999), (103, "y", "x" * 999), (104, "http://é", "\r\n\r\nHTTP/1.1")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = warc.round_trip(df).drop("url")
    assert sorted(map(tuple, out.collect())) == brute(pages)
    assert warc.round_trip(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "http://a", "z" * 2000)] * 2 + [(None, "http://b", "z" * 2000)], "page_id long, url string, html string")
    kinds = sorted((r.record_type, r.refers_to) for r in warc.round_trip(twice).collect())
    assert [k for k, _ in kinds] == ["response", "revisit", "revisit"] and all(r == 1 for k, r in kinds if k == "revisit")


@pytest.mark.parametrize("version", [1, 2])
def test_arc_parsing(version):
    blocks = [warc.http_block(3, b"body\n\nmore\n"), b"", b"plain dns answer"]
    raw = warc.arc_version_block("a.arc", version)
    for b in blocks:
        raw += warc.arc_record("a.arc", version, "http://x/", b, len(raw))
    got = list(warc.read_arc(io.BytesIO(raw)))
    assert [b for _, _, b in got] == blocks
    assert all(raw[o:].startswith(b"http://x/ ") for o, _, _ in got)
    assert ("Result-code" in got[0][1]) == (version == 2)
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(raw[:-5])))
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(raw.replace(f"{version} 0 cohesia".encode(), b"9 0 cohesia"))))


def test_warc_fields():
    _, head, block = next(warc.read_arc(io.BytesIO(warc.arc_version_block("a", 1) + warc.arc_record("a", 1, "http://x/", warc.http_block(1, b"p"), 0))))
    fields, body = next(warc.read_warc(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(warc.warc_record("a", 5, head, block, None))))))
    assert fields["warc-date"] == "2024-01-01T00:00:00Z" and fields["warc-type"] == "response" and body == block
    assert warc.warc_type("dns:x") == "resource" and warc.record_id("a", 5) == fields["warc-record-id"]


def test_one_very_large_page_and_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    pages = [(1, "http://large", "<p>0123456789é</p>" * 1_200_000)] + [(i, f"http://a/{i}", f"{i} " * 3000) for i in range(2, 60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    assert sorted(map(tuple, warc.round_trip(df).drop("url").collect())) == brute(pages)
    archives = warc.write_arcs(df, warc.new_path(spark, "arc-test"))
    n = archives.count()
    assert n > 10 and warc.tasks(n) == n and warc.tasks(10**7) == warc.TASKS and warc.tasks(0) == 1
