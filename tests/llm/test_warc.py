import gzip
import hashlib
import json

from tallyspark.llm import warc
from tallyspark.llm.warc import archive_round_trip, normalise, read_records, with_revisits, write_archives


def test_archives_files_and_offsets(spark, tmp_path):
    rows = [(i, f"http://h.example/{i}", ("ü" * 700 if i % 5 == 0 else f"<p>{i}</p>" * (i * 40))) for i in range(1, 60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    written = write_archives(with_revisits(pages), f"file://{tmp_path}/whole", archive_bytes=40_000)
    assert written.count() > 3 and written.selectExpr("sum(n_records)").first()[0] == len(rows)
    index = normalise(written, f"file://{tmp_path}/members")
    for f in (tmp_path / "whole").glob("*.gz"):  # one member a file
        d = warc.zlib.decompressobj(31)
        d.decompress(f.read_bytes())
        assert d.eof and not d.unused_data
    seen = 0
    for f in (tmp_path / "members").glob("*.warc.gz"):
        data = f.read_bytes()
        for line in (f.parent / f"{f.name}.idx.jsonl").read_text().splitlines():
            x = json.loads(line)
            member = gzip.decompress(data[x["offset"] : x["offset"] + x["length"]])
            assert member.startswith(b"WARC/1.1\r\n") and x["id"].encode() in member
            seen += 1
    assert seen == len(rows) == index.count()
    got = {r.page_id: r for r in read_records(index).collect()}
    same = [i for i, _, h in rows if i % 5 == 0]
    for i, url, h in rows:
        top = max(same) if i in same else i
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if top == i else ("revisit", top))
        assert got[i].payload is None if top != i else bytes(got[i].payload) == h.encode()
        assert got[i].target_uri == url and got[i].payload_digest == hashlib.sha1(h.encode()).hexdigest()


def test_odd_rows(spark):
    big = "y" * 3_000_000
    rows = [(1, None, None, 1), (2, "http://x/\r\nA: b", "", 2), (3, "u", "x" * 999, 3), (4, "u", "x" * 999, 4), (5, "u", "z" * 1000, 5), (6, "u", "z" * 1000, 6), (6, "u", "z" * 1000, 6), (None, "u", "z" * 1000, 7), (None, "u", "q" * 1000, 8), (9, "u", big, 9)]
    got = sorted((tuple(r) for r in archive_round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string, refers_to int")).collect()), key=str)
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(i, len(t or ""), digest(t), "revisit" if i == 5 or (i is None and t[0] == "z") else "response", 6 if i == 5 or (i is None and t[0] == "z") else None) for i, _, t, _ in rows]
    assert got == sorted(want, key=str)
    assert archive_round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
