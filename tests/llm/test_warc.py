"""WARC archives: round trips, equal bytes, rolling, commits and damage."""

import gzip
import hashlib
import os
import re

import pytest

from formline.llm import warc

LONG = "long page " * 150
ROWS = [(i, f"http://a.example/{i}", f"<p>{i} é</p>" * (i * 3 % 50)) for i in range(200)]
ROWS += [(300 + i, None if i % 2 else f"http://b.example/a b\r\n{i}", LONG) for i in range(40)]
ROWS += [(500, "http://x/", None), (501, "http://x/", ""), (None, "http://x/1", LONG), (None, "http://x/2", "q" * 2000), (None, "http://x/2", "q" * 2000), (339, "http://a.example/same", LONG), (7, "http://a.example/7", "x" * 1500), (7, "http://a.example/7", "x" * 1500), (8, "u", "s" * 999), (9, "u", "s" * 999), (10, "u", "t" * 1000), (11, "u", "t" * 1000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")


def files(path):
    return {f: open(f"{path}/{f}", "rb").read() for f in sorted(os.listdir(path)) if f.endswith(".gz")}


def expected():
    """(page_id, bytes, sha1, type, refers_to) of each row."""
    groups = {}
    for i, u, h in ROWS:
        groups.setdefault(h or "", []).append((i, u))
    out = []
    for h, rows in groups.items():
        data = h.encode()
        rows.sort(key=lambda r: (-(r[0] if r[0] is not None else -1), r[1] or ""))
        for k, (i, _) in enumerate(rows):
            again = k and len(data) >= 1000
            out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", rows[0][0] if again else None))
    return sorted(out, key=repr)


def test_what_is_read_back(spark, pages, tmp_path):
    told = warc.write(pages.repartition(7), str(tmp_path / "w"), shard_bytes=20_000, file_bytes=3_000)
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected()
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert sorted(bytes(r.payload).decode() for r in got if r.payload) == sorted([h for _, _, h in ROWS[:200] if h] + [LONG, "q" * 2000, "x" * 1500, "s" * 999, "s" * 999, "t" * 1000])
    assert len({r.record_id for r in got}) == len(got)
    assert {r.url for r in got if r.page_id == 300} == {"http://b.example/a%20b%0D%0A0"}
    rows = told.collect()
    assert sum(r.records for r in rows) == len(ROWS) and len({r.shard for r in rows}) > 3 and any(r.number for r in rows)
    assert not os.path.exists(tmp_path / "w" / "_temporary")


def test_files_are_sorted_rolled_and_the_same_each_time(spark, pages, tmp_path):
    settings = {"shard_bytes": 20_000, "file_bytes": 3_000}
    warc.write(pages.repartition(7), str(tmp_path / "a"), **settings)
    warc.write(pages.orderBy("html").coalesce(1), str(tmp_path / "b"), **settings)
    a, b = files(tmp_path / "a"), files(tmp_path / "b")
    assert a == b and len(a) > 5
    ids = []
    for name, data in a.items():
        assert len(data) <= 3_000 or data.count(b"\x1f\x8b\x08") <= 2  # the description and one record
        text = gzip.decompress(data)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and f"WARC-Filename: {name}".encode() in text
        ids += [int(x) for x in re.findall(rb"\r\nWARC-Page-ID: (\d+)\r\n", text)]
    assert ids == sorted(ids)


def test_a_staged_archive_is_read_only_after_its_commit(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.stage(pages, path, shard_bytes=20_000)
    open(f"{path}/_temporary/part-00000000-00000.warc.gz.lost", "wb").close()  # of an attempt that was lost
    with pytest.raises(FileNotFoundError):
        warc.read(spark, path)
    one = warc.manifest(spark, path).first()
    os.rename(f"{path}/{one.temporary}", f"{path}/{one.name}")  # a commit that was cut short
    warc.commit(spark, path)
    warc.commit(spark, path)
    assert warc.read(spark, path).count() == len(ROWS)
    with pytest.raises(FileExistsError):
        warc.write(pages, path)


def test_damage_is_noticed(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write(pages, path)
    (name, data), *_ = files(path).items()
    with open(f"{path}/{name}", "wb") as f:
        f.write(data[:-40])
    with pytest.raises(Exception, match="isn't whole|holds"):
        warc.read(spark, path).collect()
    fields, block = warc.parsed(warc.page_record(1, b"u", b"text", 0, "d", None))
    with pytest.raises(ValueError, match="differs"):
        warc.told(fields, block.replace(b"text", b"next"))


def test_empty_tables_and_shuffled_payload_keys(spark, pages, tmp_path, monkeypatch):
    assert warc.write(pages.limit(0), str(tmp_path / "e")).count() == 0
    assert warc.read(spark, str(tmp_path / "e")).count() == 0
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    path = f"file:{tmp_path}/s"
    warc.write(pages, path)
    got = warc.read(spark, path, payload=False).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected()
