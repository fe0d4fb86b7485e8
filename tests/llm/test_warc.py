import gzip
import sys
import zlib

import duckdb

from narratum.llm import warc

ROWS = [(k, f"http://x/{k}", "<p>é</p>" * k, 1) for k in range(25)] + [(7, "http://x/7", "<p>again</p>", 1), (8, "http://x/\r\nWARC-Type: x", "y", 1), (None, None, None, 1), (50, "", "", 1), (51, "u", "long " * 50_000, 1)]


def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string, part int").repartition(3)


def test_tree_and_descent():
    data = bytes(range(256)) * 40
    for n in (1, 2, 3, 7, 100):
        offsets = [len(data) * k // n for k in range(n + 1)]
        levels = warc.tree(data, offsets)
        assert warc.levels_of(warc.flat(levels), n) == levels and len(levels[-1]) == 1
        assert warc.descend(levels, levels) == ([], 1)
        for place in {0, n // 2, n - 1}:
            broken = bytearray(data)
            broken[offsets[place]] ^= 1
            bad, seen = warc.descend(levels, warc.tree(bytes(broken), offsets))
            assert bad == [place] and seen <= 2 * len(levels)
        assert warc.descend(levels, warc.tree(data[:-1], offsets))[0] == [n - 1]
        for left in {0, 1, n // 2, n - 1} - {n}:  # a lost tail: only what is lost differs, whatever the number of records
            if left:
                short = warc.tree(data[: offsets[left]], offsets[: left + 1])
                bad, seen = warc.descend(levels, short)
                assert bad == list(range(left, n)) and warc.descend(short, levels)[0] == bad and seen <= 2 * len(levels)


def test_damaged_shard_with_another_number_of_records():
    data, offsets = bytes(range(250)) * 40, list(range(0, 10_001, 100))
    broken = bytearray(data[: offsets[70]])
    for place in (3, 64, 69):
        broken[offsets[place]] ^= 1
    bad, seen = warc.descend(warc.tree(data, offsets), warc.tree(bytes(broken), offsets[:71]))
    assert bad == [3, 64, 69, *range(70, 100)] and seen < 40


def test_fixity_matches_sql(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "SHARD_RECORDS", 4)
    hit = next(k for k in range(10_000) if zlib.crc32(str(k).encode()) % warc.DAMAGED == 0)
    monkeypatch.setattr(sys.modules[__name__], "ROWS", [*ROWS, (hit, "http://hit", "<p>planted</p>", 1)])
    got = sorted(map(str, map(tuple, warc.fixity(pages(spark)).collect())))
    pages(spark).write.parquet(str(tmp_path / "p"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/p/*.parquet'")
    assert got == sorted(map(str, con.execute(warc.SQL).fetchall())) and sum("False" in r for r in got) == 1
    assert warc.fixity(pages(spark).limit(0)).count() == 0


def test_audit_finds_corruption(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_RECORDS", 5)
    shards = warc.write(pages(spark))
    rows = sorted(shards.collect(), key=lambda r: (r.part, r.seq))
    broken = bytearray(rows[1].payload)
    broken[rows[1].offsets[3] + 20] ^= 255
    replica = [r for k, r in enumerate(rows) if k not in (1, 2)] + [rows[1].asDict() | {"payload": bytes(broken)}]
    copy = spark.createDataFrame([tuple(r[c] for c in ("part", "seq", "ids", "offsets", "payload")) for r in replica], warc.SHARD)
    got = sorted((r.part, r.seq, r.place) for r in warc.audit(warc.trees(shards), warc.trees(copy)).collect())
    assert got == sorted([(rows[1].part, rows[1].seq, 3), *[(rows[2].part, rows[2].seq, k) for k in range(len(rows[2].ids))]])
    text = gzip.decompress(rows[0].payload)
    assert text.count(b"WARC/1.1\r\n") == len(rows[0].ids)
    back = {(r.page_id, r.url, r.html) for r in warc.read_records(shards).collect()}
    assert back == {(i, (u or "").replace("\r", "%0D").replace("\n", "%0A"), h or "") for i, u, h, _ in ROWS}

