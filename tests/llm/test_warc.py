import base64
import gzip
import hashlib
import uuid
from collections import Counter

import pytest

from urban_spark.llm import warc
from urban_spark.llm.shared import shared_dir


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def trip(spark, rows, **options):
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(spark.createDataFrame([(*r, "e", 0) for r in rows], "page_id long, url string, html string, id string, first int"), path, **options)
    return path, warc.read_warc(spark, path).collect()


ROWS = [(3, "http://a/é b", "<p>é中\x00</p>"), (1, "u", "<p>é中\x00</p>"), (2, None, None), (4, "v", ""), (5, "w", "x" * 200_000), (6, "w", "WARC/1.1\r\nfoo\r\n\r\nbar"), (7, "\r\nEvil: 1", "1")]


def test_round_trip(spark):
    _, out = trip(spark, ROWS)
    payload = {i: (h or "").encode() for i, _, h in ROWS}
    first = {}
    for i in sorted(payload):
        first.setdefault(payload[i], i)
    assert {r.kind for r in out} == {"record"} and len(out) == len(ROWS)
    for r in out:
        i = int(r.record_id.removeprefix("urn:page:"))
        again = first[payload[i]] != i
        assert (r.record_type, r.payload_bytes, r.payload_digest) == ("revisit" if again else "response", len(payload[i]), sha(payload[i]))
        assert bytes(r.payload) == (b"" if again else payload[i]) and r.refers_to == (f"urn:page:{first[payload[i]]}" if again else None)


def test_short_payloads_repeats_and_no_rows(spark):
    _, out = trip(spark, [(1, "a", "xy"), (2, "a", "xy"), (3, "a", "long one"), (4, "b", "long one"), (None, "c", "long one"), (3, "a", "long one")], min_bytes=3)
    assert Counter((r.record_id.removeprefix("urn:page:"), r.record_type) for r in out) == Counter({("1", "response"): 1, ("2", "response"): 1, ("3", "response"): 2, ("4", "revisit"): 1, ("urn:page", "revisit"): 1})
    assert trip(spark, [])[1] == []


@pytest.fixture(scope="module")
def archive():
    records = [warc.record(f"urn:page:{i}", "response", f"http://x/{i}", (body := f"body {i} ".encode() * 50), sha(body), len(body), None) for i in range(12)]
    return [warc.member(r) + b"\0" for r in records], records


def salvaged(data):
    rows = list(warc.salvage("f", data))
    return [int(r[5].rpartition(":")[2]) for r in rows if r[3] == "record"], [r for r in rows if r[3] == "gap"]


def test_members_are_plain_gzip(archive):
    members, records = archive
    assert gzip.decompress(b"".join(members)) == b"".join(records)
    big = bytes(17 << 20)
    assert gzip.decompress(warc.member(big) + b"\0") == big


def test_salvages_after_damage(archive):
    members, records = archive
    assert salvaged(b"".join(members)) == (list(range(12)), [])
    assert salvaged(b"".join(records)) == (list(range(12)), [])
    hurt = [*members]
    hurt[4] = hurt[4][:30] + bytes(40) + hurt[4][70:]
    got, gaps = salvaged(b"".join(hurt[:9]) + b"noise WARC/1.1\r\n" + b"".join(hurt[9:])[:-25])
    assert got == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10] and len(gaps) == 3
    plain = b"".join(records)
    at = plain.index(b"body 5 ")
    got, gaps = salvaged(plain[:at] + b"BODY" + plain[at + 4 :])
    assert got == [i for i in range(12) if i != 5] and gaps[0][1:3] == (sum(map(len, records[:5])), len(records[5])) and "digest" in gaps[0][4]
    whole = gzip.compress(plain[:at] + b"BODY" + plain[at + 4 :])
    got, gaps = salvaged(whole)
    assert got == [i for i in range(12) if i != 5] and len(gaps) == 1
    assert salvaged(b"")[1] == [] and [g[1:3] for g in salvaged(b"no archive at all")[1]] == [(0, 17)]


def test_bytes_are_records_or_gaps(archive):
    members, _ = archive
    data = bytearray(b"".join(members))
    for at in range(50, len(data), 331):
        data[at] ^= 0x55
    rows = list(warc.salvage("f", bytes(data)))
    assert sum(r[2] for r in rows if r[3] == "gap" and "in member" not in r[4]) + sum({r[1]: r[2] for r in rows if r[3] == "record"}.values()) <= len(data)


def test_ranges_give_what_the_whole_gives(archive):
    members, records = archive
    hurt = [*members]
    hurt[4] = hurt[4][:30] + bytes(40) + hurt[4][70:]
    hurt[7] = gzip.compress(b"no record in here")
    hurt[8] = gzip.compress(b"")
    data = b"noise" + b"".join(hurt[:9]) + b"noise WARC/1.1\r\n" + b"".join(hurt[9:])[:-25]
    whole = list(warc.salvage("f", data))
    for size in (1, 7, 64, 300, 1000, 5000, len(data)):
        parts = [row for start in range(0, len(data), size) for row in warc.salvage("f", data, start, start + size)]
        assert parts == whole, size


def test_reads_by_ranges(spark, tmp_path, monkeypatch, archive):
    members, records = archive
    (tmp_path / "a b.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "c.warc").write_bytes(b"".join(records))
    (tmp_path / "empty").write_bytes(b"")
    want = Counter((name, i) for name in ("a b.warc.gz", "c.warc") for i in range(12))
    for size in (200, 1 << 20):
        rows = warc.read_warc(spark, str(tmp_path), range_bytes=size).collect()
        assert Counter((r.archive.rpartition("/")[2], int(r.record_id.rpartition(":")[2])) for r in rows if r.kind == "record") == want and len(rows) == 24
    monkeypatch.setattr(warc, "_opened", lambda path: None)
    assert warc.read_warc(spark, str(tmp_path)).count() == 24
    monkeypatch.setattr(warc, "WHOLE", 100)
    with pytest.raises(ValueError):
        warc.read_warc(spark, str(tmp_path))


def test_files_are_cut_by_bytes(spark):
    path, out = trip(spark, [(i, "u", f"{i} " + "x" * 10_000) for i in range(40)], file_bytes=50_000)
    assert len(out) == 40 and all(n <= 5 for n in Counter(r.archive for r in out).values())


def test_invalid_utf8_passes_through_the_text_sink(spark):
    from pyspark.sql import functions as F

    path = f"{shared_dir(spark)}/bytes-{uuid.uuid4().hex}"
    data = bytes(range(1, 256)) + b"\xc3\x28\xff\xfe"
    spark.createDataFrame([(bytearray(data),)], "b binary").select(F.col("b").cast("string")).coalesce(1).write.option("lineSep", "\0").text(path)
    assert [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()] == [data + b"\0"]


@pytest.mark.parametrize(
    ("kind", "ids"),
    [("long", [3, 1, None, None, 3, 9, -4]), ("string", ["b", "a>\r\nX: y", None, None, "b", "", "é +%"]), ("int", [None, None, None, None, None, None, None]), ("string", ["10", "9", None, None, "10", "urn:page", "x y"])],
)
def test_query_on_any_ids(spark, tmp_path, kind, ids):
    from urban_spark.llm.queries import op10_warc

    html = ["<p>same</p>", "<p>same</p>", "<p>same</p>", "alone", "<p>same</p>", None, ""]
    spark.createDataFrame(list(zip(ids, ["u"] * 7, html, strict=True)), f"page_id {kind}, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = op10_warc(spark, str(tmp_path))
    assert out.schema["page_id"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
    first = {}
    for i, h in zip(ids, html, strict=True):
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, h in zip(ids, html, strict=True):
        again = (h or "") in first and first[h or ""] != i
        want[i, len((h or "").encode()), sha((h or "").encode()), "revisit" if again else "response", first[h or ""] if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()) == want


def test_query_without_pages(spark, tmp_path):
    from urban_spark.llm.queries import op10_warc

    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op10_warc(spark, str(tmp_path)).collect() == []
