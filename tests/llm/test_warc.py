import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import warc

ROWS = [(1, "http://a/1", "<p>x"), (2, "http://a/2", "<p>y é"), (3, "http://b/3", "<p>x"), (3, "http://b/3", "<p>x"), (4, None, None), (5, "http://x/a%20b%0A?q=<b>", ""), (None, "http://n", "<p>x"), (9, "http://long", "z" * 300000)]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module", params=[warc.BROADCAST_ROWS, 0])
def archives(spark, tmp_path_factory, request):
    path = str(tmp_path_factory.mktemp("w") / "a")
    warc.write(spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "last": F.lit(2), "rid": F.lit(3)}), path, broadcast_rows=request.param)
    return path


def strict(path):
    """(headers, block) of each record of an archive's folder, read by the standard's grammar alone."""
    for name in sorted(path.glob("*.warc.gz")):
        data, at = gzip.decompress(name.read_bytes()), 0
        while at < len(data):
            assert data.startswith(b"WARC/1.1\r\n", at)
            end = data.index(b"\r\n\r\n", at)
            headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
            n = int(headers["Content-Length"])
            assert data[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
            yield headers, data[end + 4 : end + 4 + n]
            at = end + 8 + n


def test_a_strict_reader_sees_uris_as_they_are(spark, tmp_path):
    uris = ["http://x/a%20b", "http://x/?q=<b>", "sha1:abc", "urn:record:7", "http://x/%250A", "http://x/\r\nX-Bad: 1"]
    warc.write(spark.createDataFrame([(i, u, f"p{i}") for i, u in enumerate(uris)], "page_id long, url string, html string"), str(tmp_path / "u"))
    found = {h["WARC-Target-URI"]: b for h, b in strict(tmp_path / "u")}
    assert set(found) == {*uris[:5], "http://x/%0D%0AX-Bad: 1"} and found["sha1:abc"].endswith(b"\r\n\r\np2")
    got = warc.read(spark, str(tmp_path / "u"))
    assert {r["target_uri"] for r in got.collect()} == set(found)
    assert got.where("target_uri = 'http://x/a%20b'").count() == 1


def test_headers_of_others_stay_as_they_are(spark, tmp_path):
    lines = ["WARC/1.0", "WARC-Type: response", "WARC-Record-ID: <urn:uuid:1>", "WARC-Target-URI: <http://y/a%25b%0Ac>", "WARC-Payload-Digest: sha256:00ff", "X-Folded: a", " b", "Content-Length: 4"]
    more = ["WARC/1.0", "WARC-Type: metadata", "WARC-Record-ID: <urn:uuid:2>", "WARC-Target-URI: <half", "Content-Length: 0"]
    (tmp_path / "a.warc").write_bytes(b"".join("\r\n".join(x).encode() + b"\r\n\r\n" + body + b"\r\n\r\n" for x, body in ((lines, b"\r\n\r\n"), (more, b""))))
    a, b = warc.read(spark, str(tmp_path)).orderBy("record_id").collect()
    assert (a["record_id"], a["target_uri"], a["payload_digest"], a["headers"]["x-folded"]) == ("urn:uuid:1", "http://y/a%25b%0Ac", "sha256:00ff", "a b")
    assert (b["record_id"], b["record_type"], b["target_uri"], b["payload"]) == ("urn:uuid:2", "metadata", "<half", None)


@pytest.mark.parametrize("split", [64 << 20, 1])
def test_round_trip(spark, archives, split):
    got = warc.read(spark, archives, verify=True, split_bytes=split).collect()
    assert len(got) == len(ROWS)
    want = []
    for i, url, html in ROWS:
        last = max((j for j, _, h in ROWS if (h or "") == (html or "") and j is not None), default=None)
        revisit = last is not None and i != last
        want.append((str(i or ""), "revisit" if revisit else "response", url, str(last) if revisit else None, sha(html), len((html or "").encode()), None if revisit else (html or "").encode()))
    key = lambda r: tuple(map(str, r))
    made = [(r["record_id"], r["record_type"], r["target_uri"], r["refers_to"], r["payload_digest"], r["payload_bytes"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(made, key=key) == sorted(want, key=key)


def test_predicates_are_pushed_and_payloads_stay_packed(spark, archives):
    df = warc.read(spark, archives, payload=False).where("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [r["record_id"] for r in df.collect()] == ["1"]
    assert df.select("payload").first()[0] is None
    reader = warc.WarcReader({"path": archives, "payload": "false"})
    rest = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 3)]))
    assert len(rest) == 1 and reader.tests == [("record_type", "EqualTo", "revisit")]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3


def test_small_payloads_are_never_revisits(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "v", "ab"), (3, "u", "abcdef"), (4, "v", "abcdef")], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"), least_bytes=5)
    got = {r["record_id"]: r["record_type"] for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert got == {"1": "response", "2": "response", "3": "revisit", "4": "response"}
    warc.write(df.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_others(spark, tmp_path, packed):
    data = b"".join(warc.record(str(i), f"http://x/{i}", b"p" * (i * 40000), None, "2020-01-01T00:00:00Z") for i in range(5))
    (tmp_path / ("a.warc.gz" if packed else "a.warc")).write_bytes(gzip.compress(data) if packed else data)
    got = warc.read(spark, str(tmp_path), verify=True).orderBy("record_id").collect()
    assert [r["payload_bytes"] for r in got] == [i * 40000 for i in range(5)]
    assert warc.read(spark, str(tmp_path), payload=False).where("record_id = '3'").count() == 1


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    data = warc.record("1", "u", b"payload", None, "2020-01-01T00:00:00Z").replace(b"payload", b"paYload")
    (tmp_path / "a.warc").write_bytes(data)
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, str(tmp_path), verify=True).collect()
