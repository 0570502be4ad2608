import gzip
import hashlib

import pytest

from snapdelta.llm import warc_source as W

BIG = "<html>" + "é" * 80 + "</html>"
PAGES = [(3, "http://a/", BIG), (1, "http://b/\r\nX: y", BIG), (2, "http://c/", "small"), (4, None, "small"), (5, "http://d/", None), (6, "http://e/", "\r\n\r\nWARC/1.1\r\n\r\n" + "z" * 200), (None, "http://f/", BIG), (7, "http://g/", "q" * 3_000_000), (1, "http://b/\r\nX: y", BIG), (None, None, "n" * 120), (None, None, "n" * 120), (8, "u", "x" * 99), (9, "u", "x" * 99)]


def expected():
    first = {}
    for i, _, html in PAGES:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    return sorted((str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), *(("revisit", first[h]) if h in first and first[h] != i else ("response", None))) for i, _, h in PAGES)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, pages, tmp_path, compression):
    folder = str(tmp_path / "w")
    W.dedupe_and_write(pages, folder, compression=compression)
    got = W.pages_back(spark, folder).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected()
    names = [p.name for p in (tmp_path / "w").iterdir()]
    assert all(n.startswith("part-") and n.endswith(".warc.gz" if compression == "gzip" else ".warc") for n in names)
    every = W.read_warc(spark, folder)
    assert every.count() == len(PAGES)
    html = {r.payload.decode() for r in every.where("record_type = 'response'").collect()}
    assert html == {h or "" for _, _, h in PAGES}
    revisit = every.where("record_type = 'revisit'").first()
    assert revisit.headers["WARC-Profile"] == W.REVISIT and every.where(every.record_id == revisit.refers_to).count() >= 1


def test_pushdown_skips_payloads(spark, pages, tmp_path):
    folder = str(tmp_path / "w")
    W.dedupe_and_write(pages, folder)
    q = W.read_warc(spark, folder).where("record_type = 'response' and target_uri like 'http://a%' and content_length > 0")
    plan = q._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "RuntimeFilters" not in line]
    assert len(filters) == 1 and "record_type" not in filters[0] and "target_uri" not in filters[0]  # the source has taken those
    assert q.count() == sum(u == "http://a/" for _, u, _ in PAGES) - 1  # a revisit
    assert W.read_warc(spark, folder, payload=False).where("payload is not null").count() == 0
    assert W.read_warc(spark, folder).where("record_type in ('metadata', 'revisit')").count() == sum(r[3] == "revisit" for r in expected())


def test_skipping_seeks(tmp_path):
    import pyarrow as pa

    rows = [{"record_id": f"<{k}>", "record_type": "response", "target_uri": "u", "warc_date": "d", "refers_to": None, "payload_digest": None, "headers": [("X", "1")], "payload": b"p" * (3 << 20)} for k in range(4)]
    path = tmp_path / "a.warc"
    path.write_bytes(b"".join(map(W.record, rows)))
    reads = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            data = self.f.read(n)
            reads.append(len(data))
            return data

        def seek(self, n, whence):
            return self.f.seek(n, whence)

    blocks, heads = W.Blocks(Counting(pa.OSFile(str(path))), False), 0
    while (head := blocks.head()) is not None:
        blocks.skip(int(W.parse_head(head)["Content-Length"]) + 4)
        heads += 1
    assert heads == 4 and sum(reads) < path.stat().st_size / 2


def test_foreign_archives(spark, tmp_path):
    records = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    records += b"WARC/1.0\r\nWARC-Type: resource\r\nX-Long: one\r\n two\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(records))
    (tmp_path / "none.warc").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"no archive")
    got = sorted(W.read_warc(spark, str(tmp_path)).collect(), key=lambda r: r.record_type)
    assert [(r.record_type, bytes(r.payload)) for r in got] == [("resource", b""), ("warcinfo", b"a: b")]
    assert got[0].headers["X-Long"] == "one two"


def test_empty_table(spark, pages, tmp_path):
    W.dedupe_and_write(pages.limit(0), str(tmp_path / "w"))
    assert W.pages_back(spark, str(tmp_path / "w")).count() == 0


@pytest.mark.parametrize("kind", ["string", "int"])
def test_ids_of_other_types(spark, tmp_path, kind):
    ids = ["b c", "", None, "a\n/ü", "ß"] if kind == "string" else [5, -3, None, 7, 2]
    rows = [(i, "http://x/", BIG) for i in ids] + [(ids[0], "http://x/", "other")]
    folder = str(tmp_path / kind)
    W.dedupe_and_write(spark.createDataFrame(rows, f"page_id {kind}, url string, html string"), folder)
    least = min((i for i in ids if i is not None), key=lambda i: i.encode() if kind == "string" else i)
    got = W.pages_back(spark, folder, kind).collect()
    want = [(i, "revisit" if h == BIG and i != least else "response", least if h == BIG and i != least else None) for i, _, h in rows]
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id is not None) == sorted(w for w in want if w[0] is not None)
    assert [(r.record_type, r.refers_to) for r in got if r.page_id is None] == [w[1:] for w in want if w[0] is None]


def http(head, body):
    block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
    return b"WARC/1.0\r\nwarc-type: response\r\nCONTENT-TYPE: Application/HTTP; msgtype=response\r\ncontent-length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_other_writers_spelling_and_codings(spark, tmp_path):
    import zlib

    page = b"<p>" + b"z" * 500
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = raw.compress(page) + raw.flush()
    chunks = b"%x;x=y\r\n%b\r\n%x\r\n%b\r\n0\r\n\r\n" % (100, page[:100], len(page) - 100, page[100:])
    zipped = gzip.compress(page)
    records = [
        http(b"transfer-encoding: Chunked", chunks), http(b"Content-Encoding: gzip", zipped), http(b"Content-Encoding: deflate", zlib.compress(page)), http(b"Content-Encoding: deflate", raw),
        http(b"Transfer-Encoding: chunked\r\nContent-Encoding: GZIP", b"%x\r\n%b\r\n0\r\n\r\n" % (len(zipped), zipped)), http(b"Content-Encoding: br", page), http(b"Content-Encoding: gzip", page),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    got = W.read_warc(spark, str(tmp_path)).where("record_type = 'response'").collect()
    assert [bytes(r.payload) for r in got] == [page] * len(records)
    assert W.read_warc(spark, str(tmp_path), "metadata,revisit").where("payload is null").count() == len(records)


def test_files_roll_and_strays_go(spark, pages, tmp_path):
    folder = tmp_path / "w"
    rows = spark.range(50).selectExpr("concat('<', id, '>') record_id", "'response' record_type", "'u' target_uri", "'d' warc_date", "cast(null as string) refers_to", "cast(null as string) payload_digest", "0L content_length", "map('X', 'y') headers", "cast(repeat(uuid(), 300) as binary) payload").repartition(2)
    W.write_warc(rows, str(folder), "none", roll_bytes=50_000)
    names = [p.name for p in folder.iterdir()]
    assert len(names) > 8 and all(p.stat().st_size < 70_000 for p in folder.iterdir()) and W.read_warc(spark, str(folder)).count() == 50
    writer = W.WarcWriter({"path": str(folder)}, False)
    stray, other = folder / f"_task-{writer.job}-00000-x.warc.gz", folder / "_task-other-00000-x.warc.gz"
    for end in (writer.commit, writer.abort):
        stray.write_bytes(b"half a record")
        other.write_bytes(b"another job's")
        end([])
        assert not stray.exists() and other.exists()
    assert W.read_warc(spark, str(folder)).count() == 50
