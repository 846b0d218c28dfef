import base64
import hashlib
import random
import zlib

from tessera.llm import warc
from tessera.llm.warc import Index, archive_and_read, file_system, lookup, sort_key, url_key, write_archives, write_index

SCHEMA = "page_id long, url string, html string, offset long, digest string, largest long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "", 0) for r in rows], SCHEMA).repartition(3)


def pages(seed, n=300):
    rng = random.Random(seed)
    body = lambda: "<p>" + "é word " * rng.randint(0, 40) + str(rng.random())
    shared = [body() for _ in range(4)]
    out = [(i, f"http://{'www.' * (i % 2)}site{i % 7}.example.org/p/{rng.randint(0, 50)}?q={i % 3}#frag", rng.choice(shared) if rng.random() < 0.5 else body()) for i in range(n)]
    return out + [(n, None, None), (n + 1, "", ""), (n + 2, "not a url", None), (n + 3, "http://[bad", "x"), (None, "http://a.b/", "only"), (None, "http://a.b/", shared[0]), (7, out[7][1], out[7][2]), (n + 4, "http://h/\r\nX: y", "z\r\n\r\nz")]


def brute(rows, least=0):
    raw = [(p, (h or "").encode()) for p, _, h in rows]
    largest = {}
    for p, b in raw:
        if len(b) >= least and p is not None:
            largest[b] = max(p, largest.get(b, p))
    out = []
    for p, b in raw:
        revisit = b in largest and largest[b] != p
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", largest[b] if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    rows = pages(1)
    df = archive_and_read(frame(spark, rows))
    # equal rows of null page and url are asked for by the pair, and each comes back once
    assert got(df) == brute(rows)
    payloads = {r.page_id: bytes(r.payload) for r in df.collect() if r.record_type == "response" and r.page_id is not None}
    html = {p: (h or "").encode() for p, _, h in rows if p is not None}
    assert all(html[p] == x for p, x in payloads.items())


def test_least_payload_and_cases(spark):
    rows = pages(2, 40)
    assert got(archive_and_read(frame(spark, rows), least=50, with_payload=False)) == brute(rows, 50)
    assert archive_and_read(frame(spark, [])).count() == 0


def test_url_keys():
    assert url_key("https://User@WWW.Example.ORG:8080/a/b?c=d#e") == "org,example,www:8080)/a/b?c=d"
    assert url_key("http://example.org:80") == "org,example)/"
    assert url_key(None) == ")/"
    keys = [(x, i) for x in ["a)/", "a,b)/", "é)/", ""] for i in [None, -1, 5]]
    assert sorted(keys, key=lambda k: sort_key(*k)) == sorted(keys, key=lambda k: (k[0].encode(), k[1] is not None, k[1] or 0))


def test_index_holds_every_capture_once_and_searches_few_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rows = [(i, f"http://h{i % 5}.org/{i // 5}", "x") for i in range(200)] + [(3, "http://same.org/", f"v{i}") for i in range(30)]
    captures = write_archives(frame(spark, rows), f"file://{tmp_path}/w")
    top = write_index(captures, f"file://{tmp_path}/i")
    assert sum(r["blocks"] for r in top) >= 230 // 4
    index = Index(f"file://{tmp_path}/i", top)
    read: list = []
    plain = Index.read
    monkeypatch.setattr(Index, "read", lambda self, *a: read.append(a) or plain(self, *a))
    assert [x[1] for x in index.find("org,h3)/7", 38)] == [38] and len(read) <= 2
    assert len(list(index.find("org,same)/", 3))) == 30
    assert not list(index.find("org,nowhere)/", 3)) and not list(index.find("org,h3)/7", 39)) and not list(index.find("", None)) and not list(index.find("zz", 1))
    places = lookup(frame(spark, [(3, "http://same.org/", ""), (8, "http://h3.org/1", ""), (9, "http://no.org/", "")]), f"file://{tmp_path}/i", top).collect()
    assert sorted(r.page_id for r in places) == [3] * 30 + [8]
    store, path = file_system(f"file://{tmp_path}/w")
    for r in places:
        with store.open_input_file(f"{path}/{r.file}") as f:
            assert zlib.decompress(f.read_at(r.length, r.offset), wbits=31).startswith(b"WARC/1.1\r\nWARC-Type: ")
