"""WARC archives with a two-level capture index: sorted URL keys in compressed blocks, and a sparse directory of blocks."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batch, file_system, map_arrow, parts, pieces, saved, scratch_path

#: Bytes at which a task begins a new archive; captures in an index block; bytes between records worth reading over.
ARCHIVE_BYTES, BLOCK_LINES, GAP, READ_BYTES = 1 << 30, 512, 1 << 15, 4 << 20
#: Archives, like the tables they are made from, bear no time of capture.
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PLACE = [("url_key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
PLACE_SQL = "url_key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed, without scheme, user and fragment: ``org,example,www)/path?query``. A null
    or relative URL has no host; what cannot be parsed is its own key."""
    try:
        parts_ = urlsplit((url or "").strip())
        host, port = (parts_.hostname or ""), parts_.port
    except ValueError:
        return url.strip()
    at = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{at}){parts_.path or '/'}" + (f"?{parts_.query}" if parts_.query else "")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(4, wbits=31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def capture(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit that has only the payload's digest and the length HTTP told."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", headers, http if revisit else http + payload)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by name and the block of a record."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


class Writer:
    """Appends records to archives of a folder; a task that runs again writes others, and only rows it returns count."""

    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix, self.out, self.at, self.name = folder, suffix, None, 0, ""

    def append(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= ARCHIVE_BYTES:
            self.close()
            store, path = file_system(self.folder)
            store.create_dir(path, recursive=True)
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.out = store.open_output_stream(f"{path}/{self.name}", compression=None)
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self):
        if self.out is not None:
            self.out.close()
        self.out = None


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) and return where each is (PLACE_SQL).

    Of rows with equal payloads of at least ``least`` bytes, those with the largest page_id are responses and the
    others revisits of it; smaller payloads are all responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    largest = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("largest"))
    joined = rows.join(largest, "digest", "left").select("page_id", "url", "html", "largest")

    def run(batches):
        writer = Writer(folder, ".warc.gz")
        writer.append(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        for part in pieces(batches, "html"):
            out = []
            for i, url, html, largest in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "largest")), strict=True):
                member = capture(i, url, html.encode(), largest, largest is not None and i != largest)
                out.append((url_key(url), i, *writer.append(member)))
            yield arrow_batch(PLACE, [list(x) for x in zip(*out)])
        writer.close()

    return saved(map_arrow(joined, run, PLACE_SQL), "captures")


def sort_key(key: str, page_id: int | None) -> tuple[bytes, int]:
    """Index order: by the key's bytes, then by page, null first."""
    return key.encode(), -(2**63) - 1 if page_id is None else page_id


def write_index(captures: DataFrame, folder: str) -> list[dict]:
    """The two-level index of ``captures`` in ``folder``: a file for each range of keys, a row of the returned top for each.

    A file is a run of zlib blocks of BLOCK_LINES sorted captures, then its directory (each block's first key, offset
    and length), then the directory's place. The top has one row a file, as many as partitions, however many captures.
    """
    order = ["url_key", "page_id", "file", "offset"]
    ranged = captures.repartitionByRange(parts(captures.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches):
        writer, lines, directory = Writer(folder, ".index"), [], []

        def block():
            packed = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            name, at, size = writer.append(packed)
            directory.append((lines[0][0], lines[0][1], at, size))
            lines.clear()
            return name

        name = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c, _ in PLACE), strict=True):
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    name = block()
        if lines:
            name = block()
        if name:
            _, at, size = writer.append(zlib.compress(json.dumps(directory).encode(), 6))
            writer.append(at.to_bytes(8, "little") + size.to_bytes(8, "little"))
            writer.close()
            yield arrow_batch([("url_key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("blocks", pa.int64())], [[directory[0][0]], [directory[0][1]], [name], [len(directory)]])

    top = map_arrow(ranged, run, "url_key string, page_id long, file string, blocks long").collect()
    return sorted((r.asDict() for r in top), key=lambda r: sort_key(r["url_key"], r["page_id"]))


class Index:
    """Looks captures up: binary search in the top, in a file's directory, then a range read and a search of the block.
    The last directory and block stay in memory, so sorted keys read each block once."""

    def __init__(self, folder: str, top: list[dict]):
        self.store, self.path = file_system(folder)
        self.top, self.files = [sort_key(r["url_key"], r["page_id"]) for r in top], [r["file"] for r in top]
        self.kept: dict[str, tuple] = {}

    def read(self, name: str, at: int, size: int) -> bytes:
        with self.store.open_input_file(f"{self.path}/{name}") as f:
            return f.read_at(size, at)

    def directory(self, name: str) -> tuple[list, list]:
        if self.kept.get("directory", ("",))[0] != name:
            with self.store.open_input_file(f"{self.path}/{name}") as f:
                tail = f.read_at(16, f.size() - 16)
                rows = json.loads(zlib.decompress(f.read_at(int.from_bytes(tail[8:], "little"), int.from_bytes(tail[:8], "little"))))
            self.kept["directory"] = (name, [sort_key(r[0], r[1]) for r in rows], rows)
        return self.kept["directory"][1:]

    def block(self, name: str, at: int, size: int) -> tuple[list, list]:
        if self.kept.get("block", ((),))[0] != (name, at):
            rows = [json.loads(x) for x in zlib.decompress(self.read(name, at, size)).split(b"\n")]
            self.kept["block"] = ((name, at), [sort_key(r[0], r[1]) for r in rows], rows)
        return self.kept["block"][1:]

    def find(self, key: str, page_id: int | None) -> Iterator[list]:
        """All captures of a page under a key; equal ones may go on in the next blocks and files."""
        want = sort_key(key, page_id)
        for i in range(max(0, bisect.bisect_left(self.top, want) - 1), len(self.top)):
            if self.top[i] > want:
                return
            firsts, rows = self.directory(self.files[i])
            for j in range(max(0, bisect.bisect_left(firsts, want) - 1), len(rows)):
                if firsts[j] > want:
                    break
                keys, lines = self.block(self.files[i], rows[j][2], rows[j][3])
                at = bisect.bisect_left(keys, want)
                while at < len(keys) and keys[at] == want:
                    yield lines[at]
                    at += 1


def lookup(wanted: DataFrame, folder: str, top: list[dict]) -> DataFrame:
    """Where the captures of ``wanted`` (url, page_id) are, each distinct pair asked once. Keys are sorted into ranges as
    the index is, so that a task reads few blocks and each about once."""
    spark = wanted.sparkSession

    def keyed(batches):
        for batch in batches:
            yield arrow_batch([("url_key", pa.string()), ("page_id", pa.int64())], [[url_key(x) for x in batch.column("url").to_pylist()], batch.column("page_id")])

    keys = map_arrow(wanted.select("url", F.col("page_id").cast("long").alias("page_id")), keyed, "url_key string, page_id long").distinct()
    ranged = keys.repartitionByRange(parts(spark), "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    sent = spark.sparkContext.broadcast(top)

    def run(batches):
        index = Index(folder, sent.value)
        for batch in batches:
            rows = [x for key, i in zip(batch.column("url_key").to_pylist(), batch.column("page_id").to_pylist(), strict=True) for x in index.find(key, i)]
            yield arrow_batch(PLACE, [list(x) for x in zip(*rows)] if rows else [[] for _ in PLACE])

    return map_arrow(ranged, run, PLACE_SQL)


def fetch(places: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records at ``places``, read in file order with near ones in one range: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to[, payload]. A response's length and digest are those of what was read."""
    ranged = places.repartitionByRange(parts(places.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if with_payload else [])]

    def members(batches):
        store, path = file_system(folder)
        run: list[tuple[int, int]] = []
        name = None

        def read():
            with store.open_input_file(f"{path}/{name}") as f:
                data = f.read_at(run[-1][0] + run[-1][1] - run[0][0], run[0][0])
            for at, size in run:
                yield data[at - run[0][0] : at - run[0][0] + size]
            run.clear()

        for batch in batches:
            for file, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if run and (file != name or at - run[-1][0] - run[-1][1] > GAP or at + size - run[0][0] > READ_BYTES):
                    yield from read()
                name = file
                run.append((at, size))
        if run:
            yield from read()

    def run(batches):
        out: list[tuple] = []
        held = 0
        for member in members(batches):
            head, block = parsed(member)
            http, _, payload = block.partition(b"\r\n\r\n")
            page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
            if head["WARC-Type"] == "response":
                size, digest = len(payload), base32_sha1(payload)
                if f"sha1:{digest}" != head["WARC-Payload-Digest"]:
                    raise ValueError(f"page {page}: the archive's payload has another digest than its record")
            else:
                told = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                size, digest = int(told["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
            out.append((page and int(page), head["WARC-Target-URI"], size, digest, head["WARC-Type"], refers and int(refers), *([payload] if with_payload else [])))
            held += len(payload) if with_payload else 100
            if held > READ_BYTES:
                yield arrow_batch(fields, [list(x) for x in zip(*out)])
                out, held = [], 0
        if out:
            yield arrow_batch(fields, [list(x) for x in zip(*out)])

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return map_arrow(ranged, run, schema)


def archive_and_read(pages: DataFrame, least: int = 0, with_payload: bool = True) -> DataFrame:
    """Write ``pages`` to archives, index them, and read every page back through the index.

    A null html is an empty payload, a null url an empty one; a null page_id is read back as null, and is a response
    unless another row of the same payload has an id. Rows that share page_id and payload are alike, so if theirs is
    the largest id all are responses. Repeated rows come back as often as they went in; no rows give none; other
    columns are left. The archives stay in the shared folder, as the result is read from them.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    captures = write_archives(pages, f"{folder}/archives", least)
    top = write_index(captures, f"{folder}/index")
    return fetch(lookup(pages, f"{folder}/index", top), f"{folder}/archives", with_payload)
