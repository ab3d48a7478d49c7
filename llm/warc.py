"""WARC archives with a two-level capture index.

Captures are sorted by their key (reversed host, path and query, then page). Each task writes an archive of one gzip
member per record, beside it the index entries of its records in compressed blocks, and the block directory: the first
key of every block with its place. A capture is found by binary search over the archives' first keys, over the block
directory, and in the block; then its record is read from the archive by its place alone.

Files go to the shared folder under a name with the task attempt, and a manifest lists those of the attempts that Spark
committed; so a repeated or speculative task does no harm.
"""

import base64
import bisect
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.frames import BROADCAST_ROWS, column, shared_folder, stored
from llm.urls import reversed_host_key

#: Entries of an index block.
BLOCK = 512
#: The pages have no capture time.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def capture_key(url: Column, page: Column) -> Column:
    """Reversed-host key and page, in an order that strings keep; a null page comes first."""
    number = F.lpad((page.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    whole = F.concat(reversed_host_key(url), F.lit("\u0001"), F.coalesce(number, F.lit("")))
    # Without the characters that separate entries, so that keys are sorted as they are searched for.
    for character, escape in (("%", "%25"), ("\n", "%0A"), ("\t", "%09")):
        whole = F.replace(whole, F.lit(character), F.lit(escape))
    return whole


def _name(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record as a gzip member; a revisit holds the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    header = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(header).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> dict:
    """A record read back; a response's payload is checked against its digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, name = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != name):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": name,
        "record_type": kind,
        "refers_to": _page(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def _open(uri: str, write: bool = False):
    files, place = pa.fs.FileSystem.from_uri(uri)
    if write:
        files.create_dir(place.rsplit("/", 1)[0])
        return files.open_output_stream(place, compression=None)
    return files.open_input_file(place)


def write(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0, folder: str | None = None) -> DataFrame:
    """Archives of all pages; returns their manifest: archive, first and last key, number of records.

    Of records with equal payloads of at least ``revisit_from`` bytes, that with the largest page is a response and the
    others revisit it; smaller payloads are all responses. A null payload is empty. A null url has an empty host and
    path. A page without an id is a revisit of a page with its payload if there is one, else a response. Rows that repeat
    the page of a response with its payload are responses too. Other columns are ignored.
    """
    folder = folder or shared_folder(pages.sparkSession)
    rows = pages.select(
        column(key).cast("long").alias("page"), F.coalesce(column(url).cast("string"), F.lit("")).alias("url"), F.coalesce(column(html).cast("string"), F.lit("")).cast("binary").alias("payload")
    )
    digests = rows.filter(F.octet_length("payload") >= revisit_from).select(F.sha1("payload").alias("sha1"), "page")
    several = stored(digests.groupBy("sha1").agg(F.max("page").alias("original"), F.count("*").alias("n")).filter("n > 1 and original is not null").select("sha1", "original"))
    # Repeated payloads are few as a rule; many are joined by shuffle, in which hot payloads are split by AQE.
    few = several.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.withColumn("sha1", F.when(F.octet_length("payload") >= revisit_from, F.sha1("payload")))
    rows = rows.join(F.broadcast(several) if few else several, "sha1", "left").drop("sha1")
    rows = rows.withColumn("revisit", F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page")))
    rows = rows.withColumn("key", capture_key(F.col("url"), F.col("page"))).repartitionByRange("key").sortWithinPartitions("key")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        archive, place, count, first, last = None, 0, 0, None, None
        lines: list[bytes] = []
        directory: list[bytes] = []

        def close_block() -> None:
            nonlocal index_place
            packed = zlib.compress(b"\n".join(lines))
            directory.append(b"%s\t%d\t%d" % (lines[0].split(b"\t")[0], index_place, len(packed)))
            index.write(packed)
            index_place += len(packed)
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if archive is None:
                    archive, index, index_place = _open(base + ".warc.gz", True), _open(base + ".cdx", True), 0
                member = record(row["page"], row["url"], row["payload"], row["original"], row["revisit"])
                name = row["key"].encode()
                lines.append(b"%s\t%d\t%d" % (name, place, len(member)))
                archive.write(member)
                place, count, first, last = place + len(member), count + 1, first or name, name
                if len(lines) == BLOCK:
                    close_block()
        if archive is None:
            return
        if lines:
            close_block()
        archive.close()
        index.close()
        with _open(base + ".directory", True) as out:
            out.write(b"\n".join(directory))
        yield pa.RecordBatch.from_pydict({"archive": [base], "first_key": [first], "last_key": [last], "records": [count]})

    return stored(rows.select("page", "url", "payload", "original", "revisit", "key").mapInArrow(task, "archive string, first_key binary, last_key binary, records long"))


class Archive:
    """One archive with its index."""

    def __init__(self, base: str):
        self.records, self.index = _open(base + ".warc.gz"), _open(base + ".cdx")
        with _open(base + ".directory") as file:
            entries = [line.split(b"\t") for line in file.read().split(b"\n")]
        self.firsts = [e[0] for e in entries]
        self.places = [(int(e[1]), int(e[2])) for e in entries]
        self.block = lru_cache(maxsize=4)(self.read_block)

    def read_block(self, n: int) -> tuple[list[bytes], list[tuple[int, int]]]:
        place, size = self.places[n]
        entries = [line.split(b"\t") for line in zlib.decompress(self.index.read_at(size, place)).split(b"\n")]
        return [e[0] for e in entries], [(int(e[1]), int(e[2])) for e in entries]

    def find(self, key: bytes) -> Iterator[bytes]:
        """The gzip members of all captures with this key."""
        n = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while n < len(self.firsts) and self.firsts[n] <= key:
            keys, places = self.block(n)
            for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                yield self.records.read_at(places[i][1], places[i][0])
            n += 1


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def look_up(wanted: DataFrame, manifest: DataFrame, key: str = "page_id", url: str = "url", payload: bool = False) -> DataFrame:
    """The captures of ``wanted`` pages and urls, read from the archives through the index.

    One row per record: page, full payload's size and digest, type, page that a revisit refers to, and with ``payload``
    the payload of responses. Unknown pages give no row; repeated requests count once.
    """
    # One row per archive, of some hundred bytes.
    parts = sorted((bytes(r.first_key), bytes(r.last_key), r.archive) for r in manifest.select("first_key", "last_key", "archive").collect())
    firsts = [p[0] for p in parts]
    # Ends of archives so far, so that those that may hold a key are an interval.
    lasts, top = [], b""
    for p in parts:
        top = max(top, p[1])
        lasts.append(top)
    keys = wanted.select(capture_key(F.coalesce(column(url).cast("string"), F.lit("")), column(key).cast("long")).alias("key")).distinct()
    names = [f.split()[0] for f in READ.split(", ")] + ["payload"] * payload

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = lru_cache(maxsize=8)(Archive)
        for batch in batches:
            found: list[dict] = []
            size = 0
            for name in map(str.encode, batch.column("key").to_pylist()):
                for n in range(bisect.bisect_left(lasts, name), bisect.bisect_right(firsts, name)):
                    for member in archive(parts[n][2]).find(name):
                        found.append({k: v for k, v in parsed(member).items() if k in names})
                        size += len(member) if payload else 100
                        if size > 8 << 20:
                            yield _rows(found, payload)
                            found, size = [], 0
            yield _rows(found, payload)

    return keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(task, READ + ", payload binary" * payload)


def _rows(found: list[dict], payload: bool) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    return pa.RecordBatch.from_pylist(found, schema=pa.schema(kinds + [("payload", pa.binary())] * payload))
