"""WARC archives: written with revisit records, read back by byte ranges."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b16decode, b16encode, b32decode, b32encode

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, numbered, shared_dir, written

#: Payloads below this many bytes are always stored.
LEAST_BYTES = 1000
RANGE = 8 << 20
MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 16
#: Bytes behind its range for which a task follows the chain of records it found.
AHEAD = 1 << 18
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


def deduplicate(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, payload, digest (hex), refers_to, is_revisit.

    Of equal payloads of at least `least` bytes the row with the largest page_id (a null is
    smallest; among rows of the same page_id one) is kept and the others refer to it. The pages
    are numbered and written once, and all else reads that table. Only digests are gathered, and
    only those that occur twice; the few revisits come to the pages by a broadcast, and by a
    shuffle where they are more than BROADCAST_ROWS.
    """
    payload = F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8")
    base = numbered(pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest")), "row")
    heads = base.select("row", "page_id", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    best = (
        heads.groupBy("digest")
        .agg(F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "row")).alias("best"), F.count("*").alias("k"))
        .where("k > 1")
        .select("digest", F.col("best.page_id").alias("keeper"), F.col("best.row").alias("keeper_row"))
    )
    # a revisit needs no payload, so rows are matched by their number and html stays where it is read
    revisits = written(heads.join(best, "digest").where("row <> keeper_row").select("row", F.col("keeper").alias("refers_to"), F.lit(True).alias("r")))
    side = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    j = base.join(side, "row", "left")
    return j.select("page_id", "url", "payload", "digest", "refers_to", F.coalesce("r", F.lit(False)).alias("is_revisit"))


def _member(head: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def write(records: DataFrame, folder: str, level: int = 1, name: str = "part") -> DataFrame:
    """Write records (as deduplicate() returns them) as .warc.gz files, one gzip member a record.

    Returns what was written: path, bytes, records. Each task writes its file under a name of
    its attempt and then moves it to the name of its partition, so a repeated attempt leaves
    one whole file. The returned rows are already written; reading them writes nothing again.
    """

    def run(batches):
        from pyspark import TaskContext

        at, store, top = TaskContext.get().partitionId(), *_open(folder)
        store.create_dir(top, recursive=True)
        final, temp = f"{top}/{name}-{at:06d}.warc.gz", f"{top}/_{name}-{at:06d}-{uuid.uuid4().hex}"
        size = n = 0
        out = None
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, digest, refers, again = (c[i].as_py() for c in b.columns)
                length = len(payload)
                head = [
                    ("WARC-Type", "revisit" if again else "response"),
                    ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"),
                    ("WARC-Date", "2024-01-01T00:00:00Z"),
                    ("WARC-Target-URI", _clean(url)),
                    ("WARC-Payload-Digest", "sha1:" + b32encode(b16decode(digest.upper())).decode()),
                    ("Content-Type", "application/http;msgtype=response"),
                    ("Page-Id", "" if page_id is None else str(page_id)),
                    ("Payload-Length", str(length)),
                ]
                if again:
                    head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
                    head.append(("Refers-To-Page-Id", "" if refers is None else str(refers)))
                m = _member(head, HTTP + (b"" if again else payload), level)
                if out is None:
                    out = store.open_output_stream(temp)
                out.write(m)
                size, n = size + len(m), n + 1
        if out is not None:
            out.close()
            store.move(temp, final)
            where = folder.rstrip("/") + "/" + final.rpartition("/")[2]
            yield pa.RecordBatch.from_pydict({"path": [where], "bytes": [size], "records": [n]})

    cols = ["page_id", "url", "payload", "digest", "refers_to", "is_revisit"]
    return written(records.select(*cols).mapInArrow(run, "path string, bytes long, records long"))


def _decode(raw: bytes) -> dict | None:
    """The record of a decompressed member: its fields and its block; None if it is none."""
    if not raw.startswith(b"WARC/1."):
        return None
    head, cut, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    if not cut or not fields.get("Content-Length", "").isdigit():
        return None
    n = int(fields["Content-Length"])
    return None if len(rest) < n else {"fields": fields, "block": rest[:n]}


class _Source:
    """Bytes of a file from a place on, read as they are needed."""

    def __init__(self, f, size: int, start: int):
        self.f, self.size, self.start, self.data = f, size, start, b""

    def upto(self, end: int) -> bytes:
        end = min(end, self.size)
        if end > self.start + len(self.data):
            want = max(end, self.start + len(self.data) + STEP) - self.start - len(self.data)
            self.data += self.f.read_at(min(want, self.size - self.start - len(self.data)), self.start + len(self.data))
        return self.data

    def drop(self, at: int) -> None:
        if at - self.start > 1 << 20:
            self.data, self.start = self.data[at - self.start :], at


def _inflate(src: _Source, at: int, probe: bool = False):
    """(decompressed, place after the member) of the gzip member at a place, or None.

    probe: stop as soon as the first bytes show that it is no WARC record.
    """
    z, out, n, here = zlib.decompressobj(31), [], 0, at
    try:
        while not z.eof:
            got = src.upto(here + STEP)[here - src.start : here - src.start + STEP]
            if not got:
                return None
            out.append(z.decompress(got))
            n += len(out[-1])
            here += len(got)
            if probe and n >= 7 and not b"".join(out).startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    return b"".join(out), here - len(z.unused_data)


def records_in(f, size: int, start: int, end: int):
    """The records whose gzip member starts at start <= place < end, as (place, record).

    The range may begin inside a member. Each gzip magic is a candidate; it counts if its
    header decodes to a WARC record and every member after it, up to the range's end and AHEAD
    bytes on, follows without a gap. A payload that is itself an archive, stored as it is,
    breaks that chain where it ends, and the search goes on behind the false start.
    """
    at, src = start, _Source(f, size, start)
    while at < end:
        found, here, sure = [], at, start == 0 and at == 0
        if not sure:
            got = src.upto(end + len(MAGIC))
            k = got.find(MAGIC, at - src.start)
            if k < 0 or src.start + k >= end:
                return
            at = here = src.start + k
        broken = False
        while here < end:
            m = _inflate(src, here, probe=True)
            r = _decode(m[0]) if m else None
            if r is None:
                broken = True
                break
            found.append((here, r))
            here = m[1]
            if sure:
                yield found.pop()
                src.drop(here)
        if broken and sure:
            raise ValueError(f"no record at byte {here}")
        ahead = 0 if sure else min(size, here + AHEAD)
        while not broken and here < ahead:  # the chain must go on behind the range, too
            m = _inflate(src, here, probe=True)
            broken, here = m is None, m[1] if m else here
        if not broken:
            yield from found
            return
        at += 1


def read(spark: SparkSession, files: DataFrame, size: int = RANGE) -> DataFrame:
    """The records of archives (path, bytes) -> page_id, url, record_type, payload_bytes,
    payload_digest (bare lower-case hex), refers_to, payload (null in a revisit).

    Every file is cut into byte ranges, dealt over the tasks; a range owns the records that
    start in it. Stored payloads are checked against their digests.
    """
    starts = files.select("path", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("start"))
    n = files.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / size)), F.lit(0))).first()[0]
    cut = starts.repartition(max(1, min(int(n), 100_000)), "path", "start")

    def run(batches):
        for b in batches:
            for path, total, start in zip(*(c.to_pylist() for c in b.columns)):
                store, name = _open(path)
                cols: dict[str, list] = {k: [] for k in names}
                with store.open_input_file(name) as f:
                    for _, r in records_in(f, total, start, min(start + size, total)):
                        h, body = r["fields"], r["block"].partition(b"\r\n\r\n")[2]
                        kind = h["WARC-Type"]
                        digest = b16encode(b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:"))).decode().lower()
                        if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"payload of {h['WARC-Record-ID']} in {path} is not what its digest says")
                        cols["page_id"].append(int(h["Page-Id"]) if h["Page-Id"] else None)
                        cols["url"].append(h["WARC-Target-URI"])
                        cols["record_type"].append(kind)
                        cols["payload_bytes"].append(len(body) if kind == "response" else int(h["Payload-Length"]))
                        cols["payload_digest"].append(digest)
                        to = h.get("Refers-To-Page-Id")
                        cols["refers_to"].append(int(to) if to else None)
                        cols["payload"].append(body if kind == "response" else None)
                        if len(cols["url"]) == 200:
                            yield pa.RecordBatch.from_pydict(cols, schema)
                            cols = {k: [] for k in names}
                yield pa.RecordBatch.from_pydict(cols, schema)

    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64())]
        + [("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )
    names = schema.names
    ddl = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return cut.mapInArrow(run, ddl)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = LEAST_BYTES, size: int = RANGE) -> DataFrame:
    """Write a record per page to archives in the shared folder and read them back.

    Null html is an empty payload, always a response; null page_id comes back null (a revisit
    of such a page has refers_to null); repeated rows are a record each, of which one is the
    response; empty tables give no rows; other columns are ignored.
    """
    files = write(deduplicate(pages, least), shared_dir(spark))
    return read(spark, files, size)
