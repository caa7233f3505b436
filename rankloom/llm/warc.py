"""Legacy ARC archives converted to WARC, with revisit records for repeated payloads, and readers of both."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import bounded_batches, remove, scratch, stored

#: Payloads of fewer bytes are never turned into revisits.
MIN_REVISIT = 1000
#: Revisits whose list is broadcast to the conversion (under 200 bytes each); more go by a shuffle.
BROADCAST_REVISITS = 200_000
#: Field names of ARC header lines, by version: fixed values of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
DATE, HOST = "20240101000000", "0.0.0.0"
FLUSH = 4 << 20


def _batched(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])


def arc_header(version: int, url: str, kind: str, length: int, status: int = 200, name: str = "-") -> bytes:
    url = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) or "-"
    middle = "" if version == 1 else f"{status} - - 0 {name} "
    return f"{url} {HOST} {DATE} {kind} {middle}{length}\n".encode()


def _arc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    version, name = 1 + part % 2, f"pages-{part:05d}.arc"

    def records() -> Iterator[bytes]:
        begun = False
        for batch in batches:
            for page, url, html in zip(*(c for c in batch.columns), strict=True):
                if not begun:
                    body = f"{version} 0 rankloom\n{FIELDS[version]}\n".encode()
                    yield arc_header(version, f"filedesc://{name}", "text/plain", len(body), name=name) + body
                    begun = True
                payload = html.as_py() or b""
                own = "" if page.as_py() is None else f"X-Page-Id: {page.as_py()}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode()
                yield arc_header(version, url.as_py() or "", "text/html", len(head) + len(payload), name=name) + head + payload

    yield from _batched(records())


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One gzipped ARC file for each partition of the pages, of version 1 or 2 in turn; null html is an empty payload."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string").cast("binary"))
    rows.mapInArrow(_arc_records, "record binary").select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def opened(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def parse_arc(content: bytes) -> Iterator[dict]:
    """The records of an ARC file: number, url, ip, date, kind, block and whether the block is cut short.

    The version block tells the version, and so the fields of header lines; blocks have their declared length.
    A header line that doesn't have its version's fields ends the file.
    """
    f, version, n = opened(content), 1, 0
    while line := f.readline():
        line = line.strip(b"\r\n")
        if not line:
            continue
        text = line.decode("utf-8", "surrogateescape")
        if text.startswith("filedesc:"):
            version = 2 if len(text.split(" ")) >= len(FIELDS[2].split(" ")) else 1
        fields = text.rsplit(" ", len(FIELDS[version].split(" ")) - 1)
        if len(fields) != len(FIELDS[version].split(" ")) or not fields[-1].isdigit():
            return
        block = f.read(int(fields[-1]))
        if fields[0].startswith("filedesc:") and block[:1] in b"12" and block[:1]:
            version = int(block[:1])
        yield {"number": n, "url": fields[0], "ip": fields[1], "date": fields[2], "kind": fields[3], "block": block, "cut": len(block) < int(fields[-1])}
        n += 1


def parse_http(block: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (names lower-cased) and payload of an HTTP response; None if it is none."""
    if not block.startswith(b"HTTP/"):
        return None
    head, _, payload = block.partition(b"\r\n\r\n")
    return _fields(head.split(b"\r\n")[1:]), payload


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.partition(b":") for x in lines if b":" in x)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "surrogateescape") for k, _, v in pairs}


def warc_date(date: str) -> str:
    """ARC dates have up to 14 digits; missing ones are those of the first moment."""
    d = "".join(c for c in date if c.isdigit())[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(url: str, date: str, digest: str, page: str | None) -> str:
    """The same for the same record on every run."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr((url, date, digest, page)).encode('utf-8', 'surrogateescape')).digest()[:16], version=5)}>"


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def to_warc(r: dict, revisit: dict | None = None) -> bytes:
    """The WARC record of an ARC record, without the blank lines after it; a revisit has the response's headers only."""
    http = parse_http(r["block"])
    block, payload = r["block"], http[1] if http else r["block"]
    sha = hashlib.sha1(payload)
    page = http[0].get("x-page-id") if http else None
    kind = "warcinfo" if r["url"].startswith("filedesc:") else "response" if http else "resource"
    head = {
        "WARC-Type": kind if revisit is None else "revisit",
        "WARC-Record-ID": record_id(r["url"], r["date"], sha.hexdigest(), page),
        "WARC-Date": warc_date(r["date"]),
        "WARC-Target-URI": None if kind == "warcinfo" else r["url"],
        "WARC-Filename": r["url"].removeprefix("filedesc://") if kind == "warcinfo" else None,
        "WARC-IP-Address": r["ip"] if kind == "response" else None,
        "WARC-Payload-Digest": base32(sha.digest()) if kind == "response" else None,
        "X-Payload-Length": str(len(payload)) if kind == "response" else None,
        "X-Page-Id": page,
        "WARC-Truncated": "unspecified" if r["cut"] else None,
    }
    if revisit is not None:
        block = block[: len(block) - len(payload)]
        url, date = revisit["url"], revisit["date"]
        head |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": record_id(url, date, sha.hexdigest(), str(revisit["page_id"])),
            "WARC-Refers-To-Target-URI": url,
            "WARC-Refers-To-Date": warc_date(date),
            "X-Refers-To-Page-Id": str(revisit["page_id"]),
        }
    else:
        head["WARC-Block-Digest"] = base32(hashlib.sha1(block).digest())
    head["Content-Type"] = "application/http; msgtype=response" if http else r["kind"]
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.0\r\n" + lines.encode("utf-8", "surrogateescape") + b"\r\n" + block


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(*batch.columns, strict=True):
            rows = []
            for r in parse_arc(content.as_py()):
                if http := parse_http(r["block"]):
                    page = http[0].get("x-page-id")
                    rows.append({"path": path.as_py(), "number": r["number"], "url": r["url"], "date": r["date"], "page_id": int(page) if page else None, "bytes": len(http[1]), "digest": hashlib.sha1(http[1]).hexdigest()})
            kinds = [("path", pa.string()), ("number", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[bytes]:
        for batch in batches:
            for content, revisits in zip(*batch.columns, strict=True):
                to = {x["number"]: x for x in revisits.as_py() or []}
                for r in parse_arc(content.as_py()):
                    yield to_warc(r, to.get(r["number"]))

    yield from _batched(records())


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = MIN_REVISIT) -> None:
    """The ARC files of a folder as gzipped WARC files, one or more ARC files to each.

    HTTP records become ``response`` records with payload digests; the version block becomes ``warcinfo`` and
    anything else ``resource``. Record ids are made from the record, so they are the same on every run. Of
    responses with equal payloads of ``min_revisit`` bytes or more, that with the largest page id stays and
    the others become ``revisit`` records without payload; records of that same id all stay, and those
    without an id stay unless another has one. Payloads aren't shuffled: only places and digests are.
    """
    files = spark.read.format("binaryFile").load(arc_path).select("path", "content")
    index = stored(files.mapInArrow(_index, "path string, number long, url string, date string, page_id long, bytes long, digest string"), "arc-index")
    kept = index.where(F.col("bytes") >= min_revisit).groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("page_id", "url", "date"), F.struct("page_id", "url", "path", "number")).alias("to"))
    kept = kept.where("n > 1 and to.page_id is not null")
    revisits = index.join(kept, ["digest", "bytes"]).where(~F.col("page_id").eqNullSafe(F.col("to.page_id")))
    revisits = stored(revisits.groupBy("path").agg(F.collect_list(F.struct("number", "to.page_id", "to.url", "to.date")).alias("revisits")), "revisits")
    n = revisits.agg(F.coalesce(F.sum(F.size("revisits")), F.lit(0))).first()[0]
    joined = files.join(F.broadcast(revisits) if n <= BROADCAST_REVISITS else revisits.hint("shuffle_hash"), "path", "left")
    out = joined.select("content", "revisits").mapInArrow(_convert, "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(warc_path)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names lower-cased) and block of each record of a WARC file."""
    f = opened(content)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        lines = []
        while (line := f.readline()).strip():
            lines.append(line)
        head = _fields(lines)
        yield head, f.read(int(head.get("content-length", "0")))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("sound", pa.bool_())])
    number = lambda x: int(x) if x else None
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for head, block in parse_warc(content.as_py()):
                kind = head.get("warc-type")
                if kind not in ("response", "revisit"):
                    continue
                stated = base64.b32decode(head.get("warc-payload-digest", "sha1:").removeprefix("sha1:")).hex()
                size, digest = int(head.get("x-payload-length", "-1")), stated
                if kind == "response":
                    http = parse_http(block)
                    payload = http[1] if http else block
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                rows.append((number(head.get("x-page-id")), size, digest, kind, number(head.get("x-refers-to-page-id")), head.get("warc-target-uri"), head.get("warc-record-id"), digest == stated))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of a folder of WARC files: page_id, payload_bytes, payload_digest (SHA-1),
    record_type, refers_to, url, record_id, and sound: whether the payload has its stated digest."""
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, sound boolean"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, kinds)


def archive(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages written as ARC files in the shared folder, converted to WARC, and read back (``read_warc``)."""
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(pages, arc)
    convert_arc(spark, arc, warc, min_revisit)
    remove(spark, arc)
    return read_warc(spark, warc)
