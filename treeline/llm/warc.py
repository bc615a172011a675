"""Operator 2: WARC files, read one record after another.

A file is a row of gzip members, one record each. The reader streams a file in
blocks of a fixed size through an incremental zlib decompressor, starts a new
one where a member ends, frames each block by its Content-Length and checks the
digests. Nothing but the record at hand is in memory. One task reads one file;
the writer packs a partition's rows into a file, named by the partition and put
in place by a rename, so that a task run again leaves the same file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.shared import read, shared_dir

BLOCK = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

RECORD = (
    "file string, record_no bigint, record_id string, record_type string, target_uri string, record_date string, "
    "content_length bigint, payload binary, block_digest_ok boolean, payload_digest_ok boolean, problem string"
)


def digest(data: bytes, name: str = "sha1") -> str:
    return f"{name}:" + base64.b32encode(hashlib.new(name, data).digest()).decode()


def _matches(field: str | None, data: bytes) -> bool | None:
    """None: no digest to check, or an algorithm that isn't known. Base 32 or hexadecimal."""
    if not field or ":" not in field:
        return None
    name, _, value = field.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "md5", "sha512"):
        return None
    found = hashlib.new(name, data)
    return value.strip().upper() in (base64.b32encode(found.digest()).decode(), found.hexdigest().upper())


def member(block: bytes, headers: dict[str, str], level: int = 6) -> bytes:
    """One record as one gzip member. Control characters in header values become spaces."""
    clean = {k: "".join(c if c >= " " else " " for c in v) for k, v in headers.items()}
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


_MAGIC = b"\x1f\x8b\x08"


class Records:
    """The records of one stream, as dicts. A broken member is a row that names the problem; the next record is looked for behind it."""

    def __init__(self, read_block: Callable[[int], bytes]):
        self._read = read_block
        self._rest = b""

    def _members(self) -> Iterator[tuple[bytes, str | None]]:
        while True:
            if not self._rest:
                self._rest = self._read(BLOCK)
                if not self._rest:
                    return
            unpack, parts, raw, problem = zlib.decompressobj(31), [], [], None
            try:
                while not unpack.eof:
                    if not self._rest:
                        self._rest = self._read(BLOCK)
                        if not self._rest:
                            problem = "truncated member"
                            break
                    raw.append(self._rest)
                    parts.append(unpack.decompress(self._rest))
                    self._rest = unpack.unused_data if unpack.eof else b""
            except zlib.error:
                problem = "not a gzip member"
            yield b"".join(parts), problem
            if problem:
                self._rest = self._next(b"".join(raw))

    def _next(self, data: bytes) -> bytes:
        """The stream from the next member on that begins as a record does; data: what was read from the start of the broken one."""
        at, ended = 1, False
        while True:
            at = data.find(_MAGIC, at)
            if at < 0:
                more = self._read(BLOCK)
                if not more:
                    return b""
                data, at = data[-2:] + more, 0
                continue
            if len(data) - at < 4096 and not ended:
                more = self._read(BLOCK)
                data, at, ended = data[at:] + more, 0, not more
                continue
            try:
                if zlib.decompressobj(31).decompress(data[at : at + 4096], 5) == b"WARC/":
                    return data[at:]
            except zlib.error:
                pass
            at += 1

    def __iter__(self) -> Iterator[dict]:
        for n, (data, problem) in enumerate(self._members()):
            row = {"record_no": n, "problem": problem}
            head, gap, block = data.partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "replace").split("\r\n")
            if not gap or not lines[0].startswith("WARC/"):
                yield row | {"problem": problem or "no WARC header"}
                continue
            fields: dict[str, str] = {}
            last = ""
            for line in lines[1:]:
                if line[:1] in (" ", "\t") and last:  # a folded line
                    fields[last] += " " + line.strip()
                    continue
                last, _, value = line.partition(":")
                last = last.strip().lower()
                fields[last] = value.strip()
            row |= {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "record_date": fields.get("warc-date")}
            length = fields.get("content-length", "")
            if not length.isdigit():
                yield row | {"problem": problem or "no Content-Length"}
                continue
            size = int(length)
            if len(block) < size:
                yield row | {"content_length": size, "problem": problem or "block shorter than its Content-Length"}
                continue
            if block[size:].strip(b"\r\n"):
                problem = problem or "block longer than its Content-Length"
            block = block[:size]
            payload = block
            if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
                payload = block.partition(b"\r\n\r\n")[2]
            yield row | {
                "content_length": size, "payload": payload, "problem": problem,
                "block_digest_ok": _matches(fields.get("warc-block-digest"), block), "payload_digest_ok": _matches(fields.get("warc-payload-digest"), payload),
            }


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of the files at paths, in any folder that the executors reach: columns as in RECORD.

    An empty list or file gives no rows. A record without digests has null in
    the two columns; one that can't be framed keeps what was read, with problem
    set. A damaged member is one row with a problem, and so is a file that can't
    be opened; all other records come back. Payloads are those of the HTTP
    message where the record holds one.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(":")[0].split()[0] for x in RECORD.split(", ")]
        for frame in frames:
            for path in frame["file"]:
                system, place = _filesystem(path)
                try:
                    opened = system.open_input_stream(place, compression=None)
                except FileNotFoundError:
                    yield pd.DataFrame([{**dict.fromkeys(names), "file": path, "record_no": 0, "problem": "no such file"}], columns=names)
                    continue
                with opened as stream:
                    rows, held = [], 0
                    for row in Records(stream.read):
                        rows.append({**dict.fromkeys(names), "file": path, **row})
                        held += len(row.get("payload") or b"") + 500
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    files = spark.createDataFrame([(p,) for p in paths], "file string")
    return files.repartition(max(1, len(paths)), "file").mapInPandas(run, RECORD)


def write_warc(pages: DataFrame, folder: str) -> list[str]:
    """Writes (page_id, url, html) as response records, a file for each partition; returns the files' names.

    Rows with a null html get an empty payload, those with a null url no
    WARC-Target-URI and those with a null page_id an empty one in the record's
    id; every row is a record, repeats too. Other columns are left out. Empty partitions
    leave no file.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, place = _filesystem(folder)
        part = TaskContext.get().partitionId()
        name, tmp = f"part-{part:05d}.warc.gz", f"{place}/_{part:05d}-{uuid.uuid4().hex}"
        count = 0
        system.create_dir(place, recursive=True)
        with system.open_output_stream(tmp, compression=None) as out:
            for frame in frames:
                for key, url, html in zip(frame["page_id"], frame["url"], frame["html"]):
                    payload = b"" if html is None else html.encode("utf-8", "surrogatepass")
                    fields = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{'' if pd.isna(key) else int(key)}>", "WARC-Date": "2024-01-01T00:00:00Z"}
                    if url is not None:
                        fields["WARC-Target-URI"] = url
                    fields |= {"Content-Type": "application/http; msgtype=response", "WARC-Block-Digest": digest(_HTTP + payload), "WARC-Payload-Digest": digest(payload)}
                    out.write(member(_HTTP + payload, fields))
                    count += 1
        if count:
            system.move(tmp, f"{place}/{name}")
            yield pd.DataFrame({"file": [f"{folder}/{name}"]})
        else:
            system.delete_file(tmp)

    # one file name for each partition comes to the driver
    return sorted({r.file for r in pages.select("page_id", "url", "html").mapInPandas(run, "file string").collect()})


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files in the shared folder and read back: a row for each record."""
    pages = read(spark, sf_dir, "pages")
    records = read_warc(spark, write_warc(pages, f"{shared_dir(spark)}/treeline/warc-{uuid.uuid4().hex}"))
    return records.select(
        F.regexp_extract("record_id", "<urn:page:([0-9-]+)>", 1).try_cast("bigint").alias("page_id"),
        F.col("target_uri").alias("url"),
        "record_type",
        F.col("payload").cast("string").alias("html"),
        F.octet_length("payload").cast("bigint").alias("n_bytes"),
        (F.col("block_digest_ok") & F.col("payload_digest_ok") & F.col("problem").isNull()).alias("intact"),
    )


OP2_SQL = """
SELECT page_id, url, 'response' AS record_type, coalesce(html, '') AS html,
       CAST(strlen(coalesce(html, '')) AS BIGINT) AS n_bytes, TRUE AS intact
FROM pages
"""
