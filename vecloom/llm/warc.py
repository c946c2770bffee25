"""WARC reading and writing as a PySpark Python data source (format "warc").

Reading: file partitions are planned on the driver (one per file, small files together), predicates on record type,
target URI, record id, digest and refers-to are pushed into the reader, headers are parsed first, and the payload of a
record that no predicate wants is skipped undecoded: plain files seek over it, gzip members that carry their length
(the "sl" extra field this writer adds) are jumped over without inflating. Other gzip files are streamed.

Writing: one file series per task under a name of its own attempt; each commit writes a manifest of the files of its
successful attempts, and reading a folder with manifests reads only what they name, so lost executors leave no doubles and
appended tables add up. Header lines may be folded; a chunked transfer coding is undone; content codings stay as they are.

Options: path; compression gzip (default) or none; payload true/false (reading: leave payloads null and undecoded);
file_mb (size at which the writer opens the next file); partition_mb (small files read together up to this).
Files are reached through pyarrow.fs (file, hdfs, s3, gs).

Defined cases: null payload writes an empty one; null ids, URIs and digests have no header and read back as null;
control characters in header values are percent-encoded; an empty table writes no file and reads back no rows.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from ._shared import lookup, scratch_path, ship, stored, table

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
MANIFEST = "_manifest"
PUSHED = {"record_id", "record_type", "target_uri", "refers_to", "payload_digest"}
_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,15})[^\r\n]*\r\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _value(s: str) -> str:
    return "".join(quote(c) if ord(c) < 32 or c in "%<>\x7f" else c for c in s)


def record(row: dict) -> bytes:
    """One record of WARC 1.1, without compression."""
    body = row["payload"] or b""
    head = ["WARC/1.1", f"WARC-Type: {_value(row['record_type'] or 'response')}", "WARC-Date: 2000-01-01T00:00:00Z"]
    if row["record_id"] is not None:
        head.append(f"WARC-Record-ID: <{_value(row['record_id'])}>")
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_value(row['target_uri'])}")
    if row["refers_to"] is not None:
        head.append(f"WARC-Refers-To: <{_value(row['refers_to'])}>")
    if row["payload_digest"] is not None:
        head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}")
    if row["payload_length"] is not None:
        head.append(f"X-Payload-Length: {row['payload_length']}")
    if row["record_type"] == "revisit":
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field "sl" holds its own length and that of its content."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    total = 10 + 2 + 12 + len(body) + 8
    tail = body + (zlib.crc32(data)).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    if max(total, len(data)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + tail
    extra = b"sl" + (8).to_bytes(2, "little") + total.to_bytes(4, "little") + len(data).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + len(extra).to_bytes(2, "little") + extra + tail


def _headers(raw: bytes) -> dict:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    h, unfolded = {}, []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and unfolded:
            unfolded[-1] += " " + line.strip()
        else:
            unfolded.append(line)
    for line in unfolded:
        name, colon, value = line.partition(":")
        if colon:
            h[name.strip().lower()] = value.strip()
    return h


def _row(h: dict) -> dict:
    bare = lambda k: unquote(h[k].strip("<>")) if k in h else None
    digest = h.get("warc-payload-digest")
    if digest and digest.lower().startswith("sha1:"):
        value = digest[5:]
        digest = value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    length = h.get("x-payload-length")
    return {"record_id": bare("warc-record-id"), "record_type": bare("warc-type"), "target_uri": bare("warc-target-uri"), "refers_to": bare("warc-refers-to"), "payload_digest": digest, "payload_length": int(length) if length is not None else None}


def _payload(h: dict, block: bytes) -> bytes:
    if h.get("content-type", "").startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        return _unchunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head) else body
    return block


def _unchunked(body: bytes) -> bytes:
    """The body without chunk sizes; as it is, where it isn't chunked in truth."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        n, at = int(m[1], 16), m.end()
        if not n:
            return b"".join(out)
        out.append(body[at : at + n])
        at += n + 2
    return body


def _stream_records(f, want, payload: bool) -> Iterator[dict]:
    """Records of a readable (and perhaps seekable) stream."""
    seekable = isinstance(f, io.BufferedReader)
    while line := f.readline():
        if line in (b"\r\n", b"\n"):
            continue
        raw = [line]
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            raw.append(line)
        h = _headers(b"".join(raw))
        n, row = int(h.get("content-length", 0)), _row(h)
        if not want(row) or not payload:
            if seekable:
                f.seek(n, 1)
            else:
                left = n
                while left and (got := len(f.read(min(left, 1 << 20)))):
                    left -= got
            if want(row):
                yield row | {"payload": None}
            continue
        block = f.read(n)
        if len(block) < n:
            raise ValueError(f"record {row['record_id']} ends early")
        yield row | {"payload": _payload(h, block)}


def _member_length(head: bytes) -> tuple[int, int] | None:
    """(member length, offset of its deflate data) where the "sl" field says so."""
    if head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"sl":
        return None
    return int.from_bytes(head[16:20], "little"), 12 + int.from_bytes(head[10:12], "little")


def _member_records(f, size: int, want, payload: bool) -> Iterator[dict]:
    """Records of a file in which each gzip member is one record and carries its length."""
    at = 0
    while at < size:
        f.seek(at)
        data = f.read(4096)
        found = _member_length(data)
        if not found:
            f.seek(at)
            yield from _stream_records(gzip.GzipFile(fileobj=f), want, payload)
            return
        total, start = found
        d = zlib.decompressobj(-15)
        out = d.decompress(data[start : min(total, len(data))], 2048)
        while b"\r\n\r\n" not in out and (d.unconsumed_tail or len(data) < total):
            if d.unconsumed_tail:
                out += d.decompress(d.unconsumed_tail, 2048)
            else:
                more = f.read(min(4096, total - len(data)))
                if not more:
                    raise ValueError("gzip member ends early")
                data += more
                out += d.decompress(more, 2048)
        raw, _, rest = out.partition(b"\r\n\r\n")
        h = _headers(raw)
        row = _row(h)
        if want(row):
            if payload:
                rest += d.decompress(d.unconsumed_tail) if d.unconsumed_tail else b""
                rest += d.decompress(f.read(total - len(data))) if len(data) < total else b""
                rest += d.flush()
                n = int(h.get("content-length", 0))
                if len(rest) < n:
                    raise ValueError(f"record {row['record_id']} ends early")
                yield row | {"payload": _payload(h, rest[:n])}
            else:
                yield row | {"payload": None}
        at += total


@dataclass
class _Files(InputPartition):
    paths: list


@dataclass
class _Written(WriterCommitMessage):
    files: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.partition_bytes = int(float(options.get("partition_mb", "16")) * 1e6)
        self.wanted: list[tuple] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in PUSHED and isinstance(f, EqualTo):
                self.wanted.append((name, "in", [f.value]))
            elif name in PUSHED and isinstance(f, In):
                self.wanted.append((name, "in", list(f.value)))
            elif name in PUSHED and isinstance(f, StringStartsWith):
                self.wanted.append((name, "prefix", f.value))
            else:
                yield f

    def _want(self, row: dict) -> bool:
        for name, kind, value in self.wanted:
            x = row[name]
            if x is None or (x not in value if kind == "in" else not x.startswith(value)):
                return False
        return True

    def partitions(self) -> list:
        from pyarrow import fs

        system, path = _fs(self.path)
        infos = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        sizes = {i.path: i.size for i in infos if i.type == fs.FileType.File}
        manifests = [p for p in sizes if p.rsplit("/", 1)[1].startswith(MANIFEST)]
        if manifests:
            names = set()
            for p in manifests:
                with system.open_input_file(p) as f:
                    names.update(json.loads(f.read()))
            sizes = {p: n for p, n in sizes.items() if p.rsplit("/", 1)[1] in names}
        parts, held, total = [], [], 0
        for p in sorted(p for p in sizes if p.endswith((".warc", ".warc.gz"))):
            if held and total + sizes[p] > self.partition_bytes:
                parts.append(_Files(held))
                held, total = [], 0
            held.append(p)
            total += sizes[p]
        return parts + [_Files(held)] if held else parts or [_Files([])]

    def read(self, partition) -> Iterator:
        system, _ = _fs(self.path)
        for p in partition.paths:
            with system.open_input_file(p) as raw:
                size = raw.size()
                if p.endswith(".gz"):
                    found = _member_records(raw, size, self._want, self.payload)
                else:
                    found = _stream_records(io.BufferedReader(raw, 1 << 20), self._want, self.payload)
                for r in found:
                    yield (r["record_id"], r["record_type"], r["target_uri"], r["refers_to"], r["payload_digest"], r["payload_length"], r["payload"])


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.gz = options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(float(options.get("file_mb", "64")) * 1e6)

    def write(self, iterator) -> _Written:
        system, path = _fs(self.path)
        system.create_dir(path, recursive=True)
        token, files, out, size = uuid.uuid4().hex, [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.file_bytes:
                    if out:
                        out.close()
                    files.append(f"part-{token}-{len(files):04d}.warc" + ".gz" * self.gz)
                    out, size = system.open_output_stream(f"{path}/{files[-1]}", compression=None), 0
                data = record(row)
                data = gzip_member(data) if self.gz else data
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        system, path = _fs(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages: list) -> None:
        system, path = _fs(self.path)
        for m in messages:
            for x in m.files if m else []:
                system.delete_file(f"{path}/{x}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_warc(df: DataFrame, path: str, **options) -> None:
    """Add rows of SCHEMA as WARC files below a path."""
    register(df.sparkSession)
    df.select(*[x.split(" ")[0] for x in SCHEMA.split(", ")]).write.format("warc").options(**options).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload: str, least_bytes: int) -> DataFrame:
    """Rows of SCHEMA: of equal payloads of at least least_bytes, the one with the largest id is the response."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body")).withColumn("n", F.octet_length("body").cast("long")).withColumn("digest", F.sha1("body"))
    groups = rows.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "n", "top")
    joined = rows.join(lookup(stored(groups, "revisits")), ["digest", "n"], "left")
    again = F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top"))
    uri = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return joined.select(uri(F.col("id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), uri(F.when(again, F.col("top"))).alias("refers_to"), F.col("digest").alias("payload_digest"), F.col("n").alias("payload_length"), F.when(~again, F.encode("body", "UTF-8")).alias("payload"))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(with_revisits(table(spark, sf_dir, "pages"), "page_id", "url", "html", 1000), path)
    back = read_warc(spark, path)
    response = F.col("record_type") == "response"
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).cast("long")
    return back.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""
