"""Operator 10: WARC archives with a two-level capture index.

Pages are written as WARC/1.1 records, each its own gzip member, into archive files in the
shared folder.  Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the
smallest id is a response, the others are revisits of it; smaller payloads are all responses.

The index sorts captures by reversed-host URL key and id, in shards by ranges.  A shard file is
a row of compressed blocks of sorted lines; its sparse directory has the first key of each block
with its place.  A lookup finds the shard and the block by binary search, reads that range of
the shard file, searches the block, and reads the record's range of its archive.

Files are reached through the file system that the folder's URI names (pyarrow), never a local
folder of an executor.  A task writes under names of its own, and only files that finished
tasks report are ever read, so lost or repeated tasks leave no trace in results.

Defined results: NULL html is an empty payload; a NULL url is the empty url; rows with a NULL id
are responses that nothing refers to; repeated rows are records of their own; pages of any
length are one record; other columns play no part."""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import bound_batches, scratch, table, to_bytes
from evalspark.session import open_folder, qualified, scratch_path

MIN_BYTES = 100
#: An archive file is closed beyond this size.
ARCHIVE_BYTES = 256 << 20
#: Captures in one compressed block of the index.
BLOCK_LINES = 1000
#: A fixed date keeps repeated tasks' records equal.
DATE = "1970-01-01T00:00:00Z"

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Archive(NamedTuple):
    """Written archives: the captures, and the directory of the index (one row per block)."""

    captures: DataFrame
    directory: DataFrame


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://www.a.org:80/B?c`` is ``org,a,www)/B?c``.  Scheme, user, port
    and fragment are left out; the host is lower-cased."""
    rest = (url or "").split("#", 1)[0]
    rest = rest.split("://", 1)[-1]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    host = host.rsplit("@", 1)[-1].split(":", 1)[0].lower().strip(".")
    return ",".join(reversed(host.split("."))) + ")" + (path if path.startswith("/") else "/" + path)


def capture_key(url: str | None, page: int | None) -> str:
    """What captures are sorted by; control characters of a url cannot collide with the divider."""
    key = "".join(c if c > " " else f"%{ord(c):02X}" for c in url_key(url))
    return f"{key} {'' if page is None else f'{page + (1 << 63):020d}'}"


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def make_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One compressed record."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page)),
              ("WARC-Date", DATE), ("WARC-Target-URI", " ".join((url or "").split())),
              ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
              ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> dict:
    """Fields and payload of a compressed record; its lengths and digest are checked."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload doesn't match its digest")
    page, first = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
    return {"page_id": page and int(page), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
            "refers_to": first and int(first), "payload_bytes": size, "payload_digest": digest,
            "payload": payload if fields["WARC-Type"] == "response" else None}


_CAPTURES = "key string, file string, at long, length long"
_DIRECTORY = "shard int, block int, first string, last string, file string, at long, length long, n int"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES,
                   id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages; returns their captures (key, file, offset, length)."""
    folder = qualified(pages.sparkSession, folder)
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    slim = rows.where((F.octet_length("html") >= min_bytes) & F.col("page").isNotNull()).select(
        "page", F.sha2("html", 256).alias("digest"))
    first = slim.groupBy("digest").agg(F.min("page").alias("refers_to"), F.max("page").alias("last"))
    again = slim.join(first.where("refers_to < last"), "digest").where("page > refers_to")
    again = again.select("page", F.col("digest").alias("of"), "refers_to").distinct()
    # an id may repeat with other html, so each row is joined by its own payload's digest
    joined = rows.withColumn("of", F.sha2("html", 256)).join(again, ["page", "of"], "left").withColumn(
        "refers_to", F.when(F.octet_length("html") >= min_bytes, F.col("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                made = []
                for page, url, html, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                  to_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    member = make_record(page, url, html, first)
                    out.write(member)
                    made.append((capture_key(url, page), name, at, len(member)))
                    at += len(member)
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(list(zip(*made, strict=True)) or [[]] * 4, kinds, strict=True)],
                    names=["key", "file", "at", "length"])
        finally:
            if out is not None:
                out.close()

    return scratch(joined.select("page", "url", "html", "refers_to").mapInArrow(run, _CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str, shards: int, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorted, compressed blocks of captures, in ``shards`` ranges of keys; returns the directory."""
    folder = qualified(captures.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        shard, at, rows = TaskContext.get().partitionId(), 0, []
        name, out, held = f"captures-{shard:06d}-{uuid.uuid4().hex}.gz", None, []

        def flush():
            nonlocal at, out, held
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            block = gzip.compress("".join(f"{json.dumps(h)}\n" for h in held).encode(), 6, mtime=0)
            out.write(block)
            rows.append((shard, len(rows), held[0][0], held[-1][0], name, at, len(block), len(held)))
            at, held = at + len(block), []

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(line)
                if len(held) == block_lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
        kinds = [pa.int32(), pa.int32(), *[pa.string()] * 3, pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 8, kinds, strict=True)],
            names=["shard", "block", "first", "last", "file", "at", "length", "n"])

    ordered = captures.repartitionByRange(shards, "key", "file", "at").sortWithinPartitions("key", "file", "at")
    return scratch(ordered.mapInArrow(run, _DIRECTORY), "directory")


def lookup(archive: Archive, wanted: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Records whose capture key starts with a wanted key: ``wanted`` has the column key, either
    ``url_key(url) + " "`` for all captures of a url or a whole ``capture_key``.

    Keys go to the shards that may hold them (a shard's bounds; there are as many as shards);
    there the directory and blocks are searched."""
    folder = qualified(wanted.sparkSession, folder)
    ends = archive.directory.groupBy("shard").agg(F.min("first").alias("low"), F.max("last").alias("high"))
    ends = sorted((r["shard"], r["low"], r["high"]) for r in ends.collect())  # one row per shard
    lows, highs = [e[1] for e in ends], [e[2] for e in ends]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                low = bisect.bisect_left(highs, key)
                high = bisect.bisect_right(lows, key + "\U0010ffff")
                rows += [(ends[i][0], key) for i in range(low, high)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                              pa.array([r[1] for r in rows], pa.string())], names=["shard", "key"])

    sent = wanted.select("key").where("key IS NOT NULL").distinct().mapInArrow(route, "shard int, key string")
    # the shard's directory travels to the shard's task, before its keys
    blocks = archive.directory.select("shard", F.lit(0).alias("role"), F.col("first").alias("key"), "file", "at", "length")
    none = [F.lit(None).cast(k).alias(n) for n, k in (("file", "string"), ("at", "long"), ("length", "long"))]
    both = blocks.unionByName(sent.select("shard", F.lit(1).alias("role"), "key", *none))
    both = both.repartition(max(1, len(ends)), "shard").sortWithinPartitions("shard", "role", "key", "at")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        state = {"shard": None, "firsts": [], "places": []}
        blocks: dict[int, list] = {}  # the last block read, as keys come sorted

        def block(i: int) -> list:
            if i not in blocks:
                blocks.clear()
                file, at, length = state["places"][i]
                with store.open_input_file(f"{base}/{file}") as f:
                    lines = gzip.decompress(f.read_at(length, at)).decode().splitlines()
                blocks[i] = [json.loads(x) for x in lines]
            return blocks[i]

        def captures(key: str) -> Iterator[list]:
            i = max(0, bisect.bisect_left(state["firsts"], key) - 1)
            while i < len(state["firsts"]) and (state["firsts"][i] <= key or state["firsts"][i].startswith(key)):
                lines = block(i)
                for line in lines[bisect.bisect_left(lines, key, key=lambda x: x[0]):]:
                    if not line[0].startswith(key):
                        return
                    yield line
                i += 1

        def records(found: list[list]) -> Iterator[pa.RecordBatch]:
            by_file: dict[str, list] = {}
            for _, file, at, length in found:
                by_file.setdefault(file, []).append((at, length))
            rows = []
            for file, places in by_file.items():
                with store.open_input_file(f"{base}/{file}") as f:
                    for at, length in sorted(places):
                        r = parse_record(f.read_at(length, at))
                        rows.append(tuple(r[n] for n in names[:-1]) + (r["payload"] if payload else None,))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], names=names)

        found: list[list] = []
        for batch in batches:
            for shard, role, key, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != state["shard"]:
                    state = {"shard": shard, "firsts": [], "places": []}
                    blocks.clear()
                if role == 0:
                    state["firsts"].append(key)
                    state["places"].append(place)
                    continue
                for line in captures(key):
                    found.append(line)
                    if len(found) >= 1000:
                        yield from records(found)
                        found = []
        yield from records(found)

    ddl = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
           "payload_digest string, payload binary")
    return both.mapInArrow(run, ddl)


def wanted_keys(pages: DataFrame, id_col: str | None = "page_id", url_col: str = "url") -> DataFrame:
    """Lookup keys of urls (``id_col`` None: all their captures) or of single pages."""
    rows = pages.select(F.col(url_col).alias("url"), (F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [capture_key(u, p) for u, p in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["key"])

    return rows.mapInArrow(run, "key string")


def archive_pages(pages: DataFrame, folder: str, shards: int | None = None) -> Archive:
    """Archives and index of ``pages`` in ``folder`` (a URI that all executors share)."""
    bound_batches(pages.sparkSession)
    captures = write_archives(pages, folder)
    shards = shards or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Archive(captures, write_index(captures, folder, shards))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = scratch_path(spark, "warc")
    archive = archive_pages(pages, folder)
    return lookup(archive, wanted_keys(pages), folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op10_warc": op10_warc}
ORACLE = {"op10_warc": f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
         d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
         f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {MIN_BYTES} GROUP BY 1)
    SELECT d.page_id, d.payload_bytes, d.payload_digest,
           CASE WHEN f.first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN f.first < d.page_id THEN f.first END AS refers_to
    FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= {MIN_BYTES}"""}
