"""Deterministic sharded WARC writer and reader.

Pages are sorted by id and cut into shards of ``shard_bytes``: a page belongs to the shard that the bytes of all pages
before it, divided by that size, name. The sums come from range-sorted ids and sizes, with one sum for each partition; an
id (or the null id) that outweighs a shard is split further by the digest of its payload. So shards depend on the pages
alone, not on settings or on how Spark deals or samples them, and their number grows with the pages, not their size. A
shard's records are separate gzip members; a new file starts as soon as the compressed size passes a limit.
Record ids, dates and digests are functions of the page, so a second run gives equal files and an equal
manifest. A file is written under a temporary name that is unique to the attempt and then renamed to its final
name; two attempts of a task make equal bytes. The rows that the tasks return are the manifest, written as a
table once all tasks have ended. Readers open the files that the manifest lists, and only those, and check
number of records, size and sha256 of each against it.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest page id is a
response and the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlake.llm.common import heavy_keys, materialize, scratch_path, skewed_join

MANIFEST = "file string, records long, bytes long, sha256 string"
#: Bytes of pages, not compressed, that one task writes.
SHARD_BYTES = 64 << 20
READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, not compressed. Headers that hold line breaks would break the format, so those become blanks."""
    name = "" if page_id is None else str(page_id)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.splitlines())))
    head += [("X-Page-Id", name), ("X-Payload-Length", str(len(payload))), ("WARC-Payload-Digest", f"sha1:{_base32(hashlib.sha1(payload).digest())}")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block = http + payload
    else:
        block = http
        head += [("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _write(root: str, roll_bytes: int, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        attempt = uuid.uuid4().hex
        made, out, shard, files, size, count, digest, temporary = [], None, None, 0, 0, 0, None, ""
        refers: tuple = (None, None, None)  # the last referral read; it stands right before its pages

        def close() -> None:
            nonlocal out, files
            final = f"shard-{shard:06d}-{files:04d}.warc.gz"
            out.close()
            store.move(temporary, f"{base}/{final}")
            made.append((final, count, size, digest.hexdigest()))
            out, files = None, files + 1

        for batch in batches:
            for where, page_id, sha1, page, url, html, refers_to in zip(*(batch.column(i) for i in range(7))):
                where, key = where.as_py(), (page_id.as_py(), sha1.as_py())
                if not page.as_py():
                    refers = (*key, refers_to.as_py())
                    continue
                if where != shard:
                    if out is not None:
                        close()
                    shard, files = where, 0
                if out is None:
                    temporary, size, count, digest = f"{base}/.tmp-{attempt}-{len(made)}", 0, 0, hashlib.sha256()
                    out = store.open_output_stream(temporary, compression=None)
                raw = record(key[0], url.as_py(), (html.as_py() or "").encode(), refers[2] if refers[:2] == key else None, date)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                digest.update(member)
                size, count = size + len(member), count + 1
                if size >= roll_bytes:
                    close()
        if out is not None:
            close()
        columns = list(zip(*made)) if made else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "records", "bytes", "sha256"])

    return run


def referrals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``(page_id, sha1, refers_to)`` for the payloads of ``pages(page_id, sha1, n)`` that another page with a smaller id has.

    Pages of a very common payload stay where they are and meet a broadcast of those few payloads.
    """
    known = pages.where("page_id is not null").where(F.col("n") >= min_bytes).select("page_id", "sha1")
    first = known.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("size")).where("size > 1")
    first = materialize(first, "payloads")
    both = skewed_join(known, first.drop("size"), "sha1", heavy_keys(first, "sha1", "size"))
    return both.where("page_id > refers_to").select("page_id", "sha1", "refers_to").distinct()


def shard_ranges(sizes: DataFrame, shard_bytes: int) -> tuple[list[int], list[int], list[int]]:
    """(first id, first shard, number of shards) of ranges of ids, so that shards of ``sizes(page_id, sha1, n)`` hold about ``shard_bytes``.

    A range has several shards only if it is one id. The driver keeps one sum a partition and one id a shard.
    """
    order = ["page_id", "sha1", "n"]
    rows = sizes.where("page_id is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.select("page_id", "n", F.monotonically_increasing_id().alias("id")).withColumn("part", F.shiftright("id", 33)), "sizes")
    before, shift = 0, []
    for r in rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        shift.append((r["part"], before))
        before += r["n"]
    parts = rows.sparkSession.createDataFrame(shift, "part long, shift long")
    upto = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = rows.join(F.broadcast(parts), "part").select("page_id", F.floor((F.col("shift") + upto) / shard_bytes).cast("long").alias("shard"))
    firsts = [r["id"] for r in cut.groupBy("shard").agg(F.min("page_id").alias("id")).orderBy("shard").collect()]
    starts, first, count = [], [], []
    for shard, page_id in enumerate(firsts):
        if starts and starts[-1] == page_id:
            count[-1] += 1
            continue
        if count and count[-1] > 1 and page_id > starts[-1] + 1:  # what follows an id of several shards goes on in its last one
            starts.append(starts[-1] + 1)
            first.append(shard - 1)
            count.append(1)
        starts.append(page_id)
        first.append(shard)
        count.append(1)
    if count and count[-1] > 1:
        starts.append(starts[-1] + 1)
        first.append(len(firsts) - 1)
        count.append(1)
    return (starts, first, count) if starts else ([0], [0], [1])


def _sharded(ranges: tuple[list[int], list[int], list[int]], null_shards: int) -> Column:
    """The shard of a page, by its id and, where one id has several, its payload's digest; null ids come last."""
    starts, first, count = (np.array(x, np.int64) for x in ranges)
    last, spread = int((first + count).max()), F.xxhash64("sha1")

    @F.pandas_udf("long")
    def known(page_id: pd.Series, spread: pd.Series) -> pd.Series:
        at = np.maximum(np.searchsorted(starts, page_id.to_numpy(), "right") - 1, 0)
        return pd.Series(first[at] + spread.to_numpy() % count[at])

    known = known(F.coalesce("page_id", F.lit(0).cast("long")), spread)
    return F.when(F.col("page_id").isNull(), last + F.pmod(spread, F.lit(null_shards).cast("long"))).otherwise(known).cast("long")


def write_warc(pages: DataFrame, root: str, min_bytes: int = 0, roll_bytes: int = 32 << 20, shard_bytes: int = SHARD_BYTES, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write ``pages(page_id, url, html, ...)`` below ``root`` and return the manifest, also written to ``root/manifest``.

    Null html is empty; a null page id is written as a response of its own; rows that share a page id are
    written each, and judged each by its own payload. Very long pages are written whole; no rows give an empty
    manifest. Other columns are ignored.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary"))))
    weight = pages.select("page_id", "sha1", (F.octet_length("html") + 500).cast("long").alias("n"))
    ranges = shard_ranges(weight, shard_bytes)
    nulls = weight.where("page_id is null").agg(F.sum("n")).first()[0] or 0
    null_shards = max(1, -(-nulls // shard_bytes))
    shard = _sharded(ranges, null_shards)
    # referrals travel with the pages through the one sort, each right before its page, so pages are shuffled once
    rows = pages.select("page_id", "sha1", F.lit(True).alias("page"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    known = referrals(pages.select("page_id", "sha1", F.octet_length("html").alias("n")), min_bytes)
    full = rows.unionByName(known.withColumn("page", F.lit(False)), allowMissingColumns=True).select(shard.alias("shard"), "*")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{root}/data")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    # one shard a task
    ordered = full.repartitionById(max(f + c for _, f, c in zip(*ranges)) + null_shards, F.col("shard").cast("int")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "sha1", "page", "url", "html")
    ordered.mapInArrow(_write(f"{root}/data", roll_bytes, date, level), MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def parse_member(raw: bytes) -> tuple:
    """The fields of one record; payload digest and length of a response are taken from its payload and checked."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    block = rest[: int(head["Content-Length"])]
    if f"sha1:{_base32(hashlib.sha1(block).digest())}" != head["WARC-Block-Digest"]:
        raise ValueError(f"block digest differs in {head['WARC-Record-ID']}")
    page = int(head["X-Page-Id"]) if head["X-Page-Id"] else None
    digest, size, payload = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), None
    if head["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if _base32(hashlib.sha1(payload).digest()) != digest or len(payload) != size:
            raise ValueError(f"payload differs in {head['WARC-Record-ID']}")
    refers_to = head.get("X-Refers-To-Page-Id")
    return page, head.get("WARC-Target-URI"), payload, size, digest, head["WARC-Type"], int(refers_to) if refers_to else None


def members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a file, unpacked; the file comes in small pieces, as the unpacker copies whatever follows a member."""
    left = b""
    pieces = iter(pieces)
    while left := left or next(pieces, b""):
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if not left:
                raise ValueError("a member is cut off")
            parts.append(one.decompress(left))
            left = one.unused_data or (b"" if one.eof else next(pieces, b""))
        yield b"".join(parts)


def _read(root: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        for batch in batches:
            for listed in batch.to_pylist():
                digest, size, count = hashlib.sha256(), 0, 0

                def pieces(name: str) -> Iterator[bytes]:
                    nonlocal size
                    with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                        while piece := f.read(1 << 14):
                            digest.update(piece)
                            size += len(piece)
                            yield piece

                rows, held = [], 0
                for raw in members(pieces(listed["file"])):
                    row = parse_member(raw)
                    held, count = held + row[3], count + 1
                    rows.append(row if with_payload else (*row[:2], None, *row[3:]))
                    if len(rows) >= 2000 or with_payload and held > 16 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)
                if (count, size, digest.hexdigest()) != (listed["records"], listed["bytes"], listed["sha256"]):
                    raise ValueError(f"{listed['file']} is not what the manifest says")

    return run


def read_warc(spark: SparkSession, root: str, with_payload: bool = False) -> DataFrame:
    """The records of all files that the manifest below ``root`` lists; a missing or changed file is an error."""
    listed = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "file").mapInArrow(_read(f"{root}/data", with_payload), READ)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages to the shared folder, read the archives back and return what they hold for each page.

    Nulls, repeated rows and ids, very long pages and empty tables are as ``write_warc`` says.
    """
    root = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, root, min_bytes)
    return read_warc(pages.sparkSession, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
