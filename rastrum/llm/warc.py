"""A deterministic sharded WARC writer and its reader.

Records are put in shards by position: a running total of payload bytes over
(page id, digest) order cuts the table into shards of ``shard_bytes``, whatever
the partitions were.  Each shard is one task, which sorts its records and rolls
files by compressed size.  A task writes under a temporary name of its own; the
manifest holds the files of the attempts that Spark counts, a second job gives
those their final names, and the manifest is written last.  Files that a lost
attempt left are in no manifest and are never read.

Defined results: a null html is an empty payload; a null url leaves out the
target header; a null page id sorts first, is never the response that others
name unless no row of its payload has an id, and reads back as null; of equal
rows the first is the response and the rest revisit it; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastrum.llm.common import materialize, new_path

SHARD_BYTES = 12 << 20
#: The shards grow with the table once there would be more than this many.
MOST_SHARDS = 20_000
ROLL_BYTES = 4 << 20
#: Compressed bytes that a reading task takes.
READ_BYTES = 16 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
_NO_ID = -(1 << 63)
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


def member(data: bytes, level: int = LEVEL) -> bytes:
    """One gzip member without a time stamp."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}>"


def base32(digest_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest_hex: str, refers_to: int | None, revisit: bool) -> bytes:
    digest = base32(digest_hex)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest_hex)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest_hex)}"]
        if refers_to is not None:
            head.append(f"Refers-To-Page-ID: {refers_to}")
    head += [
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a file of gzip members."""
    while data:
        unpacker = zlib.decompressobj(31)
        raw = unpacker.decompress(data)
        data = unpacker.unused_data
        at = 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            lines = raw[at:end].decode().split("\r\n")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            start = end + 4
            at = start + int(headers["Content-Length"]) + 4
            yield headers, raw[start : at - 4]


def _facts(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id"),
        F.coalesce("page_id", F.lit(_NO_ID)).alias("__id"),
        F.sha1(F.encode("html", "UTF-8")).alias("digest"),
        F.octet_length("html").cast("long").alias("bytes"),
    )


def _shards(facts: DataFrame, shard_bytes: int) -> list[tuple[int, str]]:
    """The first (__id, digest) of every shard: cuts of the running total of bytes."""
    total = facts.agg(F.sum("bytes")).first()[0] or 0
    each = max(shard_bytes, -(-total // MOST_SHARDS), 1)
    keys = facts.groupBy("__id", "digest").agg(F.sum("bytes").alias("bytes")).sort("__id", "digest").withColumn("__p", F.spark_partition_id())
    keys = materialize(keys, "warc-keys")
    before, offset = 0, []
    for r in keys.groupBy("__p").agg(F.sum("bytes").alias("n")).orderBy("__p").collect():  # one row per partition
        offset.append((r["__p"], before))
        before += r["n"]
    if not offset:
        return []
    offsets = facts.sparkSession.createDataFrame(offset, "__p int, before long")
    running = F.sum("bytes").over(Window.partitionBy("__p").orderBy("__id", "digest")) - F.col("bytes")
    placed = keys.join(F.broadcast(offsets), "__p").select("__id", "digest", F.floor((F.col("before") + running) / F.lit(each)).alias("shard"))
    firsts = placed.groupBy("shard").agg(F.min(F.struct("__id", "digest")).alias("x")).collect()  # MOST_SHARDS rows
    return sorted((r["x"]["__id"], r["x"]["digest"]) for r in firsts)


def write(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write archives under ``out``/data; returns the manifest (shard, file, records, bytes, sha256)."""
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    facts = materialize(_facts(pages), "warc-facts")
    firsts = facts.where(F.col("bytes") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    refs = facts.join(firsts, "digest").where("not (page_id <=> first)").select("__id", "digest", "first").distinct()
    cuts = _shards(facts, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(cuts, k) - 1 for k in zip(ids.tolist(), digests.tolist(), strict=True)], dtype="int32")

    def rows(df: DataFrame, kind: int, first) -> DataFrame:
        some = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
        return df.select("__id", "digest", F.lit(kind).alias("kind"), first.alias("first"), some("url").alias("url"), some("html").alias("html"))

    full = pages.withColumns({"__id": F.coalesce("page_id", F.lit(_NO_ID)), "digest": F.sha1(F.encode("html", "UTF-8"))})
    both = rows(refs, 0, F.col("first")).unionByName(rows(full, 1, F.lit(None).cast("long"))).withColumn("shard", shard_of("__id", "digest"))
    dealt = both.repartitionById(max(1, len(cuts)), F.col("shard")).sortWithinPartitions("__id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = uuid.uuid4().hex
        fs, root = pafs.FileSystem.from_uri(out)
        fs.create_dir(f"{root}/tmp", recursive=True)
        made: list[dict] = []
        sink, shard, refs_to, seen = None, -1, None, (None, None)

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.close()
                made[-1]["sha256"] = hasher.hexdigest()
                sink = None

        for b in batches:
            for r in b.to_pylist():
                key = (r["__id"], r["digest"])
                if r["kind"] == 0:
                    refs_to = (key, r["first"])
                    continue
                page = None if r["__id"] == _NO_ID else r["__id"]
                payload = r["html"].encode()
                pointed = refs_to is not None and refs_to[0] == key
                again = key == seen and len(payload) >= least_revisit
                data = member(record(page, r["url"], payload, r["digest"], refs_to[1] if pointed else page, pointed or again))
                seen = key
                if sink is None or r["shard"] != shard or made[-1]["bytes"] + len(data) > roll_bytes:
                    close()
                    n = made[-1]["n"] + 1 if made and r["shard"] == shard else 0
                    shard = r["shard"]
                    name = f"shard-{shard:06d}-{n:05d}.warc.gz"
                    made.append({"shard": shard, "n": n, "file": name, "temporary": f"{attempt}-{name}", "records": 0, "bytes": 0})
                    sink, hasher = fs.open_output_stream(f"{root}/tmp/{attempt}-{name}", compression=None), hashlib.sha256()
                sink.write(data)
                hasher.update(data)
                made[-1]["records"] += 1
                made[-1]["bytes"] += len(data)
        close()
        yield pa.RecordBatch.from_pylist(made, _MADE)

    made = materialize(dealt.mapInArrow(run, "shard int, n int, file string, temporary string, records long, bytes long, sha256 string"), "warc-made")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        fs.create_dir(f"{root}/data", recursive=True)
        for b in batches:
            for r in b.to_pylist():
                source, target = f"{root}/tmp/{r['temporary']}", f"{root}/data/{r['file']}"
                if fs.get_file_info(source).type != pafs.FileType.NotFound:
                    fs.move(source, target)  # a second try of this task finds it moved
                if fs.get_file_info(target).size != r["bytes"]:
                    raise OSError(f"{target} isn't complete")
            yield b

    made.mapInArrow(commit, made.schema).drop("n", "temporary").write.parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/manifest")


_MADE = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("file", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def read(spark, out: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of
    the manifest's files; a revisit's payload is null.  Tasks open the files that the
    manifest names, so no list of them passes through the driver.  Digests are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        for b in batches:
            for made in b.to_pylist():
                with fs.open_input_stream(f"{root}/data/{made['file']}", compression=None) as source:
                    content = source.read()
                if hashlib.sha256(content).hexdigest() != made["sha256"]:
                    raise ValueError(f"{made['file']}: not the file of the manifest")
                rows = []
                for head, block in parse(content):
                    if head["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
                        raise ValueError(f"{head['WARC-Record-ID']}: block digest differs")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = head["WARC-Type"] == "revisit"
                    if not revisit and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                        raise ValueError(f"{head['WARC-Record-ID']}: payload digest differs")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    number = lambda name: int(head[name]) if name in head else None
                    rows.append({"page_id": number("Page-ID"), "url": head.get("WARC-Target-URI"), "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number("Refers-To-Page-ID")})
                yield pa.RecordBatch.from_pylist(rows, _READ)

    manifest = spark.read.parquet(f"{out}/manifest").select("file", "bytes", "sha256")
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    parts = min(max(spark.sparkContext.defaultParallelism, -(-total // READ_BYTES)), MOST_SHARDS)
    return manifest.repartition(parts).mapInArrow(run, _READ_SQL)


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_READ_SQL = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a table to a new folder of the shared one and read it back."""
    out = new_path(pages.sparkSession, "warc")
    write(pages, out)
    return read(pages.sparkSession, out)
