"""Token-id files with a shared zstandard dictionary.

A store is a folder: ``dictionary`` (trained on serialised ids), ``data`` (shards
of zstandard frames, one for each document, in ascending id order), ``index``
(Parquet: each document's shard, offset, length and token count, the ids before
it, and the dictionary's hash) and ``manifest`` (Parquet: the shards).  A frame
holds the ids as little-endian unsigned 32-bit integers; with the index a short
document is read by one range request and the dictionary.

The dictionary only affects the files' size.  It is trained on the first
``SAMPLE_IDS`` ids of about ``SAMPLE_DOCS`` distinct documents, those whose hash is
under a limit; every document is encoded, written and indexed.

A shard is one task.  It writes under a temporary name of its own; a second job
gives the files of the attempts that Spark counts their final names, and the
manifest is written last.

Defined results: a null text is an empty text, of which only the end id is
written; null ids sort first; rows with one id stand next to each other; a
special token's string in a text is taken as the library takes it; an empty table
gives a store without shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rastrum.llm.common import discard, materialize, new_path, per_worker

END = 2
SAMPLE_DOCS, SAMPLE_IDS = 1000, 2048
DICTIONARY_BYTES = 1 << 16
LEVEL = 1
SHARD_BYTES, MOST_SHARDS = 8 << 20, 100_000
#: Shards whose totals are added up as one.
GROUP = 4096
#: Pieces of text whose ids a worker keeps.
MOST_KEPT = 1_000_000
#: Bytes of text that are encoded at once.
BLOCK = 8 << 20

_BLANK = r"\s\v\x{85}\p{Z}\x1c-\x1f"


class Encoder:
    """Ids of whole texts, by the library; a piece that begins at a space is
    encoded once and kept.

    No match of a byte-level pre-tokeniser goes on over a space after something
    visible, so pieces cut there have the ids that they have in the text.  Where
    no white space stands next to other, line breaks are pieces too.  A text with
    an added token's string, or with a zero character, goes to the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_level = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(byte_level.values()) + 1, np.int64)
        for token, i in byte_level.items():
            self.width[i] = len(token)  # a character stands for a byte
        self._forget()

    def _forget(self) -> None:
        """Pieces that are kept, how many ids each has, and the ids one after the other."""
        self.known, self.size, self.ids = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _encoded(self, texts: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(texts), 256):  # so many at once, as their ids are objects first
            for e in self.tokenizer.encode_batch_fast(texts[at : at + 256], add_special_tokens=False):
                yield e.ids

    def _learn(self, new: pa.Array) -> None:
        """Encode pieces in runs of 64 and cut the ids where the pieces' bytes end;
        a piece with white space next to a cut is encoded alone."""
        inner = pc.and_(pc.match_substring_regex(new, f"^ [^{_BLANK}]"), pc.match_substring_regex(new, f"[^{_BLANK}]$"))
        spaced, alone = new.filter(inner), new.filter(pc.invert(inner))
        bounds = np.append(0, np.cumsum(pc.binary_length(spaced).to_numpy())).tolist()
        raw = b"".join(spaced.cast(pa.binary()).to_pylist())
        runs = [raw[a:z].decode() for a, z in zip(bounds[:-1:64], [*bounds[64::64], bounds[-1]])]
        ids = np.fromiter(chain.from_iterable(self._encoded(runs)), "<u4")
        stops = np.searchsorted(np.cumsum(self.width[ids]), bounds[1:]) + 1
        rest = list(self._encoded(alone.to_pylist()))
        self.known = pa.concat_arrays([self.known, spaced, alone])
        self.size = np.concatenate([self.size, np.diff(stops, prepend=0), np.fromiter(map(len, rest), np.int64, len(rest))])
        self.ids = np.concatenate([self.ids, ids, np.fromiter(chain.from_iterable(rest), "<u4")])

    def _by_pieces(self, marked: pa.Array) -> list[bytes]:
        """Ids of texts whose pieces are divided by zero characters."""
        cut = pc.split_pattern(marked, "\0")
        pieces = cut.flatten().dictionary_encode()
        own = pieces.dictionary
        if len(self.known) > MOST_KEPT:
            self._forget()
        found = pc.index_in(own, value_set=self.known)
        self._learn(own.filter(found.is_null()))
        found = pc.index_in(own, value_set=self.known).to_numpy() if found.null_count else found.to_numpy()
        first, at = np.cumsum(self.size) - self.size, found[pieces.indices.to_numpy()]
        n = self.size[at]
        stops = np.append(0, np.cumsum(n))
        raw = self.ids[np.repeat(first[at] - stops[:-1], n) + np.arange(stops[-1])].tobytes()
        ends = (4 * stops[cut.offsets.to_numpy() - cut.offsets[0].as_py()]).tolist()
        return list(map(raw.__getitem__, map(slice, ends, ends[1:])))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        whole = pc.match_substring(texts, "\0")
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        blanks = pc.and_not(pc.match_substring_regex(texts, f"[{_BLANK}][{_BLANK}]"), whole)
        kind = np.where(whole.to_numpy(zero_copy_only=False), 2, blanks.to_numpy(zero_copy_only=False).astype(int))
        out: list = [None] * len(texts)
        for k in range(3):
            at = np.flatnonzero(kind == k)
            some = texts.take(pa.array(at))
            if not len(at):
                continue
            if k == 0:
                found = self._by_pieces(pc.replace_substring(pc.replace_substring(some, "\n", "\0\n\0"), " ", "\0 "))
            elif k == 1:
                found = self._by_pieces(pc.replace_substring_regex(some, f"([^{_BLANK}]) ", "\\1\0 "))
            else:
                found = [np.array(ids, "<u4").tobytes() for ids in self._encoded(some.to_pylist())]
            for i, x in zip(at.tolist(), found, strict=True):
                out[i] = x
        return out


def _encoder(path: str) -> Encoder:
    return per_worker(("tokens", path), lambda: Encoder(path))


def _blocks(texts: pa.Array, most: int = BLOCK) -> Iterator[pa.Array]:
    """Slices of about ``most`` bytes, at least one text each."""
    size = pc.cumulative_sum(pc.binary_length(texts).cast(pa.int64())).to_numpy()
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def train_dictionary(docs: DataFrame, vocabulary: str, n_docs: int = SAMPLE_DOCS, n_ids: int = SAMPLE_IDS) -> bytes:
    """A dictionary from ``docs`` (id, text); empty if there is too little to learn from."""
    h = F.xxhash64("id", "text")
    limit = min(1 << 31, -(-(n_docs << 31) // max(docs.count(), 1)))
    few = docs.where(F.pmod(h, F.lit(1 << 31)) < limit).select(h.alias("h"), F.substring("text", 1, 16 * n_ids).alias("text"))
    picked = few.groupBy("h").agg(F.min("text").alias("text"))  # repeated rows count once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = _encoder(vocabulary).encode(b["text"])
            yield pa.RecordBatch.from_arrays([b["h"], pa.array([i[: 4 * n_ids] for i in ids], pa.binary())], names=["h", "ids"])

    samples = [bytes(r["ids"]) for r in picked.mapInArrow(run, "h long, ids binary").orderBy("h").collect()]  # about n_docs rows of 4 * n_ids bytes
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if s]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _put(path: str, data: bytes) -> None:
    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at, compression=None) as f:
        f.write(data)


def _get(path: str) -> bytes:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at, compression=None) as f:
        return f.read()


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write(docs: DataFrame, out: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write a store; returns its index."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    trained = train_dictionary(docs, vocabulary)
    mark = hashlib.sha256(trained).hexdigest()
    _put(f"{out}/dictionary", trained)
    held = spark.sparkContext.broadcast(trained)  # DICTIONARY_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(held.value))
        last = np.array([end], "<u4").tobytes()
        for b in batches:
            at = 0
            for block in _blocks(b["text"]):
                ids = [i + last for i in _encoder(vocabulary).encode(block)]
                frames = pa.array(list(map(packer.compress, ids)), pa.binary())
                yield pa.RecordBatch.from_arrays([b["id"].slice(at, len(block)), pa.array([len(i) // 4 for i in ids], pa.int64()), frames], names=["id", "n_tokens", "frame"])
                at += len(block)

    packed = materialize(docs.mapInArrow(pack, "id long, n_tokens long, frame binary").withColumn("row", F.monotonically_increasing_id()), "frames")
    total = packed.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    dealt = packed.repartitionByRange(max(1, -(-total // max(shard_bytes, -(-total // MOST_SHARDS)))), "id", "row").sortWithinPartitions("id", "row").withColumn("shard", F.spark_partition_id())

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        fs.create_dir(f"{root}/tmp", recursive=True)
        sink, at, before, name = None, 0, 0, f"{uuid.uuid4().hex}.zst"
        for b in batches:
            rows = []
            for i, n, frame, shard in zip(b["id"].to_pylist(), b["n_tokens"].to_pylist(), b["frame"], b["shard"].to_pylist(), strict=True):
                sink = sink or fs.open_output_stream(f"{root}/tmp/{name}", compression=None)
                sink.write(data := frame.as_py())
                rows.append({"id": i, "shard": shard, "offset": at, "length": len(data), "n_tokens": n, "before": before, "temporary": name})
                at += len(data)
                before += n
            yield pa.RecordBatch.from_pylist(rows, _STORED)
        if sink:
            sink.close()

    stored = materialize(dealt.mapInArrow(store, "id long, shard int, offset long, length long, n_tokens long, before long, temporary string"), "stored")
    made = stored.groupBy("shard", "temporary").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("length").alias("bytes"), F.count("*").alias("documents"))
    made = made.withColumn("group", F.floor(F.col("shard") / GROUP))
    # running totals: of the groups in one task, a row for every GROUP shards, then inside each group
    sums = made.groupBy("group").agg(F.sum("n_tokens").alias("n"))
    sums = sums.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("ahead"))
    inside = F.sum("n_tokens").over(Window.partitionBy("group").orderBy("shard")) - F.col("n_tokens")
    manifest = materialize(
        made.join(sums, "group").select("shard", "temporary", F.format_string("shard-%06d.zst", "shard").alias("file"), "documents", "n_tokens", "bytes", (F.col("ahead") + inside).alias("first"), F.lit(mark).alias("dictionary")),
        "shards",
    )

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

    index = stored.join(manifest.select("shard", "file", "first", "dictionary"), "shard")
    index.select("id", "file", "offset", "length", "n_tokens", (F.col("first") + F.col("before")).alias("start"), "dictionary").write.parquet(f"{out}/index")
    manifest.mapInArrow(commit, manifest.schema).drop("temporary").write.parquet(f"{out}/manifest")
    discard(packed, stored, manifest)
    return spark.read.parquet(f"{out}/index")


_STORED = pa.schema([("id", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("temporary", pa.string())])


def read(spark: SparkSession, out: str, ids: DataFrame | None = None, digest: bool = False) -> DataFrame:
    """(id, start, n_tokens, token_ids or ids_crc32) of all documents, or of those
    in ``ids``; each frame is read at its place in its shard."""
    index = spark.read.parquet(f"{out}/index")
    if ids is not None:
        index = index.join(ids.select("id").distinct(), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        trained = _get(f"{out}/dictionary")
        mark = hashlib.sha256(trained).hexdigest()
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(trained))
        source, held = None, None
        for b in batches:
            found = []
            for r in b.to_pylist():
                if r["dictionary"] != mark:
                    raise ValueError(f"{r['file']} needs the dictionary {r['dictionary']}")
                if held != r["file"]:
                    source, held = fs.open_input_file(f"{root}/data/{r['file']}"), r["file"]
                source.seek(r["offset"])
                raw = unpacker.decompress(source.read(r["length"]))
                if len(raw) != 4 * r["n_tokens"]:
                    raise ValueError(f"{r['file']}: document {r['id']} isn't complete")
                found.append(zlib.crc32(raw) if digest else np.frombuffer(raw, "<u4").tolist())
            last = pa.array(found, pa.int64() if digest else pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b["id"], b["start"], b["n_tokens"], last], names=["id", "start", "n_tokens", "x"])

    name = "ids_crc32" if digest else "token_ids"
    found = index.mapInArrow(run, f"id long, start long, n_tokens long, x {'long' if digest else 'array<long>'}")
    return found.withColumnRenamed("x", name)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a table to a new store in the shared folder and read it back."""
    out = new_path(docs.sparkSession, "tokens")
    write(docs, out, vocabulary, id_col, text_col)
    return read(docs.sparkSession, out, digest=True).withColumnRenamed("id", id_col)
