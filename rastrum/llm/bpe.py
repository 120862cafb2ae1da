"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of more than ``CHUNK`` characters is cut into chunks that overlap, which
are dealt out and pre-tokenised on their own.  A chunk's first boundaries may be
wrong, as it starts anywhere; from a boundary that it has in common with the
chunk before, it goes on as a scan of the whole text would.  Chunks are stitched
at the first such boundary between a visible ASCII character and a space, where
every scan has one.  The pieces between stitches are encoded apart and their ids
joined.  A text with a pair of chunks that never meet in their overlap (one word
of many thousand letters) is encoded in one piece.  Decoding concatenates the
ids' raw bytes.

Defined results: a null text is an empty text and has no ids; a null id is an
ordinary id; repeated rows stay and get equal ids; an empty table gives no rows;
other columns are left alone; one called like a new column gets ``_in`` appended.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastrum.llm.common import materialize, per_worker, unveiled, veiled, with_row_key

CHUNK = 1 << 15
OVERLAP = 1 << 10
#: No match looks further than so many characters past its end.
LOOK = 3
#: Rows are encoded and decoded by so many bytes of text or ids at a time.
PART_BYTES = 1 << 21


def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    def make() -> tiktoken.Encoding:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return per_worker((path, pattern), make)


def _ids(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    return encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))


def _parts(b: pa.RecordBatch, size: pa.Array) -> Iterator[pa.RecordBatch]:
    """Slices of about ``PART_BYTES``, at least one row each."""
    ends = pc.cumulative_sum(pc.fill_null(size.cast(pa.int64()), 0)).to_numpy()
    at = 0
    while at < len(b):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, side="right")))
        yield b.slice(at, stop - at)
        at = stop


def boundaries(chunk: str, pattern: regex.Pattern, last: bool, overlap: int, step: int) -> tuple[list[int], list[int]]:
    """Stitches a chunk offers in its first and in its last overlap, as offsets from its start."""
    sure = len(chunk) if last else len(chunk) - LOOK
    ends = [e for m in pattern.finditer(chunk) if (e := m.end()) < len(chunk) and e <= sure and chunk[e] == " " and "!" <= chunk[e - 1] <= "~"]
    return [e for e in ends if e < overlap], [e - step for e in ends if e >= step]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The documents' rows with ``token_ids``."""
    docs, names = veiled(docs)
    keyed = with_row_key(docs.withColumn("__text", F.coalesce(F.col(names[text_col]).cast("string"), F.lit(""))), names[id_col], "__text")
    with_ids = T.StructType([*keyed.drop("__text").schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary, pattern)
        for b in batches:
            for part in _parts(b, pc.binary_length(b["__text"])):
                yield part.drop_columns(["__text"]).append_column("token_ids", _lists([_ids(encoding, t.as_py()) for t in part["__text"]]))

    short = keyed.where(F.char_length("__text") <= chunk + overlap).mapInArrow(whole, with_ids)
    long = keyed.where(F.char_length("__text") > chunk + overlap)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, tag, t in zip(b["__id"], b["__tag"], b["__text"], strict=True):
                t = t.as_py()
                n = -(-(len(t) - overlap) // chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * n), pa.array([tag.as_py()] * n), pa.array(range(n), pa.int32()), pa.array([k + 1 == n for k in range(n)]), pa.array([t[k * chunk : (k + 1) * chunk + overlap] for k in range(n)])],
                    names=["__id", "__tag", "k", "last", "piece"],
                )

    # read by three branches: written once
    chunks = materialize(long.select("__id", "__tag", "__text").mapInArrow(cut, "__id long, __tag long, k int, last boolean, piece string").dropDuplicates(["__id", "__tag", "k"]), "chunks")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for b in batches:
            found = [boundaries(p.as_py(), compiled, last.as_py(), overlap, chunk) for p, last in zip(b["piece"], b["last"], strict=True)]
            heads, tails = (pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("__id", "__tag", "k", "last")), heads, tails], names=["__id", "__tag", "k", "last", "head", "tail"])

    scanned = chunks.mapInArrow(scan, "__id long, __tag long, k int, last boolean, head array<int>, tail array<int>")
    before = scanned.select("__id", "__tag", (F.col("k") + 1).alias("k"), "tail")
    after = scanned.where("k > 0").select("__id", "__tag", "k", "head")
    meet = after.join(before, ["__id", "__tag", "k"]).select("__id", "__tag", "k", F.array_min(F.array_intersect("head", "tail")).alias("at"))
    # of each document, where its chunks begin; null if some pair never meets
    begins = meet.groupBy("__id", "__tag").agg(F.when(F.count("*") == F.count("at"), F.map_from_entries(F.collect_list(F.struct("k", "at")))).alias("begins"))
    pieces = (
        chunks.join(begins.where("begins is not null"), ["__id", "__tag"])
        .select("__id", "__tag", "k", F.coalesce(F.try_element_at("begins", F.col("k")), F.lit(0)).alias("a"), (F.try_element_at("begins", F.col("k") + 1) + chunk).alias("z"), "piece")
        .select("__id", "__tag", "k", F.expr("substring(piece, a + 1, coalesce(z - a, length(piece)))").alias("__text"))
    )

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary, pattern)
        for whole_batch in batches:
            for b in _parts(whole_batch, pc.binary_length(whole_batch["__text"])):
                yield pa.RecordBatch.from_arrays([b["__id"], b["__tag"], b["k"], _lists([_ids(encoding, t.as_py()) for t in b["__text"]])], names=["__id", "__tag", "k", "ids"])

    parts = pieces.mapInArrow(part, "__id long, __tag long, k int, ids array<int>")
    joined = parts.groupBy("__id", "__tag").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda p: p["ids"])).alias("token_ids"))
    stitched = long.join(joined, ["__id", "__tag"]).select(*short.columns)
    unmet = long.join(begins.where("begins is null"), ["__id", "__tag"], "left_semi").select(*keyed.columns).mapInArrow(whole, with_ids)
    return unveiled(short.unionByName(stitched).unionByName(unmet), names, F.col("token_ids"))


def decode(encoded: DataFrame, vocabulary: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """Adds ``decoded``, the bytes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary, pattern)
        for b in batches:
            for part in _parts(b, pc.multiply(pc.list_value_length(b[ids_col]), 4)):
                yield part.append_column("decoded", pa.array([encoding.decode_bytes(ids or []) for ids in part[ids_col].to_pylist()], pa.binary()))

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of ``token_ids`` and ``decoded``; null ids are no ids."""
    ids = F.coalesce("token_ids", F.array().cast("array<int>"))
    return decoded.select(
        id_col,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
