"""Quality rules: hashed n-gram log-likelihood ratio of trusted against raw text.

Byte n-grams are hashed to ``BUCKETS`` buckets.  One multinomial is counted
over the whole corpus, the other over trusted documents; a document's score is
the mean over its n-grams of log p_trusted - log p_raw.  The threshold is fixed
by labelled documents and applied to every document alike.

Bounds: the trusted multinomial and the threshold are fitted on at most
``MOST_LABELLED`` labelled documents, those with the smallest hash of their id:
the multinomial on the trusted ones of one half by that hash, the threshold on
the other half (on all if that half lacks a label).  Documents labelled toxic are
on neither side; the verdict is about quality and isn't meant to find them.
Everything else covers all documents.

Defined results: a null text has no words; a text shorter than one n-gram
scores 0; rows without an id are never labelled, and a document labelled both
ways counts as not trusted; without labels of both kinds nothing is rejected by
score; repeated rows stay and count as often as they occur; an empty table gives
no rows; other columns are left alone, one called like a new column gets ``_in``
appended.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastrum.llm.common import in_parts, texts_of, unveiled, veiled

NGRAM = 4
BUCKETS = 1 << 15
MOST_LABELLED = 20_000
#: A trusted document below the threshold weighs as much as so many others above it.
FALSE_REJECT = 10
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
BLOCK = 1 << 22

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_CONTINUE = bytes(range(0x80, 0xC0))


def ngram_buckets(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, block by block."""
    b = np.frombuffer(text, np.uint8)
    for at in range(0, len(b) - NGRAM + 1, BLOCK):
        part = b[at : at + BLOCK + NGRAM - 1].astype(np.uint32)
        x = part[: len(part) - NGRAM + 1].copy()
        for k in range(1, NGRAM):
            x = x << np.uint32(8) | part[k : len(part) - NGRAM + 1 + k]
        yield (x * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def rules(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    kept = text.translate(None, _SPACE)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    repeated = 0
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        edge = np.zeros(len(words) + 1, np.int64)
        twice = np.flatnonzero(np.fromiter((times[w] > 1 for w in windows), bool, len(windows)))
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + WINDOW, -1)
        repeated = int(np.count_nonzero(np.cumsum(edge)))
    return len(words), len(kept.translate(None, _CONTINUE)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated


def labelled_ids(labels: DataFrame, id_col: str, label_col: str, most: int = MOST_LABELLED) -> DataFrame:
    """(__lid, __trusted) of at most ``most`` documents; those labelled toxic are on neither side."""
    known = labels.where("not coalesce(toxic, 0) = 1") if "toxic" in labels.columns else labels
    known = known.select(F.col(id_col).cast("long").alias("__lid"), F.col(label_col).alias("__good")).dropna()
    one = known.groupBy("__lid").agg((F.min("__good") == 1).alias("__trusted"))
    return one.orderBy(F.xxhash64("__lid"), "__lid").limit(most)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED, label_id: str | None = None) -> tuple[np.ndarray, float]:
    """Each bucket's log-likelihood ratio, and the threshold."""
    spark = docs.sparkSession
    picked = labelled_ids(labels, label_id or id_col, label_col, most).withColumn("__part", F.pmod(F.xxhash64("__lid"), F.lit(2)).cast("int")).toPandas()  # at most ``most`` rows
    picked = spark.createDataFrame(list(picked.itertuples(index=False, name=None)), "__lid long, __trusted boolean, __part int")
    known = docs.select(F.col(id_col).cast("long").alias("__lid"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(picked), "__lid", "left").select("__text", "__trusted", "__part")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in in_parts(batches):
            for text, trusted, part in zip(texts_of(b), b["__trusted"].to_pylist(), b["__part"].to_pylist(), strict=True):
                for x in ngram_buckets(text):
                    n = np.bincount(x, minlength=BUCKETS) if len(x) > BUCKETS // 8 else x
                    if n is x:
                        np.add.at(raw, x, 1)
                    else:
                        raw += n
                    if trusted and part == 0:
                        np.add.at(good, x, 1)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    sums = known.mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()  # BUCKETS rows
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[sums["bucket"]] += sums["raw"]
    good[sums["bucket"]] += sums["good"]
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([mean_ratio(t, ratio) for t in texts_of(b)], pa.float64()), b["__trusted"], b["__part"]], names=["score", "trusted", "part"])

    seen = known.where("__trusted is not null").mapInArrow(score, "score double, trusted boolean, part int").toPandas()
    apart = seen[seen["part"] == 1]
    seen = apart if apart["trusted"].nunique() == 2 else seen
    return ratio, threshold(seen["score"].to_numpy(float), seen["trusted"].to_numpy(bool))


def mean_ratio(text: bytes, ratio: np.ndarray) -> float:
    total, n = 0.0, 0
    for x in ngram_buckets(text):
        total += float(ratio[x].sum())
        n += len(x)
    return total / n if n else 0.0


def threshold(scores: np.ndarray, trusted: np.ndarray) -> float:
    """The middle of the gap that divides trusted from other documents at least
    cost; of gaps of equal cost the widest, then the lowest."""
    if not trusted.any() or trusted.all():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, good = scores[order], trusted[order]
    cost = FALSE_REJECT * np.cumsum(good)[:-1] + np.cumsum((~good)[::-1])[::-1][1:]
    gap = np.diff(s)
    cost = np.where(gap > 0, cost, np.inf)
    if not len(gap) or min(cost.min(), (~good).sum()) == (~good).sum() and cost.min() >= (~good).sum():
        return -np.inf
    best = np.flatnonzero(cost == cost.min())
    k = best[np.argmax(gap[best])]
    return float((s[k] + s[k + 1]) / 2)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED, label_id: str | None = None) -> DataFrame:
    """The documents' rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed and kept."""
    ratio, least = fit(docs, labels, id_col, text_col, label_col, most, label_id)
    held = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            texts = texts_of(b)
            counts = np.array([rules(t) for t in texts], np.int64).reshape(-1, 5)
            scores = np.array([mean_ratio(t, held.value) for t in texts], float)
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            new = [*(pa.array(c) for c in counts.T), pa.array(scores), pa.array(failed), pa.array(~failed & (scores >= least))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*b.schema.names[:-1], *_ADDED.names])

    own, names = veiled(docs)
    wide = own.withColumn("__text", F.col(names[text_col]).cast("string"))
    return unveiled(wide.mapInArrow(run, T.StructType([*own.schema.fields, *_ADDED.fields])), names, *map(F.col, _ADDED.names))


_ADDED = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("score", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    own, names = veiled(docs)
    return unveiled(judge(own, labels, names[id_col], names[text_col], label_id=id_col, **how).where("kept"), names)
