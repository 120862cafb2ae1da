"""Pairs in packed arrays against pairs as rows, and how they are put in buckets."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rastrum.llm import lm, lm_packed
from rastrum.llm.common import materialize, with_row_key


def test_packed_numbers():
    for x in (np.array([0, 3, 1 << 31], np.uint32), np.array([-(1 << 63), 7], np.int64), np.zeros(0, np.uint16)):
        assert lm_packed.unpack(lm_packed.pack(x), x.dtype.type).tolist() == x.tolist()
    assert lm_packed._sums(lm_packed._steps(np.array([2, 2, 9]))).tolist() == [2, 2, 9]


def test_each_partition_has_as_many_buckets(spark):
    labels = lm_packed._labels(spark, 8)
    rows = spark.createDataFrame([(int(x),) for x in labels], "bucket int").repartition(8, "bucket")
    assert [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()] == [lm_packed.BUCKETS] * 8


def test_packed_pairs_score_as_rows_of_pairs(spark, docs):
    """Words that are common and others, unknown words, repeated rows, and texts of two tables of different widths."""
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id") + 1000, "text")
    both = docs.select("doc_id", "text").unionByName(more.toDF("doc_id", "text"))
    own = with_row_key(both.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("__text")), "id", "__text")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    packed = lm_packed.score(own, materialize(lm.word_counts(own), "words"), most_common=20)
    rows = lm.score(own, lm.fit(own, most_common=20))
    a, b = (np.array(sorted((r["id"] or -1, r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in x.collect())) for x in (packed, rows))
    assert len(a) == both.count() and (a[:, 1] > a[:, 2]).any() and np.allclose(a, b, rtol=1e-9)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


def odd_texts(n):
    pick = random.Random(5)
    return ["".join(pick.choice("aAbBé\u00c9ß \t\n\r\x0b\x0c\x1c\x1f\x85  ") for _ in range(pick.randrange(12))) for _ in range(n)] + ["", None, " ", "\n "]


def test_tokens_of_many_texts_at_once():
    for texts in (odd_texts(3000), [""], [None], ["a"], ["a", ""]):
        words, token, size = lm.tokenized(pa.array(texts, pa.string()))
        words, cuts = words.to_pylist(), [0, *np.cumsum(size).tolist()]
        assert len({*words}) == len(words)
        assert [[words[x] for x in token[i:j]] for i, j in zip(cuts, cuts[1:], strict=False)] == [lm.tokens_of((t or "").encode()) for t in texts]


def test_word_counts(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts(700))]
    expected = Counter(w for i, t in rows if not lm.held_out(i) for w in lm.tokens_of((t or "").encode()))
    got = lm.word_counts(spark.createDataFrame(rows, "id long, __text string").repartition(3)).collect()
    assert {bytes(r["word"]): r["c"] for r in got} == expected and len(got) == len(expected)


def test_parts_keep_all_rows_and_their_limits():
    batches = [pa.record_batch({"id": pa.array(range(10 * k, 10 * k + 10)), "__text": pa.array(["x" * (7 * i % 50) for i in range(10)])}) for k in range(30)]
    for rows, size in ((7, 1000), (4096, 60), (4096, 10), (33, 200)):
        found = list(lm.parts_of(iter(batches), rows, size))
        assert [i for b in found for i in b["id"].to_pylist()] == list(range(300))
        assert all(len(b) <= rows and (len(b) == 1 or sum(map(len, b["__text"].to_pylist())) <= size) for b in found)


def broadcast_words(spark, docs, most_common):
    every = materialize(lm.word_counts(docs), "words")
    n, v = every.agg(F.sum("c"), F.count("*")).first()
    common = [bytes(r["word"]) for r in every.orderBy(F.desc("c"), "word").limit(most_common).collect()]
    words, classes = lm.named_words(every, common)
    ids = lm_packed._broadcast(lm_packed._word_blocks(words).select("block", "id", "c"), v, lambda r: (np.frombuffer(r["id"], np.int64), np.frombuffer(r["c"], np.int64)), np.int64, np.uint32)
    return words, classes, ids, n, v


def test_numbers_of_words_in_many_pieces(spark, monkeypatch):
    """Workers read the numbers from the broadcasts' files: those of large and of small pieces, and of unknown words."""
    monkeypatch.setattr(lm_packed, "PIECE", 12_000)
    docs = spark.createDataFrame([(8 * i, f"w{i} x{i}") for i in range(35_000)], "id long, __text string")
    words, _, ids, _, v = broadcast_words(spark, docs, 5)
    assert len(ids.pieces) == 8 and sum(ids.sizes) == v and max(ids.sizes) * 12 > 1 << 16

    def run(batches):
        for b in batches:
            h = b["id"].to_numpy()
            at = ids.places(h)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids.at(at) == h), pa.array(ids.at(at, 1) == b["c"].to_numpy()), pa.array(ids.places(h ^ 1) < 0)], names=["at", "same", "counted", "new"])

    got = words.mapInArrow(run, "at long, same boolean, counted boolean, new boolean").toArrow()
    assert sorted(got["at"].to_pylist()) == list(range(v)) and all(got["same"].to_pylist()) and all(got["counted"].to_pylist()) and sum(got["new"].to_pylist()) > v - 10


def test_rows_of_pairs_do_not_grow_with_the_square_of_the_table(spark):
    """Some thousand texts send a row of pairs to each partition, not one for each 1,024 texts, side and bucket."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 500}" for k in range(60))) for i in range(4096)], "id long, __text string").coalesce(1)
    _, classes, ids, n, v = broadcast_words(spark, docs, 20)
    labels = lm_packed._labels(spark, 8)
    kinds = lm_packed.Kinds(int(ids.blocks[: lm_packed.BLOCKS // 2].sum()), classes.n)
    mapped = lm_packed._mapped(docs, spark.sparkContext.broadcast(classes), ids, kinds, n, v, labels)
    assert mapped.where("ids IS NULL").count() == 8
    pairs = lm_packed._by_pair(mapped, kinds, v, labels).where("n IS NOT NULL").select("n", "times").collect()
    assert sum(int(lm_packed.unpack(r["times"], np.int64).sum()) for r in pairs) == 4096 * 61 - sum(int(lm_packed.unpack(r["times"], np.int64).sum()) for r in mapped.where("ids IS NOT NULL").select("times").collect())
    assert sum(int(lm_packed.unpack(r["n"], np.int64).sum()) for r in pairs) == n


def test_tables_of_millions_of_words_keep_packed_pairs():
    """The 0.5 GB table has 3.6 million words, larger ones more than the 8 Mi that pairs were packed for."""
    assert lm_packed.MOST_WORDS >= 64 << 20
    sums = lm_packed.Sums()
    for x in ([5, 1, 5], [], [2, 1]):
        sums.add(np.array(x, np.int64), np.ones(len(x), np.int64))
    assert [x.tolist() for x in sums.merged()] == [[1, 2, 5], [2, 1, 2]]
