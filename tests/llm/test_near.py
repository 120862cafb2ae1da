"""Near copies on five-word shingles against brute force."""

import pyarrow as pa
import pytest

import corpus_pipeline
from rastrum.llm import decontam, near
from rastrum.llm.common import in_parts, texts_of
from tests.llm.conftest import DOCS
from tests.llm.test_text_operators import SPACE, TABLES, lower

WORDS = [f"w{i * 7919 % 1009}" for i in range(400)]


def changed(*at):
    return " ".join("other" + str(i) if i in at else w for i, w in enumerate(WORDS))


#: Copies with a few words changed; 204 is only near 203, which is near 201, and 205 is near none.
NEAR = [(201, changed()), (202, changed(7)), (203, changed(5, 50, 90, 150, 200, 250)), (204, changed(5, 50, 90, 150, 200, 250, 300, 320, 340, 360, 380, 395)), (205, changed(*range(3, 400, 15)))]


def grams(text):
    words = SPACE.findall(lower(text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows):
    own = [grams(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if own[i] == own[j] or 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        k = (d is None, d or 0)
        least[top(i)] = min(least.get(top(i), k), k)
    return sorted(least.values())


def kept(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())


@pytest.mark.parametrize("source", ["fixture", "sf0.001", "sf0.01"])
def test_near_duplicate_stage(spark, source):
    if source == "fixture":
        docs = spark.createDataFrame(DOCS + NEAR, "doc_id long, text string").repartition(3)
    else:
        docs = spark.read.parquet(f"{TABLES.rsplit('/', 1)[0]}/{source}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert kept(corpus_pipeline.near_duplicates(spark, docs, "")) == brute_kept(rows)


def test_near_of_nothing(empty):
    assert near.dedup(empty).count() == 0


def test_workers_take_texts_in_parts_and_carry_them_once(spark, docs):
    batch = pa.RecordBatch.from_pydict({"__text": ["a", "b", None, "d", "e"]})
    parts = list(in_parts(iter([batch, batch.slice(0, 0)]), 2))
    assert [p.num_rows for p in parts] == [2, 2, 1] and [t for p in parts for t in texts_of(p)] == [b"a", b"b", b"", b"d", b"e"]
    found = decontam.scan(docs, spark.createDataFrame([("i", "one two three")], "item_id string, text string"))
    plan = next(x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapInArrow" in x)
    assert "__hit" in plan and "__text" not in plan.split("[")[-1]
