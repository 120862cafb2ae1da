"""Models that are trained here: language model, URL trees, archives, and the pipeline."""

import gzip
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

import corpus_pipeline
from rastrum.llm import lm, queries, secrets, url_filter, warc
from rastrum.llm.common import new_path, with_row_key
from tests.llm.conftest import DOCS
from tests.llm.test_near import brute_kept
from tests.llm.test_text_operators import TABLES, brute_hits, brute_rules, lower, multiset, real, reference_ids

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(rows):
    words = [[*SPACE.findall(lower(t or "")), None] for _, t in rows]
    out = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    counts = Counter(w for own, aside in zip(words, out) if not aside for w in own)
    n, v = sum(counts.values()), len(counts)
    return [(d, aside, len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)) for (d, _), own, aside in zip(rows, words, out)]


@pytest.mark.parametrize("most", [lm.MOST_WORDS, 0])
def test_base_scores(docs, most):
    got = lm.judge(docs, most_words=most).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)).collect()
    assert multiset(got) == multiset((*r[:-1], round(r[-1], 6)) for r in brute_base(DOCS))


def test_scores_of_both_ways_agree(docs):
    a, b = (sorted((r["doc_id"] or -1, r["n_tokens"], r["score"]) for r in lm.judge(docs, most_words=m).collect()) for m in (lm.MOST_WORDS, 0))
    assert np.allclose(np.array(a), np.array(b), rtol=1e-9)


def test_scores_do_not_depend_on_partitions(spark, docs):
    found = []
    for n in (1, 4, 9):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(3 * n))
        found.append(sorted((r["doc_id"] or -1, r["n_tokens"], r["score"]) for r in lm.judge(docs.repartition(n)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert np.allclose(np.array(found[0]), np.array(found[1]), rtol=1e-9) and np.allclose(np.array(found[0]), np.array(found[2]), rtol=1e-9)


def test_word_probabilities_go_through_the_driver_in_pieces(spark, monkeypatch):
    h = lm.mixed(np.arange(5000)).view(np.int64)
    rows = spark.createDataFrame([(int(x), i, -float(i)) for i, x in enumerate(h)], "h long, c long, p double")
    seen, whole = [], type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda self: seen.append(whole(self)) or seen[-1])
    pieces = lm.broadcast_by_hash(rows, np.uint32)
    assert sum(map(len, seen)) == 5000 and max(map(len, seen)) < 500
    known, c, p = lm.looked_up(np.append(h[::-1], [1, -(1 << 63), (1 << 63) - 1]), pieces)
    assert known.tolist() == [True] * 5000 + [False] * 3
    assert c.tolist() == [*range(4999, -1, -1), 0, 0, 0] and p.tolist() == (-c).tolist()
    assert lm.broadcast_by_hash(rows.unionByName(rows.limit(1)), np.uint32) is None
    assert not lm.looked_up(h[:3], lm.broadcast_by_hash(rows.where("false"), np.int64))[0].any()


def test_held_out_perplexity_beats_a_proper_base(spark):
    """The base gives unknown words, however many, one share; here it is spread
    evenly over spellings, so that both are distributions over texts."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    known = {w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in SPACE.findall(lower(t or ""))}
    spelling = {d: sum((len(w.encode()) + 1) * math.log10(256) for w in SPACE.findall(lower(t or "")) if w not in known) for d, t in rows}
    got = lm.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    familiar = [r for r in got if r["n_known"] == r["n_tokens"]]
    assert familiar and sum(r["score"] for r in familiar) > sum(r["base_score"] for r in familiar)
    assert sum(r["base_score"] - spelling[r["doc_id"]] for r in got) < sum(r["score"] for r in got) < 0


def test_spelling_is_a_distribution(spark, docs):
    own = with_row_key(docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("__text")), "id", "__text")
    model = lm.fit(own, most_common=20)
    assert np.allclose(model.follow.sum(axis=1), 1) and (model.follow > 0).all()
    for (rows, values), _ in model.sweeps:
        assert np.allclose((10.0 ** values.astype(float)).sum(axis=1), 1, atol=1e-4)
    known = model.words.collect()
    assert sum(r["c"] for r in known) == model.n and all(r["common"] or 1 <= r["tables"] <= r["c"] for r in known)


def test_seats_follow_the_restaurant():
    """Mean tables of one dish against those of customers seated one by one."""
    rng = np.random.default_rng(0)
    c, a, d = 500, 3.0, 0.5
    one = []
    for _ in range(400):
        t = 1
        for i in range(1, c):
            t += rng.random() * (a + i - d * t) < a
        one.append(t)
    keys = np.arange(4000, dtype=np.uint64)
    many = lm.seats(np.full(4000, c), np.full(4000, a), d, keys)
    assert abs(np.mean(one) - many.mean()) < 4 * np.std(one) / 20 and abs(np.std(one) - many.std()) < 0.15 * np.std(one)
    assert (lm.seats(np.array([1, 1]), np.array([5.0, 9.0]), d, keys[:2]) == 1).all()
    both = np.array([3, 70, 5000, 1, 64, 65])
    assert (lm.seats(both, both / 9.0, d, keys[:6])[::-1] == lm.seats(both[::-1], both[::-1] / 9.0, d, keys[:6][::-1])).all()
    few = lm.seats(np.full(4000, 20_000), np.full(4000, 0.02), 0.05, keys)
    one = []
    for _ in range(400):
        u, t, i = rng.random(20_000), 1, 1
        while i < 20_000:
            hit = np.flatnonzero(u[i:] * (0.02 + np.arange(i, 20_000) - 0.05 * t) < 0.02)
            if not len(hit):
                break
            i, t = i + int(hit[0]) + 1, t + 1
        one.append(t)
    assert abs(np.mean(one) - few.mean()) < 4 * np.std(one) / 20


def test_word_order_matters(spark):
    text = "the cat sat on the mat and the dog sat on the rug "
    rows = [(i, text * 3) for i in range(40)] + [(100, text), (101, " ".join(sorted(text.split())))]
    got = {r["doc_id"]: r["score"] for r in lm.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] > got[101] + 5


@pytest.mark.parametrize("most", [lm.MOST_WORDS, 0])
def test_order_of_words_that_are_not_common_matters(spark, most):
    """Over twice as many words as have classes, each pair as frequent as any other."""
    pairs = [f"a{i} b{i}" for i in range(lm.COMMON + 500)]
    in_order, mixed_up = [i for i in range(100, 200) if lm.held_out(i)][:2]
    rows = [(i, " ".join(pairs)) for i in range(10)] + [(in_order, "a5 b5 a1200 b1200"), (mixed_up, "a5 b1200 a1200 b5")]
    got = {r["doc_id"]: r["score"] for r in lm.judge(spark.createDataFrame(rows, "doc_id long, text string"), most_words=most).collect()}
    assert got[in_order] > got[mixed_up] + 5


def test_every_context_has_a_restaurant_of_its_own(spark, docs):
    own = with_row_key(docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("__text")), "id", "__text")
    model = lm.fit(own, most_common=20)
    words = {r["id"]: r for r in model.words.collect()}
    name = {bytes(r["word"]): i for i, r in words.items()}
    want = Counter()
    for d, t in DOCS:
        if not lm.held_out(d):
            tokens = lm.tokens_of((t or "").encode())
            want.update((name[u], name[w]) for u, w in zip([b"", *tokens], tokens))
    assert want == {(r["u"], r["w"]): r["n"] for r in model.pairs.collect()}
    rest = {k: n for k, n in want.items() if not (words[k[0]]["common"] and words[k[1]]["common"])}
    tables = {(r["u"], r["w"]): r["t"] for r in model.multi.collect()}
    assert tables.keys() == {k for k, n in rest.items() if n > 1} and all(1 <= t <= want[k] for k, t in tables.items())
    # what pairs' customers have and what goes to the parent is all there is
    customers, follows = Counter(), Counter()
    for (u, w), n in rest.items():
        customers[u] += n
        follows[u] += tables.get((u, w), 1)
    for i, r in words.items():
        assert customers[i] == (model.alone[i] if r["common"] else r["c"]) and math.isclose(follows[i], r["follows"])


def test_training_rows_are_needed_for_none(spark):
    held = [i for i in range(60) if lm.held_out(i)]
    got = lm.judge(spark.createDataFrame([(i, "a few words") for i in held], "doc_id long, text string")).collect()
    assert len(got) == len(held) and all(r["train_tokens"] == 0 and r["score"] < 0 for r in got)


def test_language_model_of_nothing(empty):
    assert lm.judge(empty).count() == 0


PAGES = [
    (1, "http://a.org/fr/x?q=1#f", "<p>one</p>"),
    (2, "https://EXAMPLE.net/en/page", "<p>one</p>"),
    (3, "http://sub.example.net/de/", None),
    (4, None, ""),
    (5, "no scheme", "<p>two é</p>" * 2000),
    (6, "http://example.com/de/casino-" + "1" * 5000, "<p>one</p>"),
    (6, "http://example.com/de/casino", "<p>one</p>"),
    (None, "http://notnet/x", "<p>none</p>"),
    (None, "http://notnet/x", "<p>none</p>"),
    (7, "ftp://casino.bets.example/a/b/c?x=1&y=2", "<p>two é</p>" * 2000),
    (8, "http://org/fr", "x"),
    (9, "http://net/", "\r\n\r\nWARC/1.1\r\n"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 0) for p in PAGES], "page_id long, url string, html string, shard int").repartition(3)


def brute_warc(rows):
    import base64

    first = {}
    for i, _, h in rows:
        h = h or ""
        if i is not None:
            first[h] = min(first.get(h, i), i)
    seen, out = set(), []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        h = h or ""
        raw = h.encode()
        revisit = i != first.get(h) or (i, h) in seen
        seen.add((i, h))
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first.get(h) if revisit else None))
    return out


def test_warc(spark, pages):
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert multiset(got) == multiset(brute_warc(PAGES))
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_reads_only_what_the_manifest_holds(spark, pages):
    out = new_path(spark, "warc-test")
    warc.write(pages, out, shard_bytes=10_000, roll_bytes=300)
    whole = multiset(warc.read(spark, out).drop("payload").collect())
    fs, root = pafs.FileSystem.from_uri(out)
    first = min(f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/data")) if f.path.endswith(".warc.gz"))
    fs.copy_file(first, f"{root}/data/shard-of-no-manifest.warc.gz")
    assert multiset(warc.read(spark, out).drop("payload").collect()) == whole
    with fs.open_output_stream(first, compression=None) as cut:
        cut.write(b"cut")
    with pytest.raises(PythonException, match="not the file of the manifest"):
        warc.read(spark, out).collect()


def test_warc_files_do_not_depend_on_partitions(spark, pages):
    made = []
    for n in (1, 5):
        out = new_path(spark, "warc-test")
        rows = warc.write(pages.repartition(n), out, shard_bytes=10_000, roll_bytes=300).orderBy("file").collect()
        fs, root = pafs.FileSystem.from_uri(out)
        data = b"".join(fs.open_input_stream(f"{root}/data/{r['file']}", compression=None).read() for r in rows)
        assert len(rows) > 2 and b"WARC/1.1" in gzip.decompress(data)
        made.append([(r["file"], r["sha256"], r["records"]) for r in rows])
    assert made[0] == made[1]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
    fits = [r for r, _ in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark, pages):
    got = url_filter.judge(pages, url_filter.weak_labels(pages)).collect()
    assert multiset(r[:4] for r in got) == multiset((i, *brute_rule(u)) for i, u, _ in PAGES)
    rules = dict(url_filter.RULES)
    assert all(r["verdict"] == rules.get(r["rule"], r["verdict"]) for r in got)
    assert url_filter.judge(pages.where("false"), url_filter.weak_labels(pages)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, url_filter.weak_labels(pages).where("false")).where("rule is null").collect()} == {"allow"}


def test_url_trees_on_held_out_urls(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        bad = i % 2
        host = f"x{rng.integers(1e9)}-{rng.integers(1e9)}.win-{i % 9}.example" if bad else f"news.site{i % 20}.example"
        path = "/".join(str(rng.integers(1e6)) for _ in range(5)) + "?a=1&b=2&c=3" if bad else "articles/spring"
        rows.append((i, f"http://{host}/{path}", bad))
    table = spark.createDataFrame(rows, "page_id long, url string, blocked int")
    got = url_filter.judge(table.where("page_id >= 200"), table.where("page_id < 200").select("url", "blocked"), rules=()).collect()
    assert np.mean([(r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got]) > 0.97


def brute_redacted(text):
    spans = []
    for rule in secrets.RULES:
        spans += [m.span() for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.at_least]
    out, at = [], 0
    for a, z in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def test_pipeline_stages_on_odd_tables(docs, empty, spark, tmp_path):
    """Nulls, repeated rows and clashing columns, and no rows at all, through every stage."""
    folder = str(tmp_path)
    spark.createDataFrame([("q", "no such passage stands in any of these documents at all")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    odd = docs.withColumns({c: F.lit("own") for c in ("__text", "kept", "hit", "secret_spans", "__id")})
    for table in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, table, folder)
            assert found.columns == (["doc_id", "token_ids"] if name == "encode" else table.columns)
            assert (found.count() > 0) == (table is odd)


def test_rare_labels_are_all_taken_and_rates_leave_the_own_label_out(spark):
    rows = [(f"http://h{i}.example/{i}", 0) for i in range(3000)] + [(f"http://rare{i}-x.test/{i}", 1) for i in range(7)] + [("http://rare0-x.test/0", 1)] * 5
    picked = url_filter.sample_of(spark.createDataFrame(rows, "url string, blocked int"), "url", "blocked", 400)
    assert (picked["__label"] == 1).sum() == 7 and 120 < (picked["__label"] == 0).sum() < 300
    assert abs((picked["__label"] * picked["__weight"]).sum() / picked["__weight"].sum() - 12 / 3012) < 1e-9


def test_url_trees_beat_suffixes_on_unseen_hosts(spark):
    """Area under the curve on hosts that training has not seen: trees, and the suffix rates alone (which know none)."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    host = url_filter.host_of(F.col("url"))
    aside = F.when(F.col("blocked") == 1, host.rlike("casino|spam|ads-")).otherwise(F.pmod(F.xxhash64(host), F.lit(2)) == 1)
    labels = url_filter.weak_labels(pages).withColumn("part", aside.cast("int"))
    model, rates, prior = url_filter.train(labels.where("part = 0"))
    rows = url_filter._featured(labels.where("part = 1").select(F.col("url").alias("__url"), "blocked"))
    got = model.transform(url_filter._assembler().transform(url_filter._with_rates(rows, rates, prior))).select("blocked", "probability", "__rate3").toPandas()
    score = got["probability"].map(lambda v: v[1])

    def area(x):
        rank, bad = x.rank(), got["blocked"] == 1
        return (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())

    print("AUC", area(score), area(got["__rate3"]), int((got["blocked"] == 1).sum()), len(got))
    assert area(score) > max(area(got["__rate3"]), 0.9)


def test_pipeline(spark):
    stages = [(name, f) for name, f in corpus_pipeline.STAGES]
    assert [n for n, _ in stages] == ["quality_rules", "near_duplicates", "decontaminate", "redact_secrets", "encode"]
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = real(spark)
    good = corpus_pipeline.quality_rules(spark, docs, TABLES)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in queries.op4_quality_rules(spark, TABLES).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept and not any(brute_rules(t)[-1] for d, t in rows if d in kept)
    rows = [(d, t) for d, t in rows if d in kept]
    stay = {d for _, d in brute_kept(rows)}
    rows = [(d, t) for d, t in rows if d in stay]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if not brute_hits(t, items)[-1]]
    found = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, TABLES).collect()}
    assert set(found) == {d for d, _ in rows}
    hidden = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(hidden).collect()}
    assert all(clean[d] == brute_redacted(t) for d, t in rows)
    assert secrets.scan(hidden.select("doc_id", F.lit("").alias("own"), "text")).count() == len(rows)
    assert all(found[d] == reference_ids(clean[d]) for d, _ in rows)
