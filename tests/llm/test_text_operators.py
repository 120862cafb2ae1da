"""Operators over documents against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from rastrum.llm import bpe, decontam, near, quality, queries, repeats, secrets, simhash, tokens
from tests.llm.conftest import DOCS, LONG

TABLES = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def real(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]


def multiset(rows):
    return Counter(map(tuple, rows))


def brute_fingerprint(text):
    words = SPACE.findall(lower(text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_groups(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, f"{fp:016x}", least.get(top(i))) for i, ((d, _), fp) in enumerate(zip(rows, fps))]


@pytest.mark.parametrize("source", ["fixture", "table"])
def test_simhash(spark, docs, source):
    rows = DOCS if source == "fixture" else real(spark)
    got = simhash.near_groups(docs if source == "fixture" else spark.read.parquet(f"{TABLES}/documents.parquet"))
    shown = got.select("id", F.lower(F.lpad(F.hex("__fp"), 16, "0")), "component").collect()
    assert multiset(shown) == multiset(brute_groups(rows))


HALVES = [(list(range(0, 64, 2)), 1), (list(range(1, 64, 2)), 0)]


@pytest.mark.parametrize("partitions", [lambda p: p, lambda p: HALVES], ids=["planned", "halves"])
@pytest.mark.parametrize("most", [simhash.MOST, 3])
def test_simhash_links_by_way_of_others(spark, partitions, most):
    rng = np.random.default_rng(1)
    seeds = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = {s ^ (1 << a) ^ (1 << b) if a != b else s for s in seeds for a, b in rng.integers(0, 63, (12, 2)).tolist()} | set(seeds)
    table = spark.createDataFrame([(f, 1) for f in fps], "fp long, first long")
    got = {(r["a"], r["b"]) for r in simhash.links(table, partitions(simhash.plan(table)), most=most).collect()}

    def classes(edges):
        top = {f: f for f in fps}

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in edges:
            top[find(a)] = find(b)
        groups = {}
        for f in fps:
            groups.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, groups.values()))

    brute = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
    assert classes(got) == classes(brute)


def test_simhash_keeps_one_of_each_group(docs, empty):
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == len(set(map(brute_fingerprint, texts)))
    assert simhash.dedup(empty).count() == 0


def brute_hits(text, items, n=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = find.findall(lower(text or ""))
    hit, named, windows = set(), set(), {}
    for name, item in items:
        w = find.findall(lower(item or ""))
        for x in [w] if 0 < len(w) < n else [w[i : i + n] for i in range(len(w) - n + 1)]:
            windows.setdefault(tuple(x), set()).add(name)
    for size in {len(x) for x in windows}:
        for i in range(len(words) - size + 1):
            if (names := windows.get(tuple(words[i : i + size]))) is not None:
                hit |= set(range(i, i + size))
                named |= {str(x) for x in names if x is not None}
    return len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


def test_columns_with_the_names_of_others(spark, docs):
    """Columns called like what operators use or return come back, under those names or with _in appended."""
    new = ["__id", "__tag", "__text", "__hit", "__c0", "__spans", "hit", "items", "n_words", "kept", "score", "secret_spans", "token_ids", "n_removed", "__runs", "__group", "__bit"]
    odd = docs.drop("score").withColumns({c: F.lit(f"own {c}") for c in new})
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    how = {"vocabulary": RANKS, "pattern": public_tokenizers.PATTERN}
    for found in (
        quality.judge(odd, labels), quality.keep_good(odd, labels), decontam.scan(odd, bench), decontam.remove_documents(odd, bench), decontam.remove_spans(odd, bench),
        secrets.scan(odd), secrets.redact(odd), simhash.dedup(odd), near.dedup(odd), bpe.encode(odd, **how), repeats.dedup(odd),
    ):
        assert len(set(found.columns)) == len(found.columns)
        rows = found.collect()
        assert rows
        for c in new:
            column = c if f"{c}_in" not in found.columns else f"{c}_in"
            assert {r[column] for r in rows} == {f"own {c}"}


ITEMS = [("q1", "The capital of the small country that lies between two large mountains"), ("q2", "Word"), ("q3", None), ("q4", "..."), (None, "gamma delta epsilon"), ("q6", "äöü SS éa"), ("q7", "between two")]


@pytest.mark.parametrize("most", [decontam.MOST_BYTES, 0])
def test_decontamination(spark, docs, most):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = decontam.digest(decontam.scan(docs, bench, most_bytes=most)).collect()
    assert multiset(got) == multiset((d, *brute_hits(t, ITEMS)) for d, t in DOCS)
    clean = decontam.remove_documents(docs, bench, most_bytes=most)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not brute_hits(t, ITEMS)[-1] for _, t in DOCS)
    assert decontam.remove_documents(docs, bench.where("false"), most_bytes=most).count() == len(DOCS)
    assert decontam.scan(docs.where("false"), bench, most_bytes=most).count() == 0


def test_decontamination_cuts_spans(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    cut = {r["doc_id"]: r["text"] for r in decontam.remove_spans(docs, bench).collect()}
    assert cut[14] == "What is ? ÄÖÜ ß éa" and cut[1] == DOCS[0][1] and cut[2] is None and cut[16] == ""


def test_decontamination_of_a_table(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    got = queries.op3_decontaminate(spark, TABLES).collect()
    assert multiset(got) == multiset((d, *brute_hits(t, items)) for d, t in real(spark))
    assert any(r["contaminated"] for r in got)


def brute_rules(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


@pytest.mark.parametrize("source", ["fixture", "table"])
def test_quality_counts(spark, docs, source):
    table = docs if source == "fixture" else spark.read.parquet(f"{TABLES}/documents.parquet")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    got = quality.judge(table, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert multiset(got) == multiset((d, *brute_rules(t)) for d, t in (DOCS if source == "fixture" else real(spark)))


def half(d):
    return xxhash.xxh64_intdigest(d.to_bytes(8, "little"), 42) & 1


def brute_threshold(scored):
    """Least cost over all middles between neighbouring scores: the widest gap, then the lowest."""
    s = sorted(scored)
    cost = lambda x: sum(quality.FALSE_REJECT * (v < x) if g else v >= x for v, g in s)
    tried = [(cost((a + b) / 2), a - b, (a + b) / 2) for (a, _), (b, _) in zip(s, s[1:]) if b > a]
    best = min(tried)
    return best[2] if best[0] < sum(not g for _, g in s) else -np.inf


def test_quality_scores_by_brute_force(spark):
    rows = real(spark)
    good = {}
    for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect():
        if r["quality"] is not None and not r["toxic"]:
            good[r["doc_id"]] = min(good.get(r["doc_id"], 1), r["quality"])
    raw, trusted = Counter(), Counter()
    bucket = lambda g: (int.from_bytes(g, "big") * 2654435761 & 0xFFFFFFFF) >> 17
    grams = {d: [bucket(t.encode()[i : i + 4]) for i in range(len(t.encode()) - 3)] for d, t in rows}
    for d, g in grams.items():
        raw.update(g)
        if good.get(d) == 1 and not half(d):
            trusted.update(g)
    n_raw, n_good = sum(raw.values()) + quality.BUCKETS, sum(trusted.values()) + quality.BUCKETS
    ratio = lambda b: np.log((trusted[b] + 1) / n_good) - np.log((raw[b] + 1) / n_raw)
    judged = queries.op4_quality_rules(spark, TABLES).collect()
    mean = {d: sum(map(ratio, g)) / len(g) if g else 0.0 for d, g in grams.items()}
    least = brute_threshold([(mean[d], good[d]) for d in grams if d in good and half(d)])
    for r in judged:
        assert r["score"] == pytest.approx(mean[r["doc_id"]], abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and mean[r["doc_id"]] >= least)
    scored = [(r["score"], good[r["doc_id"]]) for r in judged if r["doc_id"] in good and not r["base_failed"]]
    kept = {r["doc_id"]: r["kept"] for r in judged}
    right = [kept[r["doc_id"]] for r in judged if good.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert scored and np.mean(right) > 0.9
    bad = [kept[r["doc_id"]] for r in judged if good.get(r["doc_id"]) == 0]
    assert np.mean(bad) < 0.2
    assert all(not r["kept"] for r in judged if r["base_failed"])


def test_quality_without_labels_or_rows(docs, spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judge(docs, none)
    assert got.where("kept = base_failed").count() == 0
    assert quality.keep_good(empty, none).count() == 0


def reference_ids(text):
    encoding = bpe._encoding(RANKS, public_tokenizers.PATTERN)
    return encoding.encode_ordinary(text or "")


@pytest.mark.parametrize("chunk, overlap", [(bpe.CHUNK, bpe.OVERLAP), (200, 40)])
def test_byte_bpe(docs, chunk, overlap):
    how = {"vocabulary": RANKS, "pattern": public_tokenizers.PATTERN}
    encoded = bpe.encode(docs, **how, chunk=chunk, overlap=overlap)
    assert encoded.columns == [*docs.columns, "token_ids"]
    decoded = bpe.decode(encoded, **how).select("doc_id", "text", "token_ids", "decoded").collect()
    assert multiset((r[0], r[1], tuple(r[2])) for r in decoded) == multiset((d, t, tuple(reference_ids(t))) for d, t in DOCS)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in decoded)


def test_byte_bpe_digest_and_empty(spark, docs, empty):
    how = {"vocabulary": RANKS, "pattern": public_tokenizers.PATTERN}
    got = bpe.digest(bpe.decode(bpe.encode(docs, **how), **how)).collect()
    want = [(d, len(i := reference_ids(t)), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in DOCS]
    assert multiset(got) == multiset(want)
    assert bpe.encode(empty, **how).count() == 0


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int(np.count_nonzero(np.diff(np.append(False, gone).astype(int)) == 1))
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


METHODS = pytest.mark.parametrize("method", ["anchors", "doubling"])


@METHODS
def test_suffix_dedup(docs, empty, method):
    assert multiset(repeats.dedup(docs, method=method).select(*COLUMNS).collect()) == multiset(brute_repeats(DOCS, 400))
    assert repeats.dedup(empty, method=method).count() == 0


@METHODS
def test_suffix_dedup_near_copies(spark, method):
    rng = np.random.default_rng(3)
    words = [f"{'abcdefgh'[i % 8]}{i}" for i in range(300)]
    base = [str(w) for w in rng.choice(words, 500)]
    rows = []
    for d in range(60):
        own = list(base)
        for at in rng.integers(0, len(own), rng.integers(0, 6)):
            own[at] = "CHANGED" * int(rng.integers(1, 3))
        cut = int(rng.integers(0, 200))
        rows.append((d, " ".join(own[cut:])))
    rows.append((99, "ab" * 1000))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert multiset(repeats.dedup(table, length=400, method=method).select(*COLUMNS).collect()) == multiset(brute_repeats(rows, 400))


@METHODS
def test_suffix_dedup_across_blocks(spark, monkeypatch, method):
    text = LONG[:30_000]
    rows = [(1, text), (2, "shift " + text[2_000:20_000]), (3, text[:9_000] + "#" + text[9_000:12_000])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(repeats, "BLOCK", 4096)
    assert multiset(repeats.dedup(table, method=method).select(*COLUMNS).collect()) == multiset(brute_repeats(rows, 400))


def test_suffix_dedup_of_a_table(spark):
    got = queries.op6_suffix_dedup(spark, TABLES).collect()
    assert multiset(got) == multiset(brute_repeats(real(spark), 400))
    assert any(r["n_removed"] for r in got)
    ranked = repeats.dedup(spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text"), method="doubling")
    assert multiset(ranked.select(*COLUMNS).collect()) == multiset(got)


ODD = ["hello <|endoftext|> world", "<|endoftext|>", "zero \0 inside  twice", "nbsp\u00a0 \u00a0  then \x1c x \x85 y", "a \n b\tc\r\nd ", "  lead", "trail  \n\n", "\u3000wide\u2028 x", "it's  don't 12,34 5.6! ?"]


def test_encoder_on_odd_texts():
    from tokenizers import Tokenizer
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    parts = [" ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1f", "\x85", "a", "Bc", "1", ".", "!", "'s", "é", "東", "\0", "<|endoftext|>", "🙂", "-"]
    texts = ODD + ["".join(parts[i] for i in rng.integers(0, len(parts) - 3 * (k % 2), rng.integers(0, 30))) for k in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(path).encode(pa.array(texts))] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_store(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    ids = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, tokens.END]
    from rastrum.llm.common import new_path

    out = new_path(spark, "store-test")
    tokens.write(docs, out, path, shard_bytes=20_000)
    got = tokens.read(spark, out).collect()
    assert multiset((r["id"], tuple(r["token_ids"])) for r in got) == multiset((d, tuple(ids(t))) for d, t in DOCS)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["id"] is None for r in order] == sorted((r["id"] is None for r in order), reverse=True)
    known = [r["id"] for r in order if r["id"] is not None]
    assert known == sorted(known)
    at = 0
    for r in order:
        assert r["start"] == at
        at += r["n_tokens"]
    one = tokens.read(spark, out, spark.createDataFrame([(11,)], "id long")).collect()
    assert len(one) == 1 and one[0]["token_ids"] == ids(dict(DOCS)[11])
    assert tokens.round_trip(empty, path).count() == 0
    crc = tokens.round_trip(docs, path).collect()
    assert multiset((r["doc_id"], r["ids_crc32"]) for r in crc) == multiset((d, zlib.crc32(np.array(ids(t), "<u4").tobytes())) for d, t in DOCS)


def brute_secrets(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, m.end(), "assign"))
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    return *(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")), hashlib.sha256(base.encode()).hexdigest()


def test_secrets(docs, empty):
    got = secrets.digest(secrets.scan(docs)).drop("spans").collect()
    assert multiset(got) == multiset((d, *brute_secrets(t)) for d, t in DOCS)
    assert secrets.scan(empty).count() == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert "hunter22" not in clean[10] and clean[2] is None and clean[1] == DOCS[0][1]
    assert secrets.redact(docs).columns == docs.columns


def test_secrets_of_every_kind(spark):
    texts = [
        "ghp_" + "A1b2" * 10,
        "xoxb-1234567890-abcdef",
        "AIza" + "x" * 35,
        "sk_live_" + "9" * 24,
        "eyJhbGciOi.eyJzdWIiOiIx.c2lnbmF0dXJlc2ln",
        "-----BEGIN RSA PRIVATE KEY-----",
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = [r["secret_spans"][-1]["kind"] for r in secrets.scan(table).orderBy("doc_id").collect()]
    assert kinds == ["github", "slack", "google", "stripe", "jwt", "private_key"]
    assert secrets.trigram_query("[0-9a-f]+") == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    twin = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        twin.execute(f"create view {table} as select * from '{TABLES}/{table}.parquet'")
    found = twin.execute(queries.oracle_sql()[name])
    columns, want = [c[0] for c in found.description], found.fetchall()
    got = queries.queries()[name](spark, TABLES)
    assert set(got.columns) == set(columns)
    assert multiset(got.select(*columns).collect()) == multiset(want)
