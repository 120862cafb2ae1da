"""The ``opN_<name>`` queries: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm import bpe, decontam, lm, quality, repeats, secrets, simhash, tokens, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"))
    shown = F.lower(F.lpad(F.hex("__fp"), 16, "0"))
    return groups.select(F.col("id").alias("doc_id"), shown.alias("fingerprint"), F.col("component").alias("component_id"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return judged.select("doc_id", *counts)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = {"vocabulary": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    return bpe.digest(bpe.decode(bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), **how).drop("text"), **how))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url", "payload")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.judge(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.weak_labels(pages))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2:3].isdigit()}


_SECRETS = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as (
    select doc_id, t,
        regexp_extract_all(t, '((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)') as ma,
        regexp_extract_all(t, '((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2) as ga,
        string_split_regex(t, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?[A-Za-z0-9+/_.=-]+') as pa,
        {more_columns}
    from d),
s as (
    select doc_id,
        list_transform(list_filter(range(1, len(ma) + 1), lambda i: length(ga[i]) >= 8), lambda i: {{'start': list_sum(list_transform(pa[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ma[1:i-1], lambda x: length(x))), 0), 'rank': 0, 'len': length(ma[i]), 'kind': 'assign'}}) as s0,
        {more_spans}
    from m),
j as (select doc_id, s0, s1, s2, list_sort(list_concat(s0, s1, s2)) as base, list_sort({all_spans}) as spans from s)
select doc_id, len(s0)::bigint as n_assign, len(s1)::bigint as n_access, len(s2)::bigint as n_hex,
    sha256(coalesce(array_to_string(list_transform(base, lambda x: x.kind || ':' || x.start::bigint || ':' || (x.start + x.len)::bigint), ','), '')) as base_sha256,
    coalesce(array_to_string(list_transform(spans, lambda x: x.kind || ':' || x.start::bigint || ':' || (x.start + x.len)::bigint), ','), '') as spans
from j
"""


def _secrets_sql() -> str:
    rules = secrets.RULES[1:]
    columns, spans = [], []
    for i, r in enumerate(rules, 1):
        columns += [f"regexp_extract_all(t, '{r.pattern}') as m{i}", f"string_split_regex(t, '{r.pattern}') as p{i}"]
        spans.append(
            f"list_transform(list_filter(range(1, len(m{i}) + 1), lambda i: length(m{i}[i]) >= {r.at_least}), lambda i: {{'start': list_sum(list_transform(p{i}[1:i], lambda x: length(x)))"
            f" + coalesce(list_sum(list_transform(m{i}[1:i-1], lambda x: length(x))), 0), 'rank': {i}, 'len': length(m{i}[i]), 'kind': '{r.kind}'}}) as s{i}"
        )
    every = "list_concat(" + ", ".join(f"s{i}" for i in range(len(rules) + 1)) + ")"
    return _SECRETS.format(more_columns=",\n        ".join(columns), more_spans=",\n        ".join(spans), all_spans=every)


# base32 of a SHA-1: 32 groups of 5 bits
_WARC = """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, html, sha1(html) as hex, strlen(html) as n from p),
b as (select *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0')), 'string_agg', '') as bits from h),
f as (select *, min(page_id) over (partition by hex) as first from b)
select page_id, n::bigint as payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + bits[5*k+1]::int * 16 + bits[5*k+2]::int * 8 + bits[5*k+3]::int * 4 + bits[5*k+4]::int * 2 + bits[5*k+5]::int]), 'string_agg', '') as payload_digest,
    case when page_id = first then 'response' else 'revisit' end as record_type,
    case when page_id = first then null else first end as refers_to
from f
"""


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

# every window of the benchmark against every window of the documents of as many words
_DECONTAM = """
with d as (select row_number() over () as r, doc_id, {words} as w from documents),
b as (select item_id, {words} as w from benchmark),
i as (select item_id, w, least(len(w), 10) as k, unnest(range(1, len(w) - least(len(w), 10) + 2)) as nth from b where len(w) > 0),
v as (select distinct item_id, k, array_to_string(w[nth:nth + k - 1], ' ') as g from i),
p as (select r, k, w, unnest(range(1, len(w) - k + 2)) as nth from d, (select distinct k from v) where len(w) >= k),
f as (select p.r, p.nth, v.k, v.item_id from p join v on v.k = p.k and v.g = array_to_string(p.w[p.nth:p.nth + p.k - 1], ' ')),
c as (select r, count(distinct pos) as n_hit from (select r, unnest(range(nth, nth + k)) as pos from f) group by r),
e as (select r, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as items from f group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (r) left join e using (r)
""".format(words=_WORDS)

# texts as two digits a byte; starts whose 400 bytes have equal MD5
_REPEATS = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
s as (select r, nth, md5(substr(h, 2 * nth + 1, 800)) as g from (select r, h, unnest(range(0, length(h) // 2 - 399)) as nth from d where length(h) >= 800)),
f as (select r, nth from (select r, nth, count(*) over (partition by g) as n from s) where n > 1),
o as (select r, nth, sum(new) over (partition by r order by nth) as span from (select r, nth, case when nth <= lag(nth) over (partition by r order by nth) + 400 then 0 else 1 end as new from f)),
x as (select r, span, min(nth) as a, max(nth) + 400 as z from o group by r, span),
y as (select r, a, z, coalesce(lag(z) over (partition by r order by a), 0) as before from x),
k as (select y.r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as head, max(z) as last, sum(z - a) as n_removed, count(*) as n_spans from y join d using (r) group by y.r)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
    sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join k using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _secrets_sql(), "op3_decontaminate": _DECONTAM, "op6_suffix_dedup": _REPEATS, "op7_warc": _WARC}
