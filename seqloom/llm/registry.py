"""The operators' queries over the driver's tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, decontaminate, html_extract, line_dedup, pii, quality_model, quality_rules, simhash, url_filter, warc
from seqloom.llm.common import spread_join, table

RULES = [
    url_filter.Rule.parse("block", "com/en/"),
    url_filter.Rule.parse("allow", "example.com/en/7"),
    url_filter.Rule.parse("allow", "net/de/"),
    url_filter.Rule.parse("block", "example.net/de/8"),
    url_filter.Rule.parse("block", "org/es/"),
]


def _labelled_hosts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels counted by host. A page shows the document whose id ends its path; it is bad if that is labelled so.

    Pages are counted by host and id before they meet the labels, so an id of very many pages is a row for each host.
    """
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"([0-9]+)(?:/|\.html)?$", 1)
    rows = pages.select(url_filter.host_of(F.col("url")).alias("host"), number.try_cast("bigint").alias("doc_id"))
    rows = rows.groupBy("host", "doc_id").agg(F.count("*").alias("w"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return url_filter.count_hosts(spread_join(rows, known, ["doc_id"], None, "left"), weight="w")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    counts = _labelled_hosts(pages, table(spark, sf_dir, "labels"))
    found = url_filter.filter_urls(pages, RULES, counts=counts)
    return found.select("page_id", "host", "path", "rule", "verdict", "n_labelled", "bad_mean", "bad_lower")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    places = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.array_join(places, ",").alias("spans"),
    )


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.policy_mask("base"))) != 0
    out = quality_rules.apply_policy(book).withColumn("base_failed", base)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, from the masks alone."""
    return quality_rules.ablation(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explicit part of op1: host, path, and the rule that fits with its verdict."""
    return op1_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("by_rule"))


def _has_rank(rank: int, span: Column) -> Column:
    return span["rank"] == rank


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(pii.KINDS))
    # A second parameter of the function would be the place in the array.
    counts = [F.size(F.filter("spans", functools.partial(_has_rank, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    digest = F.sha2(F.col("sanitised"), 256).alias("sanitised_sha256")
    return pii.sanitise(found).select("doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"), digest)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_decontaminate, op3_html_extract, op4_quality_rules, op5_pii, op6_line_dedup, op7_bpe, op8_quality_model,
        op9_warc, op10_simhash, pipeline, quality_ablation, url_rules,
    )
}

LEDGER = r"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') as ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) as ls from docs),
wins as (select rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') as x from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
twice as (select rid, i from (select *, count(*) over (partition by rid, x) as c from wins) where c > 1),
steps as (select rid, least(8, coalesce(lead(i) over (partition by rid order by i) - i, 8)) as s from twice),
reps as (select rid, sum(s)::bigint as n from steps group by rid),
m as (select doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(reps.n, 0)::bigint as n_repeat_words, len(ls) as n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper,
    length(t) - length(regexp_replace(t, '[!?]', '', 'g')) as n_marks from w left join reps on w.rid = reps.rid),
f as (select *, (case when n_words < 20 then 1 else 0 end + case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end
    + case when 100 * n_symbols > 25 * n_words then 4 else 0 end + case when 100 * n_upper > 30 * word_chars then 8 else 0 end
    + case when 100 * n_marks > 25 * n_words then 16 else 0 end + case when 100 * n_dup_lines > 60 * n_lines then 32 else 0 end
    + case when word_chars < 2 * n_words or word_chars > 15 * n_words then 64 else 0 end)::bigint as failed from m)"""
LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
BASE32 = " || ".join(
    f"substr({LETTERS}, ((('0x' || substr(h, {i}, 5))::bigint >> {b}) & 31)::int + 1, 1)" for i in range(1, 41, 5) for b in (15, 10, 5, 0)
)
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
RULE_ROWS = ", ".join(f"('{r.host}', '{r.path}', '{r.text}', '{r.action}')" for r in RULES)

SQL: dict[str, str] = {
    "op6_line_dedup": r"""
with docs as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select rid, doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from docs),
keyed as (
    select *, translate(trim(line, e' \t\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), common as (select k from keyed where length(k) >= 1 group by k having count(distinct rid) >= 10)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count(*) filter (c.k is not null)::bigint as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (c.k is null), '')) as kept_sha256
from keyed left join common c on keyed.k = c.k group by rid""",
    "op4_quality_rules": LEDGER
    + "\nselect doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed, failed = 0 as kept, failed from f",
    "quality_ablation": LEDGER
    + ", r as (select * from (values "
    + ", ".join(f"('{p}', {quality_rules.policy_mask(p)}, '{r.name}', {1 << r.bit})" for p, names in quality_rules.POLICIES.items() for r in quality_rules.RULES if r.name in names)
    + """) as t(policy, everything, rule, bit))
select policy, rule, count(*) filter ((failed & bit) <> 0)::bigint as n_failed, count(*) filter ((failed & everything) = bit)::bigint as n_only from f, r group by 1, 2""",
    "url_rules": f"""
with parts as (select page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) as x from pages),
u as (select row_number() over () as rid, page_id, {LOWERED.format("x.host")} as host, x.path as path from parts),
r as (select * from (values {RULE_ROWS}) as t(rule_host, rule_path, rule, verdict)),
fits as (select rid, rule, verdict, row_number() over (partition by rid order by length(rule) desc, rule) as k
    from u, r where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, verdict as by_rule from u left join fits on u.rid = fits.rid and k = 1""",
    "op9_warc": f"""
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages),
q as (select page_id, strlen(t)::bigint as payload_bytes, {BASE32} as payload_digest, max(page_id) over (partition by t) as largest from p)
select page_id, payload_bytes, payload_digest, case when largest is null or page_id >= largest then 'response' else 'revisit' end as record_type,
    case when largest is not null and (page_id is null or page_id < largest) then largest end as refers_to from q""",
    "op2_decontaminate": f"""
with items as (select cast(item_id as varchar) as item_id, {WORDS} as ws from benchmark),
wins as (select distinct item_id, least(len(ws), 10) as size, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') as win
    from (select *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from items where len(ws) > 0)),
docs as (select row_number() over () as rid, doc_id, text, {WORDS} as ws from documents),
sizes as (select distinct size from wins),
places as (select rid, ws, size, unnest(range(1, len(ws) - size + 2)) as i from docs, sizes where len(ws) >= size),
hits as (select rid, i, p.size, item_id from places p join wins w on p.size = w.size and array_to_string(list_slice(ws, i, i + p.size - 1), ' ') = w.win),
marks as (select distinct rid, i + k as i from (select rid, i, unnest(range(size)) as k from hits)),
seps as (select rid, ws, regexp_split_to_array(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ss from docs where rid in (select rid from marks)),
words as (select rid, i, length(ws[i]) as n, sum(length(ss[i])) over (partition by rid order by i) + coalesce(sum(length(ws[i])) over (partition by rid order by i rows between unbounded preceding and 1 preceding), 0) as pos
    from (select *, unnest(range(1, len(ws) + 1)) as i from seps)),
runs as (select m.rid, min(pos)::bigint as low, max(pos + n)::bigint as high, count(*) as n from (select *, i - row_number() over (partition by rid order by i) as run from marks) m
    join words on m.rid = words.rid and m.i = words.i group by m.rid, run),
covered as (select rid, sum(n)::bigint as n_hit, string_agg(low || ':' || high, ',' order by low) as spans from runs group by rid),
found as (select rid, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id) filter (item_id is not null)), ',') as names from hits group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(spans, '') as spans
from docs left join covered on docs.rid = covered.rid left join found on docs.rid = found.rid""",
}
