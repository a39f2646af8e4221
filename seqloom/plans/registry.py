"""Queries over the driver's tables and the SQL that gives the same rows.

The tables hold no reads, so reads are made of lineitem by an expression that both engines know.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.construct import Construct
from seqloom.functions import reads as R
from seqloom.operators import counting, criteria, matching, metrics
from seqloom.plans import pipelines, reports
from seqloom.shared import scratch, write_text
from seqloom.sources import sinks
from seqloom.sources.fastx import read_fastq_lines, read_reads

MAIN = Construct.parse("const:AAAAAA", "rand:8-12", "const:TTTTTT")
LEADING = Construct.parse("rand:0-5", "const:AAAAAA", "rand:8-12", "const:TTTTTT")
TRAILING = Construct.parse("const:AAAAAA", "rand:8-12", "const:TTTTTT", "rand:0-1")
THREE = Construct.parse("const:AAA", "rand:3-5", "const:G", "rand:2-9", "const:TTT")
ADJACENT = Construct.parse("const:AAA", "const:AAA", "rand:8-12", "const:TTTTTT")
CRITERIA = {"constant": "TTTTTT", "min_length": 22, "max_length": 26, "upstream": 16, "upstream_tolerance": 2, "downstream": 0, "downstream_tolerance": 1}

READS = """select l_orderkey as k, l_linenumber as n,
 concat(case when l_linenumber = 5 then 'GG' else '' end, case when l_linenumber = 6 then 'AAATAA' else 'AAAAAA' end,
  substr(translate(md5(cast(l_partkey as {text})), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, cast(6 + l_suppkey % 9 as int)),
  case when l_linenumber = 7 then 'TTTTAT' else 'TTTTTT' end, case when l_linenumber = 4 then 'CC' else '' end) as seq
 from {table}"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, sequence and a quality string of the sequence's length."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    df = spark.sql(READS.format(text="string", table="{t}"), t=t)
    quality = F.substring(F.repeat(F.translate(F.md5(F.col("seq")), "0123456789abcdef", "!#%')+-/13579;=?"), 2), F.lit(1), F.length("seq"))
    return df.select(F.concat_ws("_", "k", "n").alias("id"), F.col("seq").alias("sequence"), quality.alias("quality"))


def unique(spark: SparkSession, sf_dir: str, construct: Construct = MAIN, strict: bool = True, near: bool = False) -> DataFrame:
    out = matching.annotate(counting.count_sequences(reads(spark, sf_dir).select("sequence")), construct, strict)
    return matching.near_miss(out, construct) if near else out


# --- the SQL side -----------------------------------------------------------------------------------------------

RAW = "with raw as (" + READS.format(text="varchar", table="lineitem") + "), r as (select concat_ws('_', k, n) as id, seq, substr(repeat(translate(md5(seq), '0123456789abcdef', '!#%'')+-/13579;=?'), 2), 1, length(seq)) as quality from raw)"


def match_sql(construct: Construct, strict: bool = True) -> str:
    """Common tables up to m: one row per read with anchors p0.., regions s0, l0, i0.., kind, arg and mask."""
    out, last = RAW, "r"
    consts = construct.consts
    for k, c in enumerate(consts):
        if k == 0:
            place = f"instr(seq, '{c}')"
        else:
            e = f"(p{k - 1} + {len(consts[k - 1])})"
            place = f"case when p{k - 1} > 0 then case when instr(substr(seq, {e}), '{c}') > 0 then {e} + instr(substr(seq, {e}), '{c}') - 1 else 0 end end"
        out += f", a{k} as (select *, {place} as p{k} from {last})"
        last = f"a{k}"
    z = len(consts) - 1
    lead, trail = "p0 - 1", f"length(seq) - p{z} - {len(consts[z])} + 1"
    columns, kinds, mask = [], [], []
    for n, (before, r) in enumerate(construct.rands):
        start = "0" if before == 0 else f"p{before - 1} + {len(consts[before - 1])} - 1"
        size = lead if before == 0 else trail if before == len(consts) else f"p{before} - (p{before - 1} + {len(consts[before - 1])})"
        columns += [f"case when p{z} > 0 then {start} end as s{n}", f"case when p{z} > 0 then {size} end as l{n}"]
        kinds.append((f"l{n} not between {r.min_len} and {r.max_len}", "RandOutOfRange", str(n)))
        mask.append(f"case when l{n} between {r.min_len} and {r.max_len} then {1 << (len(consts) + n)} else 0 end")
    columns += [f"case when p{z} > 0 then {lead} else 0 end as lead", f"case when p{z} > 0 then {trail} else 0 end as trail"]
    mask = [f"case when p{k} > 0 then {1 << k} else 0 end" for k in range(len(consts))] + mask
    kinds = [(f"p{k} = 0", "ConstNotFound", str(k)) for k in range(len(consts))] + kinds
    kinds += [("lead > 0", "LeadingGap", "lead")] * (strict and not construct.starts_open)
    kinds += [("trail > 0", "TrailingGap", "trail")] * (strict and not construct.ends_open)
    cases = " ".join(f"when {c} then '{k}'" for c, k, _ in kinds)
    args = " ".join(f"when {c} then {a}" for c, _, a in kinds)
    out += f", g as (select *, {', '.join(columns)} from {last})"
    return out + f", m as (select *, case {cases} end as kind, case {args} end::int as arg, ({' + '.join(mask)})::bigint as mask from g)"


def _match_columns(df: DataFrame, construct: Construct) -> DataFrame:
    regions = [F.get("rand_regions", F.lit(k))["length"].alias(f"rand_{k}") for k in range(len(construct.rands))]
    found = [F.get("const_matches", F.lit(k))["position"].alias(f"const_{k}") for k in range(len(construct.consts))]
    return df.select(
        "sequence", *found, *regions, F.col("leading_gap"), "trailing_gap", F.col("failure.kind").alias("failure"),
        F.col("failure.arg").alias("arg"), "matched", "mask",
    )


def _match_select(construct: Construct) -> str:
    found = [f"case when p{k} > 0 then p{k} - 1 end::int as const_{k}" for k in range(len(construct.consts))]
    regions = [f"l{k}::int as rand_{k}" for k in range(len(construct.rands))]
    return ", ".join(["seq as sequence", *found, *regions, "lead::int as leading_gap", "trail::int as trailing_gap", "kind as failure", "arg", "kind is null as matched", "mask"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


for _name, _c, _strict in (
    ("match_annotate", MAIN, True), ("match_nonstrict", MAIN, False), ("match_leading_rand", LEADING, True),
    ("match_trailing_rand", TRAILING, True), ("match_three_const", THREE, True), ("match_adjacent_const", ADJACENT, True),
):
    _add(
        _name,
        lambda s, d, c=_c, strict=_strict: _match_columns(matching.annotate(reads(s, d).select("sequence"), c, strict), c),
        f"{match_sql(_c, _strict)} select {_match_select(_c)} from m",
    )

M = match_sql(MAIN)
NORMAL = "regexp_replace(translate(regexp_replace({}, '[ \\t\\r\\n]', '', 'g'), 'acgtnuU.~', 'ACGTNTT--'), '[^ACGTN-]', 'N', 'g')"
_add(
    "normalize",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", R.normalize(F.col("text")).alias("sequence")),
    f"select doc_id, {NORMAL.format('text')} as sequence from documents",
)
_add(
    "reads_total_unique",
    lambda s, d: counting.count_sequences(reads(s, d)).agg(F.sum("count").cast("long").alias("total"), F.count("*").alias("unique_sequences")),
    f'{RAW} select count(*)::bigint as total, count(distinct seq)::bigint as unique_sequences from r',
)
_add(
    "valid_filter",
    lambda s, d: matching.valid(matching.annotate(reads(s, d), MAIN)).select("id", "sequence", "quality"),
    f"{M} select id, seq as sequence, quality from m where kind is null",
)
_add(
    "extract_random",
    lambda s, d: matching.valid(matching.annotate(reads(s, d), MAIN)).select("id", matching.random_region().alias("random_region")),
    f"{M} select id, substr(seq, s0::int + 1, l0::int) as random_region from m where kind is null",
)
_add(
    "failure_breakdown",
    lambda s, d: metrics.failure_breakdown(unique(s, d), "count"),
    f"{M} select kind, case when kind in ('ConstNotFound', 'RandOutOfRange') then arg end as arg, count(*)::bigint as n from m group by 1, 2",
)
_add(
    "summary",
    lambda s, d: metrics.summary(unique(s, d), "count"),
    f"{M}, t as (select count(*)::bigint as total_reads, count(*) filter (kind is null)::bigint as valid from m) "
    "select total_reads, valid, (total_reads - valid)::bigint as invalid, valid::double / total_reads * 100.0 as valid_pct from t",
)
HAMMING = "case when p{k} = 0 and length(seq) >= 6 then list_min(list_transform(range(1, (length(seq) - 4)::bigint), lambda i: hamming(substr(seq, i::int, 6), '{c}'))) end"
BUCKETS = ", ".join(
    f"case when h{k} <= 3 then case when h{k} = 0 then 3 else least(h{k} - 1, 3) end end as b{k}" for k in (0, 1)
)
NEAR = f"{M}, h as (select *, {HAMMING.format(k=0, c='AAAAAA')} as h0, {HAMMING.format(k=1, c='TTTTTT')} as h1 from m), b as (select *, {BUCKETS} from h)"
_add(
    "per_const_stats",
    lambda s, d: metrics.per_const(unique(s, d, near=True), MAIN, "count"),
    NEAR + " "
    + " union all ".join(
        f"select {k}::int as const_idx, '{c}' as sequence, count(*) filter (p{k} > 0)::bigint as found, count(*) filter (p{k} = 0)::bigint as not_found, "
        f"count(*) filter (p{k} > 0)::double / count(*) * 100.0 as found_pct, "
        + ", ".join(f"count(*) filter (b{k} = {i})::bigint as near_{i + 1}" for i in range(4))
        + " from b"
        for k, c in enumerate(MAIN.consts)
    ),
)
_add(
    "near_miss",
    lambda s, d: matching.near_miss(matching.annotate(reads(s, d).select("sequence"), MAIN), MAIN).select("sequence", F.col("_b0").alias("near_0"), F.col("_b1").alias("near_1")),
    f"{NEAR} select seq as sequence, b0::int as near_0, b1::int as near_1 from b",
)
_add(
    "per_rand_stats",
    lambda s, d: metrics.per_rand(unique(s, d), MAIN, "count"),
    f"{M} select 0::int as rand_idx, 8::int as min_len, 12::int as max_len, count(*) filter (l0 between 8 and 12)::bigint as in_range, "
    "count(*) filter (l0 not between 8 and 12)::bigint as out_of_range, count(*) filter (l0 between 8 and 12)::double / count(*) * 100.0 as in_range_pct from m",
)
_add(
    "rand_length_dist",
    lambda s, d: metrics.rand_length_dist(unique(s, d), "count"),
    f"{M} select 0::int as rand_idx, l0::int as length, count(*)::bigint as n from m where l0 is not null group by 2",
)
COMPOSITION = (
    f"{M}, q as (select substr(seq, s0::int + 1, l0::int) as x from m where kind is null), e as (select unnest(range(1, length(x)::bigint + 1)) as position, x from q), "
    "k as (select 0::int as rand_idx, position::int as position, "
    + ", ".join(f"count(*) filter (substr(x, position::int, 1) = '{b}')::bigint as {b}" for b in "ATGC")
    + " from e group by 2)"
)
_add("composition", lambda s, d: metrics.composition(unique(s, d), MAIN, "count"), f"{COMPOSITION} select * from k")
_add(
    "composition_pct",
    lambda s, d: metrics.composition_pct(metrics.composition(unique(s, d), MAIN, "count")),
    f"{COMPOSITION} select rand_idx, position, " + ", ".join(f"case when A + T + G + C = 0 then 0.0 else {b}::double / (A + T + G + C) * 100.0 end as {b}_pct" for b in "ATGC") + " from k",
)
MASKS = f"{M}, c as (select mask, count(*)::bigint as n from m group by 1)"
_add("combinations_top20", lambda s, d: metrics.top_combinations(metrics.combinations(unique(s, d), "count")), f"{MASKS} select * from c order by n desc, mask limit 20")
NAMES = "['const_0', 'const_1', 'rand_0']"
_add(
    "combination_pass_fail",
    lambda s, d: metrics.pass_fail(metrics.combinations(unique(s, d), "count"), MAIN).select("mask", "n", F.array_join("passed", ",").alias("passed"), F.array_join("failed", ",").alias("failed")),
    f"{MASKS} select mask, n, array_to_string(list_filter({NAMES}, lambda x, i: (mask >> (i - 1)) & 1 = 1), ',') as passed, "
    f"array_to_string(list_filter({NAMES}, lambda x, i: (mask >> (i - 1)) & 1 = 0), ',') as failed from c",
)
_add(
    "combination_labels_top10",
    lambda s, d: metrics.top_combinations(metrics.combinations(unique(s, d), "count"), 10).select(metrics.mask_label(MAIN).alias("label"), "n"),
    f"{MASKS} select case when mask = 7 then 'ALL PASS' else 'mask=0b' || bin(mask) end as label, n from c order by n desc, mask limit 10",
)
COUNTS = f"{RAW}, c as (select seq as sequence, count(*)::bigint as count from r group by 1), t as (select *, rank() over (order by count desc)::bigint as rank, count / (select sum(count) from c)::double * 1000000.0 as rpm from c)"
_add("count_sequences", lambda s, d: counting.count_sequences(reads(s, d)), f"{COUNTS} select sequence, count from c")
_add("count_rpm", lambda s, d: counting.with_rpm(counting.count_sequences(reads(s, d))), f"{COUNTS} select sequence, count, rpm from t")
_add("count_rank", lambda s, d: counting.with_rank(counting.count_sequences(reads(s, d))).select("sequence", "count", "rank"), f"{COUNTS} select sequence, count, rank from t")
_add(
    "count_table",
    lambda s, d: counting.ranked(counting.count_table(reads(s, d))),
    f"{COUNTS} select rank, sequence, count, rpm, strlen(sequence)::int as length from t",
)
_add(
    "count_by_sample",
    lambda s, d: counting.with_rank(
        counting.with_rpm(counting.count_sequences(reads(s, d).withColumn("sample", F.substring_index("id", "_", -1)), "sample"), "sample"), "sample"
    ).select("sample", "sequence", "count", "rpm", "rank"),
    f"{RAW}, c as (select split_part(id, '_', 2) as sample, seq as sequence, count(*)::bigint as count from r group by 1, 2) select sample, sequence, count, "
    "count / (sum(count) over (partition by sample))::double * 1000000.0 as rpm, rank() over (partition by sample order by count desc)::bigint as rank from c",
)
_add(
    "ranked_fasta_lines",
    lambda s, d: counting.fasta_header(counting.count_table(reads(s, d))).select("value"),
    f"{COUNTS} select concat('>', rank, '-', count, '-', printf('%.2f', rpm), chr(10), sequence) as value from t",
)
_add(
    "filtered_fastq_lines",
    lambda s, d: sinks.read_records(matching.valid(matching.annotate(reads(s, d), MAIN))),
    f"{M} select concat('@', id, chr(10), seq, chr(10), '+', chr(10), quality) as value from m where kind is null",
)
_add(
    "analysis_table",
    lambda s, d: pipelines.analysis_table(unique(s, d)),
    f"{M}, u as (select seq, count(*)::bigint as count, bool_and(kind is null) as is_valid, any_value(case when kind is null then substr(seq, s0::int + 1, l0::int) end) as random_region from m group by seq) "
    "select rank() over (order by count desc)::bigint as rank, seq as sequence, count, count / (select sum(count) from u)::double * 1000000.0 as rpm, strlen(seq)::int as length, is_valid, random_region from u",
)
JUDGED = (
    f"{RAW}, p as (select *, length(seq)::int as total_length, case when instr(seq, 'TTTTTT') > 0 then instr(seq, 'TTTTTT') - 1 end::int as upstream_length, "
    "case when instr(seq, 'TTTTTT') > 0 then length(seq) - instr(seq, 'TTTTTT') - 5 end::int as downstream_length from r), "
    "j as (select *, upstream_length is not null as ok_constant, total_length between 22 and 26 as ok_length, coalesce(abs(upstream_length - 16) <= 2, false) as ok_upstream, "
    "coalesce(abs(downstream_length) <= 1, false) as ok_downstream from p), v as (select *, ok_upstream and ok_downstream as ok_structure from j)"
)


def _judged(s: SparkSession, d: str, **more) -> DataFrame:
    return criteria.judge(reads(s, d), criteria.Criteria(**CRITERIA, **more))


_FLAGS = ["ok_constant", "ok_length", "ok_upstream", "ok_downstream", "ok_structure"]
_add("length_range", lambda s, d: _judged(s, d).select("id", "total_length", "ok_length"), f"{JUDGED} select id, total_length, ok_length from v")
_add(
    "upstream_downstream",
    lambda s, d: _judged(s, d).select("id", "upstream_length", "downstream_length", "ok_upstream", "ok_downstream", "ok_structure"),
    f"{JUDGED} select id, upstream_length, downstream_length, ok_upstream, ok_downstream, ok_structure from v",
)
_add(
    "structure_pairs",
    lambda s, d: criteria.structure_pairs(_judged(s, d)),
    f"{JUDGED} select upstream_length, downstream_length, count(*)::bigint as n, count(*)::double / (select count(*) from v where ok_constant) * 100.0 as percentage from v where ok_constant group by 1, 2",
)
_add("validate_and", lambda s, d: _judged(s, d).select("id", *_FLAGS, "valid"), f"{JUDGED} select id, {', '.join(_FLAGS)}, ok_constant and ok_length and ok_structure as valid from v")
_add("validate_or", lambda s, d: _judged(s, d, mode="or").select("id", *_FLAGS, "valid"), f"{JUDGED} select id, {', '.join(_FLAGS)}, ok_constant or ok_length or ok_structure as valid from v")
MEAN = "list_sum(list_transform(string_split(quality, ''), lambda x: ascii(x) - 33))::double / length(quality)"
_add(
    "mean_quality",
    lambda s, d: reads(s, d).select("id", "sequence", R.mean_quality(F.col("quality")).alias("mean_quality")),
    f"{RAW} select id, seq as sequence, {MEAN} as mean_quality from r",
)
for _name, _column in (("length_dist", "total_length"), ("upstream_dist", "upstream_length"), ("downstream_dist", "downstream_length")):
    _add(
        _name,
        lambda s, d, c=_column: criteria.length_distribution(_judged(s, d), c),
        f"{JUDGED} select {_column} as length, count(*)::bigint as n from v where {_column} is not null group by 1",
    )
_V = f"{JUDGED}, w as (select *, ok_constant and ok_length and ok_structure as valid from v) "
_add(
    "failure_reasons",
    lambda s, d: criteria.failure_reasons(_judged(s, d)),
    _V + " union all ".join(f"select '{f[3:]}' as reason, count(*) filter (not {f} and not valid)::bigint as n, count(*) filter (not {f} and not valid)::double / count(*) filter (not valid) * 100.0 as pct from w" for f in _FLAGS),
)
_add(
    "validation_summary",
    lambda s, d: criteria.validation_summary(_judged(s, d)),
    _V + " union all ".join(
        f"select '{f.removeprefix('ok_')}' as criterion, count(*) filter ({f})::bigint as n, count(*) filter ({f})::double / {b} * 100.0 as pct from w"
        for f, b in [("ok_constant", "count(*)"), ("ok_length", "count(*)"), *[(x, "count(*) filter (ok_constant)") for x in _FLAGS[2:]], ("valid", "count(*)")]
    ),
)
_add(
    "validate_quality_or",
    lambda s, d: criteria.judge(reads(s, d), criteria.Criteria("TTTTTT", min_length=26, min_quality=14.0, mode="or")).select("id", "sequence", "ok_constant", "ok_length", "ok_quality", "valid"),
    f"{RAW}, q as (select *, instr(seq, 'TTTTTT') > 0 as ok_constant, length(seq) >= 26 as ok_length, {MEAN} >= 14.0 as ok_quality from r) "
    "select id, seq as sequence, ok_constant, ok_length, ok_quality, ok_constant or ok_length or ok_quality as valid from q",
)


def _counts_back(s: SparkSession, d: str, kind: str) -> DataFrame:
    """The count table, written in a format and read back."""
    path = scratch(s, kind)
    sinks.write_counts(counting.count_table(reads(s, d)), path, kind)
    if kind == "parquet":
        return s.read.parquet(path)
    if kind == "fasta":
        back = read_reads(s, path)
        parts = F.split("id", "-")
        return back.select(parts[0].cast("bigint").alias("rank"), "sequence", parts[1].cast("bigint").alias("count"), parts[2].alias("rpm"))
    return s.read.option("header", True).option("sep", "," if kind == "csv" else "\t").schema("rank bigint, sequence string, count bigint, rpm string").csv(path)


def _reads_back(s: SparkSession, d: str, kind: str) -> DataFrame:
    """The reads, written as files and read back by the splitting readers."""
    path = scratch(s, kind)
    sinks.write_reads(reads(s, d), path, kind)
    if kind == "fastq.gz":
        return read_fastq_lines(s, path).select("id", "sequence", "quality")
    return read_reads(s, path).select("id", "sequence", "quality")


_TEXT = f"{COUNTS} select rank, sequence, count, printf('%.2f', rpm) as rpm from t"
_add("sink_parquet", lambda s, d: _counts_back(s, d, "parquet"), SQL["count_table"])
for _kind in ("csv", "tsv", "fasta"):
    _add(f"sink_{_kind}", lambda s, d, k=_kind: _counts_back(s, d, k), _TEXT)
for _name, _kind, _quality in (("source_fastq", "fastq", "quality"), ("source_fastq_gz", "fastq.gz", "quality"), ("source_fasta", "fasta", "cast(null as varchar) as quality")):
    _add(_name, lambda s, d, k=_kind: _reads_back(s, d, k), f"{RAW} select id, seq as sequence, {_quality} from r")


def _regions_back(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "random")
    sinks.write_random_regions(matching.valid(matching.annotate(reads(s, d), MAIN)), path)
    return read_reads(s, path).select("id", F.col("sequence").alias("random_region"))


_add("sink_random_regions", _regions_back, SQL["extract_random"])


def _filtered_back(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "filtered")
    sinks.write_reads(matching.valid(matching.annotate(reads(s, d), MAIN)), path, "fastq")
    return read_reads(s, path).select("id", "sequence", "quality")


_add("sink_filtered_reads", _filtered_back, SQL["valid_filter"])


def _report_rows(s: SparkSession, d: str) -> DataFrame:
    """The report's constants, from its JSON file."""
    path = f"{scratch(s, 'report')}.json"
    write_text(s, path, reports.as_json(reports.report(unique(s, d, near=True).persist(), MAIN, "count")))
    near = [F.col(f"c.near_miss.`{n}`").alias(f"near_{k + 1}") for k, n in enumerate(reports.NEAR)]
    rows = s.read.option("multiLine", True).json(path).select(F.explode("per_const_segment").alias("c"))
    return rows.select("c.sequence", "c.found", "c.not_found", "c.found_pct", *near)


_add("sink_report_json", _report_rows, f"select sequence, found, not_found, found_pct, near_1, near_2, near_3, near_4 from ({SQL['per_const_stats']})")
_add(
    "composition_rows",
    lambda s, d: metrics._composition_rows(unique(s, d), "count", "sequence"),
    SQL["composition"],
)


def analyze_end_to_end(s: SparkSession, d: str) -> DataFrame:
    """What the analyze command does with reads in a table: match, count, report, write; returns the written table."""
    path = scratch(s, "analyze")
    pool = pipelines.match_unique(pipelines.normalized(reads(s, d)), MAIN).persist()
    data = reports.report(pool, MAIN, "count")
    write_text(s, f"{path}.report.json", reports.as_json(data))
    sinks.write_parquet(counting.ranked(pipelines.analysis_table(pool)), f"{path}.parquet")
    pool.unpersist()
    return s.read.parquet(f"{path}.parquet")


_add("analyze_end_to_end", analyze_end_to_end, SQL["analysis_table"])
_ROUNDS = "select sequence, count(*)::bigint as count from (select seq as sequence, id from r) x where {} group by 1"
_add(
    "enrichment",
    lambda s, d: counting.enrichment(
        *[counting.count_sequences(reads(s, d).filter(F.substring_index("id", "_", -1).cast("int") % 2 == k)) for k in (0, 1)]
    ),
    f"{RAW}, a as ({_ROUNDS.format("split_part(id, '_', 2)::int % 2 = 0")}), b as ({_ROUNDS.format("split_part(id, '_', 2)::int % 2 = 1")}), "
    "x as (select *, count / (select sum(count) from a)::double * 1000000.0 as rpm from a), y as (select *, count / (select sum(count) from b)::double * 1000000.0 as rpm from b) "
    "select coalesce(x.sequence, y.sequence) as sequence, x.count as count_before, x.rpm as rpm_before, y.count as count_after, y.rpm as rpm_after, y.rpm / x.rpm as fold_change "
    "from x full join y on x.sequence = y.sequence",
)
