"""Personal data: patterns for direct identifiers, and corpus co-occurrence for terms that give them away.

Direct identifiers (emails, addresses of machines, payment cards, phone numbers) are found by
patterns. The nearest terms (runs of letters) on both sides, up to the next identifier, are an identifier's context. Over all
documents it is counted how many hold the identifier, how many hold the term, and how many hold the term in the identifier's
context. A term discloses an identifier when their pointwise mutual information comes close to the
identifier's whole information content: from ``generalise_at`` of it on the term is generalised, from
``remove_at`` on removed. A pair counts only if it stands in ``min_contexts`` different contexts, so copies of
one text disclose nothing by themselves. Everything is DataFrame functions.

A text with many matches takes time in proportion to its length: offsets are running sums taken in two levels, and texts between
matches are cut from pieces of PIECE letters.

Defined results: a null text is empty and has no spans. Texts of any length are searched whole. Repeated rows get equal spans,
whatever their doc_id. Of terms that disclose several identifiers the strictest action holds. An empty table gives an empty
result. Input columns named like a result column are replaced, columns of other names pass through.
Offsets are code points of the original text, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import ascii_lower, durable, fenced_filter, hot_keys, small_or_plain, spread_join, unused

#: Patterns take whole runs at once and start only where a run starts or the last match ended, so long runs stay linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: What is done with a disclosing term; ranks after those of KINDS.
ACTIONS = ("generalise", "remove")
GENERALISE, REMOVE = len(KINDS), len(KINDS) + 1
#: Running values are taken in chunks of so many.
CHUNK = 128
PIECE = 1024
RESULTS = ("spans", "sanitised")
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i) % 2 == 1
        return total + F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind == "ip":
        return value.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$")
    if kind == "card":
        return F.when(F.length(_digits(value)) <= 19, _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _possible(kind: str, t: Column) -> Column:
    """A cheap test that spares most texts the pattern."""
    sign = {"email": "@", "phone": "+"}.get(kind)
    digits = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"}.get(kind)
    return F.contains(t, F.lit(sign)) if sign else t.rlike(digits)


def _running(values: str, fold: Callable[[Column, Column], Column]) -> Column:
    """The running fold of a column of numbers from 0 on, each value included: within chunks, from the fold of the chunks before.

    It has to be a column: an expression would be computed again for every chunk.
    """
    n = F.size(values)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda j: F.slice(values, j * CHUNK + 1, CHUNK))
    none = F.array().cast("array<int>")

    def before(acc: Column, chunk: Column) -> Column:
        return F.struct(F.aggregate(chunk, acc["at"], fold).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    def inside(acc: Column, x: Column) -> Column:
        at = fold(acc["at"], x)
        return F.struct(at.alias("at"), F.array_append(acc["out"], at).alias("out"))

    starts = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), none.alias("out")), before)["out"]
    parts = F.zip_with(chunks, starts, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), inside)["out"])
    return F.when(n > 0, F.flatten(parts)).otherwise(none)


def _steps(found: Column, gaps: Column) -> Column:
    """From the end of each match to the end of the next, from the texts between them."""
    return F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))


def _located(found: str, ends: str, rank: Callable[[Column], Column]) -> Column:
    """Matches as spans."""
    return F.zip_with(
        found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), rank(m).alias("rank"), e.alias("end"), m.alias("value"))
    )


def _add(a: Column, b: Column) -> Column:
    return a + b


def find_direct(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add spans: the direct identifiers of each text by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    out = docs.drop(*[r for r in RESULTS if r != text])
    own = unused(out, *[f"_{k}{x}" for k in PATTERNS for x in ("", "_steps", "_ends")])
    names = {k: own[3 * i : 3 * i + 3] for i, k in enumerate(PATTERNS)}
    out = out.withColumns({names[k][0]: F.when(_possible(k, t), F.regexp_extract_all(t, F.lit(p), 0)).otherwise(none) for k, p in PATTERNS.items()})
    no_steps = F.array().cast("array<int>")
    out = out.withColumns({names[k][1]: F.when(F.size(names[k][0]) > 0, _steps(F.col(names[k][0]), F.split(t, p, -1))).otherwise(no_steps) for k, p in PATTERNS.items()})
    out = out.withColumns({names[k][2]: _running(names[k][1], _add) for k in PATTERNS})
    spans = []
    for rank, k in enumerate(PATTERNS):
        located = F.filter(_located(names[k][0], names[k][2], lambda m, r=rank: F.lit(r)), partial(_valid, k))
        spans.append(F.when(F.size(names[k][0]) > 0, located).otherwise(F.array().cast(SPAN)))
    return out.withColumn("spans", F.sort_array(F.concat(*spans))).drop(*own)


def _entity(s: Column) -> Column:
    """An identifier's normal form: rank and lower-cased value, of numbers the digits."""
    plain = F.when(s["rank"] >= 2, _digits(s["value"])).otherwise(ascii_lower(s["value"]))
    return F.concat(s["rank"].cast("string"), F.lit(":"), plain)


def _terms(t: Column) -> Column:
    """Runs of letters, A-Z lower-cased."""
    return F.regexp_extract_all(ascii_lower(t), F.lit(r"\p{L}+"), 0)


def _words(text: str) -> Column:
    """The distinct runs of letters of a text, A-Z lower-cased."""
    return F.array_distinct(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), r"\P{L}+"))


def _reached(df: DataFrame, spans: str, name: str) -> DataFrame:
    """Add name: how far the spans before each reach, 0 for the first."""
    ends, reach = unused(df, "_span_ends", "_reach")
    df = df.withColumn(ends, F.transform(spans, lambda s: s["end"]))
    df = df.withColumn(reach, F.concat(F.array(F.lit(0)), _running(ends, lambda a, b: F.greatest(a, b))))
    return df.withColumn(name, F.col(reach)).drop(ends, reach)


def _between(df: DataFrame, text: str, spans: str, gaps: str) -> DataFrame:
    """Add gaps: the texts before each span (empty where it overlaps one before it) and the one after the last."""
    pieces, reach = unused(df, "_pieces", "_reached")
    t = F.coalesce(F.col(text), F.lit(""))
    df = _reached(df, spans, reach).withColumn(pieces, F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), 0))

    def cut(low: Column, high: Column) -> Column:
        first = F.floor(low / PIECE).cast("int")
        some = F.array_join(F.slice(F.col(pieces), first + 1, F.floor(high / PIECE).cast("int") - first + 1), "")
        return F.when(high > low, F.substring(some, low - first * PIECE + 1, high - low)).otherwise("")

    parts = F.zip_with(spans, F.slice(reach, 1, F.size(spans)), lambda s, low: cut(low, s["start"]))
    tail = cut(F.element_at(reach, -1), F.length(t))
    return df.withColumn(gaps, F.concat(parts, F.array(tail))).drop(pieces, reach)


def contexts(found: DataFrame, width: int, text: str) -> DataFrame:
    """One row for each entity, term and context of a document: e, t, c."""
    (gaps,) = unused(found, "_gaps")
    found = _between(found.select(text, "spans"), text, "spans", gaps)
    (terms,) = unused(found, "_near")
    found = found.select("spans", F.transform(gaps, _terms).alias(terms))

    def of(s: Column, i: Column) -> Column:
        before, after = F.get(F.col(terms), i), F.get(F.col(terms), i + 1)
        near = F.concat(F.slice(before, F.greatest(F.size(before) - width + 1, F.lit(1)), F.lit(width)), F.slice(after, 1, width))
        return F.struct(_entity(s).alias("e"), F.array_distinct(near).alias("ts"), F.xxhash64(near).alias("c"))

    # As texts, which are told apart by hashing; structs would be compared one by one.
    pairs = F.flatten(F.transform(F.transform("spans", of), lambda x: F.transform(x["ts"], lambda t: F.concat_ws("\n", x["e"], t, x["c"].cast("string")))))
    parts = F.split(F.col("p"), "\n")
    return found.select(F.explode(F.array_distinct(pairs)).alias("p")).select(parts[0].alias("e"), parts[1].alias("t"), parts[2].alias("c"))


def disclosing_terms(
    docs: DataFrame, holders: DataFrame, width: int = 4, min_contexts: int = 3, generalise_at: float = 0.8,
    remove_at: float = 0.95, text: str = "text",
) -> DataFrame:
    """Pairs of entity and term over the threshold: e, t, n_t (texts that hold t), ratio, remove. holders: the documents with spans.

    All counts are sums of partial sums, so an identifier or a term of a third of all documents is a row of each task. The terms of
    all documents are counted before they meet the pairs: the joins have a row for each pair, and an identifier has no more pairs than there are terms.
    """
    near = contexts(holders, width, text)
    pairs = (
        near.groupBy("e", "t", "c").agg(F.count("*").alias("n"))
        .groupBy("e", "t").agg(F.sum("n").alias("n_te"), F.count("*").alias("n_c"))
        .filter(F.col("n_c") >= min_contexts)
    )
    pairs = durable(pairs, "pairs")
    entities = F.array_distinct(F.transform("spans", _entity))
    n_e = holders.select(F.explode(entities).alias("e")).groupBy("e").agg(F.count("*").alias("n_e"))
    n_t = docs.select(F.explode(_words(text)).alias("t")).groupBy("t").agg(F.count("*").alias("n_t"))
    many = F.lit(float(max(docs.count(), 1)))
    scored = pairs.join(n_e, "e").join(n_t, "t").withColumn("n_te", F.least("n_te", "n_e", "n_t"))
    information = F.log(many / F.col("n_e"))
    mutual = F.log(F.col("n_te") * many / (F.col("n_t") * F.col("n_e")))
    ratio = F.when(information > 0, mutual / information)
    scored = scored.select("e", "t", "n_t", ratio.alias("ratio")).filter(F.col("ratio") >= generalise_at)
    return scored.withColumn("remove", F.col("ratio") >= remove_at)


def find_personal_data(docs: DataFrame, text: str = "text", broadcast_bytes: int | None = None, **limits) -> DataFrame:
    """Add spans: direct identifiers and the terms that disclose one, as structs of start, rank, end, value.

    A term that discloses any identifier has a span wherever it stands, in documents without identifiers too.
    rank 0 to 3 are the kinds of PATTERNS, GENERALISE and REMOVE are terms with what is to be done. The disclosing terms, and
    the terms by text, are sent to all tasks if their measured size allows (broadcast_bytes); else texts are shuffled to them,
    and terms or texts of very many rows to several tasks each.
    """
    found = find_direct(docs, text)
    holders = durable(fenced_filter(found, F.size("spans") > 0).select(text, "spans"), "holders")
    pairs = disclosing_terms(docs, holders, text=text, **limits)
    terms = durable(pairs.groupBy("t").agg(F.max("remove").alias("remove"), F.max("n_t").alias("n_t")), "terms")
    small, fits = small_or_plain(terms.drop("n_t"), F.octet_length("t"), broadcast_bytes)
    each = docs.select(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.explode(_words(text)).alias("t"))
    if fits:
        held = each.join(small, "t")
    else:
        held = spread_join(each, terms.drop("n_t"), ["t"], hot_keys(terms, ["t"], "n_t"))
    # Copies of a text have one key and one set of terms.
    words = durable(held.groupBy("key").agg(F.collect_set(F.struct("t", "remove")).alias("terms"), F.count("*").alias("n")), "disclosing")
    key, own, pattern, matched = unused(found, "_key", "_terms", "_pattern", "_found")
    size = F.lit(32) + F.aggregate("terms", F.lit(0), lambda n, t: n + F.octet_length(t["t"]) + 24)
    small, fits = small_or_plain(words, size, broadcast_bytes)
    out = found.withColumn(key, F.md5(F.coalesce(F.col(text), F.lit(""))))
    names = {"key": key, "terms": own}
    if fits:
        out = out.join(small.drop("n").withColumnsRenamed(names), key, "left")
    else:
        hot = hot_keys(words.select(F.col("key").alias(key), "n"), [key])
        out = spread_join(out, words.drop("n").withColumnsRenamed(names), [key], hot, "left")
    t = F.coalesce(F.col(text), F.lit(""))
    any_term = F.array_join(F.transform(F.array_sort(own), lambda x: x["t"]), "|")
    out = out.withColumn(pattern, F.when(F.size(own) > 0, F.concat(F.lit(r"(?i)(?<!\p{L})(?:"), any_term, F.lit(r")(?!\p{L})"))))
    out = out.withColumn(matched, F.when(F.col(pattern).isNotNull(), F.regexp_extract_all(t, F.col(pattern), F.lit(0))))
    gone, steps, ends = unused(out, "_gone", "_steps", "_ends")
    out = out.withColumns(
        {
            gone: F.transform(F.filter(own, lambda x: x["remove"]), lambda x: x["t"]),
            steps: F.when(F.size(matched) > 0, _steps(F.col(matched), F.split(t, F.col(pattern), -1))).otherwise(F.array().cast("array<int>")),
        }
    )
    out = out.withColumn(ends, _running(steps, _add))
    rank = lambda m: F.when(F.array_contains(F.col(gone), ascii_lower(m)), REMOVE).otherwise(GENERALISE)
    more = F.sort_array(F.concat("spans", _located(matched, ends, rank)))
    return out.withColumn("spans", F.when(F.size(matched) > 0, more).otherwise(F.col("spans"))).drop(key, own, pattern, matched, gone, steps, ends)


def span_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined; a term's kind is what is to be done with it."""
    kind = F.array(*[F.lit(k) for k in (*KINDS, *ACTIONS)])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def sanitise(found: DataFrame, text: str = "text") -> DataFrame:
    """Add sanitised: identifiers and generalised terms become a tag, removed terms vanish; of overlapping spans the first counts."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit("[TERM]"), F.lit(""))
    gaps, before = unused(found, "_gaps", "_before")
    n = F.size("spans")
    found = _reached(_between(found, text, "spans", gaps), "spans", before)
    # A span that begins before an earlier one ends has no tag of its own; the text goes on where the last of them ends.
    said = F.zip_with("spans", F.slice(before, 1, n), lambda s, b: F.when(s["start"] >= b, F.get(tags, s["rank"])).otherwise(""))
    pieces = F.zip_with(F.slice(gaps, 1, n), said, lambda g, tag: F.concat(g, tag))
    out = F.concat(F.array_join(pieces, ""), F.element_at(gaps, -1))
    t = F.coalesce(F.col(text), F.lit(""))
    return found.withColumn("sanitised", F.when(n > 0, out).otherwise(t)).drop(gaps, before)
