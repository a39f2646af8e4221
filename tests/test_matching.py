import random

import pytest
from pyspark.sql import functions as F

from seqloom.construct import Construct
from seqloom.functions.reads import min_hamming, near_miss_bucket, normalize, two_decimals
from seqloom.operators import counting, criteria, matching, metrics

MAIN = Construct.parse("const:AAAAAA", "rand:8-12", "const:TTTTTT")
SPECS = [
    (("const:ATCG", "rand:5-10", "const:GCTA"), True), (("const:ATCG", "rand:3-5", "const:GCTA"), False),
    (("rand:0-5", "const:ATCG", "rand:3-5", "const:GCTA"), True), (("const:AAAA", "const:TTTT"), True), (("const:ATCG",), True),
    (("const:AAA", "rand:2-4", "const:TTT", "rand:1-3", "const:GGG"), True), (("const:AT", "rand:0-3"), True), (("rand:1-2", "const:AT", "rand:0-3"), True),
]
READS = [
    "ATCGNNNNNNGCTA", "ATCGNNGCTA", "XXATCGNNNGCTA", "AAAATTTT", "AAAAGGTTTT", "atcg", "AAANNNTTTNNGGG", "TTTTAAAA", "", "A", "ATNNN", "GATA", "ATATAT",
    "ATCGATCGNNNGCTAGCTA",
]


def plain(read, construct, strict):
    """An independent matcher: failure, mask, region lengths."""
    read, at, spots, mask = read.upper(), 0, [], 0
    for k, c in enumerate(construct.consts):
        p = read.find(c, at)
        if p < 0:
            return ("ConstNotFound", k), mask, []
        spots.append((p, p + len(c)))
        at, mask = p + len(c), mask | 1 << k
    gaps = [spots[0][0], *[b[0] - a[1] for a, b in zip(spots, spots[1:])], len(read) - spots[-1][1]]
    failure, sizes = None, []
    for n, (before, r) in enumerate(construct.rands):
        sizes.append(gaps[before])
        if r.min_len <= gaps[before] <= r.max_len:
            mask |= 1 << (len(construct.consts) + n)
        else:
            failure = failure or ("RandOutOfRange", n)
    if strict and not construct.starts_open and gaps[0]:
        failure = failure or ("LeadingGap", gaps[0])
    if strict and not construct.ends_open and gaps[-1]:
        failure = failure or ("TrailingGap", gaps[-1])
    return failure, mask, sizes


@pytest.mark.parametrize("spec", SPECS)
def test_against_plain_matcher(spark, spec):
    construct, strict = Construct.parse(*spec[0]), spec[1]
    rng = random.Random(3)
    reads = READS + ["".join(rng.choice(["A", "T", "AT", "ATCG", "GCTA", "AAA", "TTT", "GGG", "N"]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    rows = matching.annotate(spark.createDataFrame([(r,) for r in reads], "sequence string"), construct, strict).collect()
    for r in rows:
        failure, mask, sizes = plain(r.sequence, construct, strict)
        assert (tuple(r.failure) if r.failure else None, r.mask, [x.length for x in r.rand_regions]) == (failure, mask, sizes), r.sequence
        assert r.matched == (failure is None)
        if failure and failure[0] == "ConstNotFound":
            assert len(r.const_matches) == failure[1] + 1 and r.const_matches[-1] is None and r.leading_gap == r.trailing_gap == 0


def test_fixture_of_eleven_reads(spark):
    a, t = "A" * 6, "T" * 6
    reads = [
        a + "N" * 10 + t, a + "N" * 10 + t, a + "GCATGCATGC" + t, a + "N" * 8 + t, a + "NN" + t, a + "N" * 14 + t, a + "N" * 10 + "N" * 6, "N" * 16 + t,
        "GG" + a + "N" * 10 + t, a + "N" * 10 + t + "CC", a + "N" * 10 + t,
    ]
    df = spark.createDataFrame([(r,) for r in reads], "sequence string")
    once = matching.near_miss(matching.annotate(counting.count_sequences(df), MAIN), MAIN)
    each = matching.near_miss(matching.annotate(df, MAIN), MAIN)
    for data, w in ((once, "count"), (each, None)):
        s = metrics.summary(data, w).first()
        assert (s.total_reads, s.valid, s.invalid) == (11, 5, 6)
        assert {r.mask: r.n for r in metrics.combinations(data, w).collect()} == {7: 7, 3: 2, 1: 1, 0: 1}
        assert [(r.found, r.not_found, r.near_1, r.near_4) for r in metrics.per_const(data, MAIN, w).orderBy("const_idx").collect()] == [(10, 1, 0, 0), (9, 1, 0, 0)]
        assert {r.length: r.n for r in metrics.rand_length_dist(data, w).collect()} == {2: 1, 8: 1, 10: 6, 14: 1}
        rows = metrics.composition(data, MAIN, w).orderBy("position").collect()
        assert len(rows) == 10 and [(r.A, r["T"], r.G, r.C) for r in rows[:3]] == [(0, 0, 1, 0), (0, 0, 0, 1), (1, 0, 0, 0)]
    table = counting.count_table(df).orderBy(F.desc("count")).collect()
    assert len(table) == 9 and (table[0].rank, table[0]["count"]) == (1, 3) and {r.rank for r in table[1:]} == {2}
    assert counting.fasta_header(counting.count_table(df)).orderBy(F.desc("count")).first().value.startswith(">1-3-272727.27\n")


def test_near_miss_and_normalise(spark):
    df = spark.createDataFrame([("ATCGATCG",), ("AXCG",), ("AT",), (None,)], "s string")
    assert [r[0] for r in df.select(min_hamming(F.col("s"), "ATCG")).collect()] == [0, 1, None, None]
    assert [r[0] for r in spark.range(6).select(near_miss_bucket(F.col("id"), 4)).collect()] == [3, 0, 1, 2, 3, None]
    odd = spark.createDataFrame([("acgu. ~\tRX-n",)], "s string")
    assert odd.select(normalize(F.col("s"))).first()[0] == "ACGT--NN-N"
    before = matching.near_miss(matching.annotate(spark.createDataFrame([("TTTTAAAA",)], "sequence string"), Construct.parse("const:AAAA", "const:TTTT")), Construct.parse("const:AAAA", "const:TTTT"))
    assert before.first()["_b1"] == 3


def test_two_decimals_halves_to_even(spark):
    values = [1953.125, 1.015, 2.5, 0.125, 0.375, 272727.2727272727, 0.0, 0.999, 3.0, *[k / 1000 for k in range(5, 1000, 10)], *[7 + k / 1000 for k in range(5, 1000, 10)]]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(two_decimals(F.col("v"))).collect()]
    assert got == [f"{v:.2f}" for v in values]


def test_criteria(spark):
    df = spark.createDataFrame([("AAACCGGG", "IIIIIIII"), ("AACCGG", "!!!!!!"), ("GGGG", "IIII")], "sequence string, quality string")
    c = {"constant": "cc", "min_length": 8, "upstream": 3, "downstream": 3, "min_quality": 20.0}
    both = criteria.judge(df, criteria.Criteria(**c)).collect()
    assert [r.valid for r in both] == [True, False, False]
    either = criteria.judge(df, criteria.Criteria(**c, mode="or"))
    assert [r.valid for r in either.collect()] == [True, True, True]
    assert criteria.structure_pairs(either).count() == 2
