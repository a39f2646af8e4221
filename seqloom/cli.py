"""Command line: analyze, count, validate, criteria."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from seqloom.construct import Construct, parse_segment
from seqloom.operators.criteria import Criteria
from seqloom.plans import pipelines
from seqloom.sources.sinks import FORMATS

READ_FORMATS = ("auto", "fasta", "fastq", "fastq.gz")


def _list(text: str) -> tuple[str, ...]:
    names = tuple(x.strip() for x in text.split(",") if x.strip())
    if wrong := [x for x in names if x not in pipelines.REPORTS]:
        raise argparse.ArgumentTypeError(f"unknown report formats {wrong}; of {pipelines.REPORTS}")
    return names


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("seqloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "count", "validate", "criteria"):
        c = sub.add_parser(name)
        c.add_argument("-i", "--input", nargs=1 if name in ("validate", "criteria") else "+", required=True)
        c.add_argument("-o", "--output", required=True)
        c.add_argument("-t", "--threads", type=int, default=0, help="cores of a session on one machine; 0: as Spark is set up")
        c.add_argument("--quiet", action="store_true")
        if name != "criteria":
            c.add_argument("-q", dest="quiet", action="store_true")
        if name in ("analyze", "count"):
            c.add_argument("--rpm", action="store_true", help="accepted; reads per million are always written")
        if name == "count":
            c.add_argument("-f", "--format", choices=FORMATS, default="parquet")
            continue
        c.add_argument("--filter", action="store_true")
        c.add_argument("--filter-format", choices=READ_FORMATS, default="fasta" if name == "criteria" else "auto")
        c.add_argument("--multiqc", action="store_true")
        if name == "criteria":
            c.add_argument("-f", "--formats", type=_list, default=("txt", "json"))
            c.add_argument("-c", "--constant", required=True)
            c.add_argument("--validation-mode", choices=("and", "or"), default="and")
            for option in ("--min-length", "--max-length", "--upstream-length", "--downstream-length"):
                c.add_argument(option, type=int)
            for option in ("--upstream-tolerance", "--downstream-tolerance"):
                c.add_argument(option, type=int, default=0)
            c.add_argument("-q", "--min-quality", type=float)
            continue
        c.add_argument("--formats", type=_list, default=("json", "txt"))
        c.add_argument("--segment", action="extend", nargs="+", type=parse_segment, required=True)
        c.add_argument("--extract-random", action="store_true")
        c.add_argument("--strict-boundaries", action=argparse.BooleanOptionalAction, default=True)
        c.add_argument("--near-miss-depth", type=int, default=3)
        if name == "analyze":
            c.add_argument("--enrich", action="store_true", help="compare each input with the next")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("seqloom")
    if a.threads:
        builder = builder.master(f"local[{a.threads}]")
    spark = builder.getOrCreate()
    if a.command == "count":
        pipelines.count(spark, a.input, a.output, a.format, a.quiet)
        return
    shared = {"keep": a.filter, "kind": a.filter_format, "multiqc": a.multiqc, "formats": a.formats, "quiet": a.quiet}
    if a.command == "criteria":
        wanted = Criteria(
            a.constant, a.min_length, a.max_length, a.upstream_length, a.upstream_tolerance, a.downstream_length, a.downstream_tolerance,
            a.min_quality, a.validation_mode,
        )
        pipelines.validate_criteria(spark, a.input[0], a.output, wanted, **shared)
        return
    shared |= {"construct": Construct(tuple(a.segment)), "strict": a.strict_boundaries, "depth": a.near_miss_depth, "extract": a.extract_random}
    if a.command == "analyze":
        pipelines.analyze(spark, a.input, a.output, enrich=a.enrich, **shared)
    else:
        pipelines.validate(spark, a.input[0], a.output, **shared)


if __name__ == "__main__":
    main()
