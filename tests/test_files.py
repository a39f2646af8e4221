import gzip
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seqloom import cli
from seqloom.sources import sinks
from seqloom.sources.fastx import FastxError, parse, read_fasta_lines, read_fastq_lines, read_fastx, read_reads, sample_name
from seqloom.streaming.reads import SCHEMA, matched_stream, read_stream, running_counts

FASTQ = "@r1 x\nAAAAAAGCATGCATGCTTTTTT\n+\n@" + "I" * 21 + "\n@r2\nAAAAAAGCTTTTTT\n+\n" + "I" * 14 + "\n"


def test_sample_names():
    assert [sample_name(p) for p in ("/a/b.fastq.gz", "c.fq", "d.fasta", "e.x.fasta")] == ["b", "c", "d", "e.x"]
    assert sample_name("dir/pool.fastq") == "pool"


def test_parse_rejects_broken_records():
    for bad in (["@a", "ACG", "+"], ["@a", "ACG", "+", "II"], ["@a", "ACG", "x", "III"], ["ACG"]):
        with pytest.raises(FastxError):
            list(parse(iter(bad)))
    assert list(parse(iter([">a b", "AC", "GT", ">c", ""]))) == [("a b", "ACGT", None), ("c", "", None)]
    assert list(parse(iter([]))) == []


def test_commands_write_their_files(spark, tmp_path, capsys):
    src = tmp_path / "pool.fastq.gz"
    src.write_bytes(gzip.compress(FASTQ.encode()))
    rows = read_fastx(spark, str(src)).orderBy("id").collect()
    assert [(r.id, r.sequence, r.quality[0]) for r in rows] == [("r1 x", "AAAAAAGCATGCATGCTTTTTT", "@"), ("r2", "AAAAAAGCTTTTTT", "I")]
    out = str(tmp_path / "new" / "out")
    segments = ["--segment", "const:AAAAAA", "rand:8-12", "--segment", "const:TTTTTT"]
    cli.main(["analyze", "-i", str(src), "-o", out, *segments, "--filter", "--extract-random", "--multiqc", "--rpm", "--formats", "txt,json,csv"])
    assert "2 total reads, 2 unique sequences" in capsys.readouterr().err
    table = spark.read.parquet(out + ".parquet")
    assert table.columns == ["rank", "sequence", "count", "rpm", "length", "is_valid", "random_region"]
    assert {(r.is_valid, r.random_region) for r in table.collect()} == {(True, "GCATGCATGC"), (False, None)}
    assert spark.read.text(out + ".filtered.fq").count() == 4 and spark.read.text(out + ".random.fa").count() == 2
    data = json.loads(open(out + ".report.json").read())
    assert data["summary"] == {"total_reads": 2, "valid": 1, "valid_pct": 50.0, "invalid": 1}
    assert data["per_const_segment"][0] == {"sequence": "AAAAAA", "found": 2, "found_pct": 100.0, "not_found": 0, "near_miss": {"1mm": 0, "2mm": 0, "3mm": 0, "4mm+": 0}}
    assert data["per_rand_segment"] == [{"expected_range": "8-12", "in_range": 1, "in_range_pct": 50.0, "out_of_range": 1, "length_distribution": {"2": 1, "10": 1}}]
    assert data["composition"][0][0] == {"position": 1, "A": 0, "T": 0, "G": 1, "C": 0, "A_pct": 0.0, "T_pct": 0.0, "G_pct": 100.0, "C_pct": 0.0}
    best = data["combinations"][0]
    assert (best["pass"], best["fail"], best["count"], best["pct"]) == (["const_0", "const_1"], ["rand_0"], 1, 50.0)
    text, mqc = open(out + ".report.txt").read(), json.loads(open(out + "_mqc.json").read())["data"]["pool"]
    assert "Combinations" in text and "Invalid: 1 (50.00%)" in text and mqc["pass_rate"] == 50.0 and mqc["const_1_rate"] == 100.0
    assert open(out + ".length_dist.csv").read() == "rand,length,count\n0,2,1\n0,10,1\n"
    assert json.loads(open(out + ".parquet/_facts.json").read())["seqloom.total_reads"] == "2"
    for kind in ("csv", "tsv", "fasta", "parquet"):
        cli.main(["count", "-i", str(src), "-o", out + "c", "-f", kind])
    head = spark.read.option("header", True).csv(out + "c.csv")
    assert head.columns == ["rank", "sequence", "count", "rpm"] and {r.rpm for r in head.collect()} == {"500000.00"}
    assert read_fasta_lines(spark, out + "c.fasta").filter(F.length("sequence") > 0).count() == 2
    capsys.readouterr()
    cli.main(["validate", "-i", str(src), "-o", out + "v", "-q", *segments])
    assert capsys.readouterr().err == ""
    with pytest.raises(Exception):
        read_fastx(spark, __file__).collect()


def test_criteria_command(spark, tmp_path):
    src, out = tmp_path / "pool.fq", str(tmp_path / "c")
    src.write_text(FASTQ)
    cli.main(["criteria", "-i", str(src), "-o", out, "-c", "tttttt", "--min-length", "20", "--upstream-length", "16", "--downstream-length", "0", "-q", "30", "-f", "txt,csv,json", "--multiqc", "--filter", "--filter-format", "fastq.gz", "--quiet"])
    data = json.loads(open(out + ".stats.json").read())
    assert data["summary"]["valid"] == 1 and {r["criterion"]: r["n"] for r in data["validation"]} == {"constant": 2, "length": 1, "upstream": 1, "downstream": 2, "structure": 1, "quality": 2}
    assert {r["reason"]: r["n"] for r in data["failures"]}["length"] == 1 and "Structure pairs" in open(out + ".validation.txt").read()
    rows = lambda name: [tuple(r) for r in spark.read.option("header", True).csv(f"{out}.{name}.csv").collect()]
    assert rows("length_dist") == [("14", "1"), ("22", "1")] and rows("upstream_dist") == [("8", "1"), ("16", "1")] and rows("downstream_dist") == [("0", "2")]
    assert rows("structure_pairs") == [("8", "0", "1", "50.00"), ("16", "0", "1", "50.00")]
    assert [r.id for r in read_reads(spark, out + ".filtered.fq.gz/*.gz").collect()] == ["r1 x"]
    mqc = json.loads(open(out + "_mqc.json").read())["data"]["pool"]
    assert mqc["validation_mode"] == "AND" and mqc["failed_length"] == 1 and mqc["structure_rate"] == 50.0


def test_enrichment_command(spark, tmp_path):
    for name, reads in (("r1", ["AC", "AC", "GT"]), ("r2", ["AC", "TT", "TT", "TT"])):
        (tmp_path / f"{name}.fa").write_text("".join(f">x{i}\n{r}\n" for i, r in enumerate(reads)))
    out = str(tmp_path / "out")
    cli.main(["analyze", "-i", str(tmp_path / "r1.fa"), str(tmp_path / "r2.fa"), "-o", out, "--segment", "const:AC", "--enrich", "-q"])
    rows = {r.sequence: r for r in spark.read.option("header", True).csv(out + "/r1-r2.enrichment.csv").collect()}
    assert rows.keys() == {"AC", "GT", "TT"} and float(rows["AC"].fold_change) == pytest.approx(3 / 8) and rows["TT"].count_before is None


def test_splitting_readers(spark, tmp_path):
    import random

    rng, records = random.Random(1), []
    for i in range(400):
        n = rng.choice([0, 1, 5, 30, 200])
        records.append((f"r{i} x", "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@I+>!") for _ in range(n))))
    text = "".join(f"@{a}\n{b}\n+\n{q}\n" for a, b, q in records)
    folder = tmp_path / "a b+c"
    folder.mkdir()
    (folder / "p.fastq").write_text(text + "\n\n")
    (folder / "z.fq.gz").write_bytes(gzip.compress(text.replace("\n", "\r\n").encode()))
    (folder / "f.fa").write_text("".join(f">{a}\n{b[:50]}\n{b[50:]}\n" for a, b, _ in records))
    (folder / "bad.fq").write_text(text[:-9])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in ("2500", "64k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_reads(spark, str(folder / "p.fastq")).collect()
            assert sorted((r.id, r.sequence, r.quality) for r in got) == sorted(records) and {r["sample"] for r in got} == {"p"}
        both = read_reads(spark, str(folder / "f.fa"), str(folder / "z.fq.gz")).collect()
        assert sorted((r.id, r.sequence, r.quality) for r in both if r["sample"] == "z") == sorted(records)
        assert sorted((r.id, r.sequence) for r in both if r["sample"] == "f") == sorted(x[:2] for x in records)
        with pytest.raises(Exception, match="malformed"):
            read_reads(spark, str(folder / "bad.fq")).collect()
        assert len(read_reads(spark, str(folder / "bad.fq"), mode="PERMISSIVE").collect()) == len(records) - 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_fastq_passes(spark, tmp_path, monkeypatch):
    records = [(f"r{i}", "ACGT"[: i % 5], "+@I!"[: i % 5]) for i in range(500)]
    text = "".join(f"@{a}\n{b}\n+{a if int(a[1:]) % 3 else ''}\n{q}\n" for a, b, q in records)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted((r.id, r.sequence, r.quality) for r in df.collect())
    for name in ("a.fq", "b.fq"):
        (tmp_path / name).write_text(text)
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(text[:999].encode()) + gzip.compress(text[999:].encode()))
    packed = read_fastq_lines(spark, str(tmp_path / "*.gz"))
    assert rows(packed) == sorted(records * 2) and plan(packed).count("FileScan text") == 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        plain = read_fastq_lines(spark, str(tmp_path / "?.fq"))
        assert rows(plain) == sorted(records * 2) and "ReusedExchange" in plan(plain).split("Initial Plan")[0]
        assert rows(read_fastq_lines(spark, str(tmp_path))) == sorted(records * 4)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for end, good in (("@x\nA\n+\n+", 1), ("@x\nA\n+\n@", 1), ("@x\nA\n+", 0), ("@x\nAC\n+\n+", 0), ("@x\nAC\n+\n", 0), ("x", 0), ("\n \n", None), ("", None)):
        for name in ("end.fq", "end.fq.gz"):
            (tmp_path / name).write_bytes(gzip.compress((text + end).encode()) if name.endswith("gz") else (text + end).encode())
            if good == 0:
                with pytest.raises(Exception, match="malformed"):
                    read_fastq_lines(spark, str(tmp_path / name)).collect()
            got = rows(read_fastq_lines(spark, str(tmp_path / name), mode="PERMISSIVE"))
            assert got == sorted(records + ([("x", "A", end[-1])] if good else []))
    monkeypatch.setattr(sinks, "GZIP_RECORDS", 100)
    sinks.write_reads(packed, str(tmp_path / "out"), "fastq.gz")
    assert len(list((tmp_path / "out").glob("*.gz"))) == 10 and rows(read_fastq_lines(spark, str(tmp_path / "out"))) == sorted(records * 2)


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", "AAAAAAGCATGCATGCTTTTTT", None), ("b", "acgt", None), ("c", "acgt", None)], SCHEMA).write.parquet(folder)
    from seqloom.construct import Construct

    matched = matched_stream(read_stream(spark, folder), Construct.parse("const:AAAAAA", "rand:8-12", "const:TTTTTT"))
    q = matched.select("id", "matched").writeStream.format("memory").queryName("seqloom_matched").start()
    r = running_counts(read_stream(spark, folder)).writeStream.format("memory").queryName("seqloom_counts").outputMode("complete").start()
    q.processAllAvailable(), r.processAllAvailable(), q.stop(), r.stop()
    assert {(x.id, x.matched) for x in spark.table("seqloom_matched").collect()} == {("a", True), ("b", False), ("c", False)}
    assert {x.sequence: x["count"] for x in spark.table("seqloom_counts").collect()} == {"AAAAAAGCATGCATGCTTTTTT": 1, "acgt": 2}


def test_contract(spark):
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() > 0
