"""The pipeline's stages, and the whole of it against a plain version."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import VOCABULARY, classes, plain_fingerprint, prose, repeats
from tokenizers import Tokenizer

SF_DIR = "/root/testdata/sf0.001"


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def passes(t):
    """No rule of the policy fails."""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = len(words), sum(map(len, words))
    return not (
        n < 20 or 100 * repeats(words) > 30 * n or 100 * len(re.findall(r"[#*$%&|<>]", t)) > 25 * n or 100 * len(re.findall("[A-Z]", t)) > 30 * chars
        or 100 * len(re.findall("[!?]", t)) > 25 * n or 100 * (len(lines) - len(set(lines))) > 60 * len(lines) or chars < 2 * n or chars > 15 * n
    )


def without_common_lines(docs):
    def key(x):
        return lowered(x.strip(" \t\n\x0b\f\r"))

    counts = Counter(k for t in docs.values() for k in {key(x) for x in t.split("\n")} if k)
    left = {i: [x for x in t.split("\n") if counts[key(x)] < 10] for i, t in docs.items()}
    return {i: "\n".join(x) for i, x in left.items() if x}


def representatives(docs):
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    root = classes(sorted(set(fps.values())))
    first = {}
    for i in sorted(docs):
        first.setdefault(root[fps[i]], i)
    return {i: docs[i] for i in first.values()}


def clean(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t or ""))

    windows = set()
    for w in map(words, items):
        windows |= {" " + " ".join(w[k : k + 10]) + " " for k in range(max(1, len(w) - 9) if w else 0)}
    joined = {i: " " + " ".join(words(t)) + " " for i, t in docs.items()}
    return {i: t for i, t in docs.items() if not any(w in joined[i] for w in windows)}


def encoded(docs):
    tokenizer, out = Tokenizer.from_file(VOCABULARY), set()
    for i, t in docs.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        out.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The smallest tables, with cases for every stage added and a column more."""
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").filter("text is not null").orderBy("item_id").first().text
    near, shared = prose(400), "All of us write this line"
    more = [
        None, "", "!! ?? " * 30, "A B C " * 20, prose(30) + " " + "again and again we say these same eight words " * 5, near, near, near + " end", prose(60) + " " + item + " " + prose(9),
        *[prose(60) + f"\n {shared.upper() if k % 2 else shared}\t\n" + prose(40) for k in range(11)], "\n".join([" ".join([shared] * 5)] * 2),
    ]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("n_words", F.lit("x"))
    rows = [(10**6 + k, t, "en", None, 1, "x") for k, t in enumerate(more)]
    path = str(tmp_path_factory.mktemp("tables"))
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF_DIR}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_the_whole_against_a_plain_version(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want, before = docs, len(docs)
    for step in (lambda d: {i: t for i, t in d.items() if passes(t)}, without_common_lines, representatives, lambda d: clean(d, items)):
        want = step(want)
        # Every stage has something to do here, but lines go out of documents that stay.
        assert len(want) < before or step is without_common_lines
        before = len(want)
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert len(got) == len(want) and set(got) == encoded(want)


def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR).persist()
        assert docs.columns == corpus_pipeline.COLUMNS, name
        left = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= ids and len(left) > 0.5 * len(ids)
        ids = set(left)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in last.collect()} == ids


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
