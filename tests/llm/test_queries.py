"""The registered queries on small tables with odd rows, against DuckDB or plain versions."""

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import BASE, TEXTS, VOCABULARY, classes, direct, plain_fingerprint, plain_terms, prose
from tokenizers import Tokenizer

from seqloom.llm import html_extract, quality_model, registry, url_filter
from seqloom.llm.common import hot_keys, spread_join

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The smallest tables with odd rows, and columns that are named like helpers of the operators."""
    path = str(tmp_path_factory.mktemp("tables"))
    more = {
        "documents": [(10**6 + i if i % 9 else None, t, "en", None, 1) for i, t in enumerate([*TEXTS, BASE, BASE, None, "Zorblax", "\n \n"])]
        + [(2 * 10**6 + i, f"note {prose(3)} call Zorblax at z@x.org {prose(2)} thanks", "en", "s", 1) for i in range(6)],
        "pages": [
            (10**6, None, None), (None, "http://A.Example.com/en/7?x", "<p>x"), (None, None, "<p>x"), (10**6 + 1, "x://example.net/de/81", "<p>x"), (10**6 + 2, "s://b.org/es/", ""),
            (10**6 + 2, "s://b.org/es/", ""), (10**6 + 3, "no scheme", "<article>a &amp; b</article>"), (10**6 + 4, "http://u@h.co.uk:80/5/" + "é" * 9000, "<p>" + "x " * 20000),
        ],
        "benchmark": [(10**6, None), (10**6 + 1, "..."), (None, "Two Words"), (10**6 + 2, "two words"), (10**6 + 2, "same line here")],
        "labels": [(None, 1, 0), (5, 0, 1), (5, 1, 0), (10**6 + 4, None, None)],
    }
    for name, rows in more.items():
        table = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        out = table.unionByName(spark.createDataFrame(rows, table.schema))
        out = out.withColumns({c: F.lit("x") for c in ("key", "_salt", "_words", "host", "n", "spans")})
        out.repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


def rows_of(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_gives_the_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, sf_dir)
    found = con.execute(registry.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(found.fetchall())


def quantile(a, b, level):
    """Of a beta distribution, by adding up its density."""
    x = (np.arange(400_000) + 0.5) / 400_000
    log = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    total = np.cumsum(np.exp(log - log.max()))
    return float(x[np.searchsorted(total, level * total[-1])])


def shrunk(units, parents):
    """Posterior means (and pseudo-counts) of units = {name: (parent, n, k)} under beta priors at their parents' means."""
    some = [(n, k / n, parents[p]) for p, n, k in units.values() if n]
    n, v1 = sum(x[0] for x in some), sum(m * (1 - m) for _, _, m in some)
    v = sum(m * (1 - m) * x for x, _, m in some)
    s = 1e4
    if n and v:
        room = (v - v1) / n
        over = (sum(x * (p - m) ** 2 for x, p, m in some) - v1) / n
        s = 1 / min(0.99, max(1e-4, over / room if room > 0 else 1e-4)) - 1
    return {u: (k + s * parents[p], n - k + s * (1 - parents[p])) for u, (p, n, k) in units.items()}


def test_url_filter_against_plain_posteriors(spark, sf_dir):
    labels = {}
    for r in rows_of(spark, sf_dir, "labels"):
        if r.doc_id is not None:
            labels[r.doc_id] = max(labels.get(r.doc_id, 0), int(r.quality == 0 or r.toxic == 1))
    hosts = defaultdict(lambda: [0, 0])
    pages = rows_of(spark, sf_dir, "pages")

    def host_of(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")

    for p in pages:
        host, path = host_of(p.url)
        k = re.search(r"([0-9]+)(?:/|\.html)?$", path)
        known = labels.get(int(k[1])) if k else None
        hosts[host][0] += known is not None
        hosts[host][1] += known == 1

    def levels(host):
        name = re.sub(":[0-9]*$", "", re.sub("^.*@", "", host))
        parts = name.split(".")
        k = 2 if ".".join(parts[-2:]) in url_filter.SUFFIXES else 1
        return ".".join(parts[-k:]), ".".join(parts[-k - 1 :])

    suffixes, domains = defaultdict(lambda: [None, 0, 0]), defaultdict(lambda: [None, 0, 0])
    for host, (n, k) in hosts.items():
        suffix, domain = levels(host)
        for table, key, parent in ((suffixes, suffix, "root"), (domains, (domain, suffix), suffix)):
            table[key] = [parent, table[key][1] + n, table[key][2] + k]
    total, bad = sum(x[0] for x in hosts.values()), sum(x[1] for x in hosts.values())
    mean = lambda t: {u: a / (a + b) for u, (a, b) in t.items()}
    means = mean(shrunk(suffixes, {"root": (bad + 0.5) / (total + 1)}))
    means = mean(shrunk(domains, means))
    posterior = shrunk({h: (levels(h)[::-1], n, k) for h, (n, k) in hosts.items()}, means)
    low = {h: quantile(a, b, 0.05) for h, (a, b) in posterior.items()}
    got = registry.op1_url_filter(spark, sf_dir).collect()
    assert len(got) == len(pages) and len({r.host for r in got}) > 5
    for r in got:
        assert r.n_labelled == hosts[r.host][0] and r.bad_lower == pytest.approx(low[r.host], abs=1e-4)
        if r.rule is None:
            assert r.verdict == ("block" if low[r.host] > 0.5 else "allow")


def test_many_rules_and_hot_hosts(spark):
    rules = [url_filter.Rule("block" if i % 2 else "allow", f"h{i}.example.com", f"/{'x' * (i % 5)}") for i in range(3000)]
    urls = ["http://sub.h7.example.com/xx/1"] * 900 + [f"http://h{i}.example.com/{'x' * (i % 7)}" for i in range(300)] + [None] * 300
    pages = spark.createDataFrame([(u, None) for u in urls], "url string, bad int")
    plain = {r.url: r.rule for r in url_filter.filter_urls(pages, rules).collect()}
    spread = Counter((r.url, r.rule) for r in url_filter.filter_urls(pages, rules, broadcast_bytes=-1).collect())
    assert spread == Counter((u, plain[u]) for u in urls) and plain["http://sub.h7.example.com/xx/1"] == "h7.example.com/xx" and plain[None] is None


def test_spread_joins_are_joins(spark):
    many = spark.createDataFrame([(1 if i % 3 else None if i % 2 else i, i) for i in range(3000)], "k int, v int").repartition(4)
    one = spark.createDataFrame([(1, "a"), (6, "b"), (99, "c")], "k int, w string")
    hot = hot_keys(many.filter("k is not null").groupBy("k").agg(F.count("*").alias("n")), ["k"])
    assert [r.k for r in hot.collect()] == [1]
    for how in ("inner", "left"):
        assert sorted(map(repr, spread_join(many, one, ["k"], hot, how).select("k", "v", "w").collect())) == sorted(map(repr, many.join(one, "k", how).select("k", "v", "w").collect()))


class Article(HTMLParser):
    """Blocks of the article element of pages that are made of a few tags."""

    def __init__(self):
        super().__init__()
        self.blocks, self.inside = [""], False

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1", "div"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_html_query_against_another_parser(spark):
    for r in registry.op3_html_extract(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "html"), "page_id").collect():
        parser = Article()
        parser.feed(r.html)
        want = "\n".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in parser.blocks) if x)
        assert r.text == want and r.n_chars == len(want)


def test_html_query_on_odd_rows(spark, sf_dir):
    got = registry.op3_html_extract(spark, sf_dir).collect()
    assert len(got) == len(rows_of(spark, sf_dir, "pages")) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[10**6 + 3] == "a & b" and {r.page_id: r.n_chars for r in got}[10**6 + 4] == 39999
    assert html_extract.default_tree() == html_extract.grow(html_extract.labelled_rows())


def test_pii_query_against_plain(spark, sf_dir):
    docs = rows_of(spark, sf_dir, "documents")
    terms = plain_terms([r.text for r in docs])
    want = Counter()
    for r in docs:
        t = r.text or ""
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        base = direct(t)
        more = [(m.start(), 5 if terms[m[0]] else 4, m.end()) for m in re.finditer(r"[^\W\d_]+", low) if m[0] in terms]
        spell = lambda spans: ",".join(f"{('email', 'ip', 'card', 'phone', 'generalise', 'remove')[k]}:{a}:{b}" for a, k, b in spans)
        counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
        want[r.doc_id, *counts, hashlib.sha256(spell(base).encode()).hexdigest(), spell(sorted(base + more))] += 1
    columns = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    assert terms and Counter(tuple(r[c] for c in columns) for r in registry.op5_pii(spark, sf_dir).collect()) == want


def test_bpe_query_against_the_library(spark, sf_dir):
    t, want = Tokenizer.from_file(VOCABULARY), Counter()
    for r in rows_of(spark, sf_dir, "documents"):
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(map(tuple, registry.op7_bpe(spark, sf_dir).collect())) == want


def plain_features(text):
    data = (text or "").encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(data))
    of = lambda test: sum(1 for b in data if test(b))
    letters = max(1, size - of(lambda b: b < 65))
    seen = Counter(words)
    return (
        math.log1p(len(words)), (size - of(lambda b: 9 <= b <= 13 or b == 32)) / n, len(seen) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        max(seen.values(), default=0) / n, of(lambda b: 65 <= b <= 90) / letters, of(lambda b: b in b"#$%&*<>") / n, of(lambda b: b in b"!?") / n, of(lambda b: b == 124) / n,
        of(lambda b: 48 <= b <= 57) / n, of(lambda b: b in b",.") / n, 1 - len(set(lines)) / len(lines) if lines else 0.0, math.log1p(size / max(1, len(lines))),
        -sum(c / size * math.log(c / size) for c in Counter(data).values()),
    )


def test_quality_query_against_plain_sums(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = quality_model.fit(docs.select("doc_id", "text"), labels)
    texts = Counter()
    for r in docs.collect():
        x = plain_features(r.text)
        z = model.base + sum(t[bisect.bisect_right(list(e), v)] for t, e, v in zip(model.tables, model.edges, x))
        places = [bisect.bisect_right(list(e), v) for e, v in zip(model.coarse, x)]
        z += sum(t[places[i], places[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
        held = zlib.crc32(str("null" if r.doc_id is None else r.doc_id).encode()) % 4 == 2
        score = 1 / (1 + math.exp(-max(-30, min(30, z))))
        texts[r.doc_id, held, round(score, 6), int(score >= 0.7)] += 1
    got = registry.op8_quality_model(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.held_out, round(r.score, 6), r.predicted) for r in got) == texts
    # No more rows are learned from than there are labelled ids, though ids repeat.
    assert quality_model.labelled_features(docs.unionByName(docs), labels, max_rows=7).count() == 7


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.01"
    assert quality_model.auc(registry.op8_quality_model(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")) > 0.95


def test_simhash_query_against_plain(spark, sf_dir):
    docs = [(r.doc_id, plain_fingerprint(r.text)) for r in rows_of(spark, sf_dir, "documents")]
    root = classes(sorted({f for _, f in docs}))
    low = {}
    for i, f in docs:
        if i is not None:
            low[root[f]] = min(i, low.get(root[f], i))
    want = Counter((i, f"{f:016x}", low.get(root[f])) for i, f in docs)
    assert Counter(map(tuple, registry.op10_simhash(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect())) == want


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, tmp_path_factory, name):
    path = str(tmp_path_factory.mktemp("empty"))
    for table in ("documents", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{SF_DIR}/{table}.parquet").limit(0).write.parquet(f"{path}/{table}.parquet")
    found = registry.QUERIES[name](spark, path)
    assert all(r.n_failed in (None, 0) for r in found.collect()) if name == "quality_ablation" else found.count() == 0
