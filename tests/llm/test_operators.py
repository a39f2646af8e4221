"""Each operator against a plain version on one table of odd documents."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm import bpe, decontaminate, html_extract, line_dedup, pii, quality_model, quality_rules, simhash, url_filter, warc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = prose(90)
SHARED = "Subscribe NOW to the letter"
TEXTS = [
    None, "", " \n\t", "one", "Two Words", BASE, BASE, BASE.replace(" ", "  ", 3), BASE + " x", prose(3000), "a" * 3000, "word " * 400,
    *[prose(30) + f"\n  {SHARED if i % 2 else SHARED.lower()} \n" + prose(20) for i in range(12)], "\n".join(["same line here"] * 9 + [prose(40)]),
    "mail a.b@x.org, A.B@x.org_c@d.ef; ip 10.0.0.256 10.1.2.3.4.5 1.2.3.4 card 4111 1111 1111 1111 or 4111111111111112 tel +1 (555) 010-9999 +12",
    "THE!! SHOUTING!! " * 30, "a*** b### c%%% d " * 20, prose(30) + " " + " ".join(f"w{i}" for i in range(4, 18)) + " " + prose(9), "<|endoftext|> x'S ÀÉ Σ 9",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 7 else None, t, "en", i) for i, t in enumerate(TEXTS)] + [(5, BASE, "en", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int").repartition(3)


def empty(docs):
    return docs.limit(0)


def test_url_filter(spark):
    urls = [None, "nothing", "http://A.Example.com/en/7?x", "x://example.net/de/81", "x://example.net/de/1#f", "s://b.org/es/", "s://b.org", "http://h.com/fr", "http://h.com/fr"]
    pages = spark.createDataFrame([(i, u, 1 if i % 2 else None, "z") for i, u in enumerate(urls)], "page_id long, url string, bad int, host string")
    rules = [url_filter.Rule.parse(a, t) for a, t in [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert len(got) == 9 and got[0][:3] == ("", "", None) and got[1][:2] == ("", "")
    assert got[2] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[3][2:] == ("example.net/de/8", "block")
    assert got[4][2:] == ("net/de/", "allow") and got[5][2:] == ("org/es/", "block") and got[6][2] is None
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    a, b = np.array([1.0, 5.0, 0.5]), np.array([1.0, 2.0, 30.0])
    q = url_filter.beta_quantile(a, b, 0.05)
    assert abs(q[0] - 0.05) < 1e-6 and np.allclose(url_filter._beta_cdf(a, b, q), 0.05, atol=1e-5)
    hosts = spark.createDataFrame([("bad.com", 1)] * 200 + [("good.com", 0)] * 400, "host string, bad int")
    low = {r.host: r.bad_lower for r in url_filter.host_reputation(url_filter.count_hosts(hosts)).collect()}
    assert low["bad.com"] > 0.5 > low["good.com"]


def test_decontamination(spark, docs):
    items = [("a", " ".join(f"w{i}" for i in range(20))), ("b", "Two words"), ("a", "same line"), (None, "letter"), ("c", None), ("d", "...")]
    bench = spark.createDataFrame(items, "item_id string, text string")

    def tokens(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def plain(t):
        words, hit, found = tokens(t), set(), set()
        for item, text in items:
            w = tokens(text)
            for at in range(max(1, len(w) - 9) if w else 0):
                win = w[at : at + 10]
                for i in range(len(words) - len(win) + 1):
                    if words[i : i + len(win)] == win:
                        hit.update(range(i, i + len(win)))
                        found.add(item)
        return len(words), len(hit), sorted(found - {None})

    for limit in (10**6, 15):
        got = decontaminate.find_contamination(docs, bench, max_words=limit).collect()
        assert len(got) == len(TEXTS) + 1
        for r in got:
            assert (r.n_words, r.n_hit, list(r["items"])) == plain(r.text), r.text
            assert sum(len(tokens(r.text[s.start : s.end])) for s in r.spans) == r.n_hit
    assert decontaminate.find_contamination(empty(docs), bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_html_extraction(spark):
    page = (
        "<html><head><title>T</title></head><body class=has-sidebar><header>Site</header><nav><a href=/>Home</a></nav><script>var t='</p>'</script>"
        "<article><h1>Head &amp; shoulders</h1><p>First <b>bold</b>\n para<br>line<p>Second &lt;3 &eacute;<!-- no --><div class='ad'>Buy</div><aside>See also</aside>"
        "<p>Short.</p><form>Name <input></form></article><section class='comments'><p>Reader says a lot of words here, many more than ten of them in all.</p></section>"
        "<div id=\"cookie-notice\">We use cookies</div><footer>&copy; us</footer></body></html>"
    )
    pages = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, "", "x"), (4, "<p>" + "word " * 30, "x"), (4, "a < b", "x")], "page_id long, html string, text string")
    got = html_extract.extract(pages).collect()
    texts = [r.text for r in got]
    assert texts[0] == "Head & shoulders\nFirst bold para line\nSecond <3 é\nShort." and texts[1:3] == ["", ""]
    assert texts[3] == " ".join(["word"] * 30) and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(pages.limit(0)).count() == 0
    assert html_extract.block_table(pages).count() == 5


def main_text(page):
    return html_extract.main_text(page, html_extract.default_tree())


def test_html_tree():
    rows, tree = html_extract.labelled_rows(), html_extract.default_tree()
    assert all(html_extract.classify(tree, r[:-1]) == bool(r[-1]) for r in rows)
    assert {"words", "links", "words_before", "links_before", "words_after", "links_after"} <= html_extract.features_used(tree)
    # Fragments that the tree was not grown from.
    held_out = (
        "<div class=topbar>[-3]</div><ul id=main-menu><li>[-1]<li>[-2]</ul><article><h1>{+9}</h1><p>{+35}<p>{+2}<p>{+64}</article><div class=site-footer>{-25}</div>",
        "<div id=wrap><div>[-2]</div><div>[-3]</div><h1>{+6}</h1><p>{+52}<p>{+7}<p>{+47}<p>{+3}<p>{+33}<div>[-4]</div><div>[-6]</div></div>",
        "<main><h1>{+4}</h1><p>{+21}<div class='advertisement'><p>{-30}</div><p>{+16}</main><div class=comment-list><p>{-50}<p>{-8}</div>",
        "<article><p>{+70}<div class=sidebar-box>{-40}</div><ul><li>{+5}<li>{+9}</ul></article><aside><p>{-45}</aside>",
        "<div class=entry-content><p>{+3}<p>{+44}</div><div class=sponsored>{-30}</div><footer><p>{-12}</footer>",
        "<table><tr><td>[-2]<td>[-1]<tr><td>{+75}<tr><td>{+6}<tr><td>{+58}<tr><td>[-3]</table>", "<p>{+80}<p>{+9}<p>{+41}",
    )
    right = wrong = 0
    for f in held_out:
        blocks = html_extract.blocks_of(html_extract.expand(f))
        for b, row in zip(blocks, html_extract.features(blocks), strict=True):
            same = html_extract.classify(tree, row) == b.text.startswith("main")
            right, wrong = right + same, wrong + (not same)
    assert wrong <= 0.05 * (right + wrong), (right, wrong)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p title=don't>Hello world it's fine, " + "and so on " * 20 + "</p>", "Hello world it's fine, " + " ".join(["and so on"] * 20)),
        ("<article><div class='legal'>" + "legal text " * 12 + "</div><p class='comment-free'>Short one</article>", " ".join(["legal text"] * 12) + "\nShort one"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</article>", "Let x=1 be"),
        ("<article><p>a b<svg><svg><text>inner</text></svg><text>t</text></svg> c</article>", "a b c"),
        ("<article><p>x<noscript>fall back</noscript> y <object>z</object></article>", "xfall back y z"),
        ("<div class='content no-sidebar'><p>Some words here and there and yet more</div>", "Some words here and there and yet more"),
        ("<div class='post tag-news'><p>Some words here and there and yet more</div>", "Some words here and there and yet more"),
        ("<div class=content><p>" + "word " * 30 + "<p class=advert>" + "buy it " * 20 + "<p>" + "word " * 40 + "</div>", " ".join(["word"] * 30) + "\n" + " ".join(["word"] * 40)),
        ("<p>" + "word " * 40 + "<p>To.<p>" + "word " * 40, " ".join(["word"] * 40) + "\nTo.\n" + " ".join(["word"] * 40)),
        ("<form><main><h1>Title of it</h1><p>Text in a form that wraps it</main></form>", "Title of it\nText in a form that wraps it"),
        ("<article>x &amp;lt; &eacute;&nbsp;&#8364; a &lt b</article>", "x &lt; é € a < b"), ("<!-- <article>no</article> --><nav>Menu</nav>", ""),
    ],
)
def test_html_loses_no_text(page, text):
    assert main_text(page) == text


def test_html_takes_linear_time():
    import time

    for page in ("<div>" * 20000 + "</foo>" * 20000, "<b><div>" + "<i>" * 20000 + "</b>" * 20000, "<div class=ad>" * 20000 + "<main>" * 20000, "<a t='x " * 20000, "<a " + "=" * 90000, "<!--" * 20000, "<script>" * 20000):
        began = time.thread_time()
        main_text(page)
        assert time.thread_time() - began < 5


def repeats(words):
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    return len({i + k for v in seen.values() if len(v) > 1 for i in v for k in range(8)})


def test_quality_rules(docs):
    got = quality_rules.apply_policy(quality_rules.ledger(docs)).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        t = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeats(words))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t[:50]
        assert bool(r.failed & 1) == (len(words) < 20) and r.kept == (r.failed == 0)
    table = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablation(quality_rules.ledger(docs), "2026-1").collect()}
    masks = [r.failed for r in got]
    assert all(table[x.name] == (sum(m >> x.bit & 1 for m in masks), sum(m == 1 << x.bit for m in masks)) for x in quality_rules.RULES)
    assert quality_rules.ledger(empty(docs)).count() == 0


def direct(t):
    out = []
    for rank, (kind, p) in enumerate({
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_pii(spark, docs):
    got = pii.find_personal_data(docs).collect()
    assert len(got) == len(TEXTS) + 1 and sum(len(r.spans) for r in got) >= 5
    odd = ["x" * 5000 + "@" + "y" * 5000 + ".z", "1" * 6000, "1.2.3.4.5.6.7.8", "é a@b.c_d@e.f +1 23456789 0", "1-2 3 4-5 6 7-8 9 0-1 2 3", None]
    more = spark.createDataFrame([(t,) for t in odd], "text string")
    for r in [*got, *pii.find_personal_data(more).collect()]:
        assert [(s.start, s.rank, s.end) for s in r.spans if s.rank < 4] == direct(r.text), (r.text or "")[:80]
    rows = [(f"note {w} call Zorblax at z@x.org {v} thanks",) for w, v in zip(WORDS[:9], WORDS[9:18])] + [(prose(20) + " thanks call note at",) for _ in range(40)]
    table = spark.createDataFrame(rows, "text string")
    for cap in (None, -1):
        found = pii.find_personal_data(table, broadcast_bytes=cap).collect()
        terms = Counter(s.value for r in found for s in r.spans if s.rank >= 4)
        assert terms == {"Zorblax": 9}
    clean = pii.sanitise(pii.find_personal_data(table)).filter("size(spans) > 0").first()
    assert "z@x.org" not in clean.sanitised and "Zorblax" not in clean.sanitised and "[EMAIL]" in clean.sanitised
    assert pii.find_personal_data(empty(docs)).count() == 0


def test_pii_terms_in_all_documents(spark):
    rows = [f"note {w} call Zorblax at z@x.org {v} thanks" for w, v in zip(WORDS[:9], WORDS[9:18])] + [prose(20) + " thanks call note at" for _ in range(60)]
    alone, far = "Tell zorblax, not Zorblaxes.", "z@x.org " + prose(40) + " Zorblax"
    table = spark.createDataFrame([(t,) for t in [*rows, alone, far, None]], "text string")
    for cap in (None, -1):
        found = pii.find_personal_data(table, broadcast_bytes=cap).collect()
        terms = {r.text: [(s.start, s.end, s.value) for s in r.spans if s.rank >= 4] for r in found}
        assert len(found) == len(rows) + 3 and terms[alone] == [(5, 12, "zorblax")] and terms[far] == [(len(far) - 7, len(far), "Zorblax")]
        assert sum(map(len, terms.values())) == 11


def plain_terms(texts, width=4, min_contexts=3, generalise_at=0.8, remove_at=0.95):
    """Disclosing terms, and whether they are removed, by counting document by document."""
    import math

    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    with_e, with_t, near, seen = Counter(), Counter(), defaultdict(Counter), defaultdict(set)
    for text in texts:
        t = text or ""
        with_t.update({w for w in re.findall(r"[^\W\d_]+", low(t))})
        spans = direct(t)
        entities, pairs, reach = [], set(), 0
        gaps = []
        for start, _, end in spans:
            gaps.append(t[reach:start] if start > reach else "")
            reach = max(reach, end)
        gaps.append(t[reach:])
        for i, (start, rank, end) in enumerate(spans):
            e = (rank, re.sub("[^0-9]", "", t[start:end]) if rank >= 2 else low(t[start:end]))
            entities.append(e)
            before, after = (re.findall(r"[^\W\d_]+", low(g)) for g in (gaps[i], gaps[i + 1]))
            context = tuple(before[-width:] + after[:width])
            pairs |= {(e, w, context) for w in context}
        with_e.update(set(entities))
        for e, w, context in pairs:
            near[e][w] += 1
            seen[e, w].add(context)
    out = {}
    for e, words in near.items():
        for w, n in words.items():
            information = math.log(len(texts) / with_e[e])
            if len(seen[e, w]) >= min_contexts and information > 0:
                ratio = math.log(min(n, with_e[e], with_t[w]) * len(texts) / (with_t[w] * with_e[e])) / information
                if ratio >= generalise_at:
                    out[w] = out.get(w, False) or ratio >= remove_at
    return out


def test_pii_term_scores(spark):
    people = [("Zorblax", "z@x.org"), ("Quimby", "+1 555 010 9999 1"), ("Ärno", "a@b.de")]
    texts = [f"{prose(rng.randint(0, 6))} {name if i % 7 else ''} {rng.choice(WORDS)} {mail} {rng.choice(WORDS)} {prose(3)}" for i in range(60) for name, mail in people[: 1 + i % 3]]
    texts += [prose(30) for _ in range(200)] + ["Zorblax alone", "ärno Quimby quimby", None, ""] + [f"{prose(4)} Quimby" for _ in range(9)]
    table = spark.createDataFrame([(t, "x", "y") for t in texts], "text string, key string, _key string")
    want = plain_terms(texts)
    assert want
    for cap in (None, -1):
        found = pii.find_personal_data(table, broadcast_bytes=cap)
        assert found.columns == ["text", "key", "_key", "spans"]
        for r in pii.sanitise(found).collect():
            t = r.text or ""
            low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
            terms = [(m.start(), 5 if want[m[0]] else 4, m.end()) for m in re.finditer(r"[^\W\d_]+", low) if m[0] in want]
            assert [(s.start, s.rank, s.end) for s in r.spans] == sorted(direct(t) + terms), t
            at, out = 0, []
            for start, rank, end in sorted(direct(t) + terms):
                if start >= at:
                    out += [t[at:start], ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")[rank]]
                at = max(at, end)
            assert r.sanitised == "".join(out) + t[at:]


def test_pii_many_matches(spark):
    text = "é " + " or ".join(f"u{i}@h.org" for i in range(30000))
    r = pii.sanitise(pii.find_direct(spark.createDataFrame([(text,)], "text string"))).select("spans", "sanitised").first()
    assert [(s.start, s.end) for s in r.spans] == [m.span() for m in re.finditer(r"u\d+@h\.org", text)] and r.sanitised == re.sub(r"u\d+@h\.org", "[EMAIL]", text)


def test_line_dedup(docs):
    def key(x):
        return re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))

    rows = [r.text for r in docs.collect()]
    counts = Counter(k for t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    want = Counter()
    for t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if counts[key(x)] < 10]
        want[t, len(lines), len(lines) - len(left), "\n".join(left)] += 1
    for limits in ({}, {"broadcast_keys": 0}, {"batches": 9}):
        got = line_dedup.dedup_lines(docs, **limits).collect()
        assert Counter((r.text, r.n_lines, r.n_dropped, r.kept_text) for r in got) == want
    assert sum(n for (_, _, d, _), n in want.items() if d) == 12


def test_line_runs_over_two_opens(spark, docs):
    from seqloom.llm.common import scratch

    path = scratch(spark, "store")
    parts = [docs.filter(F.pmod(F.xxhash64("text"), F.lit(7)) == k) for k in range(7)]
    runs = line_dedup.LineRuns.create(spark, path, buckets=3)
    for p in parts[:4]:
        runs.add_documents(p)
    assert [x is not None for x in runs.levels] == [False, False, True]
    again = line_dedup.LineRuns.open(spark, path)
    assert (again.levels, again.buckets, again.batches) == (runs.levels, 3, 4)
    for p in parts[4:]:
        again.add_documents(p)
    counts = Counter(h for r in docs.collect() for h in set(line_dedup.line_hashes(r.text, 1)) if h)
    assert sorted(bytes(r.h) for r in again.settled().collect()) == sorted(h for h, n in counts.items() if n >= 10)
    # Settled keys are left out of later runs, and nothing is moved or sorted on the side of the runs or of the batch.
    batch = again.counted(docs)[0]
    with again._merging():
        probe = again.probe(batch)
        plan = probe._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and "Sort [" not in plan
        left = {bytes(r.h) for r in probe.collect()}
    assert left == {h for h, n in counts.items() if n < 10}
    # A later batch sees the lines of earlier ones.
    late = spark.createDataFrame([(f"{SHARED}\nnew",)], "text string")
    assert line_dedup.dedup_lines(late, runs=line_dedup.LineRuns.open(spark, path)).first().kept_text == "new"


def test_line_dedup_of_nothing(docs):
    assert line_dedup.dedup_lines(empty(docs)).count() == 0


def test_bpe(docs):
    t = Tokenizer.from_file(VOCABULARY)
    for r in bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY, names=True).collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    v = bpe.Vocabulary(VOCABULARY)
    for word in ("a" * 780, "ab" * 390, "the" * 260, "antidisestablishment" * 38):
        w, out = bpe.WordEncoder(v, 1), []
        for c in word:
            out += w.push([c])
            assert len(w.held) <= w.most
        assert out + w.finish() == t.encode(word, add_special_tokens=False).ids
    d = bpe.Decoder(v)
    assert "".join(d.stream(t.encode("héllo 日本 wörld", add_special_tokens=False).ids)).split() == ["héllo", "日本", "wörld"]
    assert bpe.round_trip(empty(docs), VOCABULARY).count() == 0


def test_bpe_streams_in_any_pieces(monkeypatch):
    t, v = Tokenizer.from_file(VOCABULARY), bpe.Vocabulary(VOCABULARY)
    e, d, r = bpe.Encoder(v), bpe.Decoder(v, names=True), random.Random(2)
    parts = ["a", "the", "ing", "é", "e\u0301", "日本", "'s", "'", "'re", "!!", " ", "\n", "\t", "7", "\u0301", "Σ", "İ", "\u1160\u1161", "각", "\u0f71", "\x1c", "\u3000", "<|endoftext|>", "<|", "🙂", "\u0344", "\U00010d50", "\ua7cb"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(700)]
    texts += ["a" * 3000, "ab" * 900 + "!" * 900 + "'s" + "é" * 300, "\u0301" * 300 + "a" + "\u0301" * 200, "日" * 900, "!" * 700 + "7" * 300 + "the" * 99]
    for size in (3, 50, 1 << 16):
        monkeypatch.setattr(bpe, "PIECE_CHARS", size)
        for x in texts:
            pieces, ids = list(e.stream(x)), t.encode(x, add_special_tokens=False).ids
            assert np.frombuffer(b"".join(pieces), "<u4").tolist() == ids and "".join(bpe._text(d, pieces)) == t.decode(ids, skip_special_tokens=False), x


def test_bpe_on_all_code_points():
    t, e = Tokenizer.from_file(VOCABULARY), bpe.Encoder(bpe.Vocabulary(VOCABULARY))
    points = [c for c in range(0x34000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50000):
        texts = ["a" + chr(c) + "b1" + chr(c) for c in points[at : at + 50000]]
        for x, enc in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
            assert e(x) == np.array(enc.ids, "<u4").tobytes(), hex(ord(x[1]))


def test_quality_model(spark, docs):
    good = [(i, prose(rng.randint(20, 80)).capitalize() + ".") for i in range(300)]
    bad = [(i, "BUY!! NOW!! " * rng.randint(5, 40)) for i in range(300, 400)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(400)], "doc_id long, quality int")
    model = quality_model.fit(table, labels)
    scored = quality_model.score(table, model).withColumn("held", quality_model.held_out(F.col("doc_id"))).filter("held").collect()
    assert scored and all((r.score >= 0.7) == (r.doc_id < 300) == bool(r.predicted) for r in scored)
    assert all(0 <= r.score <= 1 for r in quality_model.score(docs, model).collect())
    nothing = quality_model.fit(table, labels.limit(0))
    assert {r.score for r in quality_model.score(docs, nothing).collect()} == {0.5}
    assert quality_model.score(empty(docs), model).count() == 0


def test_top_word_is_of_all_words():
    top = quality_model.FEATURES.index("top_word")
    stuffed = " ".join("supercalifragilistic" if i % 2 else WORDS[i % 18] for i in range(400))
    junk = " ".join("|" if i % 20 < 9 else f"w{i}" for i in range(100))
    for t in (stuffed, junk, *TEXTS):
        words = (t or "").encode().split()
        assert quality_model.measure(t)[top] == max(Counter(words).values(), default=0) / max(1, len(words))
    assert quality_model.measure(stuffed)[top] >= 0.5 and quality_model.measure(junk)[top] == 0.45


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (5, "u", None), (4, "u", ""), (None, "n", "<p>é</p>"), (7, "v", "WARC/1.1\r\nfake\r\n\r\n" * 3), (7, "v", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = spark.createDataFrame([("null", "u", "a"), (None, "u", "b"), ("a b>%\r\n", "u", "c"), ("é", "u", "c")], "page_id string, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.archive_pages(texts).collect()} == {("null", None), (None, None), ("a b>%\r\n", "é"), ("é", None)}
    got = {(r.page_id, r.payload_digest): (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()}
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    assert got[1, digest("<p>é</p>")] == (9, "revisit", 2) and got[2, digest("<p>é</p>")] == (9, "response", None)
    assert got[4, digest("")] == (0, "revisit", 5) and got[5, digest("")] == (0, "response", None) and len(got) == 7
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    assert warc.read_gaps(spark, path).count() == 0 and warc.read_archives(spark, path).count() == 7
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_files_are_bounded(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (10 if i % 3 else 90_000) + str(i)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, file_bytes=1 << 20)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part*")]
    assert max(sizes) <= 1 << 20 and len(sizes) > 2 and sum(sizes) > 20 * 90_000
    assert sorted(int(r.record_id.removeprefix(warc.ID)) for r in warc.read_archives(spark, path, strict=True).collect()) == list(range(60))
    with open(next(iter((tmp_path / "w").glob("part*"))), "r+b") as f:
        f.seek(3)
        f.write(b"X")
    for p in (tmp_path / "w").glob(".*crc"):
        p.unlink()
    assert warc.read_gaps(spark, path).count() == 1
    with pytest.raises(Exception, match="DamagedArchive"):
        warc.read_archives(spark, path, strict=True).collect()


def test_warc_salvage_keeps_to_records():
    def record(n, body):
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    quoting = bytearray(record(5, b"quote:\r\n" + record(99, b"x") + b"mid WARC/1.1 line"))
    quoting[quoting.index(b"quote")] ^= 1
    parts = list(warc.salvage(record(1, b"a") + bytes(quoting) + record(2, b"c")))
    assert [p[3]["record_id"] for p in parts if p[0] == "record"] == ["urn:page:1", "urn:page:2"]
    import time

    data = b"".join(gzip.compress(record(i, random.Random(i).randbytes(20000)), 1) for i in range(1500))
    began = time.thread_time()
    assert sum(p[0] == "record" for p in warc.salvage(data)) == 1500 and time.thread_time() - began < 5


def test_warc_long_url(spark, tmp_path):
    url = "http://a/" + "é" * 10 + "x" * 100_000
    pages = spark.createDataFrame([(1, "http://b/", "<p>b</p>"), (2, url, "<p>a</p>"), (3, url, "<p>b</p>")], "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.archive_pages(pages).collect()) == [1, 2, 3]
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    assert warc.read_gaps(spark, path).count() == 0 and {r.record_id: r.url for r in warc.read_archives(spark, path).collect()}["urn:page:2"] == url


def test_warc_salvage():
    def record(n, body):
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    a, b, c = (record(i, b"body %d" % i) for i in range(3))
    broken = bytearray(b)
    broken[-7] ^= 1
    for data, want in (
        (a + b + c, ["0", "1", "2"]), (a + bytes(broken) + c, ["0", "2"]), (a + b[:40] + c, ["0", "2"]), (b"junk" + a, ["0"]), (a + c[:-9], ["0"]),
        (gzip.compress(a) + gzip.compress(b)[:-20] + gzip.compress(c), ["0", "2"]), (gzip.compress(a) + b + b"\x00" * 9, ["0", "1"]), (b"", []),
    ):
        parts = list(warc.salvage(data))
        assert [warc.page_of(p[3]["record_id"]) for p in parts if p[0] == "record"] == want
        assert all(x[2] <= y[1] for x, y in zip(parts, parts[1:])) and (not parts or (parts[0][1], parts[-1][2]) == (0, len(data)))


def test_warc_salvage_damage():
    def record(n, body):
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    made = [record(i, random.Random(i).randbytes(300)) for i in range(400)]
    for name in (b"response", b"sha1:"):
        bad = bytearray(made[1])
        bad[bad.index(name) + 6] = 0xE9
        assert [p[0] for p in warc.salvage(made[0] + bytes(bad) + made[2])] == ["record", "gap", "record"]
    all_ids = [str(i) for i in range(400)]
    for level in (0, 6):
        packed = gzip.compress(b"".join(made), level)
        damaged, half, last = bytearray(packed), max(packed.find(made[200][-150:]), 0) or len(packed) // 2, gzip.compress(record(400, b"last"))
        damaged[half : half + 40] = b"\xff" * 40
        for data, least in ((bytes(damaged), 0), (packed[:half], 150), (packed[:-4], 400), (packed[:-8] + b"\0" * 8, 400)):
            parts = list(warc.salvage(data + last))
            ids = [warc.page_of(p[3]["record_id"]) for p in parts if p[0] == "record"]
            want = [x for x in all_ids if x in ids[:-1]]
            assert ids[-1] == "400" and ids[:-1] == want and len(want) >= least and ids[: len(want)][:100] == all_ids[:100]
            assert (parts[0][1], parts[-1][2]) == (0, len(data) + len(last)) and any(p[0] == "gap" for p in parts)


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values):
    up = {v: v for v in values}
    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                x, y = a, b
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                up[max(x, y)] = min(x, y)
    out = {}
    for v in values:
        r = v
        while up[r] != r:
            r = up[r]
        out[v] = r
    return out


def classes_of(texts):
    return set(classes(sorted({plain_fingerprint(t) for t in texts})).values())


def test_simhash(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 1
    fps = {i if i != 7 else None: plain_fingerprint(t) for i, t in enumerate(TEXTS)}
    roots = classes(sorted(set(fps.values())))
    low = {}
    for i, f in fps.items():
        if i is not None:
            low[roots[f]] = min(i, low.get(roots[f], i))
    for r in got:
        assert int(r.fingerprint, 16) == fps[r.doc_id] and r.component_id == low[roots[fps[r.doc_id]]]
    assert simhash.near_duplicates(empty(docs)).count() == 0
    kept = simhash.keep_representatives(docs.drop("kept", "n_words"))
    left = kept.collect()
    assert len(left) == len({f for f in roots.values()}) and {r.doc_id for r in left if r.doc_id is not None} == set(low.values())
    # Of rows that share an id, of rows without one and of repeated rows exactly one stays, the same each time.
    near = spark.createDataFrame([(i, t, "x") for t in (BASE, BASE + " x") for i in (3, 3, None)] + [(None, "other words", "y")] * 3, "doc_id long, text string, _hash1 string")
    for cap in (None, -1):
        once = [tuple(r) for r in simhash.keep_representatives(near.repartition(3), broadcast_bytes=cap).collect()]
        assert len(once) == len(classes_of([BASE, BASE + " x", "other words"])) and (None, "other words", "y") in once


def test_simhash_links_split_hot_groups(spark):
    seeds = [rng.getrandbits(64) for _ in range(6)]
    values = {s ^ (1 << a) ^ (1 << b) for s in seeds for a in range(0, 64, 5) for b in range(0, 64, 7)} | {rng.getrandbits(12) for _ in range(60)}
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    want = classes(sorted(values))
    for most in (1024, 20, 2):
        labels = {r.node & (2**64 - 1): r.label for r in simhash.components(simhash.links(df, most)).collect()}
        groups = defaultdict(set)
        for v in values:
            groups[labels.get(v, simhash._signed(v))].add(want[v])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))
