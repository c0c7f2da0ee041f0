"""Packing, fingerprints, language ID, HTML extraction, sharding."""

import hashlib
import html as entities
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from texts import words

from tessera.llm import encoding, html, language, packing, sharding, sketch
from tessera.llm.common import stored
from tessera.session import written

PATH = encoding.vocabulary()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


# -- packing ------------------------------------------------------------------------------------------------------


def brute_fullest(counts, room):
    sums = {0}
    for x, n in counts.items():
        sums = {s + x * k for s in sums for k in range(n + 1) if s + x * k <= room}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=7), st.integers(0, 60))
def test_fullest_bin(counts, room):
    chosen = packing.fullest(counts, room)
    assert sum(chosen) == brute_fullest(counts, room)
    assert all(n <= counts[x] for x, n in Counter(chosen).items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1, max_size=20))
def test_plan_places_everything_once(counts):
    rows, sequences = packing.plan(counts, 64)
    fill = Counter()
    for length in counts:
        own = [r for r in rows.tolist() if r[0] == length]
        assert [r[1] for r in own] == [0, *(r[2] for r in own)][:-1] and own[-1][2] == counts[length]
        for _, lo, hi, first, many, offset in own:
            assert offset + many * length <= 64
            for k in range(hi - lo):
                fill[first + k // many] += length
    assert len(fill) == sequences and max(fill.values()) <= 64
    assert sequences >= -(-sum(k * n for k, n in counts.items()) // 64)


def packed_right(rows, docs, library, capacity=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    wanted = Counter()
    for i, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        start, end = 0, (len(ids) - 1) % capacity + 1
        for k in range(-(-len(ids) // capacity)):
            wanted[i, k, start, end - start, zlib.crc32(ids[start:end].tobytes())] += 1
            start, end = end, end + capacity
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


def test_packing_query(spark, sf, rows_of, library):
    n, least = packed_right(packing.op4_packing(spark, sf).collect(), rows_of("documents", ["doc_id", "text"]), library)
    assert n <= least + 1


def test_packing_odd_rows(odd, odd_rows, none, library):
    packed_right(packing.pack(packing.pieces(odd, PATH)).collect(), [r[:2] for r in odd_rows], library)
    assert packing.pack(packing.pieces(none, PATH)).collect() == []


def test_one_length_for_all(spark):
    cut = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(700).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    got = packing.pack(cut).collect()
    assert Counter(Counter(r.sequence_id for r in got).values()) == {2: 2500}


# -- fingerprints -------------------------------------------------------------------------------------------------


def shingles(text, n=5):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches_estimate_and_merge():
    r = random.Random(1)
    errors = []
    for _ in range(30):
        base = words(r, 800).split()
        a, b = " ".join(base[: r.randint(100, 800)]), " ".join(base[r.randint(0, 600) :])
        x, y = sketch.sketch(a), sketch.sketch(b)
        errors.append(abs(sketch.resemblance(x, y) - jaccard(shingles(a), shingles(b))))
        assert abs(sketch.distinct(x) / len(shingles(a)) - 1) < 0.4
        assert abs(sketch.containment(x, y) - len(shingles(a) & shingles(b)) / len(shingles(a))) < 0.35
        both = np.union1d(x, y)[: sketch.K]
        assert np.array_equal(sketch.merge(x, y), both) and np.array_equal(sketch.unpack(sketch.pack(x)), x)
    assert np.mean(errors) < 0.04
    empty = sketch.sketch(" \n")
    assert sketch.resemblance(empty, empty) == 1.0 and sketch.resemblance(empty, x) == 0.0 and sketch.distinct(empty) == 0


def test_merged_groups_are_sketches_of_all_shingles(spark, odd, odd_rows):
    docs = odd.select("doc_id", "text", F.coalesce("source", F.lit("-")).alias("source"))
    sketched = sketch.sketches(docs).join(docs.select("doc_id", "source").distinct(), "doc_id")
    got = {r.source: sketch.unpack(r.fingerprint) for r in sketch.merged(sketched, "source").collect()}
    for source in {r[3] or "-" for r in odd_rows if r[0] is not None}:
        wanted = np.empty(0, np.uint64)
        for i, t, _, s, _ in odd_rows:
            if i is not None and source in {q[3] or "-" for q in odd_rows if q[0] == i}:
                wanted = sketch.merge(wanted, sketch.sketch(t or ""))
        assert np.array_equal(got[source], wanted)


def edits(rows):
    """rows: (id, text) in descending order of ids."""
    out = []
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        out.append((i, t, t[: len(t) - half] + after[:half], after))
    return out


def test_fingerprint_query(spark, sf, rows_of):
    got = {r.doc_id: r for r in sketch.op5_fingerprints(spark, sf).collect()}
    rows = sorted(((i, t or "") for i, t in rows_of("documents", ["doc_id", "text"])), reverse=True)
    errors, prints = [], {}
    for i, t, edited, after in edits(rows):
        r = got.pop(i)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert r.fingerprint == sketch.pack(sketch.sketch(t)) and r.edited_fingerprint == sketch.pack(sketch.sketch(edited))
        errors += [abs(r.near_edited - jaccard(shingles(t), shingles(edited))), abs(r.near_next - jaccard(shingles(t), shingles(after)))]
    assert not got and np.mean(errors) < 0.03 and max(errors) < 0.25


def test_fingerprint_odd_rows(spark, odd, odd_rows, none):
    got = sketch.with_edits(odd).collect()
    assert Counter((r.doc_id, r.n_chars, r.fingerprint) for r in got) == Counter((r[0], len(r[1] or ""), sketch.pack(sketch.sketch(r[1] or ""))) for r in odd_rows)
    assert sketch.with_edits(none).collect() == []
    alone = sketch.with_edits(spark.createDataFrame([(3, "ab cd")], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.near_next) for r in alone] == [(5, 1.0)] and alone[0].edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()


@pytest.mark.parametrize("doc", [None, 3])
def test_one_id_for_most_rows_is_dealt_out(spark, doc):
    """An id that most rows share: no task has much more than the others, and every row has its next."""
    r = random.Random(7)
    rows = [(doc, words(r, r.randint(1, 30))) for _ in range(400)] + [(k, words(r, 20)) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sketch.with_edits(docs)
    found = got.collect()
    h = lambda t: spark.createDataFrame([(x,) for x in t], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    tie = {x.t: x.h for x in h({t for _, t in rows})}
    order = sorted(rows, key=lambda x: (-(1 << 63) if x[0] is None else x[0], tie[x[1]]), reverse=True)
    wanted = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        wanted.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted(((x.doc_id, x.n_chars, x.edited_sha256) for x in found), key=str) == sorted(wanted, key=str)
    tasks = [x["n"] for x in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("n_chars").alias("n")).collect()]
    assert max(tasks) < 250


# -- language -----------------------------------------------------------------------------------------------------


def test_language_query_keeps_clean_documents(spark, sf, rows_of):
    got = {r.doc_id: r for r in language.op6_language_id(spark, sf).collect()}
    for i, text, lang in rows_of("documents", ["doc_id", "text", "lang"]):
        if text and re.search(r"[a-z]", text) and len(text) > 20:
            assert got[i].kept and got[i].lang == lang


def test_language_held_out_accuracy(spark, sf):
    docs = language.of_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    hidden = F.col("doc_id") % 3 == 0
    got = language.identify(docs.withColumn("declared", F.when(~hidden, F.col("declared"))))
    wanted = docs.filter(hidden).select("doc_id", F.col("declared").alias("truth"))
    rows = got.join(wanted, "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.lang == r.truth for r in rows]) > 0.97


def test_language_evidence_adds_up(spark):
    r = random.Random(2)
    en, de = "the of and to in that is was with for".split(), "der die das und ist nicht mit von auf eine".split()
    say = lambda ws, n: " ".join(r.choice(ws) for _ in range(n))
    rows = [(k, say((en, de)[k % 2], 80), ("en", "de")[k % 2], (None, "de")[k % 2], f"h{k % 4}") for k in range(200)]
    rows += [(900, "ok", None, "de", "h1"), (901, "ok", None, None, "h0"), (902, "ok", "de", None, None), (903, "12 %% 34", "en", None, "h0"), (904, None, "en", None, "h0"), (905, "", None, None, None)]
    got = {x.doc_id: x for x in language.identify(spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string")).collect()}
    assert all(got[k].lang == rows[k][2] and got[k].kept for k in range(200))
    assert (got[900].lang, got[901].lang, got[902].lang) == ("de", "en", "de")
    assert [(got[k].lang, got[k].kept) for k in (903, 904, 905)] == [(None, False)] * 3


def test_rare_and_many_languages_have_models(spark):
    """A language of 3 rows among 6000, in a script of its own, and 80 labels in all."""
    r = random.Random(3)
    say = lambda first, n: " ".join("".join(chr(first + r.randrange(20)) for _ in range(r.randint(2, 6))) for _ in range(n))
    rows = [(k, say(0x61, 30), "en", None, f"h{k % 3}") for k in range(5500)]
    rows += [(6000 + k, say(0x10D0, 30), "ka", None, "h0") for k in range(3)]
    rows += [(7000 + k, say(0x4E00 + 40 * (k % 78), 30), f"x{k % 78:02}", None, "h0") for k in range(156)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string")
    langs, model = language.fit(docs)
    assert len(langs) == 80 and model.shape[1] == 80
    got = {x.doc_id: x for x in language.identify(docs).collect()}
    assert not [(d, got[k]) for k, _, d, _, _ in rows if not got[k].kept or got[k].lang != d]


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    docs = spark.createDataFrame([(k, "some text", f"x{k}", None, None) for k in range(4)], "doc_id long, text string, declared string, suffix string, host string")
    with pytest.raises(ValueError, match="4 languages are declared"):
        language.identify(docs)
    assert language.identify(docs.filter("doc_id > 0")).count() == 3


def test_language_odd_rows(odd, odd_rows, none):
    got = language.identify(language.of_documents(odd)).collect()
    assert len(got) == len(odd_rows)
    kept = language.accepted(odd)
    assert kept.columns == odd.columns
    gone = {40, 41, 42, 43}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in odd_rows if r[0] not in gone)
    assert language.accepted(none).count() == 0 and not language.identify(language.of_documents(none)).collect()


def test_language_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    evidence = language.of_pages(pages).select("doc_id", "declared")
    got = language.language_id_pages(spark, sf).join(evidence, F.col("page_id") == F.col("doc_id")).collect()
    assert len(got) == pages.count() and np.mean([r.lang == r.declared for r in got]) > 0.95
    odd = spark.createDataFrame([(1, "https://me@A.b.ORG:80/x", "<HTML LANG='de-AT'><article><p>Text"), (2, None, None)], "page_id long, url string, html string")
    row = language.of_pages(odd).select("doc_id", "text", "declared", "suffix", "host").orderBy("doc_id").collect()
    assert tuple(row[0]) == (1, "Text", "de", "org", "a.b.org") and tuple(row[1])[1:] == ("", None, None, None)
    hidden = F.col("doc_id") % 3 == 0  # labels that the model has not seen
    rows = stored(language.of_pages(pages), "pages")
    got = language.identify(rows.withColumn("declared", F.when(~hidden, F.col("declared")))).join(evidence, "doc_id").filter(hidden).collect()
    assert len(got) > 10 and np.mean([r.lang == r.declared for r in got]) > 0.95


def brute_language(rows):
    """``doc_id: (lang, confidence, kept)`` of rows ``doc_id, text, declared, suffix, host``, each label with under ``SAMPLE`` rows."""
    letter = {0x20, 0x0A, *range(97, 123), *range(128, 256)}

    def slots(text):
        b = text.lower().encode()
        return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 % 2**32) >> 16 for i in range(len(b) - 2) if letter.issuperset(b[i : i + 3])]

    def normal(logs):
        e = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(e) for x in e]

    counts = {}
    for _, text, declared, *_ in rows:
        if text is not None and declared:
            counts.setdefault(declared, Counter()).update(slots(text))
    langs = sorted(x for x in counts if counts[x])
    sizes = [sum(counts[x].values()) + 0.05 * 65536 for x in langs]
    model = [{s: math.log((c + 0.05) / n) for s, c in counts[x].items()} for x, n in zip(langs, sizes)]
    none = [math.log(0.05 / n) for n in sizes]
    scored = []
    for i, text, declared, suffix, host in rows:
        own = slots(text or "")
        mean = [sum(m.get(s, z) for s in own) / len(own) if own else 0.0 for m, z in zip(model, none)]
        letters = any(map(str.isalpha, text or ""))
        ll = [x * min(64, len(own)) for x in mean]
        scored.append((i, declared, suffix, host, letters, bool(own) and max(mean) < -2 * math.log(256), ll, normal(ll) if letters else [0.0] * len(langs)))
    sums = lambda some: [sum(r[7][k] for r in some) for k in range(len(langs))]
    smooth = lambda own, above: [(x + 20 * a) / (sum(own) + 20) for x, a in zip(own, above)]
    base = [(x + 1) / (sum(sums(scored)) + len(langs)) for x in sums(scored)]
    heard = {}
    said = {d: sums([r for r in scored if r[1] == d]) for d in langs}
    for d in langs:
        heard[d] = [math.log((x + 0.5) / (sum(said[e][k] for e in langs) + 0.5 * len(langs))) for k, x in enumerate(said[d])]
    out = {}
    for i, declared, suffix, host, letters, even, ll, _ in scored:
        prior = smooth(sums([r for r in scored if r[2] == suffix]), base) if suffix is not None else base
        prior = smooth(sums([r for r in scored if (r[2], r[3]) == (suffix, host)]), prior) if host is not None else prior
        final = normal([a + math.log(p) + h for a, p, h in zip(ll, prior, heard.get(declared, [0.0] * len(langs)))])
        p = max(final)
        lang = max(k for k, x in enumerate(final) if x == p)
        out[i] = (langs[lang] if letters else None, p if letters else 0.0, letters and not (even and (not declared or declared in langs)) and p >= 0.5)
    return out


def test_language_query_is_brute_force(spark, sf, rows_of):
    rows = [(i, t, lang, None, source) for i, t, lang, source in rows_of("documents", ["doc_id", "text", "lang", "source"])]
    _same_languages(language.op6_language_id(spark, sf).collect(), brute_language(rows))


def test_language_of_pages_is_brute_force(spark, sf):
    rows = stored(language.of_pages(spark.read.parquet(f"{sf}/pages.parquet")), "pages")
    rows = rows.union(spark.createDataFrame([(-1, "of the", None, "org", None), (-2, "", "en", None, "h"), (-3, None, None, None, None), (-4, "qq", "xx", "de", "h")], rows.schema))
    wanted = brute_language([tuple(r) for r in rows.select("doc_id", "text", "declared", "suffix", "host").collect()])
    _same_languages(language.identify(stored(rows, "pages")).collect(), wanted)


def test_scores_are_few_files(spark, sf):
    """Forty tasks read the texts; their scores, a small share of the bytes, are one file."""
    before = set(written())
    language.identify(language.of_documents(spark.read.parquet(f"{sf}/documents.parquet").repartition(40)))
    names = {path.rsplit("/", 1)[1].split("-")[0]: path for path in written() if path not in before}
    assert len(spark.read.parquet(names["scores"]).inputFiles()) == 1
    assert "suffixes" not in names  # documents have none


def test_few_hosts_are_broadcast_and_many_are_merged(spark, sf):
    rows = stored(language.of_pages(spark.read.parquet(f"{sf}/pages.parquet")), "pages")
    few = language.identify(rows)
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        many = language.identify(rows)
        assert many._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 2
        merged = {r.doc_id: (r.lang, r.confidence, r.kept) for r in many.collect()}
    finally:
        spark.conf.set(key, before)
    _same_languages(few.collect(), merged)


def _same_languages(got, wanted):
    assert len(got) == len(wanted)
    for r in got:
        lang, p, kept = wanted[r.doc_id]
        assert abs(r.confidence - p) < 1e-4 and (r.kept == kept or abs(p - 0.5) < 1e-4)
        assert r.lang == lang or p < 0.51


# -- HTML ---------------------------------------------------------------------------------------------------------


def test_html_query(spark, sf, rows_of):
    got = {r.page_id: r for r in html.op7_html(spark, sf).collect()}
    for i, url, page in rows_of("pages", ["page_id", "url", "html"]):
        inner = page[page.find("<article>") + 9 : page.find("</article>")]
        text = " ".join(entities.unescape(re.sub(r"<br>|</?p>|</?h1>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, text, len(text))


def test_html_query_in_sql(agree):
    agree(html.op7_html, html.ORACLE)


PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><h1>A  title</h1><div class=ad>Buy</div><p>First &amp; <b>bold</b>&nbsp;text<br>goes on.<!-- no --><p>Second<script>x</script> one &lt;3
<aside>Aside</aside><form><p>Your name</p><input value="a>b"></form><p hidden>Hidden</p><ul><li>point</li></ul><p>See <a href="z">the link</a> for more words.</p></main>
<div id="sidebar-left"><p>The of and the of and the side</p></div><section id=comments><p>Great post of the day</p></section>
<div role="contentinfo">Info</div><footer>&copy; me</footer></body></html>"""


def test_html_rules():
    assert html.main_text(PAGE) == "A title First & bold text goes on. Second one <3 point See the link for more words."


def test_html_names_about_something_stay():
    """Names that hold a listed word but are about something, and unquoted values that end with a slash."""
    for tag in ('p id="share-price"', 'p class="related-work"', 'section id="form-and-function"', 'div class="ad-free"', 'p class="footer_ratio x"', "div data-u=/x/"):
        assert html.main_text(f"<article><p>One.</p><{tag}>Two.</{tag.split()[0]}><p>Three.</p></article>") == "One. Two. Three."
    for tag in ("div class=ad data-u=/x/", "div id='share-buttons'", 'div class="relatedPosts"', 'div class="ad-728x90"', "section id=comments-12", 'div class="cookie-policy-banner"', "div class='x site-footer'"):
        assert html.main_text(f"<article><p>One.</p><{tag}>BUY NOW</{tag.split()[0]}><p>Three.</p></article>") == "One. Three.", tag
    many = " ".join(f"<a href=/x{k}/>word {k}</a>" for k in range(9))
    assert html.main_text(f"<article><p>One.</p><p>{many}</p></article>") == "One."  # all links
    assert html.main_text("<article><p>One.<a name='x'/> Two.</p><div hidden/><p>Three.<br/>Four.</p></article>") == "One. Two. Three. Four."
    seen = [html._closed(x) for x in ("", "/", " /", " a=/x/", " a='x'/", ' a="x"/', " hidden/", " a=x /")]
    assert seen == [False, True, True, False, True, True, True, True]


def test_both_passes_decide_in_articles():
    long = "This is the text of the story and it was told by the man who had been there for all of the days. " * 3
    calls = []
    own = html.first_pass
    html.first_pass = lambda *a: calls.append(a) or own(*a)
    try:
        page = f"<article><p>{long}</p><p>Short one.</p><ul><li><a href=a>Next</a></li><li><a href=b>Last</a></li></ul></article><p>{long}</p>"
        assert html.main_text(page) == " ".join(f"{long} Short one. {long}".split())
    finally:
        html.first_pass = own
    assert len(calls) == 5


def test_html_without_an_article():
    long = "This is the text of the story and it was told by the man who had been there for all of the days. " * 3
    page = f"<body><div><a href=a>Home</a> <a href=b>News</a></div><div>Menu</div><p>{long}</p><p>Short one.</p><p>{long}</p><div><a href=c>Next page</a></div><div>Top</div></body>"
    assert html.main_text(page) == " ".join(f"{long}Short one. {long}".split())
    assert html.second_pass([None, True, None, None, None, False, None]) == [True, True, True, False, False, False, False]
    assert html.second_pass([False, None, True], [False, True, False]) == [False, True, True]


def test_html_pages_without_an_article_through_the_operator(spark, rows_of):
    """The tables' pages of some length with the article tag taken away: nearly all text stays, and nothing around it."""
    rows = rows_of("pages", ["page_id", "url", "html"])
    bare = [(i, u, page.replace("<article>", "<div>").replace("</article>", "</div>")) for i, u, page in rows]
    kind = "page_id long, url string, html string"
    with_tag, without = ({r.page_id: r.text for r in html.extract(spark.createDataFrame(x, kind)).collect()} for x in (rows, bare))
    kept = [len(without[i]) / len(with_tag[i]) for i in with_tag if len(with_tag[i]) >= 200]
    assert len(kept) > 30 and np.mean(kept) > 0.99 and min(kept) > 0.9
    for i, _, page in rows:
        for advert in re.findall(r'<div class="ad">(.*?)</div>', page):
            assert advert not in without[i]


def test_html_teaser_articles_do_not_hide_the_body():
    long = "This is the text of the story and it was told by the man who had been there for all of the days. " * 3
    body = f"<div>{long}</div><div>It was short.</div><div>{long}</div>"
    for card in ("<article><h2>Other news</h2><p>Some words.</p></article>", "<main><p>Loading</p></main>"):
        text = html.main_text(f"<body><div><a href=a>Home</a></div>{body}{card}</body>")
        assert " ".join(f"{long}It was short. {long}".split()) in text


def test_html_without_listed_stop_words():
    """Paragraphs of few or none of the listed words stay, with the article tag or without."""
    r = random.Random(5)
    say = lambda n: " ".join("".join(r.choice("aäikloptuvy") for _ in range(r.randint(3, 9))) for _ in range(n))
    for mixed in (False, True):
        own = [say(12), say(60), say(25), say(90)]
        if mixed:
            own[1:1] = ["This is the text of the story and it was told by the man who had been there for all of the days."]
        inner = "".join(f"<p>{p}</p>" for p in own)
        for page in (f"<article>{inner}</article>", f"<div><a href=a>Etusivu</a></div><div>{inner}</div><div><a href=b>Lue muuta</a></div>"):
            assert html.main_text(page) == " ".join(own), page


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b", ">", "<", "</", "<!--", "-->", "<script>", "</script>", '<a href="', '"', "text ", "&amp", "&#x41;", "<article>", "</article>", "<div class=ad>", "</div>", "'", "<br/>", "<!x"])))
def test_html_of_any_soup(parts):
    assert isinstance(html.main_text("".join(parts)), str)


def test_html_odd_rows(spark):
    kind = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, None, None, "x", 3), (None, "u", "", None, None), (1, "u", "<article>a", "x", 3), (1, "u", "<article>a", "x", 3), (2, "u", "<article>" + "word " * 200_000, "", 0), (3, "u", "<" * 50_000, "", 0)]
    got = html.extract(spark.createDataFrame(rows, kind)).collect()
    assert Counter((r.page_id, r.n_chars) for r in got) == Counter([(1, 0), (None, 0), (1, 1), (1, 1), (2, 999_999), (3, got_chars(rows[5][2]))])
    assert html.extract(spark.createDataFrame([], kind)).collect() == []


def got_chars(page):
    return len(html.main_text(page))


# -- sharding -----------------------------------------------------------------------------------------------------


def test_sharding_query(agree):
    agree(sharding.op9_sharding, sharding.ORACLE)


def test_shards_are_merged_by_size(spark, tmp_path):
    s = sharding.Shards(spark, f"file://{tmp_path}/t", small=4000, target=1 << 20)
    make = lambda a, b: spark.range(a, b).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"))
    for k in range(3):
        s.append(make(100 * k, 100 * k + 100))
    assert s.compact()["version"] == 3  # three of a size are not enough
    old = s.manifest()
    s.append(make(300, 400))
    after = s.compact()
    assert len(after["runs"]) == 1 and s.versions() == [1, 2, 3, 4, 5]
    assert sorted(r.id for r in s.read().collect()) == list(range(400))
    assert s.read(3).count() == 300 and [r["run"] for r in s.manifest(3)["runs"]] == [r["run"] for r in old["runs"]]
    s.append(make(0, 0))
    s.append(make(0, 10))  # repeated rows stay
    assert s.read().count() == 410
    s.vacuum()
    assert s.read().count() == 410 and len(list((tmp_path / "t" / "runs").iterdir())) == len(s.manifest()["runs"])


def test_two_writers_of_shards(spark, tmp_path, second_writer):
    a = sharding.Shards(spark, f"file://{tmp_path}/t")
    b = sharding.Shards(spark, f"file://{tmp_path}/t")
    a.append(spark.range(5))
    behind = b.manifest()
    second_writer(a.commits, lambda: b.append(spark.range(5, 7)))
    a.append(spark.range(7, 10))
    assert not b._commit(behind, behind["schema"], [])  # taken
    assert sorted(r.id for r in a.read().collect()) == list(range(10)) and a.versions() == [1, 2, 3]
    a.append(spark.range(1))
    second_writer(a.commits, lambda: b.append(spark.range(1)))
    a.compact()  # an arrival came between: the merge still holds
    assert a.read().count() == 12 and len(a.manifest()["runs"]) == 2
    for _ in range(3):
        a.append(spark.range(1))
    second_writer(a.commits, b.compact)
    a.compact()  # merged by both: one of them counts
    assert a.read().count() == 15
    stray = tmp_path / "t" / "manifests" / ".tmp-x"
    stray.write_text(json.dumps({"broken": 1}))
    assert b.read().count() == 15


def test_arrivals_have_the_tables_columns(spark, tmp_path):
    s = sharding.Shards(spark, f"file://{tmp_path}/t")
    s.append(spark.range(5))
    for other in (spark.range(5).toDF("other"), spark.range(5).select(F.col("id").cast("string")), spark.range(5).withColumn("more", F.lit(1))):
        with pytest.raises(ValueError, match="columns"):
            s.append(other)
    assert s.read().count() == 5 and s.versions() == [1]
    s.append(spark.createDataFrame([(None,)], "id long"))  # nullable or not is no difference
    assert s.read().count() == 6


def test_sharding_odd_rows(spark, odd, odd_rows, none, tmp_path):
    s = sharding.Shards(spark, f"file://{tmp_path}/t", small=100)
    with pytest.raises(ValueError, match="nothing"):
        s.read()
    for _ in range(4):
        s.append(odd)
    s.append(odd.limit(0))
    s.compact()
    got = s.read()
    assert got.columns == odd.columns and got.count() == 4 * len(odd_rows)
    assert got.exceptAll(odd.union(odd).union(odd).union(odd)).count() == 0
