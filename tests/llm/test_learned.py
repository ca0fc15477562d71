import html
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import html_text, langid, toxicity

MEDIUM = "/root/testdata/sf0.01"


# --- main text ---------------------------------------------------------------------------------------------------------------


def test_tree_fits_its_table():
    x, y = html_text.labelled()
    assert (html_text.tree().predict(x) == y).all() and 0 < y.mean() < 1


def test_article_of_every_page(spark):
    """The pages' articles, cut out with regular expressions that know how these pages are built."""
    rows = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(rows.withColumn("text", F.lit("x")).withColumn("n_chars", F.lit("x"))).collect()}
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert len(got) == rows.count()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("<article>a &amp; b&nbsp;&#x41; &lt;i&gt;</article>", "a & b A <i>"),
        ("<article><p>One<p>Two <b>bold<br>x</article><footer>no</footer>", "One\nTwo bold x"),
        ("<article><script>var a='<p>no</p>'</script><style>p{}</style><p>yes<!-- <p>no</p> --></p><noscript>no</noscript></article>", "yes"),
        ("<article><p title='a>b' class=\"x\">kept</p><form>no<input></form><aside>no</aside><div class='comments'><p>no</p></div></article>", "kept"),
        ("<div class='cookie-notice'>no</div><main><p>kept</p></main><div id=sidebar>no</div>", "kept"),
        ("<article><p>a\n\t b  c</p></article>", "a b c"), ("<article><p>cut off", "cut off"), ("<article>x < y</article>", "x < y"),
        ("<svg class='i' /><article><p>kept</p></article>", "kept"), ("<article><p>a</p><iframe src=x /><p>b</p></article>", "a\nb"),
        ("<article data-id='header' data-hidden='false' title='a id=menu b'><p>kept</p></article>", "kept"), ("<main class='has-sidebar'><p>kept</p></main>", "kept"),
        ("<div class='content-sidebar-wrap'><article><p>kept</p></article></div>", "kept"), ("<article><p title=it's>a</p><p class=\"x>b</p></article>", "a\nb"),
        ("<article>a<svg><text>no</text></svg>b<SCRIPT>no</Script >c<scripty>d</article>", "abcd"), ("<article hidden><p>no</p></article><main>kept</main>", "kept"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", ["<a " * 200_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, '<a href="' * 100_000, "<!--" * 100_000, "<svg>" * 100_000, "</p x='" * 100_000, "<a b='c' " * 100_000])
def test_work_is_linear(page):
    """Hostile pages take no more than a few microseconds a character (a quadratic reader takes minutes)."""
    begin = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - begin < 5


def slow_features(found):
    """Features of each block, one by one."""
    article = any(b.in_article and not b.apart and not b.named for b in found)
    outside = [b for b in found if not b.apart]
    share = sum(b.words for b in outside if b.named) / max(1, sum(b.words for b in outside))
    near = [(0, 0), *((b.words, b.links) for b in found), (0, 0)]
    return [[b.apart, b.named, b.in_article and not b.apart and not b.named, article, share, b.words, b.links, *near[i], *near[i + 2], b.heading] for i, b in enumerate(found)]


def test_blocks_and_features_brute_force():
    """Random pages of known blocks: words, links and containers of each are what was written."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        page, want = "", []
        for _ in range(rng.integers(1, 9)):
            n, k = int(rng.integers(1, 30)), int(rng.integers(0, 4))
            tag, close, apart, named, article = [("<div>", "</div>", False, False, False), ("<nav>", "</nav>", True, False, False), ("<div class='x sidebar'>", "</div>", False, True, False), ("<main>", "</main>", False, False, True)][rng.integers(4)]
            heading = bool(rng.integers(2))
            p = "h2" if heading else "p"
            page += f"{tag}<{p}>{'w ' * n}<a href='?a>b'>{'v ' * k}</a></{p}>{close}<!-- <p>no -->"
            want.append(html_text.Block(" ".join(["w"] * n + ["v"] * k), n + k, k / (n + k), apart, named, article, heading))
        found = html_text.blocks(page)
        assert found == want
        assert np.allclose(html_text.features(found), np.array(slow_features(found), float))


def test_words_overrule_names():
    """A page that names all of its text a sidebar still has its long paragraphs; a real sidebar beside a main part goes."""
    long, other = "w " * 60, "v " * 60
    assert html_text.main_text(f"<nav><a href=a>n</a></nav><div class=sidebar><p>{long}</p><p>{other}</p></div>") == f"{long.strip()}\n{other.strip()}"
    assert html_text.main_text(f"<div><p>{long}</p><p>{long}</p><p>{long}</p></div><div class=sidebar><p>{other}</p></div>") == "\n".join([long.strip()] * 3)


def test_pages_edge_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<article>x</article>")], "page_id long, url string, html string")
    assert sorted(map(tuple, html_text.extract(df).collect()), key=str) == [(1, None, "", 0), (1, None, "", 0), (None, "u", "x", 1)]
    assert html_text.extract(df.limit(0)).collect() == []
    long = "<article><p>" + "<b>word</b> " * 50_000 + "<a title='open>" * 2000 + "</article>"
    assert html_text.main_text(long).startswith("word word")


# --- language ----------------------------------------------------------------------------------------------------------------


def slow_marginals(emission, step):
    """Forward-backward of one chain, word by word."""
    n, k = emission.shape
    e = np.exp(emission)
    a, b = np.zeros((n, k)), np.ones((n, k))
    for t in range(n):
        a[t] = (a[t - 1] if t else np.full(k, 1 / k)) @ step * e[t]
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = step @ (e[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    m = a * b
    pairs = np.zeros((k, k))
    for t in range(1, n):
        x = a[t - 1][:, None] * step * (e[t] * b[t])[None, :]
        pairs += x / x.sum()
    return m / m.sum(1, keepdims=True), pairs


def test_block_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    sizes = [1, 2, 63, 64, 65, 128, 129, 400, 3]
    step = rng.random((3, 3)) + 0.05
    step /= step.sum(1, keepdims=True)
    chains = [rng.normal(size=(n, 3)) * 3 for n in sizes]
    got, pairs = langid.forward_backward(np.concatenate(chains), np.repeat(np.arange(len(sizes)), sizes), step)
    slow = [slow_marginals(c, step) for c in chains]
    assert np.allclose(got, np.concatenate([m for m, _ in slow]), atol=1e-9)
    assert np.allclose(pairs, sum(p for _, p in slow), atol=1e-7)


def test_words_are_runs_of_letters():
    some = ["Été d'x 12 ab", "", "1 2", "日本 a"]
    words = langid.Words.of(some)
    assert [(int(d), some[d][b:e]) for d, b, e in zip(words.doc, words.begin, words.end)] == [(0, "Été"), (0, "d"), (0, "x"), (0, "ab"), (3, "日本"), (3, "a")]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    blind = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.col("lang"))).withColumn("score", F.lit("x"))
    got = langid.predict_held_out(blind).collect()
    assert {r.doc_id for r in got} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_edges_and_spans(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = langid.fit(docs)
    en, de = (docs.where(f"lang = '{x}' and length(text) between 400 and 3000").orderBy("doc_id").first().text for x in ("en", "de"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (None, en), (4, en), (4, en), (5, en + "\n" + de), (6, "é" * 300_000)], "doc_id long, text string").withColumn("lang_pred", F.lit(1))
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(odd, model, ["doc_id"]).collect()]
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")]
    assert got.count((4, "en")) == 2 and (None, "en") in got and len(got) == 8
    spans = langid.language_spans(odd.where("doc_id = 5"), model).orderBy("begin").collect()
    assert spans[0].lang == "en" and spans[-1].lang == "de" and abs(max(s.end for s in spans if s.lang == "en") - len(en)) < 60
    empty = docs.limit(0)
    assert langid.predict_held_out(empty).collect() == []
    unlabelled = docs.limit(3).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.predict_held_out(unlabelled).collect()} == {("und", 0.0)}


# --- toxicity ----------------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_brute_force():
    import random

    random.seed(5)
    entries = ["idiot", "moron", "worthless", "scum", "pathetic", "lowei*"]
    lexicon = toxicity.Lexicon(entries)
    words = ["idiot", "idiots", "lowei", "loweiabc", "lowe", "scun", "wrthles", "", "mmoronn"]
    for _ in range(3000):
        w = list(random.choice(entries).rstrip("*"))
        for _ in range(random.randint(0, 3)):
            i = random.randint(0, len(w))
            w[i : i + random.randint(0, 1)] = random.choice(["", *"abcdeimo"])
        words.append("".join(w))
    for w in words:
        exact = w in entries or w.startswith("lowei")
        near = any(0 < distance(w, e) <= toxicity.allowed(len(e)) for e in entries if not e.endswith("*"))
        assert lexicon.match(w) == (2 if exact else int(near)), w


def test_quotation_scores_lower_than_abuse():
    model = toxicity.Model(["idiot", "moron"], [2.0, 3.0, 1.0, 1.0, 1.0], -5.0)
    abuse, quoted = "you are an idiot and a moron, all of you", 'the witness said the word "idiot" was used and wrote "moron" too'
    assert model.score(abuse) > model.score(quoted) > model.score("nothing of the kind")
    assert model.score("what an id1ot") > model.score("what a nice day")


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.score_held_out(docs.withColumn("predicted", F.lit("x")), labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.93 * len(held)
    assert not any(r.predicted for r in held if not truth[r.doc_id])
    hidden = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    again = {r.doc_id: r.score for r in toxicity.score_held_out(docs, hidden).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "idiot"), (4, "x " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_held_out(docs, labels).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1
    assert toxicity.score_held_out(docs.limit(0), labels).collect() == []
    model = toxicity.Model(["idiot"], [9.0, 0, 0, 0, 0], -3.0)
    spans = toxicity.toxic_spans(spark.createDataFrame([(7, 'An IDIOT, idi0t and "idiot"')], "doc_id long, text string"), model).collect()
    assert [(r.begin, r.end, r.exact) for r in spans] == [(3, 8, True), (10, 15, False), (21, 26, True)] and spans[2].quotation > spans[0].quotation
