"""HTML extraction, the quality classifier and the pipeline."""

import html
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from apothecary.llm import html_wrappers, jaccard, quality, queries, suffix_dedup
from tests.conftest import SMALL


def test_articles_of_the_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries.op4_html_extract(spark, SMALL).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL).group(1)
        cut = re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", article.replace("<br>", " ")))
        want = "\n\n".join(t for t in (" ".join(html.unescape(c).split()) for c in cut) if t)
        assert (r["text"], r["n_chars"]) == (want, len(want))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href="/">Home</a></header><nav>Menu</nav>
<div class="cookie-notice">We use cookies</div><main><h1>Head&amp;line</h1><script>var t="</p>";</script><p>One <b>bold</b><br>line<p>Two &lt;3<!-- no -->
<ul><li>a<li>b</ul><aside>Side</aside><form>Send</form><div class="ad">Buy</div><section id="comments">Reader says</section></main><footer>Foot</footer>"""


def text_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "host": F.lit("y"), "pages": F.lit(1)})
    return {r["page_id"]: r["text"] for r in html_wrappers.extract_main_text(df).collect()}


def test_boilerplate_goes_and_blocks_stay(spark):
    got = text_of(spark, [(1, "http://a/1", PAGE), (2, "http://a/2", None), (3, None, "plain text"), (None, "no url", ""), (4, "http://b/", "<p>x</p>" * 3000)])
    assert got[1] == "Head&line\n\nOne bold line\n\nTwo <3\n\na\n\nb"
    assert got[2] == "" and got[3] == "plain text" and got[None] == "" and got[4].count("x") == 3000
    assert text_of(spark, []) == {}


def test_template_text_outside_an_article_is_found_by_comparing_pages(spark):
    page = "<body><div><span>Welcome back</span></div><div class=body><p>Story {n}</p><p>More {n}</p></div></body>"
    got = text_of(spark, [(n, f"http://h/{n}", page.format(n=n)) for n in range(4)])
    assert got[2] == "Story 2\n\nMore 2"


def test_text_that_one_page_has_stays_outside_an_article(spark):
    page = "<body><div><span>Welcome back</span></div><div class=body><p>Story {n}</p><p>More {n}</p>{own}</div></body>"
    rows = [(n, f"http://h/{n}", page.format(n=n, own="<blockquote>Said once</blockquote><h3>Lone</h3>" if n == 2 else "")) for n in range(5)]
    got = text_of(spark, rows)
    assert got[2] == "Story 2\n\nMore 2\n\nSaid once\n\nLone" and got[3] == "Story 3\n\nMore 3"
    minority = [(n, f"http://m/{n}", page.format(n=n, own="<h3>Some</h3>" if n < 3 else "")) for n in range(8)]
    assert text_of(spark, minority)[1] == "Story 1\n\nMore 1\n\nSome"


def test_copies_of_a_page_are_not_template_text(spark):
    page = "<body><nav>Menu {n}</nav><h1>Title</h1><div><p>Body</p></div></body>"
    got = text_of(spark, [(n, f"http://same/{n}", page.format(n=0)) for n in range(40)] + [(100 + n, f"http://menus/{n}", page.format(n=n)) for n in range(40)])
    assert set(got.values()) == {"Title\n\nBody"}


def test_template_text_takes_no_other_text_at_its_path(spark):
    page = "<body><p>Welcome back</p><div>Story {n}</div><p>More {n}</p></body>"
    assert text_of(spark, [(n, f"http://h/{n}", page.format(n=n)) for n in range(4)])[2] == "Story 2\n\nMore 2"


def test_counts_of_slots_are_counts_of_different_pages(spark):
    rows = [(f"<p>Same</p><div>{n % 7}</div>",) for n in range(60)]
    (row,) = html_wrappers.infer_wrappers(spark.createDataFrame(rows, "html string").repartition(6).withColumn("host", F.lit("h"))).collect()
    assert (row["pages"], row["bodies"]) == (60, 7) and json.loads(row["wrapper"])[0] == ["p", "1", [["#", "1", zlib.crc32(b"Same"), 7]]]


def test_fixed_text_inside_an_article_stays(spark):
    """Nothing of an article is dropped, however many pages of a host share it."""
    page = "<body><article><h1>Dish {n}</h1><h2>Ingredients</h2><p>Eggs {n}</p><h2>Method</h2><p>Stir {n}</p><p>Serves four.</p></article></body>"
    got = text_of(spark, [(n, f"http://h/{n}", page.format(n=n)) for n in range(8)])
    assert got[3] == "Dish 3\n\nIngredients\n\nEggs 3\n\nMethod\n\nStir 3\n\nServes four."


def test_fixed_headings_outside_an_article_stay_before_text_that_varies(spark):
    page = "<body><div><span>Welcome back</span></div><h1>Dish {n}</h1><h2>Ingredients</h2><p>Eggs {n}</p><h2>Method</h2><p>Stir {n}</p><section><h2>About us</h2><div>We cook daily</div></section></body>"
    got = text_of(spark, [(n, f"http://h/{n}", page.format(n=n)) for n in range(8)])
    assert got[3] == "Dish 3\n\nIngredients\n\nEggs 3\n\nMethod\n\nStir 3"


def test_glossaries_and_single_links_keep_their_text(spark):
    page = "<body><p><a href=/{n}>Word {n} explained</a></p><p>Plain {n}</p></body>"
    assert text_of(spark, [(n, f"http://h/{n}", page.format(n=n)) for n in range(8)])[3] == "Word 3 explained\n\nPlain 3"
    anchors = "<body><p><a name=x>One {n}</p><p>Two {n}</p><ul><li><a href=/>Open {n}<li>Three {n}</ul></body>"
    assert text_of(spark, [(n, f"http://h/{n}", anchors.format(n=n)) for n in range(8)])[3] == "One 3\n\nTwo 3\n\nOpen 3\n\nThree 3"
    single = "<body><div><a href=/{n}>Story {n}</a></div><p>Plain {n} <a href=/>more</a></p></body>"
    assert text_of(spark, [(n, f"http://h/{n}", single.format(n=n)) for n in range(8)])[3] == "Story 3\n\nPlain 3 more"


def test_only_aligned_pages_make_a_template(spark):
    """A page's own tree tells nothing; aligned with another page it does, so the wrapper decides."""
    page = "<body><div>Welcome back</div><ul><li><a href=/i>In {n}</a><li><a href=/o>Out {n}</a></ul><p>Story {n}</p></body>"
    trees = [html_wrappers.generalise(html_wrappers.blocks(page.format(n=n))[0]) for n in range(3)]
    assert all(html_wrappers.template(tree)[0] == set() for tree in trees)
    fixed, links = html_wrappers.template(html_wrappers.align(html_wrappers.align(*trees[:2]), trees[2]))
    assert fixed == {("body/div", zlib.crc32(b"Welcome back"))} and links == {"body/ul/li/a"}
    optional = html_wrappers.generalise(html_wrappers.blocks("<body><p>Story</p></body>")[0])
    assert html_wrappers.template(html_wrappers.align(trees[0], optional))[0] == set()
    got = text_of(spark, [(n, f"http://h/{n}", page.format(n=n)) for n in range(3)] + [(9, "http://lone/", page.format(n=9))])
    assert got[1] == "Story 1" and got[9] == "Welcome back\n\nIn 9\n\nOut 9\n\nStory 9"


def test_menus_without_any_mark_are_slots_of_links(spark):
    page = "<body><div><ul><li><a href=/>Home {n}</a></li><li><a href=/n>News {n}</a></li></ul></div><section><h1>Story {n}</h1><p>One {n} <a href=/x>link</a> and a good deal of other words</p></section></body>"
    got = text_of(spark, [(n, f"http://h/{n}", page.format(n=n)) for n in range(8)])
    assert got[3] == "Story 3\n\nOne 3 link and a good deal of other words"


def test_versions_of_one_page_keep_what_they_share(spark):
    page = "<body><article><h1>Same headline</h1><h2>Part</h2><p>Paragraph of version {n}</p></article></body>"
    got = text_of(spark, [(n, f"http://h/{n}", page.format(n=n)) for n in range(8)])
    assert got[5] == "Same headline\n\nPart\n\nParagraph of version 5"


def test_deeply_nested_pages_keep_all_text(spark):
    deep, end = "<div>" * 400, "</div>" * 400
    got = text_of(
        spark,
        [
            (1, "http://a/", f"<div id=page><article>{deep}deep{end}<p>rest</p></article></div>"),
            (2, "http://b/", f"<div>out</div>{deep}<article><header>H</header><p>a</p><nav>{deep}menu{end}</nav><p>b</p></article>{end}"),
            (3, "http://c/", f"<nav>{deep}menu{end}</nav>{deep}<h1>x</h1><footer>f</footer><p>y</p>{end}z"),
            (4, "http://d/", f"<article>{'<section>' * 400}<p>one<ul><li>two<li>three</ul><table><tr><td>4<td>5</table></article><p>after</p>"),
        ],
    )
    assert got == {1: "deep\n\nrest", 2: "H\n\na\n\nb", 3: "x\n\ny\n\nz", 4: "one\n\ntwo\n\nthree\n\n4\n\n5"}


def test_very_deep_pages_take_linear_time():
    texts = html_wrappers.blocks("<div>" * 100_000 + "<p>x</section>" * 20_000)[1]
    assert len(texts) == 20_000


def test_wrapper_is_a_union_free_expression():
    pages = ["<ul><li>a</li><li>b</li></ul><p>x</p>", "<ul><li>c</li></ul><h2>t</h2><p>x</p>", "<ul></ul><p>y</p><p>z</p>"]
    wrapper = []
    for page in pages:
        new = html_wrappers.generalise(html_wrappers.blocks(page)[0])
        wrapper = html_wrappers.align(wrapper, new) if wrapper else new
    assert html_wrappers.expression(json.loads(json.dumps(wrapper))) == "<ul>(<li>#</li>)*</ul>(<h2>#00000000</h2>)?(<p>#</p>)+".replace("00000000", f"{zlib.crc32(b't'):08x}")


def test_quality_on_the_held_out_third(spark):
    sf = SMALL.replace("0.001", "0.01")
    rows = queries.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "word " * 20000)], "doc_id long, text string").withColumns({"score": F.lit("x"), "quality": F.lit(0)})
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["doc_id"], r["predicted"]) for r in quality.score_documents(docs, none).collect()} == {(1, 1), (2, 1), (None, 1), (3, 1)}
    some = spark.createDataFrame([(2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.score_documents(docs, some).collect())
    assert quality.score_documents(docs.limit(0), some).collect() == []


def test_prior_is_near_the_truth():
    rng = np.random.default_rng(1)
    positive = rng.normal(0, 1, (3000, 4))
    mixed = np.vstack([rng.normal(0, 1, (2100, 4)), rng.normal(4, 1, (900, 4))])
    assert quality.estimate_prior(positive, rng.permutation(mixed)) == pytest.approx(0.7, abs=0.06)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 4
    kept = corpus_pipeline.keep_quality(spark, docs, SMALL)
    assert kept.columns == docs.columns
    scorer = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {r["doc_id"] for r in quality.score(docs, scorer).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want
    single = corpus_pipeline.keep_one_of_near_copies(spark, docs, SMALL)
    groups = jaccard.jaccard_groups(docs).collect()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({r["class_id"] for r in groups}) and single.columns == docs.columns
    cut = corpus_pipeline.cut_repeats(spark, docs, SMALL)
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(docs).collect()}


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert rows and max(r["n"] for r in rows) <= 2048


def test_near_copy_stage_keeps_rows_without_id_and_one_of_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, "other words are here now")], "doc_id long, text string")
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, SMALL).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 3]


def test_near_copy_stage_tells_texts_of_one_id_apart(spark):
    one, two, three, four = (" ".join(f"{c}{k}" for k in range(60)) for c in "abcd")
    rows = [(1, one), (2, one + " more"), (2, two), (2, two), (3, three), (3, three + " more"), (4, four), (4, None), (5, three), (4, two + " more")]
    got = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()
    kept = [(r["doc_id"], r["text"]) for r in got]
    assert kept.count((1, one)) == kept.count((2, two)) == kept.count((4, four)) == kept.count((4, None)) == 1
    assert len(kept) == 5 and sum(r[0] == 3 for r in kept) == 1


def slow_risk(scorer, positive, unlabelled):
    """The non-negative risk with logistic loss, row by row."""
    loss = lambda z: float(np.log1p(np.exp(-abs(z))) + max(-z, 0))
    p, u = scorer.margin(positive), scorer.margin(unlabelled)
    on_positive, negative = (sum(loss(s * z) for z in p) / len(p) for s in (1, -1))
    return scorer.prior * on_positive + max(0.0, sum(loss(-z) for z in u) / len(u) - scorer.prior * negative)


def test_the_fitted_scorer_has_a_low_risk_by_a_slow_count():
    """No small change of the last layer lowers the risk by much, and the classes part at the right place."""
    import copy

    rng = np.random.default_rng(6)
    positive, good, bad = rng.normal(0, 1, (800, 3)), rng.normal(0, 1, (700, 3)), rng.normal(3, 1, (300, 3))
    mixed = rng.permutation(np.vstack([good, bad]))
    scorer = quality.fit(positive, mixed, 0.7)
    risk = slow_risk(scorer, positive, mixed)
    assert risk < slow_risk(quality.fit(positive, mixed, 0.7, rounds=5), positive, mixed)
    for _ in range(30):
        other = copy.copy(scorer)
        other.w2, other.b2 = scorer.w2 + rng.normal(0, 0.05, len(scorer.w2)), scorer.b2 + rng.normal(0, 0.05)
        assert slow_risk(other, positive, mixed) > risk - 0.02
    assert (scorer(good) >= 0.5).mean() > 0.95 and (scorer(bad) >= 0.5).mean() < 0.1


def test_null_and_repeated_labels_change_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = labels.union(labels).union(labels.select("doc_id", F.lit(None).cast("int").alias("quality"), "toxic"))
    key = lambda rows: sorted((r["doc_id"], r["score"]) for r in rows)
    assert key(quality.score_documents(docs, odd).collect()) == key(quality.score_documents(docs, labels).collect())
