"""Embeddings, pages, conversations and the pipeline."""

import itertools
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from llm_fixtures import SF_MID, SF_SMALL, empty  # noqa: F401
from tokenmill.llm import chat_format, embedding_dedup, html_text, queries


def brute_links(vectors):
    ok = [k for k, v in enumerate(vectors) if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {k: set() for k in range(len(vectors))}
    for i, j in itertools.combinations(ok, 2):
        a, b = np.array(vectors[i], float), np.array(vectors[j], float)
        if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
            links[i].add(j)
            links[j].add(i)
    return links


def test_embeddings_edges(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=16)
    v = [base.tolist(), (base + 0.01).tolist(), base.tolist(), (-base).tolist(), None, [], [0.0] * 16, [1.0, None] * 8,
         [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], (1e30 * base).tolist()]
    v += [(base + 0.02 * rng.normal(size=16)).tolist() for _ in range(30)]
    d = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>").withColumn("kept", F.lit("x"))
    links = brute_links(v)
    for block in (4, 512):
        got = {r.vec_id: r for r in embedding_dedup.near_vectors(d, block=block).collect()}
        assert {k: r.n_links for k, r in got.items()} == {k: len(x) for k, x in links.items()}
        assert all(got[k].component_id == min([k, *(got[j].component_id for j in x)]) for k, x in links.items())
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding_dedup.near_vectors(d.limit(0)).isEmpty()


def test_embeddings_recall(spark):
    """Against brute force over the small table, and for pairs right at the threshold."""
    rows = spark.read.parquet(f"{SF_MID}/embeddings.parquet").orderBy("vec_id").collect()
    links = brute_links([list(r.embedding) for r in rows])
    got = {r.vec_id: r.n_links for r in embedding_dedup.query(spark, SF_MID).collect()}
    assert sum(got.values()) >= 0.9 * sum(map(len, links.values()))
    assert all(got[rows[k].vec_id] <= len(x) for k, x in links.items())
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = 0.951 * a + np.sqrt(1 - 0.951 ** 2) * b / np.linalg.norm(b, axis=1)[:, None]
    x, y = (embedding_dedup.cell_keys(u, embedding_dedup.TABLES, embedding_dedup.PROBES, embedding_dedup.SCALE) for u in (a, b))
    assert (x[:, :, None] == y[:, None, :]).any((1, 2)).mean() >= 0.97


def test_nearest_lattice_point():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)) * 2
    at = embedding_dedup.nearest_e8(x)
    best = ((x - at) ** 2).sum(1)
    for v in embedding_dedup._SHORT:      # no neighbouring lattice point is nearer
        assert (((x - at - v) ** 2).sum(1) >= best - 1e-9).all()
    assert (np.rint(2 * at) == 2 * at).all() and (at.sum(1) % 2 == 0).all()


PAGES = [
    (None, ""), ("", ""), ("<p></p>", ""),
    ("<html><body><nav><a href=x>Home</a> <a>About</a></nav><article><h1>Ti&amp;tle</h1><p>One  <b>two</b>\n three&nbsp;x<p>Four<br>five"
     "<div class='ad-box'>buy</div><form>q<input></form><ul><li>i1<li>i2</ul><section id=comments><p>nice!</section>"
     "<aside>side</aside><script>var a='</p>'</script></article><footer>&copy; me</footer></body></html>",
     "Ti&tle\nOne two three x\nFour five\ni1\ni2"),
    ("<header>Site</header><main><header><h1>T</h1></header><p>body text here</p></main><div class=cookie-notice>we use</div>",
     "T\nbody text here"),
    ("<nav><ul><li>menu<article><p>kept " + "word " * 30 + "</p></article>", "kept " + ("word " * 30).strip()),
]


def test_pages_edges(spark):
    d = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(PAGES)], "page_id long, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(d, html_text.learn_weights(d)).collect()}
    assert got == {k: (t, len(t)) for k, (_, t) in enumerate(PAGES)}
    assert html_text.main_text(d.limit(0), html_text.learn_weights(d.limit(0))).isEmpty()


def test_pages_without_mark_up(spark):
    """Weights learned from marked pages find the content of pages that mark nothing."""
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    w = html_text.learn_weights(pages)
    bare = pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
    a = {r.page_id: set(r.text.split("\n")) for r in html_text.main_text(pages, w).collect()}
    b = {r.page_id: set(r.text.split("\n")) for r in html_text.main_text(bare, w).collect()}
    assert sum(len(a[k] & b[k]) for k in a) >= 0.95 * sum(map(len, a.values()))
    assert sum(len(b[k] - a[k]) for k in a) <= 0.02 * sum(map(len, a.values()))


def test_pages_whose_content_bears_names_of_parts(spark):
    """A class or id of a wrapper, of the content itself or of a section in it loses no content."""
    body, text = "<h1>T</h1><p>" + "word " * 20 + "</p>", "T\n" + ("word " * 20).strip()
    pages = [(f"<div class='{c}'><div><{e}>{body}</{e}></div></div>", text) for e in ("main", "article")
             for c in ("layout has-sidebar", "no-comments", "sidebar", "modal social", "withSidebar", "page-layout nav-open")]
    pages += [(f"<{e} {a}>{body}</{e}>", text) for e in ("main", "article")
              for a in ("class='post social'", "id=comments", "class='hentry tag-legal has-ads'", "class='comment'")]
    pages += [(f"<article>{body}<section id=discussion><p>more</p></section><h2 id='related-work'>Related</h2><p>end</p></article>",
               text + "\nmore\nRelated\nend"),
              (f"<article>{body}</article><div id=comments><article class=comment><p>nice</p></article></div>", text),
              (f"<div class=sidebar><article><p>teaser</p></article></div><div class=sidebar><main>{body}"
               "<section id=comments><article><p>nice</p></article></section></main></div>", text),
              (f"<div class='sidebar' hidden><article>{body}</article></div>", ""),
              ("<div class='legal'><p>" + "word " * 20 + "</p></div><div class=related><ul><li>x<li>y</ul></div>", text[2:])]
    d = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(pages)], "page_id long, html string")
    got = {r.page_id: r.text for r in html_text.main_text(d, ({}, {}, (1.0, -0.5))).collect()}
    assert got == {k: t for k, (_, t) in enumerate(pages)}


def test_pages_score_inline_tags_by_the_learned_weight(spark):
    """Inline tags count as one kind of tag, in the fit and in the scan; links are a kind of their own."""
    article = "<article><p>one <b>two</b> <a href=x>three</a></p></article>"
    pages = spark.createDataFrame([(0, article + "<p>" + "<i>x</i> " * 9 + "</p>")], "page_id long, html string")
    words, tags, _ = html_text.learn_weights(pages)
    assert {"other", "a", "/a"} <= set(tags) and not {"b", "i"} & set(tags)
    page = html_text.Page("<p>" + "word " * 5 + "</p><p><b><i><span>x</span></i></b> " + "word " * 5 + "</p>")
    cheap, dear = (page.text({}, {"other": w}, (1.0, -0.5)).split("\n") for w in (-0.1, -6.0))
    assert len(cheap) == 2 and len(dear) == 1


def test_pages_tables(spark):
    import html
    for r in html_text.query(spark, SF_SMALL).join(spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "html"),
                                                   "page_id").collect():
        inner = re.search("<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [re.sub("<[^>]*>", "", re.sub("<br>", " ", x)) for x in re.split(r"</?(?:p|h\d|div|ul|li|section|table|tr|td)[^>]*>", inner)]
        want = [" ".join(html.unescape(x).split()) for x in parts]
        assert r.text == "\n".join(x for x in want if x)


def cheapest(roles):
    """All repairs by brute force over the acts."""
    best = {chat_format.START: 0}
    for role in roles:
        new = {}
        for s, c in best.items():
            for t in (1, 2, 3):
                change = 0 if chat_format.ROLES[t - 1] == role else chat_format.RELABEL
                if (s, t) in chat_format.BETWEEN:
                    x = c + change + chat_format.INSERT * len(chat_format.BETWEEN[s, t])
                    new[t] = min(new.get(t, x), x)
                if s == t:
                    x = c + change + chat_format.MERGE
                    new[t] = min(new.get(t, x), x)
        best = new
    return min(c + chat_format.INSERT * len(chat_format.CLOSING[s]) for s, c in best.items())


def test_chat_repair(spark):
    rng = np.random.default_rng(7)
    names = ["system", "user", "assistant", None, "tool"]
    convs = {k: [names[j] for j in rng.integers(0, 5, rng.integers(1, 9))] for k in range(60)}
    convs[100] = [names[j] for j in rng.integers(0, 5, 300)]       # reaches over many blocks
    rows = [(k, t, r, None if t == 2 else f"m{k}.{t}") for k, x in convs.items() for t, r in enumerate(x)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("x"))
    for block_rows in (20, 100_000):
        out = {}
        for r in chat_format.repaired(d, block_rows=block_rows).collect():
            out.setdefault(r.conv_id, []).append((r.turn, r.cost, r.rendered))
        assert {k: len(x) for k, x in out.items()} == {k: len(x) for k, x in convs.items()}
        for k, x in out.items():
            assert sum(c for _, c, _ in x) == cheapest(convs[k])
            text = "".join(f for _, _, f in sorted(x))
            parts = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)
            assert re.fullmatch("S?(UA)+", "".join(p[0][0].upper() for p in parts))
            assert [m for p in parts for m in p[1].split("\n") if m] == [f"m{k}.{t}" for t in range(len(convs[k])) if t != 2]
    assert chat_format.repaired(d.limit(0)).isEmpty()


def test_chat_repeated_and_null_keys(spark):
    d = spark.createDataFrame([(None, None, "user", "a"), (None, None, "user", "a"), (1, 0, "user", "q"), (1, 0, "user", "q")],
                              "conv_id long, turn long, role string, text string")
    got = chat_format.repaired(d).groupBy("conv_id").agg(F.sum("cost").alias("c"), F.count("*").alias("n")).collect()
    assert {(r.c, r.n) for r in got} == {(chat_format.MERGE + chat_format.INSERT, 2)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF_SMALL)
        assert d.columns == docs.columns
        before, d = d, spark.createDataFrame(d.collect(), docs.schema)
        assert d.count() > 0
    want = {r.doc_id for r in d.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF_SMALL).collect()} == want
    assert len(want) < docs.count()


def test_pipeline_stages_on_edge_rows(spark, empty):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 50, "en", "s", 250), (2, "word " * 50, "en", "s", 250)]
    d = spark.createDataFrame(rows, empty.schema).withColumn("extra", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_SMALL).isEmpty()
        stage(spark, d, SF_SMALL).collect()


def test_every_operator_is_registered():
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_|", k)[0] for k in queries.QUERIES}
    assert "pipeline" in queries.QUERIES and set(queries.ORACLE) <= set(queries.QUERIES)


WORDS20 = ("word " * 20).strip()
ATTRIBUTES = [
    (f"<article><p title=it's>{WORDS20}</p><p>can't end</p></article>", WORDS20 + "\ncan't end"),
    (f'<article><p class="x>{WORDS20}</p></article>', WORDS20),
    (f"<article><p title='a > b' data-x=\"<p class='ad'>\">{WORDS20}</p></article>", WORDS20),
    (f"<article><p title=\"x class=ad hidden\">{WORDS20}</p></article>", WORDS20),
    (f"<article><section class='search-results'><p>{WORDS20}</p></section><section class='copyright-law'>law</section></article>",
     WORDS20 + "\nlaw"),
    (f"<article><p>{WORDS20} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></article>", WORDS20 + " x=1"),
    (f"<article><p>{WORDS20} a < b &lt; c</p><div class='ad-box'>buy</div><div class=cookie_notice_bar>ok</div></article><p cla",
     WORDS20 + " a < b < c"),
]


def test_pages_attribute_values_and_names(spark):
    d = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(ATTRIBUTES)], "page_id long, html string")
    got = {r.page_id: r.text for r in html_text.main_text(d, ({}, {}, (1.0, -0.5))).collect()}
    assert got == {k: t for k, (_, t) in enumerate(ATTRIBUTES)}


def test_pages_stray_tags_and_deep_stacks_take_linear_time():
    """A quadratic search of the stack would take minutes."""
    import time
    n = 100_000
    start = time.monotonic()
    for page in ("<div>" * n + "</p>" * n, "<b>" * n + "x </i>" * n, "<p a='>" * n, "<li><div>" + "<b>" * n + "<li></li>" * n):
        html_text.Page(page)
    assert time.monotonic() - start < 30


def test_best_region_equals_all_ranges():
    rng = np.random.default_rng(4)
    for _ in range(300):
        tokens = [("word", "p", int(rng.integers(1, 4)), 0, -1) if rng.random() < 0.5 else
                  ("loose", "div", 1, -1, -1) if rng.random() < 0.05 else ("tag", rng.choice(["p", "b", "/p"]), 1, -1, -1)
                  for _ in range(rng.integers(0, 25))]
        words, tags, other = {"p": 0.7}, {"p": -1.0, "/p": -0.25}, (0.5, -0.4)
        gain = [-html_text.LOOSE_COST if k == "loose" else 0.7 * n if k == "word" else tags.get(f, -0.4) for k, f, n, *_ in tokens]
        best = max([0.0, *(sum(gain[a:b]) for a in range(len(gain)) for b in range(a + 1, len(gain) + 1))])
        got, a, b = html_text._best_region(tokens, words, tags, other)
        assert abs(got - best) < 1e-9 and abs(sum(gain[a:b]) - best) < 1e-9


def test_label_sample_is_of_distinct_pages(spark):
    """However many copies a page has, it counts once, and the sample is the first ones by hash."""
    pages = [f"<article><p>page {k} text</p></article><p>out {k}</p>" for k in range(30)]
    d = spark.createDataFrame([(p,) for p in pages + pages[:1] * 50], "html string")
    one = spark.createDataFrame([(p,) for p in pages], "html string")
    assert html_text.learn_weights(d) == html_text.learn_weights(one)
    first = [r.html for r in one.orderBy(F.xxhash64("html")).limit(7).collect()]
    assert html_text.learn_weights(d, sample=7) == html_text.learn_weights(spark.createDataFrame([(p,) for p in first], "html string"))


def test_numbered_rows_that_are_not_file_rows(spark):
    """An exploded, a united and a filtered scan; columns with clashing names."""
    from tokenmill.llm.common import numbered
    scan = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    n = scan.count()
    for d, rows in ((scan, n), (scan.filter("doc_id >= 0").select("doc_id"), n), (scan.union(scan), 2 * n),
                    (scan.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")), 2 * n),
                    (scan.select("doc_id", F.lit(1).alias("_metadata")), n)):
        got = numbered(d)
        assert got.columns == [*d.columns, "_row"]
        assert got.count() == rows == got.select("_row").distinct().count()


def test_conversations_with_clashing_columns(spark):
    d = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    names = ["before", "after", "merged", "closing", "_step", "block", "_metadata", "f", "conv"]
    more = d.withColumns({c: F.lit(f"own {c}") for c in names}).withColumn("cost", F.lit("gone"))
    got = chat_format.repaired(more, block_rows=50)
    assert set(names) <= set(got.columns) and got.filter(" or ".join(f"{c} <> 'own {c}'" for c in names)).isEmpty()
    cols = ["conv_id", "turn", "role_out", "action", "n_inserted", "cost", "rendered"]
    assert got.select(cols).exceptAll(chat_format.repaired(d).select(cols)).isEmpty()
