"""Merkle climbs, main text of pages and ranked search against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from shiftgauge.llm import html_text, lexical_tree, merkle_manifest, oracle, queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def by_sql(sql, *tables):
    duck = duckdb.connect()
    for t in tables:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return duck.execute(sql).fetchall()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x) for x in r])


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(hashes):
    made = [hashes]
    while len(made[-1]) > 1:
        made.append([sha(*made[-1][i : i + 2]) for i in range(0, len(made[-1]), 2)])
    return made


def true_proofs(rows):
    key = lambda lang: (lang is not None, (lang or "").encode())
    langs = sorted({r[2] for r in rows}, key=key)
    grouped = {lang: sorted(((r[0] is not None, r[0] or 0, sha(*map(encoded, r)), r) for r in rows if r[2] == lang), key=lambda g: g[:3]) for lang in langs}
    trees = {lang: levels([g[2] for g in group]) for lang, group in grouped.items()}
    above = levels([trees[lang][-1][0] for lang in langs])
    root = above[-1][0]
    for lang, group in grouped.items():
        for place, (*_, leaf, row) in enumerate(group):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            folded = sha(*map(encoded, (*row[:3], row[3] + 1, row[4]))) if tampered else leaf
            siblings = []
            for tree, at in ((trees[lang], place), (above, langs.index(lang))):
                for level in tree[:-1]:
                    other = level[at ^ 1 : (at ^ 1) + 1]
                    siblings += other
                    folded = sha(*other, folded) if at % 2 else sha(folded, *other)
                    at //= 2
            yield row[0], leaf, trees[lang][-1][0], root, sha(*siblings), folded, folded == root


def check_proofs(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as node", "'x' as hash", "0L as pos", "'t' as tree")
    assert ordered(merkle_manifest.manifest_proofs(docs).collect()) == ordered(true_proofs(rows))


def test_proofs_with_odd_rows(spark):
    rows = [(i, "s", "en", 3, f"text {i}") for i in range(70)]
    rows += [(None, None, None, None, None), (None, "s", "en", 1, ""), (7, "s", "en", 3, "text 7"), (7, "s", "en", 3, "text 7"), (7, "s", "en", 3, "other")]
    rows += [(100, "s", "", 1, "é" * 50_000), (14, "s", "zz", None, "no count"), (9_000_000_000, "ß", "ä", 2**63 - 2, "ü")]
    check_proofs(spark, rows)


@pytest.mark.parametrize("n", [1, 3, 513])
def test_proofs_of_trees_of_any_size(spark, n):
    check_proofs(spark, [(i * 3, "s", "en", i, "x") for i in range(n)])


def test_proofs_over_many_groups_and_steps(spark):
    rows = [(i, "s", f"l{i % 67}" if i > 4200 else "en", i, "x") for i in range(4400)]
    check_proofs(spark, rows)
    assert merkle_manifest.manifest_proofs(spark.createDataFrame([], DOCS)).collect() == []


def test_row_limit_of_recursion_is_restored(spark):
    before = spark.conf.get(merkle_manifest.ROW_LIMIT, None)
    merkle_manifest.manifest_proofs(spark.createDataFrame([(1, "s", "en", 1, "x")], DOCS)).collect()
    assert spark.conf.get(merkle_manifest.ROW_LIMIT, None) == before


def test_other_values_and_lost_rows_are_found(spark):
    """Any claim can be checked, not only the query's."""
    docs = spark.createDataFrame([(i, "s", "en", 1, "x") for i in range(130)], DOCS)
    from pyspark.sql import functions as F

    proofs = merkle_manifest.verified_documents(docs, F.col("doc_id") == 5, {"text": F.lit("y")}).collect()
    assert [r["doc_id"] for r in proofs if not r["verified"]] == [5]


def test_manifest_query_equals_sql(spark):
    assert ordered(queries.queries()["op11_merkle_manifest"](spark, SMALL).collect()) == ordered(by_sql(oracle.MERKLE_SQL, "documents"))


# Main text

FIRST = "The river rose slowly through the night and by morning it had covered the lower meadows entirely."
SECOND = "Farmers moved their animals up the hill, as their grandparents had done a hundred years before."
THIRD = "Nobody was hurt, but the old bridge will stay closed until the engineers have looked at it."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul>'
ARTICLE = f"<h1>Flood</h1><p>{FIRST}<p>Short.</p><ul><li>One</li><li>Two</li></ul><p>{SECOND}</p><p>{THIRD}</p>"
TEXT = f"Flood {FIRST} Short. One Two {SECOND} {THIRD}"
COMMENTS = "".join(f"<div class='c'><p>I was there in {y} and I can say that it was far worse than what we saw this week.</p></div>" for y in range(1950, 1990))


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav>{MENU}</nav><article>{ARTICLE}</article><footer>Contact the editors of this paper by mail</footer></body>",
        f"<body><header><h1>The Daily</h1>{MENU}</header><main>{ARTICLE}</main><aside><p>{SECOND}</p></aside>",
        f"<div id=top class='site-header'>{MENU}</div><div id=content>{ARTICLE}</div><div class='sideBar'><p>{THIRD}</p></div>",
        f"<div id=wrap><div>{MENU}</div><div class=text>{ARTICLE}</div><div>{MENU}</div></div>",
        f"<article>{ARTICLE}<section class='comments'>{COMMENTS}</section></article>",
        f"<article>{ARTICLE}</article><section id='reader-comments'><article><p>{FIRST} {SECOND}</p></article></section>",
        f"<div class='cookie-notice'><p>{SECOND} {SECOND}</p><button>Accept</button></div><article>{ARTICLE}</article>",
        f"<article>{ARTICLE}<form><label>Your name</label><input><textarea>write here</textarea></form></article>",
        f"<form id=aspnet><div>{MENU}</div><article>{ARTICLE}</article></form>",
        f"<div class='ad'>Buy one, get one free, only this week in all our shops!<article>{ARTICLE}</article>",
        f"<nav>{MENU}<article>{ARTICLE}</article>",
        f"<article><div class='advert'>{THIRD}</div>{ARTICLE}<div class='related'>{MENU}</div></article>",
        f"<article><header><h1>Flood</h1><p>By our reporter</p></header>{ARTICLE[14:]}</article>",
        f"<body class='with-sidebar'><div class='no-sidebar content'>{ARTICLE}</div></body>",
        f"<script>var a = '<p>{FIRST}</p>';</script><style>p{{}}</style><article>{ARTICLE}</article>",
        f"<article>{ARTICLE}<p hidden>{FIRST}</p><div style='display: none'>{FIRST}</div><noscript>{FIRST}</noscript></article>",
        f"<article>{ARTICLE}</article><footer><p>{FIRST}",
        f"<article>{ARTICLE}<!-- {FIRST} -->",
        f"<article>{ARTICLE}<!-- {FIRST}",
        f"<article>{ARTICLE}<p class='",
    ],
)
def test_article_without_the_rest(page):
    assert html_text.main_text(page) == TEXT


def test_white_space_references_and_inline_elements():
    page = f"<article><p>A&amp;B &lt;b&gt; caf&eacute;&nbsp;&#x41;\n\t <b>bo</b>ld a<br>b</p><p>{FIRST}</p></article>"
    assert html_text.main_text(page) == f"A&B <b> café A bold a b {FIRST}"


def test_pages_without_article():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p> </p>") == ""
    assert html_text.main_text(f"<nav>{MENU}</nav>") == ""
    assert html_text.main_text("just some text & more") == "just some text & more"
    assert html_text.main_text(f"<p>{FIRST}</p><p>Hm.</p><p>{SECOND}</p>") == f"{FIRST} Hm. {SECOND}"


@pytest.mark.parametrize(
    "page",
    ["<" * 200_000, "<div>" * 100_000, "<!--" * 100_000, "<a " * 100_000, '<a b="' * 100_000, "<div>" * 50_000 + "</p>" * 50_000,
     "<p>x" * 100_000, "<![CDATA[" * 50_000, "<![foo x]>a<![ ]>b", "<script>" * 50_000 + "</scrip", "&am<" * 100_000, "<ul><li>" * 50_000],
    ids=range(12),
)
def test_damaged_pages_take_linear_time(page):
    start = time.time()
    html_text.main_text(page)
    assert time.time() - start < 15


def test_smoothing_and_border():
    values = np.array([0.0, 0, 0, 90, 100, 80, 0, 0])
    smooth = html_text.smoothed(values)
    assert smooth[2] > smooth[1] > smooth[0] and smooth[4] == smooth.max()
    assert html_text.smoothed(np.full(9, 7.0)) == pytest.approx(np.full(9, 7.0))
    assert 1 < html_text.border(np.array([1.0, 1, 1, 90, 100])) < 90
    assert html_text.border(np.array([5.0, 5])) <= 5.0000001


def test_extracted_rows(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", 5), (None, None, None, 6), (2, "v", "", 7), (2, "v", "", 7), (3, "w", f"<p>{'é' * 300_000}</p>", 8)]
    found = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    expected = [(1, "u", TEXT), (None, None, ""), (2, "v", ""), (2, "v", ""), (3, "w", "é" * 300_000)]
    assert ordered(found) == ordered((i, u, t, len(t)) for i, u, t in expected)
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pages_of_the_test_tables(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in queries.table(spark, SMALL, "pages").collect()}
    for row in queries.queries()["op12_html_text"](spark, SMALL).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[row["page_id"]], re.DOTALL)[1]
        parts = [html.unescape(re.sub("</?b>", "", p).replace("<br>", " ")) for p in re.split("</?(?:p|h1)>", article)]
        assert row["text"] == " ".join(" ".join(parts).split())


# Ranked search


def true_ranks(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    for item_id, text in set(items):
        if text is None:
            continue
        scores = []
        for place, (doc_id, counts) in enumerate(held):
            m = 25 + (75 * sum(counts.values()) * n_docs) // n_terms
            score = 0
            for t in terms(text):
                if t in counts:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, place))
        for rank, (score, null, doc_id, _) in enumerate(sorted(scores)[:k], 1):
            yield item_id, rank, None if null else doc_id, -score


def check_ranks(spark, docs, items):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    assert ordered(lexical_tree.ranked(d, i).collect()) == ordered(true_ranks(docs, items))


def made_texts(n, seed, words=400):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    odds = [1 / (i + 1) for i in range(words)]
    return [" ".join(draw.choices(vocabulary, odds, k=draw.randrange(1, 120))) for _ in range(n)]


def test_ranks_of_made_texts(spark):
    texts = made_texts(900, 5)
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[3]) for i in range(300)]
    items = [(i, t) for i, t in enumerate(made_texts(25, 6))] + [(90, texts[3]), (91, texts[3] * 2), (92, "w399 w398 w0 w0")]
    check_ranks(spark, docs, items)


def test_ranks_with_odd_rows(spark):
    docs = [(None, "alpha beta"), (None, "alpha beta"), (3, "Alpha-BETA_gamma"), (3, "Alpha-BETA_gamma"), (4, None), (5, ""), (6, " \n!"),
            (7, "É alpha é"), (8, "x " * 200_000 + "alpha"), (9, "delta")]
    items = [(1, "alpha beta"), (1, "alpha beta"), (1, "gamma"), (None, "delta"), (2, None), (3, ""), (4, "unknown"), (5, "É é"), (6, "x X ALPHA")]
    check_ranks(spark, docs, items)
    for d, i in (([], items), (docs, [])):
        check_ranks(spark, d, i)


def test_ranks_by_blocks_of_items_and_trees(spark, monkeypatch):
    monkeypatch.setattr(lexical_tree, "ITEMS", 4)
    texts = made_texts(200, 8)
    check_ranks(spark, list(enumerate(texts)), list(enumerate(made_texts(10, 9))))


def one_tree(texts):
    counts = [Counter(lexical_tree.terms(t.encode())) for t in texts]
    df = Counter(t for c in counts for t in c)
    rank = {t: i for i, t in enumerate(sorted(df, key=lambda t: (-df[t], t)))}
    flat = [(rank[t], n) for c in counts for t, n in c.items()]
    ends = np.cumsum([0, *map(len, counts)])
    m = np.array([lexical_tree.length_figure(sum(c.values()), len(texts), 60 * len(texts)) for c in counts])
    return lexical_tree.Tree(np.arange(len(texts)), m, ends, np.array([r for r, _ in flat]), np.array([n for _, n in flat])), rank


def branches(made):
    for i, below in enumerate(made.below):
        span = slice(made.starts[i], made.starts[i + 1] if i + 1 < len(made.starts) else None)
        yield made.low[i], made.high[i], dict(zip(made.terms[span].tolist(), made.shares[span].tolist(), strict=True))
        if below:
            yield from branches(below)


def test_bounds_hold_for_all_documents_below():
    tree, _ = one_tree(made_texts(2000, 11))
    found = list(branches(tree.root))
    assert len(found) > 20
    leaves = 0
    for low, high, bounds in found:
        for d in range(low, high):
            for at in range(tree.starts[d], tree.starts[d + 1]):
                assert tree.shares[at] <= bounds[int(tree.terms[at])]
        leaves += high - low <= lexical_tree.BUCKET
    assert leaves


def test_search_leaves_branches_out(monkeypatch):
    """An item that one document answers best is found without scoring every document."""
    texts = made_texts(4000, 12)
    texts = [f"{t} v{i % 6}" if i % 40 == 0 else t for i, t in enumerate(texts)]
    tree, rank = one_tree([*texts, "v0 v1 v2 v3 v4 v5"] * 3)
    weights = np.zeros(len(rank), np.int64)
    weights[[rank[f"v{i}".encode()] for i in range(6)]] = 5000
    scored = []
    reduceat = np.add.reduceat

    class Adds:
        @staticmethod
        def reduceat(values, starts):
            scored.append(len(starts))
            return reduceat(values, starts)

    class Numpy:
        add = Adds

        def __getattr__(self, name):
            return getattr(np, name)

    monkeypatch.setattr(lexical_tree, "np", Numpy())
    best = tree.search(weights, np.empty((0, 2), np.int64), 3)
    assert best[:, 1].tolist() == [4000, 8001, 12002]
    assert sum(scored) < len(tree.ids) / 5


def test_search_query_equals_sql(spark):
    rows = queries.queries()["op13_lexical_search"](spark, SMALL).collect()
    assert ordered(rows) == ordered(by_sql(oracle.LEXICAL_SQL, "documents", "benchmark"))
