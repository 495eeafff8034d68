"""Extraction against the pages' articles, the tree's entropies against brute force, and hostile markup."""

import html
import math
import re
import tracemalloc
from collections import Counter, defaultdict

from lattica.llm import queries, style_tree

SF = "/root/testdata/sf0.01"


def article(page):
    body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    lines = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?p>|</?h1>|<br>", body))
    return "\n".join(x for x in lines if x)


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.queries()["op2_main_text"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_without_the_tree_nothing_is_found(spark):
    """The same pages, parsed in the same way, but without the tree's decisions: not one is right."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert not any(style_tree.main_text(r.html, set()) == article(r.html) for r in pages)


def test_entropies_alone(spark):
    """Without marks, texts that a host repeats in several forms go all the same, at each level."""
    rows = [(k, "http://h/", f"<div class=a>{'xyz'[k % 3]} of the house</div><div class=b><h1>Title {k}</h1><p>words {k}</p>{'<ul><li>it</ul>' * (k % 2)}</div>"
             f"<div class=c>all rights {k % 4}</div>") for k in range(200)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k}\nwords {k}" for k in range(200)}


def test_importance_against_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {(r.host, r.node): r for r in style_tree.importance(pages).collect()}
    texts, styles, marks, parent, count = defaultdict(Counter), defaultdict(Counter), Counter(), {}, Counter()
    for r in pages.collect():
        host, (blocks, nodes, looks) = style_tree.host_of(r.url), style_tree.parse(r.html)
        for x, t in {(x, t) for n, t in blocks for x in n.chain}:
            texts[host, x][t] += 1
        for x, labels in looks.items():
            styles[host, x][" ".join(dict.fromkeys(labels))] += 1
        for n in nodes.values():
            count[host, n.name] += 1
            marks[host, n.name] += n.mark
            parent[host, n.name] = n.parent.name
    assert set(got) == set(count)
    want = {}
    for key, m in count.items():
        looks, said = styles[key].values(), texts[key].values()
        style = -sum(c / sum(looks) * math.log(c / sum(looks)) for c in looks) / math.log(max(2, m)) if looks else 0
        content = 1 - sum(c * math.log(c) for c in said) / sum(said) / math.log(max(2, m)) if said else 0
        entropy = 0.5 if m < style_tree.PAGES else style_tree.DAMPED * style + (1 - style_tree.DAMPED) * content
        want[key] = style_tree.MARKED * (1 + marks[key] / m) / 2 + (1 - style_tree.MARKED) * entropy
        assert got[key].pages == m and got[key].parent == parent[key] and abs(got[key].importance - want[key]) < 1e-9
    best, most = defaultdict(float), defaultdict(float)
    for (host, x), v in want.items():
        best[host, parent[host, x]] = max(v, best[host, parent[host, x]])
        most[host, parent[host, x]] = max(got[host, x].entropy, most[host, parent[host, x]])
    flat = lambda h, x: marks[h, x] <= 0 and got[h, x].entropy < style_tree.LEAST <= most[h, parent[h, x]]
    low = {(h, x) for (h, x), v in want.items() if v < style_tree.FLOOR or v < style_tree.RATIO * best[h, parent[h, x]] - 1e-12 or flat(h, x)}
    low = {(h, x) for h, x in low if (h, parent[h, x]) not in low}
    assert {tuple(r) for r in style_tree.removed(style_tree.importance(pages)).collect()} == low


def test_templates_without_telling_names(spark):
    """Pages of plain divs: only the tree can tell the template from the text."""
    rows = [(k, f"https://a.example/{k}", f"<body><div class=x1><span>Home of all</span><span>Products we sell</span></div>"
             f"<div class=x2><div>First words {k} of a story</div><div>more {k * 7} words</div></div><div class=x3>All rights are ours</div>") for k in range(20)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"First words {k} of a story\nmore {k * 7} words" for k in range(20)}


def test_repeated_pages_keep_their_article(spark):
    page = "<nav>menu</nav><article><h1>T</h1><p>same text</p></article><footer>f</footer>"
    rows = [(k, "http://h/x", page) for k in range(12)] + [(50, "http://h/y", page.replace("same", "other"))]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: "T\nsame text" for k in range(12)}, 50: "T\nother text"}


def test_branches_that_copies_repeat_stay(spark):
    """100 pages, 60 of them copies whose article alone has a quote; all share a heading."""
    for tag in ("article", "main"):
        page = lambda k, more="": f"<div class=x1>Home of all</div><{tag}><h2>Method</h2>{''.join(f'<p>words {k} {j}</p>' for j in range(8))}{more}</{tag}><div class=x2>end</div>"
        rows = [(k, f"http://h/{k}", page(k) if k >= 60 else page(0, "<blockquote>said once</blockquote>")) for k in range(100)]
        got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        text = lambda k: "\n".join(["Method", *(f"words {k} {j}" for j in range(8))])
        assert got == {k: text(k) if k >= 60 else text(0) + "\nsaid once" for k in range(100)}


def test_kinds_of_markup(spark):
    cases = [
        ("<article><p>a &amp; b&#8217;s  c\n d<script>x='</p>'</script></article>", "a & b’s c d"),
        ("<body><p>one<p>two<ul><li>x<li>y</ul><table><tr><td>1<td>2</table>", "one\ntwo\nx\ny\n1\n2"),
        ("<main><aside>no</aside><div class='sidebar'>no</div><p>yes</p><form><input> no</form><div id=comments><p>no</p></div></main>", "yes"),
        ("<div class='cookie-notice'>no</div><p>yes <b>bold<i>er</b></i> end</p><!-- no --><p>2 < 3 & 4</p>", "yes bolder end\n2 < 3 & 4"),
        ("<article><header><h1>Title</h1></header><p>x</p></article>", "Title\nx"),
        ("<body>before<div><div><article><p>x</article><div>beside</div></div></div><div>after</div>", "x"),
        ("<nav>only this", ""), (None, ""), ("", ""), ("<!-- open", ""), ("<div class='", ""), ("plain", "plain"), ("<p>cut <b", "cut"),
        ("<div>" * 50000 + "deep", "deep")]
    rows = [(k, f"http://h{k}/", page) for k, (page, _) in enumerate(cases)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: text for k, (_, text) in enumerate(cases)}


def test_deep_pages_take_bounded_memory_and_time():
    for unit in ('<div class="c">x', "<div>", "<main><p>a</x>", "</div><p>", "<b><p>"):
        style_tree.main_text(unit * 100_000, set())
        tracemalloc.start()
        node, _, _ = style_tree._counted(unit * 10_000)  # 1000 MB and more where each element kept its path
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 150e6 and len(node), unit


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", ""), (None, None, "<p>a</p>"), (1, None, None)], "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as low")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in style_tree.extract(df).collect()) == [(0, "a", 1), (1, "", 0), (1, "", 0), (2, "", 0)]
    assert style_tree.extract(df.limit(0)).count() == 0
