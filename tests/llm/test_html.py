import html
import re
from collections import Counter

from jsonloom.llm.html_extract import Page, Template, extract, host_of, main_text, node_key, templates
from jsonloom.llm.queries import QUERIES

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a><li>Two</ul></nav><div class="ad">Buy</div><div role="alert">Notice</div><div id="cookie-notice">ok?</div>
<main><article><h1>Title &amp; more</h1><p><b>A &lt; b<br>c<p>Second&nbsp; para
 <i>x</i>y</p><blockquote>Q</blockquote><form>f<input></form><ul><li>i<li>j</ul><!-- no --><section class="comments"><p>reader</p></section></article></main>
<aside>side</aside><div style="display: none">hid</div><footer>&copy; f</footer></body></html>"""


def test_blocks():
    assert extract(FULL, None) == "Title & more\n\nA < b c\n\nSecond para xy\n\nQ\n\ni\n\nj"
    assert extract("plain & simple", None) == "plain & simple"
    assert extract("<article>x<p>y <b", None) == "x\n\ny"
    assert extract("<div>1 < 2</div><table><tr><td>a<td>b</table>", None) == "1 < 2\n\na\n\nb"
    assert extract("<nav>only</nav>", None) == ""
    assert Page("<p>a<div>b</div>").blocks[0][0] == "a"
    assert host_of("HTTPS://u@Ex.org:80/a?b") == "ex.org" and host_of(None) == "" and host_of("/a") == ""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string, n_chars long")


def test_template_regions(spark):
    """Without an article element, the region with the text is found, and template lines in it are left out."""
    body = lambda i: "".join(f"<p>page {i} says {j} things that matter here</p>" for j in range(5))
    page = "<html><body><div class='top'><a href=/>Home</a></div><div class='links'>{links}</div><div class='story'><p>Brought to you by us</p>{body}</div><div class='low'>imprint {i}</div></body></html>"
    rows = [(i, f"https://a.example/{i}", page.format(links="".join(f"<a href=x>l{k}</a> " for k in range(3)), body=body(i), i=i), "t", "h", 1) for i in range(12)]
    got = {r.page_id: r.text for r in main_text(pages(spark, rows)).collect()}
    assert all(got[i] == "\n\n".join(f"page {i} says {j} things that matter here" for j in range(5)) for i in range(12))


def test_odd_rows(spark):
    rows = [(1, "https://a.example/", None, "t", "h", 1), (2, None, "", "t", "h", 1), (None, "no url", FULL, "t", "h", 1), (4, "https://b.example/", "<p>" + "x " * 100_000, "t", "h", 1), (4, "https://b.example/", "<p>" + "x " * 100_000, "t", "h", 1)]
    got = main_text(pages(spark, rows)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, len(extract(FULL, None))), (1, 0), (2, 0), (4, 199_999), (4, 199_999)]
    assert all(r.n_chars == len(r.text) for r in got)
    assert main_text(pages(spark, rows).where("false")).collect() == []


def test_query_keeps_articles_whole(spark):
    sf = "/root/testdata/sf0.01"
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op3_equivalence_class_extraction"](spark, sf).collect()
    assert len(rows) == len(source)
    for r in rows:
        h = source[r.page_id]
        body = h[h.index("<article>") : h.index("</article>") if "</article>" in h else len(h)].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|article)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_class_words_do_not_lose_articles():
    line = "Some words of the article that nobody should lose."
    assert extract(f"<div class='layout sidebar'><article><p>{line}</p></article></div>", None) == line
    assert extract(f"<div class='layout with-sidebar'><article><p>{line}</p></article></div>", None) == line
    assert extract(f"<div class='content has-sidebar'><p>{line}</p></div>", None) == line
    assert extract(f"<body><div class='widget'><p>{line}</p></div><p>low</p></body>", None) == f"{line}\n\nlow"
    assert extract(f"<article><div class='post-header'><h1>T</h1></div><h2 id='search'>S</h2><h2 id='search-results'>R</h2><section id='related-work'>{line}</section></article>", None) == f"T\n\nS\n\nR\n\n{line}"
    # what is only beside the article stays out
    assert extract(f"<div class='sidebar'>links</div><article><p>{line}</p><div class='comments'><article>no</article></div></article>", None) == line


def test_template_of_an_article_in_a_named_element(spark):
    page = "<html><body><div class='top'>Home</div><div class='layout sidebar'><article><p>page {i} has text of its own</p></article></div><div class='ad'>Buy {i}</div></body></html>"
    rows = [(i, f"https://a.example/{i}", page.format(i=i), "t", "h", 1) for i in range(8)]
    assert {r.page_id: r.text for r in main_text(pages(spark, rows)).collect()} == {i: f"page {i} has text of its own" for i in range(8)}


def test_probes_keep_their_text():
    assert extract('<article><h2 id="pagination">Pagination</h2><p>Use it.</p></article>', None) == "Pagination\n\nUse it."
    page = '<article><h2 id="comments-in-python">Comments</h2><p>Shares of <span class="share">12.40</span> rose</p><section class="discussion">So what</section><p class="legal">By law</p><p class="notice">Mind it</p></article>'
    assert extract(page, None) == "Comments\n\nShares of 12.40 rose\n\nSo what\n\nBy law\n\nMind it"
    # a name on a container that stands beside a text still leaves it out
    assert extract('<article><p>Text of some length here</p><div class="share">Send it</div><ul class="tags"><li>x</ul></article>', None) == "Text of some length here"


def test_pages_without_articles(spark):
    """The test pages with all telling tags and classes taken away: the template alone finds the main text."""
    sf = "/root/testdata/sf0.1"
    source = spark.read.parquet(f"{sf}/pages.parquet").collect()
    hosts = Counter(host_of(r.url) for r in source)
    many = [r for r in source if hosts[host_of(r.url)] >= 8]
    assert len(many) > 500
    bare = lambda h: h.replace("<article>", '<div class="mid">').replace("</article>", "</div>").replace("<nav>", '<div class="top">').replace("</nav>", "</div>").replace("<footer>", '<div class="low">').replace("</footer>", "</div>").replace('class="ad"', 'class="box"')
    rows = [(r.page_id, r.url, bare(r.html), "t", "h", 1) for r in many]
    got = {r.page_id: r.text for r in main_text(pages(spark, rows)).collect()}
    whole = {r.page_id: extract(r.html, None) for r in many}
    assert all(got[i] == whole[i] for i in whole)


def test_classes_against_brute_force(spark):
    """Tokens with equal occurrence vectors over the pages of a host, and no others, form a class."""
    rows = [(i, f"https://h{i % 2}.example/{i}", f"<body><div class='a'><p>same</p></div><div class='b'>{'<p>x</p>' * (1 + i % 3)}</div><div class='c'><h1>t {i}</h1><p>text {i}</p></div>{'<div class=\"d\">now and then</div>' if i % 4 else ''}</body>", "t", "h", 1) for i in range(24)]
    found = {r.host: {frozenset(t.token for t in c) for c in r.template} for r in templates(pages(spark, rows), 5, 0.9).collect()}
    for host in ("h0.example", "h1.example"):
        vectors, own = {}, [r for r in rows if host_of(r[1]) == host]
        for k, r in enumerate(own):
            page = Page(r[2])
            counts = {p: v[0] for p, v in page.elements.items()}
            for text, path, _, _ in page.blocks:
                counts[node_key(path, text)] = counts.get(node_key(path, text), 0) + 1
            for token, n in counts.items():
                vectors.setdefault(token, [0] * len(own))[k] = n
        classes = {}
        for token, v in vectors.items():
            if sum(x > 0 for x in v) >= 0.9 * len(own):
                classes.setdefault(tuple(v), set()).add(token)
        assert found[host] == {frozenset(c) for c in classes.values()}


def test_classes_nest(spark):
    rows = [(i, f"https://h.example/{i}", f"<body><div class='a'><ul>{'<li>x</li>' * (1 + i % 3)}</ul></div><div class='b'><p>text {i}</p></div></body>", "t", "h", 1) for i in range(12)]
    template = Template([[t.asDict() for t in c] for c in templates(pages(spark, rows), 5, 0.9).first()["template"]])
    items, outer = template.classes["/body/div.a/ul/li"], template.classes["/body/div.a/ul"]
    assert template.inside[items] == outer and template.classes["/body/div.b"] == outer
    assert set(template.slots.below["/body"]) == {"/body/div.a", "/body/div.b"}


def test_names_leave_out_what_the_template_has(spark):
    """A box of comments that the host's pages have goes; a section that one page has for itself stays."""
    page = "<body><div class='top'>Home</div><div class='story'><h1>Title {i}</h1><p>A page with number {i} and a text that is its own.</p>{own}<div class='comments'><p>I agree with number {i}, whoever wrote it.</p></div></div></body>"
    rows = [(i, f"https://h.example/{i}", page.format(i=i, own="<div class='related'>A method that one page alone describes in full.</div>" if i == 3 else ""), "t", "h", 1) for i in range(10)]
    got = {r.page_id: r.text for r in main_text(pages(spark, rows)).collect()}
    text = lambda i: f"Title {i}\n\nA page with number {i} and a text that is its own."
    assert got == {i: text(i) + ("\n\nA method that one page alone describes in full." if i == 3 else "") for i in range(10)}


def test_copied_articles_stay(spark):
    """Text that nearly all pages of a host share is no template if it is most of the region."""
    page = "<body><div class='top'>Home {i}</div><div class='story'><h1>One story</h1><p>The same long text on every page of this host, word for word.</p></div></body>"
    rows = [(i, f"https://h.example/{i}", page.format(i=i), "t", "h", 1) for i in range(10)]
    assert {r.text for r in main_text(pages(spark, rows)).collect()} == {"One story\n\nThe same long text on every page of this host, word for word."}
