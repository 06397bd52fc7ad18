"""Template deduction and extraction on known pages, and against a plain reading of the article element."""

import html
import re

import pytest
from pyspark.sql import functions as F

from brightwater.llm.articles import Template, _page_tokens, extract, main_texts, template_extraction
from brightwater.llm.markup import events

FOLDER = "/root/testdata/sf0.01"


def plain_article(page):
    """The blocks of the article element of the given test pages."""
    page = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ", page)
    found = re.search(r"(?is)<article[^>]*>(.*?)(?:</article>|\Z)", page)
    if not found:
        return ""
    cut = re.split(r"(?i)</?(?:p|h1)\b[^>]*>", found[1])
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in cut]
    return "\n".join(b for b in blocks if b)


def test_query_equals_plain_reading(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = template_extraction(spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain_article(pages[r.page_id].html), r.page_id
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def site(k, body, extra=""):
    """Pages of a site without telling element names: only the template says what is content."""
    return (
        f"<html><body><div class='x1'><div>Home</div><div>Products</div></div><div id=top{k}>Welcome to our site</div>"
        f"<div class='c{k}'><h2>Title {k}</h2>{body}<div>Written by the staff of this site</div></div>"
        f"<div class='comments'><p>Reader {k} says hello</p></div>{extra}<div class=x2>Imprint &copy; {k}</div></body></html>"
    )


def test_template_text_is_no_content(spark):
    rows = [
        (k, f"http://h.example/{k}", site(k, "".join(f"<p>Paragraph {k} {i} with its own words {k * i}</p>" for i in range(4 + k % 3))))
        for k in range(30)
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in main_texts(pages).collect():
        k = r.page_id
        want = [f"Title {k}"] + [f"Paragraph {k} {i} with its own words {k * i}" for i in range(4 + k % 3)]
        assert r.text == "\n".join(want)


@pytest.mark.parametrize("nonce", [False, True])
def test_copies_of_one_page_are_no_template(spark, nonce):
    """One article fills 97 % of a host's rows, as equal pages or with another comment in each."""
    body = lambda k: "".join(f"<p>Paragraph {k} {i} with its own words {k * i}</p>" for i in range(4 + k % 3))
    page = lambda k: f"<html><body><article><h1>Title {k}</h1>{body(k)}</article></body></html>"
    rows = [(i, "http://h.example/x", page(min(i, 40)) + (f"<!-- {i} -->" if nonce else "")) for i in range(1300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for r in main_texts(pages).collect():
        assert r.text == plain_article(page(min(r.page_id, 40)))


@pytest.mark.parametrize("tag", ["article", "div class=c"])
def test_nested_layout_is_whole(spark, tag):
    """Headline, lead and appendix around a dense body belong to the text; so does a page's odd section."""
    rows, want = [], {}
    for k in range(12):
        words = [f"{'abcdefghijkl'[k]}{w}" for w in "ar el im on".split()]
        body = [f"{' '.join(words * 12)} {i}" for i in range(9)]
        odd = f"Correction {words[1]} " * 5 if k == 7 else ""
        end = f"Sources {words[2]}"
        html = (
            f"<html><body><div class=top><div>Home</div></div><{tag}><h1>On {words[0]}</h1><p class=lead>Lead {words[3]}</p><div class=body>"
            + "".join(f"<p>{b}</p>" for b in body)
            + f"</div><section class=appendix><p>{end}</p></section>{'<section class=odd>' + odd + '</section>' if odd else ''}"
            + f"</{tag.split()[0]}><div class=x2>Imprint {k}</div></body></html>"
        )
        rows.append((k, f"http://h.example/{k}", html))
        want[k] = "\n".join([f"On {words[0]}", f"Lead {words[3]}", *body, end] + [odd.strip()] * bool(odd))
    for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == want[r.page_id]


def test_classes_group_tokens_with_equal_vectors():
    pages = [_page_tokens(site(k, f"<p>{'words of its own ' * 20}{k}</p>" * (k % 3 + 1))) for k in range(6)]
    names = {t for p in pages for t in p}
    tokens = []
    for t in names:
        vector = tuple(p[t][0] if t in p else 0 for p in pages)
        tokens.append((t, hash(vector), sum(v > 0 for v in vector), sum(vector), sum(p[t][1] if t in p else 0 for p in pages), max(vector)))
    template = Template(tokens, 6)
    whole = next(c for c in template.classes if ("/html", 1) in c)
    assert ("/html/body", 1) in whole and ("/html/body/div.c", 1) in whole
    assert not any(t == "/html/body/div.c/p" for t, _ in whole)
    assert template.main == "/html/body/div.c"


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<article>a <b>b</b><br>c<p>d<p>e &amp;amp; f</article>", "a b c\nd\ne &amp; f"),
        ("<body><nav>n</nav><header>h</header><main><header><h1>t</h1></header><p>x</p><aside>s</aside></main><footer>f</footer>", "t\nx"),
        ("<p>a<script>if (a<b) '</p>'</script>b</p><style>p{}</style><form>f<input></form>", "ab"),
        ("<article><p>a<div class='ad-box'>buy</div><section id=comments><p>c</p></section><p>z", "a\nz"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table> 5 < 6 <a hre", "1\n2\n3\n4\n5 < 6"),
        ("<article><!-- x --><p>a\n\t b&nbsp;c</p><p> </p><!-- open", "a b c"),
        ("<ARTICLE><P CLASS=x>A</P></ARTICLE>", "A"),
        *[
            (f"<div {mark}><article><h1>t</h1><p>x y z</p></article></div><div class=footer>f</div>", "t\nx y z")
            for mark in (
                "class='content has-sidebar'", "class=no-sidebar", "class=with-comments", "class=ad-free", "id=search-results-article",
                "class=search", "id=widget", "class='search-container'",
            )
        ],
        ("<h1>t</h1><p>x</p><div class=comments-list><h2>c</h2><p>many long words</p></div><div class='related-posts'>r</div>", "t\nx"),
        ("<div class=sidebar><p>s</p></div><div class=nav><main><p>x</p></main></div>", "x"),
    ],
)
def test_markup(page, text):
    assert extract(page or "", None) == text


def test_odd_rows(spark):
    page = "<html><body><article><p>Hello</p></article></body></html>"
    rows = [(1, None, page), (1, None, page), (None, "http://a/", page), (2, "http://a/", None), (3, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("t"))
    got = sorted(((str(r.page_id), r.url, r.text, r.n_chars) for r in main_texts(pages).collect()), key=str)
    assert got == [
        ("1", None, "Hello", 5), ("1", None, "Hello", 5), ("2", "http://a/", "", 0), ("3", "x", "", 0),
        ("None", "http://a/", "Hello", 5),
    ]
    assert main_texts(pages.limit(0)).collect() == []


def test_long_page_is_read_whole():
    page = "<article>" + "".join(f"<p>word {i}</p>" for i in range(30_000)) + "</article>"
    assert extract(page, None).count("\n") == 29_999
    assert sum(1 for e in events(page) if e[0] == "text") == 30_000
