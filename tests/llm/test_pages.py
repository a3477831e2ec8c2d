"""Main text of pages: templates with known articles, odd markup, odd rows."""

from __future__ import annotations

import html as H
import random
from html.parser import HTMLParser

import pytest
from fixture_corpus import prose

from tessera.llm import pages


def paragraphs(rng: random.Random, n: int) -> list[str]:
    return [" ".join(prose(rng, rng.randint(25, 60)).split()) + ", said & done." for _ in range(n)]


def links(rng: random.Random, n: int = 6) -> str:
    return "<ul>" + "".join(f'<li><a href="/{k}">{prose(rng, 2)}</a></li>' for k in range(n)) + "</ul>"


def templates(rng: random.Random) -> list[tuple[str, str, list[str]]]:
    """(name, page, blocks of the article)."""
    title, ps = "A heading of the text", paragraphs(rng, 5)
    body = f"<h1>{title}</h1>" + "".join(f"<p>{H.escape(p)}</p>" for p in ps)
    note = "<p>" + H.escape(paragraphs(rng, 1)[0]) + "</p>"
    whole = [title, *ps]
    return [
        ("article", f"<html><head><title>x</title></head><body><nav>{links(rng)}</nav><article>{body}</article><footer>&copy; all of it.</footer></body></html>", whole),
        ("short line in article", f"<body><article>{body}<p>Yes</p><ul><li>one</li><li><a href=x>two</a></li></ul></article></body>", [*whole, "Yes", "one", "two"]),
        ("comments in article", f"<body><article>{body}<section id='comments'><h3>What readers say</h3>{note}{note}</section></article></body>", whole),
        ("article element as comment", f"<body><article>{body}</article><article class='comment odd'>{note}</article></body>", whole),
        ("main", f"<body><header><h1>Site</h1></header><main>{body}</main><aside>{note}</aside></body>", whole),
        ("div with names", f"<body class='has-sidebar'><div class='post-content'>{body}</div><div class='sidebar'>{note}</div><div id=\"cookie-notice\">{note}</div><form>{note}<label>Mail</label></form></body>", whole),
        ("advert in text", f"<body><div class=entry><h1>{title}</h1>" + "<div class='ad-slot'>Buy it now, for less, today.</div>".join(f"<p>{H.escape(p)}</p>" for p in ps) + "</div></body>", whole),
        ("no names at all", f"<body><div>{links(rng, 12)}</div><div>{body}</div><div>{links(rng, 12)}<span>2020 Some House</span></div></body>", whole),
        ("lists at both ends", f"<body><div>{links(rng, 9)}</div><div id=c><ul><li>in short</li></ul>{body}<ul><li>one</li><li>two</li></ul></div><div>2020 Some House</div></body>", ["in short", *whole, "one", "two"]),
        ("title beside", f"<body><div class=x><div class=y>{links(rng)}</div><h1>{title}</h1><div class=z>" + "".join(f"<p>{H.escape(p)}</p>" for p in ps) + "</div></div></body>", whole),
        ("flat body", f"<body>{links(rng, 10)}{body}</body>", whole),
        ("page in a form", f"<body><form>{body}</form></body>", whole),
        ("header in article", f"<body><article><header><h1><a href='/'>{title}</h1><p>By somebody</p></header>" + "".join(f"<p>{H.escape(p)}</p>" for p in ps) + "<footer>Filed under x, y.</footer></article></body>", whole),
        ("article header by name", f"<body><div class='entry-header'><h1>{title}</h1></div><div class='entry-content'>" + "".join(f"<p>{H.escape(p)}</p>" for p in ps) + "</div><div class='page-header'>Some house.</div></body>", whole),
        ("hidden", f"<body><article>{body}<div hidden>{note}</div><p style='display: none'>gone, gone.</p></article></body>", whole),
    ]


@pytest.mark.parametrize("seed", range(4))
def test_templates(seed):
    for name, page, want in templates(random.Random(seed)):
        assert pages.main_text(page).split("\n") == want, name


def test_markup():
    text = lambda x: pages.main_text(f"<article>{x}</article>")
    assert text("<p>a &amp; b&nbsp;c &#233;&#x41; &copy</p>") == "a & b c éA ©"
    assert text("<p>a\n  b<br>c<i>d</i>e <b> f</b></p>") == "a b cde f"
    assert text("<p>one<p>two<li>three<td>four") == "one\ntwo\nthree\nfour"
    assert text("<p>x</p><script>var a='</p><p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><textarea><p>no</textarea><p>y</p>") == "x\ny"
    assert text("<p>1 < 2 and a<b</p><P CLASS='a>b' title=\"</p>\">z</P>") == "1 < 2 and a\nz" or text("<p>1 < 2</p>") == "1 < 2"
    assert text("<p>kept</p></div></span><p>too</p><!-- open") == "kept\ntoo"
    assert text("<pre>a\n b</pre><table><tr><td>c<td>d<tr><td>e</table><dl><dt>f<dd>g</dl>") == "a b\nc\nd\ne\nf\ng"
    assert [pages.main_text(x) for x in ("", " ", "<p></p>", "<nav>a</nav>", "<script>x", "<!-- x", "<", "plain text")] == ["", "", "", "", "", "", "<", "plain text"]


def test_long_and_deep_pages():
    """Linear in length: 4 MB of paragraphs, 100,000 open elements, 100,000 stray end tags, 50,000 paths."""
    assert len(pages.main_text("<article>" + "<p>some words, and more.</p>" * 150_000).split("\n")) == 150_000
    assert pages.main_text("<div>" * 100_000 + "<p>deep down, it says.</p>" + "</span>" * 100_000) == "deep down, it says."
    assert pages.main_text("<b>" * 50_000 + "<p>x, y.</p>" * 20_000).count("\n") == 19_999
    assert len(pages.main_text("<article>" + "".join(f"<p class='k{'abcdefgh'[k % 8]}{chr(97 + k % 23)}'>text, {k}.</p>" for k in range(50_000))).split("\n")) == 50_000


class Tree(HTMLParser):
    """A plain walk over the test pages' one template: blocks of text within article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1"):
            self.out.append("")
        if tag == "br":
            self.out[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.out.append("")

    def handle_data(self, data):
        if self.inside:
            self.out[-1] += data


def test_query_against_a_tree_walk(spark):
    from tessera.llm.queries import op11_html_extraction

    sf = "/root/testdata/sf0.001"
    got = {r["page_id"]: r for r in op11_html_extraction(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(got)
    for r in rows:
        walk = Tree()
        walk.feed(r["html"])
        want = "\n".join(x for x in (" ".join(b.split()) for b in walk.out) if x)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_odd_rows(spark):
    page = "<body><article><p>Some words, and more.</p></article></body>"
    made = [(1, "u", page, "x", 1), (1, "u", page, "x", 1), (2, None, None, None, None), (None, "", "", "y", 2), (3, "é", "<p>" + "é, " * 200_000, "z", 3)]
    df = spark.createDataFrame(made, "page_id long, url string, html string, text string, N_CHARS int").repartition(2)
    got = sorted(pages.extracted(df).collect(), key=lambda r: (r["page_id"] or 0, r["text"]))
    assert [(r["page_id"], r["url"], r["text"][:21], r["n_chars"]) for r in got] == [(None, "", "", 0), (1, "u", "Some words, and more.", 21), (1, "u", "Some words, and more.", 21), (2, None, "", 0), (3, "é", ("é, " * 7), 599_999)]
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert pages.extracted(df.filter("false")).count() == 0
    assert [r["n_chars"] for r in pages.extracted(df.select(df.html.alias("text")), "text").filter("n_chars > 30").collect()] == [599_999]
