"""Consensus extraction on written-out pages and against a second parser on the given ones."""

import re
from html import unescape
from html.parser import HTMLParser

from factorloom.llm import html_text
from tests.conftest import SF

CASES = [
    ("", ""),
    ("plain words", "plain words"),
    ("<p>One<p>Two &amp; three&nbsp;x<br>four", "One\n\nTwo & three x four"),
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>T</h1><p><b>A.<br><p>B</p><ul><li>x<li>y</ul></article><footer>f</footer>", "T\n\nA.\n\nB\n\nx\n\ny"),
    ('<body><div id="main-menu">m</div><div class="content"><p>Long text of the page here.</p><div class="comments"><p>I disagree</p></div>'
     '<script>var a="<p>no</p>";</script><style>p{}</style><!-- <p>no</p> --><form><p>mail</p></form><div class="cookie-notice">c</div></div><aside>s</aside>',
     "Long text of the page here."),
    ("<main><p>a < b and c > d &lt;i&gt; &#233; &am</p><pre>x\n  y</pre></main>", "a < b and c > d <i> é &am\n\nx y"),
    ("<article><p>in <em>one</em> <a href=x>link</a>, <span>word</span>s</p><table><tr><td>1<td>2</table></article>", "in one link, words\n\n1\n\n2"),
    ("<div><p>unclosed <b>bold", "unclosed bold"),
]


def test_pages_alone():
    for html, want in CASES:
        assert html_text.Page(html).text(None) == want, html


A, B = "The first part " * 8, "The second part " * 8
SPLIT = [
    (f"<article><h1>T</h1><section><p>{A}</p></section><section><p>{B}</p></section></article>", ["T", A, B]),
    (f'<article><h1>T</h1><section class="intro"><p>{A}</p></section><section class="rest"><p>{B}</p></section></article>', ["T", A, B]),
    (f'<body><div class="story"><h1>T</h1><div class="par">{A}</div><div class="par">{B}</div></div><div class="box"><p>x</p></div>', ["T", A, B]),
    (f"<article><h1>T</h1><table><tr><td>{A}<td>x<tr><td>{B}</table></article>", ["T", A, "x", B]),
    (f'<body><table class="page"><tr><td><p>{A}</p></td></tr><tr><td><p>{B}</p></td></tr></table>', [A, B]),
    (f"<article><p>T</p><blockquote><p>{A}</p><p>{B}</p></blockquote><p>x</p></article>", ["T", A, B, "x"]),
    (f"<main><article><h1>T</h1><p>{A}</p></article><article><p>{B}</p></article></main>", ["T", A, B]),
]


def test_text_split_over_containers(spark):
    for html, want in SPLIT:
        assert html_text.Page(html).text(None) == "\n\n".join(t.strip() for t in want), html
    rows = [(i, f"https://h{i}.example/{j}", html) for i, (html, _) in enumerate(SPLIT) for j in range(2)]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == "\n\n".join(t.strip() for t in SPLIT[r.page_id][1]) for r in got) and len(got) == len(rows)
    # the host's path, on a page where several containers have it
    assert html_text.Page(f'<body><div class="s">{A}</div><p>x</p><div class="s">{B}</div>').text(html_text.path_name("body", "div.s")) == f"{A.strip()}\n\n{B.strip()}"


def test_letters_that_grow_in_lower_case():
    for html, want in [
        ("<body><p>\u0130</p><script>x</script><p>rest</p></body>", "\u0130\n\nrest"),
        ("<title>\u0130\u0130</TITLE ><body><p>\u0130stanbul</p><STYLE>p{}</Style><p>one</p><script>'</scripts>'</script\n><p>two", "\u0130stanbul\n\none\n\ntwo"),
        ("<p>a</p><script>'</\u017fcript>'</script><p>b", "a\n\nb"),
        ("<p>a</p><script>never closed <p>b", "a"),
    ]:
        assert html_text.Page(html).text(None) == want, html


STORY = f"<p>{A}</p><p>{B}</p>"
BOTH = f"{A.strip()}\n\n{B.strip()}"


def test_wrappers_with_noise_in_their_names(spark):
    names = ["has-sidebar", "no-sidebar", "content-with-sidebar", "elementor-widget-container", "post-tags-enabled", "header-fixed", "search-results-page", "layout sidebar", "pageWidget"]
    pages = [f'<body><div {at}="{name}">{STORY}</div><div class="sidebar"><p>side</p></div>' for name in names for at in ("class", "id")]
    pages += [
        f'<body><div class="no-sidebar"><div class="main-menu"><p>m</p></div><div class="story">{STORY}</div><div class="sidebar"><p>side</p></div></div>',
        f'<body><div class="story">{STORY}</div><div class="post-tags-enabled"><a href="/">x</a></div>',
        f'<body><div class="left sidebar"><article>{STORY}</article></div><p>{"other " * 40}</p>',
        f'<body><article><div class="post-widget">{STORY}</div></article><div class="comments"><p>{A * 9}</p></div>',
        f'<article>{STORY}</article><div class="comments"><article class="comment-body"><p>{A * 9}</p></article></div>',
        f'<body><form id="aspnetForm"><input value=v><select><option>no</select><button>Go</button><textarea>no</textarea>{STORY}<form-x></form-x></form>',
        f'<body><form><nav>n</nav><article>{STORY}</article><div class="footer">f</div></form><p>x</p>',
        f'<body><div class="story">{STORY}</div><form><p>Your mail</p></form>',
        f'<body><main>{STORY}<span class="share">share</span></main><div class="widget"><p>w</p></div>',
    ]
    for html in pages:
        assert html_text.Page(html).text(None) == BOTH, html
    rows = [(i, f"https://h{i}.example/", html) for i, html in enumerate(pages)]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == [BOTH] * len(pages)


class Slow(HTMLParser):
    """Blocks inside article, by the standard parser."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.now = 0, [], ""
        self.feed(html)
        self.close()

    def cut(self):
        if t := re.sub(r"\s+", " ", self.now).strip():
            self.blocks.append(t)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag == "br":
            self.now += " "
        elif tag not in ("b", "a", "i"):
            self.cut()

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "i"):
            self.cut()
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside:
            self.now += data


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: "\n\n".join(Slow(r.html).blocks) for r in pages.collect()}
    got = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    assert got == want and unescape("&amp;") == "&" and SF


def test_hosts_agree(spark):
    page = lambda i, body: (i, f"https://u:p@A.example:80/{i}?q", f'<body><div class="c{i} story"><p>{body}</p></div><div class="box"><p>{"noise " * (i % 3) * 5}</p></div>')
    rows = [page(i, f"The story {i} " + "goes on " * 20) for i in range(9)] + [(20, "https://a.example/x", '<body><div class="story c77"><p>Short.</p></div><div class="box"><p>' + "long noise here " * 9 + "</p></div>"), (21, None, None), (None, "", "<p>x</p>"), (22, "no host", "<p>y</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", __import__("pyspark").sql.functions.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_pages(df).collect()}
    assert got[20] == ("Short.", 6) and got[21] == ("", 0) and got[None] == ("x", 1) and got[22] == ("y", 1)
    assert all(got[i][0].startswith(f"The story {i} goes") and "noise" not in got[i][0] for i in range(9))
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_deep_pages_take_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        page = "<p>top<b>" + "<div><p>a</b></i>" * n + "<p>end" + "</span>" * n
        assert html_text.Page(page).text(None).endswith("end")
        return time.perf_counter() - began

    seconds(100)
    assert min(seconds(20_000) for _ in range(3)) < 40 * min(seconds(2_000) for _ in range(3)) + 0.5


def test_pages_beyond_the_broadcast(spark):
    rows = [(i, f"https://h{i % 3}.example/{i}", f'<body><div class="story"><p>Text {i} of the page.</p></div><div class="sidebar">x</div>') for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.text) for r in html_text.extract_pages(df, broadcast_hosts=1).collect()}
    assert got == {(i, f"Text {i} of the page.") for i in range(60)}


def test_html_does_not_move(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plan = html_text.extract_pages(pages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
