import random
from html.parser import HTMLParser

from casewatch.llm import html


class Article(HTMLParser):
    """Blocks of the article element of a page of the test tables."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag in ("p", "h1", "h2", "article"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("p", "h1", "h2"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def brute(page):
    parser = Article()
    parser.feed(page or "")
    parser.close()
    return "\n\n".join(t for t in (" ".join(b.split()) for b in parser.blocks) if t)


def test_whole_table(spark, folder, pages):
    got = html.op5_main_text(spark, folder).toPandas().set_index("page_id")
    assert len(got) == len(pages)
    for p in pages.itertuples():
        row = got.loc[p.page_id]
        assert row.text == brute(p.html) and row.n_chars == len(row.text) and row.url == p.url


LONG = "A long sentence of the article that goes on for quite a while, with enough text to count as a surge of its own. "


def text(page):
    return html.extract(page)[0]


def test_noise_goes():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header>
    <div id="cookie-notice"><p>{LONG}</p></div><ul class='main menu'><li>{LONG}</ul>
    <div><h2>Title &amp; more</h2><p>{LONG}<p>Short.<p>x &lt; y &eacute;&#233;&nbsp; z<script>if (a < b) document.write("</p>")</script>
    <div class="ad"><div>Buy</div> now</div><p>{LONG}</div><!-- <p>no</p> --><form><label>Name</label></form>
    <section class="comments"><p>{LONG}</p></section><aside>{LONG}</aside><footer>{LONG}</footer></body></html>"""
    once = LONG.strip()
    assert text(page) == "\n\n".join(["Title & more", once, "Short.", "x < y éé z", once])


def test_article_keeps_short_blocks_and_drops_noise_inside():
    page = "<nav>menu</nav><p>Outside " + LONG + "</p><article><header><h1>A</h1></header><p>b</p><div class=ads>ad</div><p>c<br>d</p><div class=comments>no</div></article>"
    assert text(page) == "A\n\nb\n\nc d"


def test_odd_pages():
    assert text("") == text("<p></p>") == text("<nav>only menu</nav>") == ""
    assert text("<p>" + LONG) == LONG.strip()
    assert text("a < b and 3 <4 <p " + LONG) != ""
    assert text("<article>" + "<p>w</p>" * 20_000 + "</article>").count("w") == 20_000
    assert text("<nav><ul><li>never closed<article><p>body</p></article>") == "body"
    assert text("<div class='ad'>" * 500 + LONG) == ""
    assert text("<article>x " + '<a href="' * 3000) != "never ends"


def test_nulls_repeats_empty(spark):
    schema = "page_id long, url string, html string, text string"
    assert html.main_text(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, "z"), (1, "u", "<article>t</article>", None), (1, "u", "<article>t</article>", None)]
    got = html.main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "t", 1), (1, "t", 1)]


def test_body_outside_small_articles_stays():
    body, once = f"<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", LONG.strip()
    assert text("<article>x</article>" + body) == "\n\n".join(["x", once, once, once])
    cards = "<article><h3>Card</h3></article>"
    assert text(body + "<ul><li>a</ul><div>short</div><div></div>" + cards * 2) == "\n\n".join([once] * 3 + ["Card"] * 2)
    assert text(f"<p>{LONG}</p><main>{body}</main><p>{LONG}</p>") == "\n\n".join([once] * 3)
    assert text(f"<article></article><p>{LONG}") == once


def test_void_elements_are_no_noise():
    for tag in ("<img class='banner' src=x>", "<hr class=ad>", "<input type=hidden>", "<img alt='Hidden lake'>", "<br class=social>", "<source class=ad>"):
        assert text(f"<article><p>a</p>{tag}<p>b</p></article>") == "a\n\nb", tag
        assert text(f"<div>{tag}<p>{LONG}</p></div>") == LONG.strip(), tag


def test_noise_without_an_end_tag_ends_at_its_sibling_or_with_its_parent():
    for page in (
        "<p class=notice>no<p>yes", "<p class=notice>no<div>yes</div>", "<div><p class=notice>no</div>yes", "<ul><li class=social>no<li>yes</ul>",
        "<ul><li class=social>no<ul><li>no</ul>no</ul>yes", "<ul><li class=social>no<ul><li>no<li>no</ul>no</li><li>yes</ul>", "<dl><dt class=ad>no<dd>yes</dl>",
        "<dl><dd class=ad>no<dt>yes</dl>", "<table><tr class=ad><td>no<tr><td>yes</table>", "<table><tr><td class=ad>no<td>yes</table>",
        "<table><tr><td class=ad>no<table><tr><td>no<td>no</table>no<tr><td>yes</table>", "<table><tr><td class=ad>no</table>yes",
        "<datalist><option class=ad>no<option>yes</datalist>", "<table><tr><td><p class=notice>no<td>yes</table>",
    ):
        assert text(f"<article>{page}</article>") == "yes", page
        assert text(page.replace("yes", LONG)) == LONG.strip(), page


def test_only_attributes_by_name_hide():
    for shown in (
        'style="overflow:hidden"', 'class="overflow-hidden"', 'title="hidden costs"', 'data-x="is hidden"', "data-id=ad", 'title="role=menu"', """title='class="ad"'""",
        'title="aria-hidden=true"', "aria-hidden=false", "data-hidden", "role=main", "hidden=until-found",
    ):
        assert text(f"<div {shown}><p>{LONG}</p></div>") == LONG.strip(), shown
        assert text(f"<article><div {shown}>yes</div></article>") == "yes", shown
    assert text("<article><p><a href='/hidden/x'>yes</a> <a href=/hidden>too</a></article>") == "yes too"
    for gone in ("hidden", "HIDDEN", 'hidden=""', "hidden=hidden", 'aria-hidden="true"', "role=menu", "ROLE='navigation x'", "data-a=1 class='x ad'", 'style="a:b"hidden', "id = nav"):
        assert text(f"<article>yes<div {gone}>no</div></article>") == "yes", gone


def test_reader_comments_go_wherever_they_stand():
    comment = f"<article class='comment'><p>{LONG}</p></article>"
    for part in (f'<section id="comments">{comment * 3}</section>', f'<div class="post-comments"><main><article>{LONG}</article></main></div>', comment, f'<ol class="comment-list"><li>{comment}</ol>'):
        assert text(f"<article><p>body</p>{part}<p>end</p></article>") == "body\n\nend", part
        assert text(f"<article><p>body</p></article>{part}") == "body", part


def test_only_whole_names_are_noise():
    for shown in ("content-with-sidebar", "layout no-sidebar", "social-history", "has-sidebar", "nav-less", "article", "sidebar2 x", "noads", "menubar-free"):
        assert text(f"<div class='{shown}'><p>{LONG}</p></div>") == LONG.strip(), shown
        assert text(f"<article><div id='{shown}'>yes</div></article>") == "yes", shown
        assert text(f"<article class='{shown}'>yes</article>") == "yes", shown
    for gone in ("sidebar", "sidebar-left", "site_nav", "main-menu", "comments-area", "x ad", "header__nav", "cookie-notice", "related-posts related"):
        assert text(f"<article>yes<div class='{gone}'>no</div></article>") == "yes", gone


def test_quotes_hold_angle_brackets():
    for tag in ('<p title="a > b">', "<p title='a > b'>", '<p data-x="<b>1</b>" title="x">', '<p title = "a > b" class=x>', "<p onclick=\"if (a > b) { go('x') }\">"):
        assert text(f"<article>{tag}yes</p></article>") == "yes", tag
    assert "end" in text(f'<article><a title="lost>one</a> <p>{LONG}</p><p>end</p></article>')


def naive(sizes, span=html.SPAN, surge=html.SURGE):
    """Lines kept by the definition, one window at a time; two empty lines in a row are a valley."""
    kept, run = set(), []
    for i in range(len(sizes) + 1):
        ahead = sum(sizes[i:i + span])
        if i < len(sizes) and ahead > 0 and not (sizes[i] == 0 and (i == 0 or sizes[i - 1] == 0)):
            run.append(i)
            continue
        if run and max(sum(sizes[j:j + span]) for j in run) >= surge:
            kept.update(j for j in run if sizes[j])
        run = []
    return kept


def test_windows_against_the_definition():
    """Pages without article elements: sums alone decide."""
    rng, decided = random.Random(3), 0
    for _ in range(300):
        parts = [rng.choice(["", "", "<hr>", "word " * rng.randrange(1, 12), "longer text " * rng.randrange(1, 12)]) for _ in range(rng.randrange(1, 30))]
        page = "".join(f"<div>{x}</div>" for x in parts)
        lines, trusted = html.lines_of(page)
        want = naive([len(x) for x in lines])
        assert not any(trusted)
        assert text(page) == "\n\n".join(x for i, x in enumerate(lines) if i in want)
        decided += len(want) < sum(map(bool, lines))
    assert decided > 100
