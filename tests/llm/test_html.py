import pytest

from coexnet.llm.html_text import extract_main_text, main_text

PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var x = "</p><p>no";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu, one</a></ul></nav><div id="cookie-notice"><p>We use cookies, many of them, on this site, for you.</p></div>
<div class=wrap><div class="post"><h1>A &amp; title</h1><p>First, of the paragraphs, with enough words,\n and commas, to <b>score</b> well &eacute;&#233;.
<p>Second paragraph, unclosed<br>but long enough, to be counted, as one.</div>
<div class="sidebar"><p>Other things, to read, in the side bar, of the page, are here.</p></div>
<section id="comments"><p>A reader says, with many words, that it is good, or bad, who knows.</p></section></div>
<form><p>Sign up, for this, and that, and more of that, with a mail address.</p></form>
<footer><p>Copyright, all rights, reserved, by us, since ever.</p></footer></body></html>"""


def test_article_only():
    assert main_text(PAGE) == "A & title\n\nFirst, of the paragraphs, with enough words, and commas, to score well éé.\n\nSecond paragraph, unclosed but long enough, to be counted, as one."


def test_article_element_and_siblings():
    page = "<article><h1>T</h1><section><p>One, two, three, four, five, six, seven.</p></section><section><p>Short.</p></section><aside>no</aside><div class='ad'>buy</div></article><p>Outside, the article, there is a paragraph, that is long.</p>"
    assert main_text(page) == "T\n\nOne, two, three, four, five, six, seven.\n\nShort."


def test_link_lists_are_menus():
    page = "<div><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul><p>Real text, of some length, with commas, and an <a>inner link</a>.</p><ul><li>item<li>another item</ul></div>"
    assert main_text(page) == "Real text, of some length, with commas, and an inner link.\n\nitem\n\nanother item"


@pytest.mark.parametrize(
    ("page", "text"),
    [(None, ""), ("", ""), ("plain   text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<script>x", ""), ("<!-- <p>x", ""), ("a < b", "a < b"), ("<p title='>'>x</p>", "x"), ('<p class="x>y</p>', "y"), ("</div></p>x", "x"), ("<p>&nbsp;a&nbsp;&nbsp;b</p>", "a b"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), ("<pre>a\n  b</pre>", "a b")],
)
def test_edges(page, text):
    assert main_text(page) == text


def test_long_and_deep():
    deep = "<div>" * 5000 + "<p>Deep, but there, in the middle of it all.</p>" + "</div>" * 5000
    assert main_text(deep) == "Deep, but there, in the middle of it all."
    many = "".join(f"<p>Paragraph {i}, with some text, to keep.</p>" for i in range(20_000))
    assert main_text(f"<body>{many}</body>").count("\n\n") == 19_999
    assert main_text("<" * 50_000).startswith("<")


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", "old", 7), (None, None, None, None, None), (1, "u", "<p>x", "old", 7)], "page_id long, url string, html string, text string, n_chars long")
    got = [tuple(r) for r in extract_main_text(df).collect()]
    assert sorted(got, key=str) == [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0)]
    assert extract_main_text(df.limit(0)).count() == 0


TEXT = "<p>A paragraph, of the article, with commas, and enough words, to be one.</p>"
MORE = "<p>One more of them, with other words, after the first, to be kept.</p>"


@pytest.mark.parametrize(
    "wrapper",
    ['div class="content with-sidebar"', 'div class="overflow-hidden"', 'div id="main" class="no-sidebar"', 'div class="elementor-widget"', 'section class="post comments-enabled"', 'div class="has-comments"', 'div class="share-layout"', 'div class="promo-page"', 'div class="widget"', 'main class="ads-enabled"'],
)
def test_names_of_layouts_keep_the_article(wrapper):
    tag = wrapper.split()[0]
    foot = "<div class='related-posts'><p>Other things, to read, on this site.</p></div>"
    for rest in ("", foot) if wrapper != 'div class="widget"' else ("",):
        assert main_text(f"<body><{wrapper}>{TEXT}{MORE}</{tag}>{rest}</body>") == main_text(f"<body><div>{TEXT}{MORE}</div></body>")


def test_names_still_cut_what_is_not_the_text():
    long = "<p>A reader says, with many words, and commas, that it is good, or bad.</p>" * 9
    for name in ("id=comments", "class=reader-comments", "class='cookie-notice'"):
        assert main_text(f"<body><div>{TEXT}</div><div {name}>{long}</div></body>") == main_text(f"<body><div>{TEXT}</div></body>")
    assert main_text(f"<div class=ad>{TEXT}</div><p>Short text.</p>") == "Short text."
    assert "article" in main_text(f"<div class='modal'><article>{TEXT}</article></div>")


def test_shorter_part_of_an_article_is_kept():
    assert main_text(f"<body><div class=a>{TEXT}{TEXT}</div><div class=b>{MORE}</div></body>").endswith("to be kept.")


def test_words_that_an_article_may_use_as_names():
    for name in ("related-work", "comment-on-method", "notice-periods", "social-history", "share_prices"):
        page = f"<body><article><h2>Before</h2>{TEXT}<section class='{name}' id='{name}'>{MORE}</section></article></body>"
        assert main_text(page) == main_text(page.replace(f" class='{name}' id='{name}'", "")), name


def test_several_articles_and_siblings_of_one():
    page = f"<main><article>{TEXT}{TEXT}</article><article>{MORE}{MORE}</article></main>"
    assert main_text(page).count("first, to be kept") == 2
    prose = "<p>" + "A long paragraph beside the article, which goes on and on, " * 3 + "is prose.</p>"
    assert main_text(f"<body><article>{TEXT * 9}</article>{prose}<p>Short one.</p></body>").endswith("is prose.")


def test_titles_and_short_paragraphs_beside_the_best_part():
    page = f"<body><h1>Title</h1><div>{TEXT}{TEXT}{MORE}</div><p>Tiny.</p><p><a href=x>link</a></p></body>"
    assert main_text(f"<body><div class=wrap>{page}</div></body>").split("\n\n") == ["Title", *main_text(f"<div>{TEXT}{TEXT}{MORE}</div>").split("\n\n"), "Tiny."]


def test_page_wide_form_keeps_its_article_and_other_forms_go():
    body = f"<div>{TEXT}{MORE}</div>"
    controls = "<label>Your name, please, as it is on the card</label><input name=q><button>Send it</button>"
    for inner in (body, f"<article>{TEXT}{MORE}</article>"):
        assert main_text(f"<body><form id=form1 action=x>{inner}{controls}</form></body>") == main_text(f"<body>{body}</body>")
    contact = f"<form><fieldset><legend>Write to us</legend><p>{controls}</p><p>Tell us, what you think.</p></fieldset></form>"
    assert main_text(f"<body>{body}{contact}</body>") == main_text(f"<body>{body}</body>")
    assert main_text("<body><form><label>User</label><input><label>Password</label><input><a href=x>Forgotten?</a></form></body>") == ""


def test_lists_of_links_in_an_article_stay():
    refs = "<ul><li><a href=1>First source</a><li><a href=2>Second source</a><li><a href=3>Third source</a></ul>"
    assert main_text(f"<body>{refs}<article>{TEXT}<h2>References</h2>{refs}</article></body>").endswith("References\n\nFirst source\n\nSecond source\n\nThird source")
    assert "First" in main_text(f"<main>{TEXT}{refs}</main>")
    assert "First" not in main_text(f"<main>{refs}<article>{TEXT}</article></main>")
    assert "First" not in main_text(f"<article>{TEXT}<div class=tags>{refs}</div><nav>{refs}</nav><div class=related-posts>{refs}</div></article>")


def test_short_paragraphs_beside_an_imprint():
    lines = "".join(f"<p>Short line {i}.</p>" for i in range(30))
    got = main_text(f"<body><div>{lines}</div><div>Published by the society, at home, since 1900.</div></body>").split("\n\n")
    assert got == [f"Short line {i}." for i in range(30)]


def test_closing_section_is_kept():
    end = "<section><h2>Conclusion</h2><p>It works, and is kept.</p></section>"
    page = f"<body><div><section>{TEXT * 8}</section>{end}<section><h2>More</h2><p><a href=x>Only a link, to some other page.</a></p></section></div></body>"
    assert main_text(page).endswith("Conclusion\n\nIt works, and is kept.")


def test_discussion_as_a_title():
    for name in ("discussion", "social-comment"):
        part = f"<section class='{name}'>{(TEXT + MORE) * 3}</section>"
        assert main_text(f"<body><div><p>A line, that leads in, to what follows.</p>{part}</div></body>").count("\n\n") == 6, name
    said = "<p>A reader says, with many words, and commas, that it is good, or bad.</p>" * 9
    for part in (f"<div class=discussion><div class=comment>{said}</div></div>", f"<div class=discussion><ul><li>{said}</li></ul></div>", f"<div class=comment>{said}</div>", f"<div class=reader-comment>{said}</div>"):
        assert main_text(f"<body><div>{TEXT}</div>{part}</body>") == main_text(f"<body><div>{TEXT}</div></body>"), part


def test_formulas_are_text():
    page = f"<p>The sum, as we know, is <math><mi>a</mi><mspace/><mo>+</mo><mi>b</mi><annotation encoding=tex>a+b</annotation></math>, and so on.</p>{TEXT}"
    assert main_text(page).startswith("The sum, as we know, is a+b, and so on.\n\nA paragraph")


@pytest.mark.parametrize(
    "page",
    ["<div>" * 200_000, "<div>" * 90_000 + "</div>" * 90_000, "<a '" * 250_000, "<a <a " * 150_000 + "'", "<a<a<a " * 140_000 + "'<>", "<a x='\"" * 140_000 + ">", "<b><table>" + "<i>" * 150_000 + "</b>" * 100_000, "<p><td>" * 140_000, "<li>" * 250_000, "<tr><td>" * 120_000, "<!-- " * 200_000, "</p>" * 250_000, "<" * 1_000_000, "<span>" * 80_000 + "<p>" * 150_000],
    ids=range(14),
)
def test_time_grows_with_the_page(page):
    import time

    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 6 * max(1.0, len(page) / 1e6)


def brute(tree, html=False):
    """The text that tree scoring keeps, from a tree of (tag, children or text), by the rules as they are written."""
    nodes = []

    def walk(node, path):
        nodes.append((node, path))
        if not isinstance(node[1], str):
            for c in node[1]:
                walk(c, [*path, node])

    walk(tree, [])
    score = {id(n): 0.0 for n, _ in nodes}
    for n, path in nodes:
        if n[0] == "p" and n[1]:
            gain = min(len(n[1]) / 25, 1) + n[1].count(",") + min(len(n[1]) // 100, 3)
            for share, up in enumerate(reversed(path), 1):
                if share <= 5:
                    score[id(up)] += gain / share
    best = max(nodes, key=lambda x: (score[id(x[0])],))  # the first of equals
    if score[id(best[0])] <= 0:
        kept = [tree]
    else:
        parent = best[1][-1] if best[1] else (None, [best[0]])
        kept = [c for c in parent[1] if c is best[0] or c[0] == "p" or c[0] == "div" and score[id(c)] > 0 and score[id(c)] >= 0.2 * score[id(best[0])]]
    texts = lambda n: [n[1]] if isinstance(n[1], str) else [t for c in n[1] for t in texts(c)]
    return "\n\n".join(t for n in kept for t in texts(n))


def test_against_brute_force_on_random_trees():
    import random

    rng = random.Random(5)

    def grow(level):
        if level == 0 or rng.random() < 0.35:
            return ("p", ", ".join("word" * rng.randint(1, 9) for _ in range(rng.randint(1, 12))))
        return ("div", [grow(level - 1) for _ in range(rng.randint(1, 4))])

    write = lambda n: f"<{n[0]}>{n[1] if isinstance(n[1], str) else ''.join(map(write, n[1]))}</{n[0]}>"
    for _ in range(400):
        tree = ("body", [("div", [grow(5), grow(4)])])
        assert main_text(write(tree)) == brute(tree)
