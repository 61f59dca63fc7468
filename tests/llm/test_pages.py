import numpy as np

from fathom.llm.pages import LABELLED, grow, main_text, text_blocks, trained_tree, with_main_text

from .conftest import words

TREE = trained_tree()
A, B, C = words(1, 30), words(2, 45), words(3, 25)


def test_tree_has_learned_its_table():
    table = np.array(LABELLED, float)
    assert [TREE.classify(r[:-1]) for r in table] == (table[:, -1] == 1).tolist()
    assert grow(table[:, :-1], table[:, -1], depth=1).low.low is None


def test_article_without_what_stands_beside_it():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>x";</script></head>
    <body class="post-template"><header class="site-header"><p>Our paper {words(9, 12)}</p></header><nav><ul><li><a href="/">Home</a><li><a>News</a></ul></nav>
    <!-- <p>hidden</p> --><div class="ad">{words(8, 20)}</div>
    <article><header><h1>Head &amp; line</h1></header><p>{A}<br>{A}</p><p><b>Bo</b>ld&nbsp;&#8212; &lt;b&gt;
    text</p><aside>{words(7, 30)}</aside><div class="advert-box">{words(6, 30)}</div><ul><li>one<li>two</ul><p>{B}<p>{C}</article>
    <section id="comments"><p>{words(5, 60)}</p></section><form><p>{words(4, 30)}</p><textarea>x</textarea></form>
    <div role="dialog" class="cookie-notice">{words(10, 30)}</div><footer>&copy; 2024 {words(11, 30)}</footer></body></html>"""
    assert main_text(page, TREE) == f"Head & line {A} {A} Bold — <b> text one two {B} {C}"


def test_page_without_marks():
    page = f"<div><a href=x>Home</a> <a href=y>About us</a></div><h1>{words(12, 6)}</h1><div>{A}</div><p>{B}</p><div>Copyright {words(13, 9)}</div>"
    assert main_text(page, TREE) == f"{words(12, 6)} {A} {B}"


def test_wrappers_with_names_of_what_stands_beside():
    side = f"<div class='sidebar'><article class='card'><p>{words(14, 12)}</p></article></div>"
    comments = f"<section id='comments'><article><p>{words(15, 200)}</p></article></section>"
    for wrapper in ("<div class='layout has-sidebar'>", "<div class='tabs'>", "<div id='main-widget'>"):
        for inner in (f"<article><p>{A}</p><p>{B}</p></article>", f"<main><p>{A}</p><p>{B}</p></main>", f"<div role=main><p>{A}</p><p>{B}</p></div>"):
            assert main_text(f"<body>{wrapper}{inner}{side}</div>{comments}</body>", TREE) == f"{A} {B}"
    assert main_text(f"<div class='elementor-widget'><p>{A}</p><p>{B}</p></div>", TREE) == f"{A} {B}"
    assert main_text(f"<p>{A}</p><p>{B}</p><div class='widget'><p>{C}</p></div>", TREE) == f"{A} {B}"


def test_broken_markup():
    assert main_text(f"<article><p>{A}<p>{B}", TREE) == f"{A} {B}"
    assert main_text(f"<article><p title='a > b'>{A} < 5 & more</p><!-- open", TREE) == f"{A} < 5 & more"
    assert main_text(f"<article><p>{A}</p></nav></div><p>{B}</p><script>while(a<b)", TREE) == f"{A} {B}"
    assert main_text(f"{A} &unknown; &#xZZ; {B}", TREE) == f"{A} &unknown; &#xZZ; {B}"
    assert main_text("", TREE) == "" and main_text("<", TREE) == "" and main_text("<p>", TREE) == ""
    assert main_text('<a "' * 3000, TREE) == ""


def test_blocks_know_links_and_white_space():
    blocks = text_blocks("<p>one <a>two three</a>\n\t four</p><h2> a  b </h2><ul><li><a>x</a></ul>")
    assert [(b.text, b.words, b.link_words, b.heading, b.item) for b in blocks] == [
        ("one two three four", 4, 2, False, False),
        ("a b", 2, 0, True, False),
        ("x", 1, 1, False, True),
    ]


def test_long_page():
    page = "<article>" + "".join(f"<p>{words(k, 20)}</p>" for k in range(3000)) + "</article>"
    assert main_text(page, TREE) == " ".join(words(k, 20) for k in range(3000))


def test_odd_rows(make):
    pages = make([(1, "u", None, "a"), (2, None, "", "b"), (None, "u", f"<article><p>{A}", "c"), (3, "u", " \n", "d")], "page_id long, url string, html string, TEXT string")
    got = with_main_text(pages)
    assert got.columns == ["page_id", "url", "html", "text"]
    assert sorted(r.text for r in got.collect()) == ["", "", "", A]
    assert with_main_text(pages.limit(0)).count() == 0
