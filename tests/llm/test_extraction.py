import pytest

from tallyledger.llm.extraction import extract_pages, main_text

LONG = "A sentence of the article, with commas, and enough words to count as a paragraph of its own."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("<p>", ""),
        ("just text", "just text"),
        (page(f"<nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{LONG}</p><p>Of.</p></article><footer>F</footer>"), f"Head\n\n{LONG}\n\nOf."),
        (page(f"<article><p>a &amp; b&nbsp;&lt;c&#62;\n  d &am</p><p>{LONG}<br>more</p>"), f"a & b <c> d &am\n\n{LONG} more"),
        (page(f'<div class="sidebar"><p>{LONG}</p></div><main><p>{LONG}</p></main>'), LONG),
        (page(f'<div id="cookie-notice">{LONG}</div><div class=content><h2>H</h2><p>{LONG}</p></div><div class="comments"><p>{LONG}</p></div>'), f"H\n\n{LONG}"),
        (page(f"<article><p><b>Open {LONG}<br><p>{LONG}</p></article>"), f"Open {LONG}\n\n{LONG}"),
        (page(f"<article><p>{LONG}</p><form><p>Name</p><input></form><aside>x</aside><script>var t='</p>';</script></article>"), LONG),
        (page(f"<article><p>{LONG}</p><ul><li>one</li><li>two<li>three</ul><table><tr><td>c1<td>c2</table></article>"), f"{LONG}\n\none\n\ntwo\n\nthree\n\nc1\n\nc2"),
        (page(f"<article><ul><li><a>a</a></li><li><a>b</a></li><li><a>c</a></li></ul><p>{LONG} <a>link</a></p></article>"), f"{LONG} link"),
        (page(f"<div><p>{LONG}</p><!-- <p>no</p> --><p>{LONG}</p></div><div hidden><p>{LONG}</p></div><p style='display: none'>x</p>"), f"{LONG}\n\n{LONG}"),
        (page(f"<article><p>{LONG}</p><p>cut <a href='"), f"{LONG}\n\ncut"),
        (page(f"<article><p>x < y and {LONG}</p></article>"), f"x < y and {LONG}"),
        (page(f"<article><header><h1>Head</h1></header><p>{LONG}</p></article><header>Site</header>"), f"Head\n\n{LONG}"),
    ],
)
def test_articles(html, text):
    assert main_text(html) == text


def test_nothing_of_a_long_article_is_dropped():
    blocks = [f"Block {k}, with a comma. {'word ' * (k % 40)}".strip() for k in range(3000)]
    html = page("<div class=menu>m</div><section>" + "".join(f"<p>{b}" for b in blocks) + "</section>")
    assert main_text(html) == "\n\n".join(blocks)


def test_table(spark):
    rows = [(1, "u", None, 0), (1, "u", page(f"<p>{LONG}"), 0), (None, None, "x", 0), (2, "v", "<" * 2000 + "'" * 2000, 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = sorted((r.page_id or 0, r.text) for r in extract_pages(pages).collect())
    assert got[:3] == [(0, "x"), (1, ""), (1, LONG)] and len(got) == 4
    assert extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("counts", [(2, 2), (4, 1), (2, 2, 2), (1, 3, 2)])
@pytest.mark.parametrize("around", ["<div>{}</div>", "<div><div>{}</div></div>"])
def test_sections_without_article_are_all_kept(counts, around):
    """Short sections next to each other, and each in a container of its own; a list of links beside them goes."""
    made = [[f"Section {s} paragraph {k} {'word ' * 26}".strip() for k in range(n)] for s, n in enumerate(counts)]
    sections = ["<section>" + "".join(f"<p>{t}</p>" for t in texts) + "</section>" for texts in made]
    want = "\n\n".join(t for texts in made for t in texts)
    assert main_text(page(around.format("".join(sections)))) == want
    assert main_text(page(around.format("".join(f"<div>{s}</div>" for s in sections)))) == want
    links = "<div>" + "".join(f"<p><a href=x>Link {k}</a></p>" for k in range(9)) + "</div>"
    assert main_text(page(around.format("".join(sections)) + links)) == want


LEDE = "The lede tells in some words what happened, and where, and to whom, before the article itself begins here."
SHORT = "A section of one paragraph with fifty-one letters."


@pytest.mark.parametrize(
    ("body", "texts"),
    [
        (f"<h1>Head</h1><div><p>{LEDE}</p><p>{LEDE}</p></div><article><p>{LONG}</p><p>{LONG}</p></article>", ["Head", LEDE, LEDE, LONG, LONG]),
        (f"<article><p>{SHORT}</p></article><article><p>{LONG}</p><p>{LONG}</p></article>", [SHORT, LONG, LONG]),
        (f"<main><article><p>{SHORT}</p></article><article><p>{LONG}</p><p>{LONG}</p></article></main>", [SHORT, LONG, LONG]),
        (f"<main><div><article><p>{SHORT}</p></article></div><div><article><p>{LONG}</p></article></div></main>", [SHORT, LONG]),
        (f"<section><p>{LONG}</p><p>{LONG}</p></section><section><p>{SHORT}</p></section><section><ul><li>one</li><li>two</li></ul></section>", [LONG, LONG, SHORT, "one", "two"]),
        (f'<article><p>{LONG}</p><section id="social-history"><p>{LEDE}</p></section><div class="legal-analysis"><p>{SHORT}</p></div></article>', [LONG, LEDE, SHORT]),
        (f"<article><p>{LONG}</p><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><p><label>Label</label> text</p></article>", [LONG, "so x=1 holds", "Label text"]),
        (f"<main><article><p>{LONG}</p><article><p>{SHORT}</p></article></article></main>", [LONG, SHORT]),
        (f"<div><h1>A title in a box of its own</h1></div><article><p>{LONG}</p></article>", ["A title in a box of its own", LONG]),
        (f'<article><p>{LONG}</p><div class="ad-slot"><p>{LEDE}</p></div><div class="share-bar">Share</div><section id="comments"><p>{LEDE}</p></section></article>', [LONG]),
        (f'<article><p>{LONG}</p></article><div class="ad"><p>{LEDE}</p></div><section><article><h3><a href=x>Another story, linked</a></h3><p>In short.</p></article></section>', [LONG]),
        (f'<main><div class="content-sidebar-wrap"><article><p>{LONG}</p></article></div></main><label>Search the site for words:</label>', [LONG]),
    ],
)
def test_every_part_of_the_article_and_nothing_around_it(body, texts):
    assert main_text(page(body)) == "\n\n".join(texts)


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages_by_blocks_in_and_out(seed):
    """Pages put together from parts known to be in or out: every block that is in comes, in order, and no other."""
    import random

    rng = random.Random(seed)
    said = iter(range(10**6))

    def prose():
        return f"Block {next(said)} says {'some words, ' * rng.randint(2, 30)}and ends."

    def parts(kinds, depth=0):
        made, wanted = [], []
        for kind in kinds:
            text = prose()
            if kind == "p":
                made.append(f"<p>{text}</p>")
                wanted.append(text)
            elif kind == "list":
                made.append(f"<ul><li>{text}</li><li>short</li></ul>")
                wanted += [text, "short"]
            elif kind == "section" and depth < 2:
                inner, inside = parts(rng.choices(["p", "list", "section", "out"], k=rng.randint(1, 3)), depth + 1)
                made.append(f"<section><h2>{text}</h2>{inner}<p>End of it.</p></section>")
                wanted += [text, *inside, "End of it."]
            elif kind == "out":
                made.append(rng.choice([
                    f'<div class="ad-box"><p>{text}</p></div>', f"<aside><p>{text}</p></aside>", f"<form><p>{text}</p></form>",
                    f'<div class="comments"><p>{text}</p></div>', f"<script>'{text}'</script>", f"<p hidden>{text}</p>",
                    f'<ul class="x">{f"<li><a href=x>{text}</a></li>" * 3}</ul>', f"<!-- <p>{text}</p> -->",
                ]))
        return "".join(made), wanted

    around = ["<nav><a href=x>Home</a></nav>", '<div class="sidebar"><p>Side text of some length, with a comma.</p></div>', "<footer><p>All rights are reserved by us.</p></footer>"]
    body, wanted = "", []
    for _ in range(rng.randint(1, 3)):
        inner, inside = parts(["p", *rng.choices(["p", "list", "section", "out"], k=rng.randint(1, 6))])
        body += f"<article>{inner}</article>"
        wanted += inside
    html = f"{around[0]}{around[1]}{rng.choice(['{}', '<main>{}</main>', '<div><div>{}</div></div>']).format(body)}{around[2]}"
    assert main_text(page(html)) == "\n\n".join(wanted)
