import html
import random

import pytest

from ambry.llm.extraction import extract, main_text, stretches, window_sums

TEXT = "A longer paragraph of running text that goes on for a while, more than eighty characters in all."
PAGES = {
    "article": (f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>x</a></ul></nav><article><h1>T &amp; U</h1><p>{TEXT}</p><p>Be.</p></article><footer>f</footer>", f"T & U\n{TEXT}\nBe."),
    "unclosed": (f"<article><h1>T</h1><p><b>One<br><p>Two  \n three<p>{TEXT}</article>", f"T\nOne\nTwo three\n{TEXT}"),
    "no article": (f"<div class='header'>Site</div><nav><a>m</a></nav><div><h1>Title</h1><p>{TEXT}<p>Short.<p>{TEXT}</div><div class=comments><p>First! {TEXT}</div>", f"Title\n{TEXT}\nShort.\n{TEXT}"),
    "parts inside": (f"<main><header><h1>T</h1></header><p>{TEXT}<div class='ad-box'>buy</div><aside>see</aside><form>mail</form><p>end</main>", f"T\n{TEXT}\nend"),
    "script": (f"<p>{TEXT}</p><script>var t='</p><p>no';</script><style>p{{}}</style><!-- <p>no --><p>{TEXT}", f"{TEXT}\n{TEXT}"),
    "references": ("<article><p>&lt;b&gt; &#233;&#x41; &nbsp; &unknown; a&b</article>", "<b> éA &unknown; a&b"),
    "camel case marks": (f"<article><p>{TEXT}</p><div id='relatedPosts'>more</div><div class=cookieNotice>ok</div></article>", TEXT),
    "list and table": ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    "text alone": (TEXT, TEXT),
    "tiny": ("<ul><li><a href=x>Home</a><li><a href=y>About</a></ul><p>Tiny page.</p>", "Tiny page."),
    "menu alone": ("<nav><a>x</a></nav><ul><li><a>y</a></ul>", ""),
    "a word in a value": (f'<article><p title="a hidden thing">{TEXT}</p><p hidden>no</p></article>', TEXT),
    "sibling articles": (f"<article><p>{TEXT}</p></article><nav>m</nav><article><p>Two {TEXT}</article><p>outside", f"{TEXT}\nTwo {TEXT}"),
    "links between": (f"<p>{TEXT}<ul><li><a>one</a><li><a>two</a><li><a>three</a><li><a>four</a></ul><p>Two {TEXT}", f"{TEXT}\none\ntwo\nthree\nfour\nTwo {TEXT}"),
    "parts of an article": (f"<article><p>{TEXT}<section class='related-work' ><p>Others.</section><section id=search><p>How.</section><div class=share-box>s</div></article>", f"{TEXT}\nOthers.\nHow."),
    "equal stretches": (f"<p>{TEXT}</p><nav>a</nav><hr><nav>b</nav><p>é{TEXT[1:]}", f"{TEXT}\né{TEXT[1:]}"),
    "null": (None, ""),
    "empty": ("", ""),
    "comments in article": (f"<article><p>{TEXT}</p><section id=comments><article class=comment><p>{TEXT}</article></section></article>", TEXT),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, text = PAGES[name]
    assert main_text(page) == text


@pytest.mark.parametrize("page", ["<p" * 50_000, "<!" * 100_000, "<![CDATA[" * 50_000, "<?x" * 50_000, '<a "' * 50_000, "<div>" * 30_000 + TEXT, "<article>" + f"<p>{TEXT}" * 2_000])
def test_long_and_broken_pages(page):
    assert isinstance(main_text(page), str)


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (None, None, "<p>x", 2), (2, "u", "<article>a</article>", 3), (2, "u", "<article>a</article>", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(map(tuple, extract(pages).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (None, None, "x", 1), (2, "u", "a", 1), (2, "u", "a", 1)], key=repr)
    assert extract(pages.limit(0)).count() == 0


def test_window_sums_and_stretches_are_those_of_their_definition():
    draw = random.Random(5)
    for _ in range(200):
        weights = [draw.choice([0, 0, 1, 30, 90]) for _ in range(draw.randint(0, 20))]
        window, surge = draw.randint(1, 4), draw.choice([1, 60])
        sums = [sum(weights[i:i + window]) for i in range(len(weights))]
        assert window_sums(weights, window) == sums
        held = set()
        for i, size in enumerate(sums):  # a line is text if a surge comes before it and no dive in between
            if any(sums[k] >= surge and all(sums[k:i + 1]) for k in range(i + 1)):
                held.add(i)
        assert {i for a, b in stretches(sums, surge) for i in range(a, b)} == held


def test_planted_articles_come_back_whole():
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgé&") for _ in range(draw.randint(1, 9)))
    block = lambda: " ".join(word() for _ in range(draw.randint(1, 40)))
    junk = ["<nav><ul><li><a href=x>m</a></ul></nav>", "<div class='ad'>buy this now</div>", "<aside><p>see</p></aside>", "<script>x<p>y</script>",
            "<form><p>mail</p></form>", "<!-- <p>no -->", "<div class=comments><p>First comment of somebody here</p></div>", ""]
    for _ in range(100):
        blocks = [block() for _ in range(draw.randint(1, 12))]
        inner = "".join(f"<{t}>{html.escape(b)}</{t}>" + draw.choice(junk) for b, t in zip(blocks, draw.choices(["p", "h2", "li", "div"], k=12), strict=False))
        page = f"<html><body>{draw.choice(junk)}<header>Site</header><article>{inner}</article>{draw.choice(junk)}<footer>f</footer></body></html>"
        assert main_text(page) == "\n".join(blocks)
