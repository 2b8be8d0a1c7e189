import random
import re
import time
import tracemalloc

import pytest

from ledgerloom.llm import html_extract as H
from ledgerloom.llm.html_extract import extract, main_text

TEXT = "This is a paragraph of some length, with commas, and stops. It goes on for a while; long enough to count."


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("plain words", "plain words"),
        (f"<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{TEXT}</p></article><footer>© us</footer></body></html>", f"Title\n{TEXT}"),
        (f"<article><p>a&amp;b &lt;c&gt; &#233;&eacute;</p><p>{TEXT}</p>", f"a&b <c> éé\n{TEXT}"),
        (f"<article><p><b>one\n\n  two<br>three<br><p>{TEXT}", f"one two three\n{TEXT}"),
        (f"<main><p>{TEXT}</p><aside>side</aside><div class='ad-slot'>buy</div><form><p>mail</p></form><section id=comments><p>I say so, too.</p></section></main>", TEXT),
        (f"<body><script>var a='<p>x</p>'</script><style>p{{}}</style><!-- <p>no</p> --><article><p>{TEXT}</p></article>", TEXT),
        (f"<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><p>{TEXT}</article>", f"one\ntwo\na\nb\n{TEXT}"),
        (f"<article><p>{TEXT}</p><p>cut off in a <a hre", f"{TEXT}\ncut off in a"),
        (f"<article><p>1 < 2 and 3 > 2</p><p>{TEXT}</p></article>", f"1 < 2 and 3 > 2\n{TEXT}"),
        (f"<article class='post has-comments'><div class='article-header'><h1>T</h1></div><figure><figcaption>Cap</figcaption></figure><p>{TEXT}</p></article>", f"T\nCap\n{TEXT}"),
        (f"<main><p>{TEXT}</p><p style='display: none'>unseen</p><article class=comment><p>I, too.</p></article></main>", TEXT),
        (f"<article><header><h1>T</h1></header><p>{TEXT} <a href='/x'>link</a> end.</p></article>", f"T\n{TEXT} link end."),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_without_an_article_the_paths_decide():
    menu = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(9))
    page = (
        f"<html><body><div class=top><ul>{menu}</ul></div><div class=wrap><div class=content><h2>Head</h2><p>{TEXT}</p><p>Short one.</p><p>{TEXT}</p></div>"
        f"<div class=sidebar><p>{TEXT}</p></div></div><div class='cookie-notice'><p>We use cookies, you know.</p></div><div class=legal>All rights reserved</div></body></html>"
    )
    assert main_text(page) == f"Head\n{TEXT}\nShort one.\n{TEXT}"


def test_odd_markup_ends():
    for page in ("<", "<<<<", "<p", "<!--", "<script>", "<a b='", "</p></p>", "<p>" * 3000 + "x", "<div>" * 3000 + TEXT, "&", "&#xZZ;", "<article>" * 50):
        assert isinstance(main_text(page), str)
    assert main_text(f"<article><p>{'word ' * 200000}</p></article>") == ("word " * 200000).strip()


def test_rows(spark):
    rows = [(1, "u", f"<p>{TEXT}</p>", "x"), (1, "u", f"<p>{TEXT}</p>", "x"), (2, None, None, None), (None, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(df).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (1, TEXT), (1, TEXT), (2, "")]
    assert extract(df.where("false")).collect() == []


def test_all_articles_and_prose_around_them():
    lead = f"{TEXT} {TEXT} {TEXT} {TEXT} {TEXT}"
    page = (
        f"<body><nav><a href=/>Home</a></nav><div><p>{lead}</p></div><article><h1>One</h1><p>{TEXT}</p></article>"
        f"<article><h2>Two</h2><p>{TEXT} {TEXT}</p><p>Short.</p></article><div class=c9><p>We sell: buy, now.</p></div><footer><p>{TEXT}</p></footer></body>"
    )
    assert main_text(page) == f"{lead}\nOne\n{TEXT}\nTwo\n{TEXT} {TEXT}\nShort."


def test_without_articles_and_helpful_classes():
    menu = "".join(f"<div class=c3><a href=/{i}>Item number {i}, and more</a></div>" for i in range(30))
    page = (
        f"<body><div class=c1>{menu}</div><div class=c4><h2>Head</h2><p>{TEXT}</p><ul><li>one<li>two</ul><p>{TEXT} {TEXT}</p></div>"
        f"<div class=c5><div class=c6>Sign up</div><div class=c7>Follow us</div></div><div class=c8>© 2024</div></body>"
    )
    assert main_text(page) == f"Head\n{TEXT}\none\ntwo\n{TEXT} {TEXT}"


def test_class_words_do_not_decide_alone():
    prose = " ".join([TEXT] * 5)
    assert main_text(f"<body><div class='search result'><p>{prose}</p><p>{prose}</p></div><footer>© us</footer></body>") == f"{prose}\n{prose}"
    assert main_text("<body><nav><a href=/>Home</a></nav><div class=ad>Buy this, now.</div><article></article><footer>© us, 2024.</footer></body>") == ""


def test_ratios_and_not_words_of_the_markup_decide(spark, monkeypatch):
    """An advert with the page's best ratios stays, one without them goes; with the same ratio for every path most pages change."""
    prose = " ".join([TEXT] * 6)
    assert main_text(f"<main><p>Short.</p><div class=banner><p>{prose}</p><p>{prose}</p></div></main>").count(TEXT) == 12
    assert main_text(f"<main><p>{prose}</p><p>{prose}</p><div class=banner>Buy now</div></main>").count("Buy") == 0
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    before = [main_text(p) for p in pages]
    monkeypatch.setattr(H, "fused", lambda length, marks, number, whole: 30.0 if number else 0.0)
    assert sum(main_text(p) != b for p, b in zip(pages, before)) >= len(pages) / 3


def test_pages_of_the_tables(spark):
    """On the tables a page's text is that of its article element."""
    for page in (r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()):
        found = H.read(page)
        assert main_text(page) == "\n".join(text for path, text, _ in found.blocks if found.inside[path] and found.place[path] == 1.0)


def test_hidden_and_inline_elements_do_not_cut_a_block():
    assert main_text(f"<article><p>one <span hidden>two <span>three</span> four</span>five<!-- six --><b>sev</b>en {TEXT}</p></article>") == f"one fiveseven {TEXT}"


def scores_by_definition(page):
    """The path scores stated on path strings, each from all blocks anew."""
    found = H.read(page)

    def name(p):
        return name(found.parent[p]) + ((found.tag[p], p),) if p else ((found.tag[0], 0),)

    blocks = [(name(p), text, linked) for p, text, linked in found.blocks]
    place, inside = {name(p): x for p, x in enumerate(found.place)}, {name(p): x for p, x in enumerate(found.inside)}

    whole = sum(len(t) - 0.9 * k for _, t, k in blocks)

    def ratio(member):
        held = [(t, k) for p, t, k in blocks if member(p)]
        if not held:
            return 0.0
        text = sum(len(t) - 0.9 * k for t, k in held) / len(held)
        marks = sum(len(re.findall(r"[.,;:!?。、،؛؟]", t)) for t, _ in held) / len(held)
        share = sum(len(t) - 0.9 * k for t, k in held) / whole if whole else 0.0
        return (text * (0.5 + marks)) ** 0.5 * share**0.5

    paths = list(dict.fromkeys(p for p, _, _ in blocks))
    own = [ratio(lambda x, p=p: x == p) for p in paths]

    def step(p):
        return 0.85 if p[-1][0] in H.COMPANION else 0.4

    def support(p):
        here = ratio(lambda x: x == p or x[:-1] == p and place[x] == place[p])
        return max(here, step(p) * support(p[:-1])) if len(p) > 1 and place[p[:-1]] == place[p] else here

    out = {}
    for i, p in enumerate(paths):
        near = [own[j] * place[paths[j]] for j in (i - 1, i + 1) if 0 <= j < len(paths)]
        smooth = (6 * own[i] + sum(near)) / (6 + len(near))
        held = [(len(t), k) for x, t, k in blocks if x == p]
        unlinked = sum(n - 0.9 * k for n, k in held) / sum(n for n, _ in held)
        around = step(p) * support(p[:-1]) * unlinked if len(p) > 1 and place[p[:-1]] == place[p] else 0.0
        outside = any(inside[x] for x in paths) and not inside[p]
        out[p[-1][1]] = max(smooth, around) * place[p] * (0.4 if outside else 1.0)
    return out


def test_scores_are_those_of_the_definition():
    rng = random.Random(4)
    tags = ["div", "p", "ul", "li", "h2", "article", "section", "nav", "table", "td", "footer", "div class=ad", "div class=x", "span", "a href=/"]
    for _ in range(60):
        page, stack = [], []
        for _ in range(rng.randrange(5, 60)):
            if stack and rng.random() < 0.35:
                page.append(f"</{stack.pop().split()[0]}>")
            else:
                stack.append(rng.choice(tags))
                page.append(f"<{stack[-1]}>")
            if rng.random() < 0.6:
                page.append(" ".join(rng.choice(["word", "another,", "end.", "x"]) for _ in range(rng.randrange(1, 30))))
        html = "".join(page)
        got, want = H.path_scores(H.read(html)), scores_by_definition(html)
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<div>" * 100_000 + TEXT, "<div>" * 50_000 + TEXT + "</div>" * 50_000, "<b" * 500_000, "< " * 500_000, "<a b=\"x>\" '" * 80_000, "<span hidden>" * 70_000 + "x", "<!-- " * 200_000],
    ids=["open tags", "nested", "closed", "names", "signs", "quotes", "hidden", "comments"],
)
def test_hostile_pages_take_time_and_memory_in_proportion(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 5
    tracemalloc.start()
    main_text(page[: len(page) // 4])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20
