import numpy as np
import pytest

from tidemill.llm import boosting, html_extract
from tidemill.llm.html_tree import parse


def test_parser_closes_what_pages_leave_open():
    t = parse("<div><p>a<b>b<p>c<ul><li>d<li>e</ul></div><script>if (a < b) '<p>'</script><br>f<!-- <p> --><img src='>'>g</x>")
    shape = [(t.tag[i], t.tag[t.parent[i]]) for i in range(1, len(t.tag))]
    assert shape == [("div", ""), ("p", "div"), ("b", "p"), ("p", "div"), ("ul", "div"), ("li", "ul"), ("li", "ul"), ("script", ""), ("br", ""), ("body", ""), ("img", "body")]
    assert [x for i, x in t.pieces if i >= 0] == ["a", "b", "c", "d", "e", "if (a < b) '<p>'", "f", "g"]


@pytest.mark.parametrize("page", ["", "<", "<p", "</", "<a href='x", "a < b & c", "<script>x", "<<<>>>", "<!--", "<p" * 2000, '<a b="' * 500, "<div>" * 3000, "\x00<p>\x00", "<!doctype", "<tr><td><table><tr><td>x"])
def test_parser_takes_anything(page):
    t = parse(page)
    assert len(t.tag) == len(t.last) and all(i <= x for i, x in enumerate(t.last))
    assert isinstance(html_extract.extract_texts([page], html_extract.default_model())[0], str)


def test_trees_learn_a_rule_of_two_features():
    r = np.random.default_rng(0)
    x = r.uniform(0, 1, (3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    m = boosting.fit(x[:2000], y[:2000])
    assert ((m.log_odds(x[2000:]) > 0) == y[2000:]).mean() > 0.97


def test_decoding_finds_the_best_consistent_labels():
    import itertools

    t = parse("<div><p>aaaa</p><div><p>bb</p><p>cc</p></div></div>")
    r = np.random.default_rng(5)
    for _ in range(50):
        odds = r.normal(0, 2, len(t.tag)).tolist()
        got = html_extract.decode(t, odds)

        def value(labels):
            """labels: 0 outside, 1 main text, 2 left out."""
            total = 0.0
            for i in range(1, len(t.tag)):
                a, b = labels[t.parent[i]], labels[i]
                if (a, b) not in ((0, 0), (0, 1), (1, 1), (1, 2), (2, 2)):
                    return -1e9
                length = sum(len(x) for j, x in t.pieces if j == i)
                total += (b == 1) * odds[i] * (html_extract.LEAST + length / 100) - ((a, b) == (0, 1)) * html_extract.ENTER - ((a, b) == (1, 2)) * html_extract.LEAVE  # noqa: B023
            return total

        every = [(0, *x) for x in itertools.product(range(3), repeat=len(t.tag) - 1)]
        best = max(map(value, every))
        assert any(abs(value(x) - best) < 1e-9 for x in every if [v == 1 for v in x] == got)
        for i in range(1, len(t.tag)):  # main text has an unbroken line up to where it begins
            if got[i] and any(got[: t.parent[i]]):
                up = t.parent[i]
                assert got[up] or not any(got[j] for j in range(up) if j < up <= t.last[j])


def test_made_pages_are_read(spark):
    import random

    r = random.Random(4242)
    pages, wanted = [], []
    for _ in range(120):
        made, _title = html_extract._page(r)
        t, inside, parts = parse(made), False, []
        for i, x in t.pieces:
            if i < 0:
                parts.append(" ")
                continue
            for part in x.replace("\x01", "\x00\x01").replace("\x02", "\x02\x00").split("\x00"):
                inside = inside or part.startswith("\x01")
                parts.append(part.strip("\x01\x02") if inside else "")
                inside = inside and not part.endswith("\x02")
        wanted.append(" ".join("".join(parts).split()))
        pages.append(made.replace("\x01", "").replace("\x02", ""))
    df = spark.createDataFrame([(i, f"u{i}", p, 1) for i, p in enumerate(pages)], "page_id long, url string, html string, text int")
    got = {x.page_id: x for x in html_extract.extract_main_text(df).collect()}
    assert sum(got[i].text == w for i, w in enumerate(wanted)) >= 0.95 * len(wanted)
    assert all(x.n_chars == len(x.text) for x in got.values())


def test_odd_rows(spark):
    page = "<html><body><nav><a href=/>menu</a></nav><article><h1>T &amp; t</h1><p>One &lt;b&gt;\n  two&nbsp;three.<br>Four <b>fi</b>ve, six and more words here.</p></article><footer>&copy; x</footer></body></html>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, None, None), (3, "u", ""), (4, "u", "   "), (5, "u", page.replace("six", "six " * 50_000))]
    got = html_extract.extract_main_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, n_chars string")).collect()
    text = "T & t One <b> two three. Four five, six and more words here."
    assert sorted((str(r.page_id), r.text) for r in got if r.page_id != 5) == sorted([("1", text), ("1", text), ("None", text), ("2", ""), ("3", ""), ("4", "")])
    assert next(r.n_chars for r in got if r.page_id == 5) > 200_000
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_attributes_are_read_to_their_end():
    article = "<article><h1>Some title</h1>" + "<p>One sentence of the article, and then another one, of words.</p>" * 4 + "</article>"
    prose = "<p>This is some other prose, that looks like it, but is not.</p>" * 3
    far = "data-x='" + '{"a": 1, ' * 120 + "}'"
    for mark in ('class="sidebar ad"', 'style="color: red; display: none"', "hidden"):
        near_page, far_page = (f"<body>{article}<div {x}{mark}>{prose}</div></body>" for x in ("", far + " "))
        near, away = (html_extract.features([parse(p)]) for p in (near_page, far_page))
        assert (near == away).all()
        got = html_extract.extract_texts([near_page, far_page], html_extract.default_model())
        assert got[0] == got[1] and got[0].startswith("Some title One sentence")


def test_pages_of_other_shapes_are_read():
    """Pages written apart from the generator that trees are fitted on."""
    from tests.llm import other_pages

    pages = other_pages.made(30, seed=12)
    got = html_extract.extract_texts([p for _, p, _ in pages], html_extract.default_model())
    exact = {}
    for (shape, _, want), text in zip(pages, got, strict=True):
        exact.setdefault(shape, []).append(text == want)
    assert all(sum(x) >= 0.9 * len(x) for x in exact.values()), {k: sum(x) for k, x in exact.items()}


def test_what_is_not_shown_or_sold_goes_and_references_stay_in_their_text():
    p = "<p>One sentence of the article, and then another one, of words.</p>"
    body = "<body><article><h1>Some title</h1>" + p * 3 + "{}" + p + "</article></body>"
    text = "One sentence of the article, and then another one, of words."
    rest = " ".join([text] * 3), text
    got = lambda inner: html_extract.extract_texts([body.format(inner)], html_extract.default_model())[0]
    for inner in ('<p hidden>no, not this one, at all</p>', '<div style="display :none">no, not this</div>', '<p>Fine words here, and more.<span class="ad">buy now</span></p>'):
        want = "Fine words here, and more." if "Fine" in inner else ""
        assert got(inner) == " ".join(x for x in ("Some title", rest[0], want, rest[1]) if x)
    assert "Fi&amp;rst, and R&D." in got("<p>Fi&am<b>p</b>;rst, and R&amp;D.</p>")  # a reference is of one text


def test_text_that_nothing_holds():
    assert html_extract.extract_texts(["Para one, of some words.<br><br>Para two, and some more.", "Plain text &amp; no more."], html_extract.default_model()) == ["Para one, of some words. Para two, and some more.", "Plain text & no more."]
