from __future__ import annotations

import random

import pytest

from riskloom.llm import page_wrappers as wrappers
from riskloom.llm.page_wrappers import align, expression, main_text, parse, pattern, program


def shape(page):
    return pattern(expression(parse(page)))


def together(*pages):
    whole = wrappers.wrapper_of(pages[0])
    for page in pages[1:]:
        whole = wrappers.align_wrappers(whole, wrappers.wrapper_of(page))
    return whole


def test_runs_become_repeated_groups():
    assert shape("<ul><li>a<li>b<li>c</ul>") == "<ul> (<li> #text </li>)+ </ul>"
    assert shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "<dl> (<dt> #text </dt> <dd> #text </dd>)+ </dl>"
    assert shape("<dl><dt>a<dd>b<dt>c<dt>d<dd>e</dl>") == "<dl> ((<dt> #text </dt>)+ <dd> #text </dd>)+ </dl>"
    assert shape("<article><h2>a</h2><p>b</p><h2>c</h2><ul><li>d</ul><h2>e</h2><p>f</article>") == (
        "<article> (<h2> #text </h2> (<p> #text </p>)? (<ul> <li> #text </li> </ul>)?)+ </article>")


def test_mismatches_become_optional_or_repeated():
    a, b = "<h1>x</h1><p>y</p>", "<h1>x</h1><h2>z</h2><p>y</p><p>w</p>"
    for one, other in ((a, b), (b, a)):
        assert pattern(together(one, other)["level"]) == "<h1> #text </h1> (<h2> #text </h2>)? (<p> #text </p>)+"
    # Another order on both sides: neither comes first.
    assert pattern(together("<p>a</p><ul>b</ul>", "<ul>b</ul><p>a</p>")["level"]).startswith("((")
    assert pattern(together("<p>a</p>", "<ul>b</ul>")["level"]).count("?") == 2


def test_a_wrapper_is_no_larger_than_its_kinds_of_tokens():
    rng = random.Random(1)
    pages = ["<article>" + "".join(f"<{t}>x{rng.random()}</{t}>" for t in rng.choices(["p", "h2", "ul", "table", "pre"], k=rng.randrange(1, 40)))
             + "</article>" for _ in range(60)]
    whole = together(*pages)
    assert len(whole["level"]["items"]["article"][1]["items"]) == 5
    assert program(whole) == {"article": {t: {"#": 1} for t in whole["level"]["items"]["article"][1]["items"]}}


def test_aligning_with_itself_changes_nothing_but_counts():
    level = expression(parse("<nav><ul><li>a<li>b</ul></nav><main><h1>t</h1><p>x<p>y<ul><li>z</ul><p>w</main>"))
    assert pattern(align(level, level)) == pattern(level)


def test_same_text_on_different_pages_is_the_template():
    page = "<div><div><p>Read more from our partners in the region today</p></div><div><h2>{}</h2><pre>{}</pre></div></div>"
    pages = [page.format(t, t * 9) for t in ("One ", "Two ", "Six ")]
    main = program(together(*pages))
    assert main_text(pages[0], main) == "One\n\n" + " ".join(["One"] * 9)
    # Copies of one page say nothing about its template.
    assert "partners" in str(main_text(pages[0], program(together(pages[0], pages[0]))))


KEPT = "<h1>Title</h1><p>First &amp; <b>second</b>\n line.</p><ul><li>one</li><li>two &lt;b&gt;</li></ul><p>Last&nbsp;one."
TEXT = "Title\n\nFirst & second line.\n\none\n\ntwo <b>\n\nLast one."


@pytest.mark.parametrize("page", [
    f"<body><header>Site</header><nav>Home</nav><article>{KEPT}</article><aside>More</aside><footer>(c)</footer></body>",
    f"<body><div class='site-header'>Site</div><main>{KEPT}</main><div id=sidebar-1>x</div><div role=contentinfo>(c)</div></body>",
    f"<div class='page has-sidebar'><div class=topNav>n</div><div class='post-content'>{KEPT}</div><div class=ad-300x250>buy</div></div>",
    f"<article>{KEPT}<form>Name <input> <button>Go</button></form><div class='share'>Tweet</div></article><div class=comments><article>I like it</article></div>",
    f"<article>{KEPT}<section id=comment-77><p>first!</section></article>",
    f"<div class='cookie-notice'>We use cookies</div><script>var a='<article>no</article>';</script><style>p{{}}</style><article>{KEPT}</article>",
    f"<!DOCTYPE html><html><head><title>No</title><meta charset=utf-8><article>{KEPT}",
    f"<ARTICLE>{KEPT}</ARTICLE><noscript>enable</noscript><template><p>t</template><!-- <p>c</p> -->",
    f"<div><ul><li><a href=/a>Menu entry</a><li><a href=/b>Another</a></ul></div><div>{KEPT}</div>",
    f"<article>{KEPT}<p hidden>secret</p><p class=advert>Buy</p><select><option>1</select></article>",
])
def test_main_text_of_one_page(page):
    assert main_text(page) == TEXT


def test_blocks_and_white_space():
    assert main_text("<article><p><b>a<br>b<p>c <i>d</i>e</p>f<h2 class='entry-header'>g</h2></article>") == "a b\n\nc de\n\nf\n\ng"
    assert main_text("<article><table><tr><td>a<td>b<tr><td>c</table></article>") == "a\n\nb\n\nc"
    assert main_text("<article><p>a <span class=share>Tweet</span>b</p></article>") == "a b"
    assert main_text("<article><p>&amp;lt; &#233;&eacute; &am &unknown;</article>") == "&lt; éé &am &unknown;"


@pytest.mark.parametrize("page", [
    "", "   ", "<", "<<<>>", "</", "<a", "<p", "<!--", "<!-- x", "<!DOCTYPE", "<p class='a>", "</p></div>", "<p/><br/>", "&", "\0",
    "<script>", "<title>x", "<article>", "<div>" * 5000, "<div><span>" * 3000, "<table><tr><td>" * 500, '<a "' * 2000, "<a<a<a" * 3000, "<p '\"" * 2000,
])
def test_broken_pages_do_not_crash(page):
    assert isinstance(main_text(page), str)
    together(page, "<p>x</p>", page)


def test_deep_pages_keep_their_text():
    assert main_text("<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000 + "<p>after") == "deep\n\nafter"


def test_long_pages():
    page = "<article>" + "".join(f"<p>paragraph {i}</p>" for i in range(20_000)) + "</article>"
    assert main_text(page).count("\n\n") == 19_999


def rows(spark, data, parts=5):
    return spark.createDataFrame([(*r, "x", "y") for r in data], "page_id long, url string, html string, host string, TEXT string").repartition(parts)


def test_equals_reading_with_wrappers_of_whole_hosts(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN_IN", 2)
    monkeypatch.setattr(wrappers, "HOSTS", 3)
    rng = random.Random(3)
    data = []
    for n in range(120):
        words = " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(3, 60)))
        host = rng.choice(["Hot.example"] * 4 + [f"h{n % 9}.example"])
        # Two templates without names: only what pages of a host share tells them apart.
        page = (f"<div><p>Welcome to our site, dear readers of all ages</p></div><div><h1>{words[:9]}</h1><pre>{words}</pre></div>"
                if host.startswith("Hot") else f"<nav>{words}</nav><main><p>{words}</main>")
        data.append((n, f"http://{host}/{n}", page))
    got = {r["page_id"]: r for r in wrappers.extract(rows(spark, data)).collect()}
    assert len(got) == len(data)
    by_host = {}
    for _, url, page in data:
        by_host.setdefault(url.split("/")[2].lower(), []).append(page)
    mains = {h: program(together(*pages)) for h, pages in by_host.items()}
    for n, url, page in data:
        want = main_text(page, mains[url.split("/")[2].lower()])
        assert (got[n]["text"], got[n]["n_chars"], got[n]["url"]) == (want, len(want), url)
        assert "Welcome" not in want


def test_large_programs_are_joined_by_shuffle(spark, monkeypatch):
    data = [(n, f"http://h{n % 5}.example/", f"<article><p>text {n}</p></article>") for n in range(40)]
    plain = sorted(map(tuple, wrappers.extract(rows(spark, data)).collect()))
    monkeypatch.setattr(wrappers, "BROADCAST", -1)
    assert sorted(map(tuple, wrappers.extract(rows(spark, data)).collect())) == plain


def test_odd_rows(spark):
    page = "<article><p>text 😀 e\u0301</p></article>"
    data = [(1, None, page), (1, None, page), (2, "", page), (3, "no scheme", page), (4, "http://", page), (5, "http://a/", None),
            (6, "http://a/", ""), (None, "http://a/", page), (7, "http://b?x", page), (8, "x://a#f", "<article></article>")]
    got = sorted((tuple(r) for r in wrappers.extract(rows(spark, data)).collect()), key=repr)
    assert got == sorted(((i, u, "text 😀 e\u0301" if h == page else "", len("text 😀 e\u0301") if h == page else 0) for i, u, h in data), key=repr)
    assert wrappers.extract(rows(spark, [], 1)).count() == 0
