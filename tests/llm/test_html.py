import time

import numpy as np
import pytest

from quaestor.llm import html


def test_suffix_order_is_lexicographic():
    rng = np.random.default_rng(0)
    tokens = rng.integers(0, 3, 300)
    for length in (1, 2, 3, 5, 6, 9):
        order, rank = html.suffix_order(tokens, length)
        prefix = [tuple(tokens[i : i + length]) for i in range(300)]
        assert [prefix[i] for i in order] == sorted(prefix)
        assert all((prefix[a] == prefix[b]) == (rank[a] == rank[b]) for a in range(0, 300, 7) for b in range(300))


def test_zones_blocks_and_references():
    page = (
        "<!DOCTYPE html><head><title>T</title><style>p{}</style><script>var t='</p><article>';</script></head><body>"
        "<nav><ul><li><a href='/x'>Menu</a></ul></nav><div class=\"ad\"><div>x</div>y</div><!-- <p>no</p> -->"
        "<article><header><h1>Head &amp; line</h1></header><p><b>One\n two<br><p>3 < 4 &eacute;&#233;&nbsp;x"
        "<ul><li>a<li>b</ul><form>f</form><aside>s</aside><div id='comments'><p>reader</p></div><p title='a > b'>last</article>"
        "<footer>&copy; host</footer>"
    )
    assert html.extract_group([page]) == ["Head & line\nOne two\n3 < 4 éé x\na\nb\nlast"]


def test_repeated_text_goes_and_unique_runs_stay():
    menu = "home news about us contact jobs"
    pages = [f"<div>{menu}</div><div>{menu} u{i} words {i * 7}</div><div>short</div>" for i in range(3)]
    assert html.extract_group(pages) == [f"u{i} words {i * 7}\nshort" for i in range(3)]
    # the same page twice is one page
    assert html.extract_group([f"<p>{menu} x</p>"] * 2) == [f"{menu} x"] * 2


def test_bodies_stay_whole_even_if_equal():
    page = "<nav>m</nav><article><p>one two three four five six seven</p></article>"
    assert html.extract_group([page, page]) == ["one two three four five six seven"] * 2


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "http://h/a", ""), (3, "http://h/b", "<p>unclosed"), (3, "http://h/b", "<p>unclosed"),
            (None, "nonsense", "plain <text"), (4, "http://H/c", "<article>" + "<p>long text</p>" * 20_000), (5, "http://h/d", "\x00<<<>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS _host")
    out = html.extract(table).collect()
    assert len(out) == len(rows)
    found = {(r.page_id, r.url): r for r in out}
    assert found[1, None].text == "" and found[2, "http://h/a"].n_chars == 0
    assert found[3, "http://h/b"].text == "unclosed" and found[None, "nonsense"].text == "plain <text"
    assert found[4, "http://H/c"].text.count("\n") == 19_999
    assert html.extract(table.limit(0)).collect() == []


def test_repeats_do_not_depend_on_partitions(spark):
    """A menu on 12 of 40 contents, a footer on all."""
    menu = " ".join(f"entry{i}" for i in range(24))
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    pages = [f"<div>{menu if i % 10 < 3 else ''}</div><p>{body(i)}</p><div>all rights of this host reserved</div>" for i in range(40)]
    pages.append("<article>the body</article><div>all rights of this host reserved</div>")
    rows = [(i, f"http://h/{i}", p) for i, p in enumerate(pages)] + [(99, "http://other/", pages[0])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(16)
    want = [body(i) for i in range(40)] + ["the body"]
    assert html.extract_group(pages) == want
    got = {r.page_id: r.text for r in html.extract(table).collect()}
    assert got == dict(enumerate(want)) | {99: html.extract_group(pages[:1])[0]}


def test_main_text_that_repeats_stays(spark):
    """A phrase on two pages, copies under other ids, and near copies that differ in a date."""
    phrase = "at the end of the day it"
    prose = [" ".join(f"p{i}q{k}" for k in range(30)) for i in range(6)]
    same = " ".join(f"s{k}" for k in range(80))
    pages = [f"<p>{prose[i]} {phrase if i < 2 else ''} tail{i}</p>" for i in range(6)]
    pages += [f"<p>{same}</p>"] * 4 + [f"<p>day{i} {same}</p>" for i in range(14)]
    table = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    want = [" ".join(html.blocks(p)[0][1].split()) for p in pages]
    assert html.extract_group(pages) == want
    got = {r.page_id: r.text for r in html.extract(table).collect()}
    assert [got[i] for i in range(len(pages))] == want


def brute_force(pages):
    """Every substring of RUN and of LONG tokens of every stream, looked up in all others."""
    parsed = [html.zones(p) for p in pages]
    contents = {}
    for _, rest, named in parsed:
        if rest or named:
            key = (bool(rest), "\n".join(rest or named))
            contents[key] = min(contents.get(key, ("\n".join(named), rest)), ("\n".join(named), rest))
    streams = [(" ".join(rest).split(), named.split()) for named, rest in contents.values()]

    def on(run):
        return sum(any(part[i : i + len(run)] == run for part in parts for i in range(len(part))) for parts in streams)

    texts = []
    for body, rest, _ in parsed:
        if body is None:
            tokens = " ".join(rest).split()
            hit = [False] * len(tokens)
            for size, least in ((html.RUN, max(html.LEAST, -(-len(streams) // 2))), (html.LONG, html.LONG_PAGES)):
                for i in range(len(tokens) - size + 1):
                    if on(tokens[i : i + size]) >= least:
                        hit[i : i + size] = [True] * size
            if sum(hit) > html.MOST * len(hit):
                hit = [False] * len(hit)
            left, kept = iter(hit), []
            for block in rest:
                words = [w for w in block.split() if not next(left)]
                kept += [" ".join(words)] if words else []
            body = "\n".join(kept)
        texts.append(body)
    return texts


def test_unmarked_hosts_equal_brute_force(spark):
    """Few words, so that runs overlap, end in each other and cross blocks; a menu that is named on
    some pages; a third host with one page."""
    rng = np.random.default_rng(3)
    long = " ".join(f"l{k}" for k in range(30))
    groups = {"a": [], "b": [], "c": ["<p>x y z</p>"]}
    for i in range(30):
        words = " ".join(f"w{k}" for k in rng.integers(0, 3 if i % 2 else 40, 40))
        menu = "<nav>{}</nav>" if i % 3 else "<div>{}</div>"
        page = menu.format("m1 m2 m3 m4 m5 m6 m7") + f"<p>{words[:60]}</p>" + (f"<p>{long}</p>" if i % 2 else "") + f"<p>{words}</p>"
        groups["a" if i < 24 else "b"].append(page)
    groups["a"] += [groups["a"][0], f"<article>{long}</article><div>m1 m2 m3 m4 m5 m6 m7</div>", "", f"<p>{long}</p>"]
    rows = [(k * 100 + i, f"http://{h}/", p) for k, (h, pages) in enumerate(groups.items()) for i, p in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r.page_id: r.text for r in html.extract(table).collect()}
    cut = 0
    for k, pages in enumerate(groups.values()):
        want = brute_force(pages)
        assert html.extract_group(pages) == want
        assert [got[k * 100 + i] for i in range(len(pages))] == want
        cut += sum(sum(len(b.split()) for b in html.zones(p)[1]) > len(t.split()) for p, t in zip(pages, want))
    assert cut > 20


def test_suffixes_are_ordered_from_one_token_by_pairs_of_ranks(spark, monkeypatch):
    """Every round sorts what the round before has ranked, at most twice as many tokens; ranks are the
    order of the runs that are on enough contents."""
    rng = np.random.default_rng(8)
    long = " ".join(f"l{k}" for k in range(26))
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3, 30)) + (f" {long}" if i % 2 else "") for i in range(24)]
    rounds, positions = [], html.dense_positions

    def sort(df, order, out):
        ranked = positions(df, order, out).localCheckpoint()
        rounds.append((order, ranked.orderBy("rank").collect()))
        return ranked

    monkeypatch.setattr(html, "dense_positions", sort)
    table = spark.createDataFrame([(i, "http://h/", f"<p>{t}</p>") for i, t in enumerate(texts)], "page_id long, url string, html string")
    html.extract(table.repartition(5)).collect()
    assert [order for order, _ in rounds] == [["host", "key"]] + [["host", "r0", "r1"]] * 4
    names = {}
    for size, step, (_, ranked) in zip((1, 2, 4, 6, 12), (1, 1, 2, 2, 6), rounds):
        runs = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in map(str.split, texts)]
        least = html.LEAST if size <= html.RUN else html.LONG_PAGES
        want = [r for r in sorted(set().union(*runs)) if sum(r in x for x in runs) >= least]
        got = [(r.key.decode(),) if size == 1 else names[r.r0][:step] + names[r.r1] for r in ranked]
        assert got == want and [r.rank for r in ranked] == list(range(len(want)))
        assert [r.pages for r in ranked] == [sum(w in x for x in runs) for w in want]
        names = dict(enumerate(got))


def test_given_pages_without_their_markup_equal_brute_force(spark):
    """The given pages as if nothing named their parts."""
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plain = given.selectExpr("page_id", "'http://one.host/' AS url", "regexp_replace(html, '(?i)</?(article|nav|footer)>|class=\"ad\"', '') AS html")
    rows = plain.orderBy("page_id").collect()
    got = {r.page_id: r.text for r in html.extract(plain).collect()}
    assert [got[r.page_id] for r in rows] == brute_force([r.html for r in rows])


@pytest.mark.parametrize("piece", ["<script ", "<a ", "<svg>", "<div></section>", "<li></li>", '<a "> ', "<a x'>", "<!--", "<!", "</", "&#"])
def test_hostile_pages_take_linear_time(piece):
    started = time.time()
    html.blocks("<div>" * 20_000 + piece * ((1 << 20) // len(piece)))
    assert time.time() - started < 10


def test_wrappers_headlines_and_comments():
    art = "<article><p>the text</p></article>"
    for page, want in [
        (f'<div class="layout has-sidebar">{art}</div>', "the text"),
        ('<div class="content no-sidebar"><p>the text</p></div>', "the text"),
        (f'<div class="menu-page">{art}<p>more</p></div>', "the text"),
        (f'{art}<article class="comment"><p>me too</p></article>', "the text"),
        (f'{art}<div class="related">{art}</div>', "the text"),
        (f"<h1>Head</h1>{art}<p>beside</p>", "Head\nthe text"),
        (f"<nav><h1>Site</h1></nav>{art}", "the text"),
        ('<article><p>a</p><section id="related-work"><h2>Related</h2>b</section><p class="share">c</p><div class="share">d</div></article>', "a\nRelated\nb\nc"),
        ('<article><p title="a hidden gem">a</p><p hidden>b</p><p style="display: none">c</p><section id="comments">d</section></article>', "a"),
        ('<p title="a>b">c</p><p title="d>e</p>', "c\ne"),
        ("<p>1 < 2 <b>and</b> 3 <svg/>x<svg><text>y</text></svg>z<SCRIPT>v</Script >w", "1 < 2 and 3 xzw"),
    ]:
        assert html.extract_group([page]) == [want], page


@pytest.mark.parametrize("most", [html.BROADCAST_BYTES, 0])
def test_bodies_enter_the_order_of_their_host(spark, monkeypatch, most):
    """Passages that articles share are cut like others, in every place; what is on too few contents,
    copies, and text beside an article are as before. On other hosts menus
    make the number."""
    passage = " ".join(f"p{k}" for k in range(26))
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    line, rare = "all rights of this host reserved", "said by two of them only"
    pages = []
    for i in range(24):
        inner = f"<p>{own(i)}</p><p>{line}</p>" + (f"<p>so{i} {passage} end{i}</p>" if i < 11 else "") + (f"<p>{rare}</p>" if i < 2 else "")
        pages.append(f"<nav>menu</nav><article>{inner}</article><p>beside {i}</p>")
    pages += [f"<article>{passage}</article>", f"<p>{passage}</p><p>unmarked</p>", pages[0]]
    want = [own(i) + (f"\nso{i} end{i}" if i < 11 else "") + (f"\n{rare}" if i < 2 else "") for i in range(24)]
    want += [passage, f"{passage}\nunmarked", want[0]]  # all, or nearly all of it, would go
    prose = [own(i) + (f" {passage}" if i < 9 else "") for i in range(21)]
    other = [f"<article><p>{p}</p></article>" + (f"<nav>{passage}</nav>" if i == 20 else "") for i, p in enumerate(prose)]
    named = [f"<article><p>{own(i)} {passage if i < 4 else ''}</p></article><nav>{passage if i > 8 else ''}</nav>" for i in range(15)]
    monkeypatch.setattr(html, "BROADCAST_BYTES", most)
    assert html.extract_group(pages) == want
    assert html.extract_group(other) == [own(i) for i in range(21)]  # the tenth is in a menu
    assert html.extract_group(other[:20]) == prose[:20]
    rows = [(i, "http://h/", p) for i, p in enumerate(pages)] + [(100 + i, "http://o/", p) for i, p in enumerate(other)]
    rows += [(200 + i, "http://n/", p) for i, p in enumerate(named)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in html.extract(table).collect()}
    assert got == dict(enumerate(want)) | {100 + i: p for i, p in enumerate(html.extract_group(other))} | {200 + i: own(i) for i in range(15)}
