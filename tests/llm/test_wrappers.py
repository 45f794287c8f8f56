import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernlode.llm import wrappers
from fernlode.llm.wrappers import OPTIONAL, REPEATED, align, extract, extract_pages, infer_wrappers, page_wrapper, parse

PAGE = """<html><head><title>x</title><script>var a="<p>no</p>";</script></head><body class="with-sidebar"><header class="site">Site</header><nav><ul><li><a>a</a><li>b</ul></nav>
<div class="cookie-notice">We use</div><article class="post"><h1>Title &amp; {n}</h1><p><b>One<br>two<p>Three &lt;x&gt;&nbsp; 3 < 4 <i>it</i>al<aside>rel</aside><div class="ad">buy</div>
<form>name</form><ul><li>i1<li>i2</ul><!-- no --><section id="comments"><p>bad comment</p></section></article><div class=sidebar>side</div><footer>f</footer>"""


def test_extract():
    assert extract(PAGE, None) == "Title & {n}\nOne two\nThree <x> 3 < 4 ital\ni1\ni2"
    assert extract(None, None) == "" and extract("plain", None) == "plain" and extract("<p>a<p>b<script>x", None) == "a\nb"


def wrapped(*pages):
    out = page_wrapper(parse(pages[0]))
    for page in pages[1:]:
        out = align(out, page_wrapper(parse(page)))
    return out


def test_mismatches_become_slots_optionals_and_repeats():
    a, b = "<h1>Site</h1><ul><li>1<li>2<li>3</ul><p>x</p>", "<h1>Site</h1><ul><li>4<li>2</ul><div>new</div><p>y</p>"
    text = lambda t: [["#", 0, t]]
    expect = [["h1", 0, text("Site")], ["ul", 0, [["li", 0, text(None)], ["li", REPEATED, text(None)]]], ["div", OPTIONAL, text("new")], ["p", 0, text(None)]]
    assert wrapped(a, b) == expect and wrapped(b, a) == expect and wrapped(a, a) == page_wrapper(parse(a))
    group = wrapped("<dl><dt>a<dd>b</dl>", "<dl><dt>a<dd>c<dt>d<dd>e<dt>f<dd>g</dl>")
    assert group == [["dl", 0, [["()", REPEATED, [["dt", 0, text(None)], ["dd", 0, text(None)]]]]]]
    assert align(group, page_wrapper(parse("<dl><dt>h<dd>i<dd>j<dt>k<dd>l</dl>"))) == [["dl", 0, [["()", REPEATED, [["dt", 0, text(None)], ["dd", REPEATED, text(None)]]]]]]


def language(wrapper, word):
    """Whether the keys of a list of nodes are a word of a wrapper's regular expression, by Python's own matcher."""
    names = {}
    sign = lambda key: names.setdefault(key, chr(0x4E00 + len(names)))

    def of(nodes):
        return "".join(f"(?:{of(x) if key == '()' else sign(key)}){'+' if flags & REPEATED else ''}{'?' if flags & OPTIONAL and not flags & REPEATED else ''}" if not (flags & OPTIONAL and flags & REPEATED) else f"(?:{of(x) if key == '()' else sign(key)})*" for key, flags, x in nodes)

    pattern = of(wrapper)
    return re.fullmatch(pattern, "".join(sign(k) for k in word)) is not None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=7), min_size=1, max_size=5))
def test_a_wrapper_covers_every_page_it_was_made_of(pages):
    wrapper = [[k, 0, []] for k in pages[0]]
    for page in pages[1:]:
        wrapper = align(wrapper, [[k, 0, []] for k in page])
    assert all(language(wrapper, page) for page in pages)


def test_odd_pages():
    assert extract("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>end", None) == "deep\nend"
    assert extract("<div>" * 300 + "a<nav>menu</nav>b" + "</div>" * 300, None) == "a\nb"
    assert extract("<p>" + "long words " * 100_000, None) == ("long words " * 100_000).strip()
    assert extract("<header><h1>Site</h1></header><p>hello</p>", None) == "hello"
    assert extract("<article><h1 class='entry-header'>x</h1><p class='search-results'>y</p><math>1</math><button>go</button></article>", None) == "x\ny\n1"
    assert extract("<article><header><h1>Title</h1></header><p>t</p></article>", None) == "Title\nt"


def test_the_wrapper_decides(spark):
    page = "<body><div>Brand</div><div><p>text {k}</p></div><div>Bottom</div></body>"
    wrapper = wrapped(*(page.replace("{k}", str(k)) for k in range(3)))
    assert extract(page, wrapper) == "text {k}" and extract(page, None) != extract(page, wrapper)
    rows = [(k, "http://two/", page.replace("{k}", str(k))) for k in range(2)] + [(9, "http://one/", page)] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in extract_pages(frame).collect()) == [(0, "text 0"), (1, "text 1"), *[(9, "Brand\ntext {k}\nBottom")] * 2]


def test_wrappers_do_not_depend_on_the_partitions(spark, monkeypatch):
    rng = random.Random(2)
    block = lambda: rng.choice(["<p>{}</p>", "<ul><li>{}<li>b</ul>", "<h2>{}</h2><p>x</p>", "<div class=ad>{}</div>", "<dl><dt>{}<dd>y</dl>"]).format(rng.randrange(3))
    rows = [(k, f"http://{'abc'[k % 3]}/", "<body><div>top</div>" + "".join(block() for _ in range(rng.randrange(6))) + "</body>") for k in range(150)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(wrappers, "FAN_IN", 4)
    monkeypatch.setattr(wrappers, "HELD_BYTES", 300)
    found = [sorted(map(tuple, infer_wrappers(frame.repartition(n).orderBy(F.hash("page_id", F.lit(n))) if n else frame.coalesce(1)).collect())) for n in (0, 3, 7)]
    assert found[0] == found[1] == found[2] and [r[2] for r in found[0]] == [50, 50, 50]


def test_pages(spark):
    rows = [(k, f"http://h/{k}", PAGE.replace("{n}", str(k))) for k in range(5)] + [(10, None, None), (11, "http://e/", "<p>only"), (12, "no host", "")]
    rows += [(20 + k, f"http://plain/{k}", f"<body><div>Brand</div><p>text {k}</p><div>Bottom</div></body>") for k in range(4)]
    frame = spark.createDataFrame([(*r, "h", "d") for r in rows], "page_id long, url string, html string, host string, description string").repartition(3)
    got = {r.page_id: r for r in extract_pages(frame).collect()}
    assert got[3].text.startswith("Title & 3\nOne two") and got[10].text == "" and got[11].text == "only" and got[12].n_chars == 0
    assert [got[20 + k].text for k in range(4)] == [f"text {k}" for k in range(4)]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert extract_pages(frame.limit(0)).count() == 0


def test_boilerplate_is_a_whole_text_of_distinct_pages(spark):
    opening = "the same opening words of every block " * 8
    rows = [(k, f"http://long/{k}", f"<body><div>Brand</div><p>{opening}{k}</p><div>Bottom</div></body>") for k in range(4)]
    rows += [(10 + k, f"http://copies/{k}", "<body><h1>Title</h1><p>lone paragraph</p></body>") for k in range(5)]
    rows += [(20 + k, f"http://ads/{k}", f"<body><p>lone paragraph</p><div class='ad'>buy {k}</div></body>") for k in range(5)]
    rows += [(30 + k, f"http://mixed/{k}", f"<body><div>Brand</div><p>text {k % 3}</p></body>") for k in range(6)]
    frame = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    for parts in (1, 4):
        got = {r.page_id: r.text for r in extract_pages(frame.repartition(parts)).collect()}
        assert [got[k] for k in range(4)] == [f"{opening}{k}" for k in range(4)]
        assert {got[10 + k] for k in range(5)} == {"Title\nlone paragraph"} and {got[20 + k] for k in range(5)} == {"lone paragraph"}
        assert [got[30 + k] for k in range(6)] == [f"text {k % 3}" for k in range(6)]


def test_all_elements_of_the_kind_are_kept():
    assert extract("<div class=content><p>one</div><div class=ad>buy</div><div class=content><p>two, longer</div>", None) == "one\ntwo, longer"
    assert extract("<main><article>a</article><article>b b<aside>x</aside></article></main><article class=comment>no no no</article><aside><article>t</article></aside>", None) == "a\nb b"
    assert extract("<main>one</main><nav>n</nav><main>two</main>", None) == "one\ntwo"
    named = "<div class='page with-sidebar'><article>long main text</article><article>next</article></div><article>end</article><div class=related><article>rel</article></div>"
    assert extract(named, None) == "long main text\nnext\nend"


def test_no_main_text_is_lost():
    assert extract("<main><h1>Title</h1><p>Lead paragraph of the story.</p><article><p>card</p></article><p>More of the story.</p></main>", None) == "Title\nLead paragraph of the story.\ncard\nMore of the story."
    assert extract("<div class='content'><p>lead text</p><article><p>card</p></article></div>", None) == "lead text\ncard"
    assert extract("<h1>Outside title</h1><article><p>body</p></article>", None) == "Outside title\nbody"
    assert extract("<article><p>first</p></article><div class='entry-content'><p>second body</p></div>", None) == "first\nsecond body"
    inside = "<article><p>a</p><div class='related-work'><p>b</p></div><section class='text-search'><p>c</p></section><div class='related-posts'>no</div><div id='search-box'>no</div></article>"
    assert extract(inside, None) == "a\nb\nc"
    assert extract("<div style='color:red; display : none'>gone</div><p style='margin:0'>there</p>", None) == "there"


def test_the_wrapper_decides_around_regions():
    page = "<body><p>Slogan of the house</p><h1>Title {k}</h1><article><p>text {k}</p></article><p>All rights</p></body>"
    wrapper = wrapped(*(page.replace("{k}", str(k)) for k in range(3)))
    assert extract(page.replace("{k}", "1"), wrapper) == "Title 1\ntext 1"
    assert extract(page.replace("{k}", "1"), None) == "Slogan of the house\nTitle 1\ntext 1\nAll rights"


def test_many_blocks_take_linear_time():
    import time

    kinds = ("<p>t{}</p>", "<h2>h{}</h2>", "<ul><li>i{}</ul>", "<pre>c{}</pre>")
    rng = random.Random(1)
    mixed = "".join(rng.choice(kinds).format(k) for k in range(50_000))
    plain = "".join(f"<p>t{k}</p>" for k in range(100_000))
    began = time.perf_counter()
    assert extract(plain, None).count("\n") == 99_999 and extract(mixed, None).count("\n") == 49_999
    assert len(wrapped(plain, plain[: len(plain) // 2 // 10 * 10])) < 100_001
    assert time.perf_counter() - began < 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=6), min_size=2, max_size=4), st.lists(st.sampled_from("abcd"), max_size=8))
def test_reading_along_a_wrapper_follows_its_order(pages, page):
    """The place of each node is the first of its key from the last place on, or from the turn of its group, as a scan finds it."""
    wrapper = [[k, 0, []] for k in pages[0]]
    for own in pages[1:]:
        wrapper = align(wrapper, [[k, 0, []] for k in own])
    level, at = wrappers._Level(wrapper), -1
    for key in page:
        again = level.turn[at] if at >= 0 else 0
        near = at if at >= 0 and level.flat[at][1] & REPEATED else at + 1
        scan = next((k for k in [*range(near, len(level.flat)), *range(again, near), *range(again)] if level.flat[k][0] == key), None)
        assert level.find(key, at) == scan
        at = at if scan is None else scan
