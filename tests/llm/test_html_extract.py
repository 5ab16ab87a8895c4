import itertools
import math
import random
import time

import pytest

from sieveline.llm import html_extract as m


@pytest.fixture(scope="module")
def model():
    return m.train()


def test_parser():
    nodes = m.parse("<html><head><title>t</title><style>p{}</style></head><body><p>a<b>b<br>c<p>d &amp; &copy;<script>x='</p>'</script><!-- n --> e<ul><li>1<li>2</ul></body>")
    assert [n.text for n in nodes if n.tag == "#text"] == ["ab c", "d & © e", "1", "2"]
    assert [n.tag for n in nodes if n.tag in ("p", "ul", "li")] == ["p", "p", "ul", "li", "li"]
    assert [n.text for n in m.parse("a < b <i>c</i>") if n.tag == "#text"] == ["a < b c"]
    assert len(m.parse("")) == 1


def words(page):
    return [n.text for n in m.parse(page) if n.tag == "#text"]


def test_text_behind_a_head_without_end():
    assert words("<head><title>t</title><meta charset=x><style>p{}</style><article><p>a</p></article>") == ["a"]
    assert words("<html><head><title>t</title><a href=x>a</a> b") == ["a b"]
    assert words("<head><title>t</title></head><header>a</header>") == ["a"]


@pytest.mark.parametrize("tag", "template svg math object canvas audio video select option datalist".split())
def test_an_element_without_end_takes_no_text_along(tag):
    assert words(f"<body><{tag} class='i'><article><p>a</p></article><{tag}>x</{tag}><p>b</p>") == ["a", "b"]
    assert words(f"<p>a</p><{tag}>x<p>y</p></{tag}><p>b</p></{tag}><p>c</p>") == ["a", "b", "c"]
    assert words(f"<p>a</p><{tag}>x<{tag}>y</{tag}>z</{tag}><p>b</p>") == ["a", "b"]


def test_what_is_empty_and_what_is_raw_text():
    assert words('<svg class="i"/><article><p>a</p></article><svg><path/></svg><math/><p>b</p>') == ["a", "b"]
    assert words("<p>a</p><svg><title>x</title></svg><select><option>x<option>y</select><p>b</p><script>x <p>y</p>") == ["a", "b"]


def test_quotes_tags_and_comments_without_end():
    assert words("<p a='x>y'>b</p><!-- <p>c</p>") == ["b"]
    assert words('a <b "c> d <p>e</p>') == ['a <b "c> d', "e"]
    assert words("<title-card>a</title-card><titles>b</titles>") == ["ab"]
    assert words("<title>x</title a>y</title><p>c</p>") == ["c"]


def test_tag_ends_equal_a_match_at_each_place():
    r = random.Random(4)
    for _ in range(2000):
        page = "".join(r.choice("""<>"'a =""") for _ in range(r.randrange(20)))
        end = m.tag_ends(page)
        for at in r.sample(range(len(page) + 1), len(page) + 1):
            want = m.REST.match(page, at)
            assert end(at) == (want.end() if want else -1), (page, at)


@pytest.mark.parametrize("piece", ('<a "', "<!", "</", "<!--", "<script>", "<p a='", "<header>", "</div>"))
def test_damaged_pages_take_time_in_proportion(piece):
    began = time.process_time()
    m.parse(piece * 200_000)
    assert time.process_time() - began < 20


def test_sum_product_equals_enumeration(model):
    nodes = m.parse("<div class='sidebar'><p>One two.</p><a href=x>links</a></div><article><h1>T</h1></article>")
    unary = m.potentials(nodes, model)
    total, content = 0.0, [0.0] * len(nodes)
    for states in itertools.product(range(3), repeat=len(nodes)):
        s = unary[0][states[0]]
        for i in range(1, len(nodes)):
            e = model.leaf_edge if nodes[i].tag == "#text" else model.edge
            s += unary[i][states[i]] + e[states[nodes[i].parent]][states[i]]
        p = math.exp(s) if s > -500 else 0.0
        total += p
        for i, x in enumerate(states):
            content[i] += p * (x == m.CONTENT)
    got = m.marginals(nodes, model)
    assert got[1:] == pytest.approx([c / total for c in content[1:]], abs=1e-9)


def test_held_out_pages(model):
    right = n = 0
    for page in m.labelled_pages(150, seed=99):
        nodes = m.parse(page)
        for node, want, p in zip(nodes, m.labels(nodes), m.marginals(nodes, model), strict=True):
            if node.tag == "#text":
                n += 1
                right += (p >= 0.5) == (want == m.CONTENT)
    assert right / n > 0.97


def test_parts_of_a_page(model):
    page = """<body><header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies on this site.</p><button>OK</button></div>
    <article class="post"><h1>A  title&nbsp;here</h1><p>First paragraph, with <a href="/x">a link</a> inside of it.</p><div class="ad">Buy now.</div><p>Second &amp; last.</p></article>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href="/r">Other page</a></li></ul></aside>
    <section class="comments"><p>Nice article, said a reader.</p></section><form class="subscribe"><label>Mail</label></form><footer>&copy; Someone</footer>"""
    assert m.extract(page, model) == "A title here\n\nFirst paragraph, with a link inside of it.\n\nSecond & last."


def test_column(spark):
    rows = [(1, "u", "<article><p>Some text of the article.</p></article>"), (2, None, None), (3, "u", ""), (None, "u", "<nav><a href=x>m</a></nav>"), (1, "u", "<article><p>Some text of the article.</p></article>")]
    out = m.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", m.F.lit("x")).withColumn("n_chars", m.F.lit(1))).collect()
    assert sorted(((r["page_id"], r["text"], r["n_chars"]) for r in out), key=repr) == sorted([(1, "Some text of the article.", 25)] * 2 + [(2, "", 0), (3, "", 0), (None, "", 0)], key=repr)
    assert m.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_table(spark):
    out = m.main_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()
    assert len(out) == 50 and all(r["n_chars"] == len(r["text"]) > 0 and r["text"] == r["text"].strip() for r in out)
    assert not any(x.isspace() and x != " " for r in out for b in r["text"].split("\n\n") for x in b)


def test_all_words_of_a_name_count():
    (node,) = (n for n in m.parse('<div class="' + " ".join(f"w{chr(97 + i)}" for i in range(20)) + ' sidebar">x</div>') if n.tag == "div")
    assert "name:sidebar" in m.features(node, None)
