import math
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from marquetry.llm import html_text as H

P = "This is a sentence of the article, with some words; and it goes on for a while. Then there is another one, too."
PAGE = f"""<!DOCTYPE html><html><head><title>Title. Of, page.</title><style>p{{a:b}}</style><script>var x="</p>, , , .";</script></head><body>
<nav><ul>{"".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(8))}</ul></nav><!-- a comment. with, text -->
<div class="ad" title="a > b">Buy now</div><article><h1>The heading</h1>{f"<p>{P} <b>Bold</b> &amp; more.</p>" * 6}<p>Last &lt;one&gt;, it ends.</article><ul>{"".join(f"<li><a>Other {k}</a></li>" for k in range(6))}</ul><footer>&copy; Site</footer></body></html>"""


def test_content_is_found():
    text, kept, total = H.extract(PAGE)
    assert text.count(P) == 6 and "Last <one>, it ends." in text
    for left_out in ("Link", "Buy now", "Site", "comment", "var x", "a:b", "Title"):
        assert left_out not in text
    assert 6 < kept < total


def test_paths():
    found = H.nodes("<body><p>one<p>two <i>three</i><ul><li>a<li>b</ul></body>")
    assert [t.strip() for _, t, _ in found] == ["one", "two", "three", "a", "b"]
    p = [p for p, _, _ in found]
    assert p[0] == p[1] and p[3] == p[4] and len(set(p)) == 3


def test_ratios_of_a_small_page():
    found = [(1, "xx.", True), (2, "yyyy.,", True), (2, "yy", True)]
    scores, deviation = H.path_scores(found, sigma=1e-3)
    assert scores == {1: 3.0 * 1, 2: 4.0 * 1.0} and abs(deviation - (2 / 9) ** 0.5) < 1e-9


def test_odd_pages(spark):
    pages = [(1, None), (2, ""), (None, PAGE), (3, "<p"), (4, "plain words only"), (5, "<script>never closed"), (6, "<p>" * 20_000 + "deep. text, here" + "</div>" * 10), (7, "a < b and c > d. " * 50_000), (8, '<a href="x')]
    df = spark.createDataFrame([(*p, "u", "t") for p in pages], "page_id long, html string, url string, text string")
    rows = {r["page_id"]: r for r in H.extracted(df).collect()}
    assert len(rows) == len(pages)
    assert all(rows[k]["text"] == "" for k in (1, 2, 5))
    assert rows[4]["text"] == "plain words only" and "deep. text, here" in rows[6]["text"]
    assert len(rows[7]["text"]) > 800_000
    assert P in rows[None]["text"]
    assert H.extracted(df.where("page_id > 100")).collect() == []


def test_most_of_the_articles_words(spark, sf_dir):
    import re
    from collections import Counter

    precision = recall = n = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        m = re.search("<article>(.*?)</article>", r["html"], re.S)
        if m:
            got, want = Counter(H.extract(r["html"])[0].split()), Counter(H.extract(f"<body>{m[1]}", threshold=-1e9)[0].split())
            both, n = sum((got & want).values()), n + 1
            precision += both / max(1, sum(got.values()))
            recall += both / max(1, sum(want.values()))
    assert n and precision / n >= 0.85 and recall / n >= 0.95


class Paths(HTMLParser):
    """Text nodes of a well-formed page with the names on their paths."""

    def __init__(self):
        super().__init__()
        self.stack, self.found = [], []

    def handle_starttag(self, tag, attrs):
        if tag != "br":
            self.stack.append(tag)

    def handle_endtag(self, tag):
        assert tag == "br" or self.stack.pop() == tag

    def handle_data(self, data):
        if data.strip() and not {"head", "script"} & set(self.stack):
            self.found.append(("/".join(self.stack), " ".join(data.split())))


def brute(page):
    """Texts of the nodes on content paths, by the definition."""
    parser = Paths()
    parser.feed(page)
    found = parser.found
    of = {p: [t for q, t in found if q == p] for p, _ in found}
    marks = lambda ts: sum(t.count(c) for t in ts for c in ".,;:!?")
    some = any(marks(ts) for ts in of.values())
    value = [sum(map(len, of[p])) / len(of[p]) * (marks(of[p]) / len(of[p]) if some else 1) for p, _ in found]
    smooth = []
    for i in range(len(value)):
        near = [(math.exp(-0.5 * ((i - j) / H.SIGMA) ** 2), value[j]) for j in range(max(0, i - 3), min(len(value), i + 4))]
        smooth.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    deviation = math.sqrt(sum((v - mean) ** 2 for v in smooth) / len(smooth))
    of_path = {p: [v for (q, _), v in zip(found, smooth) if q == p] for p in of}
    return [t for p, t in found if sum(of_path[p]) / len(of_path[p]) >= H.THRESHOLD * deviation], len(found)


def random_page(rng):
    words = "alpha beta gamma delta, epsilon. zeta; eta! theta? iota kappa".split()

    def element(depth):
        tag = str(rng.choice(["div", "section", "span", "b", "article", "em"]))
        inner = "".join(element(depth + 1) if depth < 5 and rng.random() < 0.5 else " ".join(rng.choice(words, int(rng.integers(1, 30)))) + "<br/>" * int(rng.integers(0, 2)) for _ in range(int(rng.integers(1, 5))))
        return f'<{tag} class="x > y">{inner}</{tag}>'

    return f"<html><head><title>No, text.</title></head><body>{''.join(element(0) for _ in range(6))}<script>1 < 2, 3.</script></body></html>"


def test_against_brute_force():
    rng = np.random.default_rng(7)
    some_left = 0
    for _ in range(150):
        page = random_page(rng)
        want, total = brute(page)
        text, kept, found = H.extract(page)
        assert (kept, found) == (len(want), total)
        assert text.split() == " ".join(want).split() or "".join(text.split()) == "".join("".join(want).split())
        some_left += kept < found
    assert some_left > 50


@pytest.mark.parametrize(
    "page",
    ["<a b " * 200_000, '<a title="x>text ' * 60_000, "<a '\">x" * 100_000, "<div>some text, here. " * 50_000, "<div>" + "<i>" * 100_000 + "<li>x</li>" * 100_000, "<div>" * 200_000 + "x" + "</div>" * 200_000, "< " * 500_000, "a" + " <b> </b>" * 100_000, "<!--" * 200_000, "<svg" * 200_000],
)
def test_time_is_linear(page):
    began = time.process_time()
    H.extract(page)
    assert time.process_time() - began < 15


def test_quotes_that_are_never_closed():
    assert H.extract('<p>one, two. <a title="x>three, four. <b>five, six.</b>')[0] == "one, two. three, four. five, six."
    assert H.extract('<p>one, two. <a title="x > y">three, four.</a>')[0] == "one, two. three, four."


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, PAGE)] * 3 + [(2, PAGE)], "page_id long, html string")
    rows = H.extracted(df).collect()
    assert sorted(r["page_id"] for r in rows) == [1, 1, 1, 2] and len({r["text"] for r in rows}) == 1
