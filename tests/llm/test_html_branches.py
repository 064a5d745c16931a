import pytest

from veilspark.llm import html_text


def extracted(spark, pattern, n=6):
    df = spark.createDataFrame([(k, f"https://h.org/{k}", pattern.format(k=k)) for k in range(n)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.extract(df).collect()}


@pytest.mark.parametrize(
    "pattern",
    [
        "<html><body>Skip to content<div><p>unique text {k}</p></div></body></html>",
        "<html><body><div>Label <section><p>unique text {k}</p></section></div></body></html>",
        "<html><body>Skip" + "<div>" * 40 + "unique text {k}" + "</div>" * 40 + "</body></html>",
        # paths seen on one page only have no judgement on their host and count as important
        '<html><body>Skip<div class="x{k}"><p>unique text {k}</p></div></body></html>',
    ],
)
def test_deep_own_text_keeps_its_branch(spark, pattern):
    got = extracted(spark, pattern)
    assert all(f"unique text {k}" in got[k] for k in range(6))


def test_branches_without_own_text_still_go(spark):
    got = extracted(spark, "<html><body><div>Same <section><p>same on all</p></section></div><p>unique text {k}</p></body></html>")
    assert all(got[k] == f"unique text {k}" for k in range(6))


def test_open_head():
    for page in ("<head><title>t</title><body><p>x</p></body>", "<html><head><meta charset=utf-8><p>x", "<head><title>t</title>x"):
        assert html_text.main_text(page) == "x"
    assert html_text.main_text("<head> <template><p>no</p></template> <title>t</title></head><body>x") == "x"


def test_what_names_side_matter():
    assert all(map(html_text.side_matter, ("ad", "ad-slot", "cookie-notice", "comments", "related-posts", "sidebar_left")))
    assert not any(map(html_text.side_matter, ("ad-hoc", "related-work", "entry-content", "post", "body", "")))
    page = '<article><header><h1>T</h1></header><p class="related-work">x <math><mi>y</mi></math></p><p class="ad-slot">no</p><footer>no</footer></article>'
    assert html_text.main_text(page) == "T\n\nx y"


def test_low_paths_decide_inside_an_article():
    page = html_text.Page("<body><article><p>one</p><div><p>two</p></div></article></body>")
    low = {p for p, c in zip(page.paths, page.contents) if c}
    assert html_text.kept_text(page) == "one\n\ntwo" and html_text.kept_text(page, low) == ""
    first = next(p for p, c in zip(page.paths, page.contents) if c)
    assert html_text.kept_text(page, {first}) == "two"


def test_importance_of_a_grandchild_keeps_the_branch(spark):
    got = extracted(spark, "<html><body><article><div>Share this <span><b>own words {k}</b></span></div><div class='x'>Same on all</div></article></body></html>", 8)
    assert all(got[k] == f"Share this own words {k}" for k in range(8))


def test_a_form_around_the_page_is_no_side_matter(spark):
    got = extracted(spark, "<html><body><form><div>unique words of page {k}</div></form><div class='ad'>x{k}</div></body></html>")
    assert all(got[k] == f"unique words of page {k}" for k in range(6))


def test_tree_against_plain_counts(spark):
    import math
    from collections import Counter

    rows = [(k, f"http://h{k % 3}.org/", f"<body><div>{'same' if k % 2 else k}</div><p>t{k % 4}<b>x</b></p></body>") for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    tree = {(r.host, r.path): r for r in html_text.style_tree(html_text.observations(html_text.parsed_pages(df))).collect()}
    texts = {}
    for k, url, source in rows:
        for path, _, content, _, _ in html_text.Page(source).observed():
            texts.setdefault((f"h{k % 3}.org", path), []).append(content)
    for key, contents in texts.items():
        counts = Counter(c for c in contents if c)
        if counts:
            mean = sum(n * math.log(n) for n in counts.values()) / sum(counts.values())
            assert abs(tree[key].content - max(0.0, 1 - mean / math.log(len(contents) + html_text.UNSEEN_PAGES))) < 1e-9
        else:
            assert tree[key].content is None
        assert tree[key].pages == len(contents)


def test_verdicts_by_a_join_give_the_same(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    extra = spark.createDataFrame([(10**6 + k, f"http://h.org/{k}", f"<div>same</div><div class='ad'>x</div><p>own {k}</p>") for k in range(9)], "page_id long, url string, html string")
    every = pages.select("page_id", "url", "html").unionByName(extra)
    sent = sorted(html_text.extract(every).collect())
    monkeypatch.setattr(html_text, "SENT_VERDICTS", -1)
    assert sorted(html_text.extract(every).collect()) == sent
    assert next(r.text for r in sent if r.page_id == 10**6) == "own 0"
