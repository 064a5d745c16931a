import pytest

from veilspark.llm import html_text

PAGES = "/root/testdata/sf0.1/pages.parquet"


def extracted(spark, sources, host="h.org"):
    rows = [(k, f"https://{host}/{k}", s) for k, s in enumerate(sources)]
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("copies", [4, 5, 40])
def test_equal_rows_keep_their_text(spark, copies):
    page = "<body><div>Home</div><p>the only text of this page</p></body>"
    got = extracted(spark, [page] * copies)
    assert set(got.values()) == {"Home\n\nthe only text of this page"} and len(got) == copies


def test_copies_count_once_beside_other_pages(spark):
    page = lambda k: f"<body><div>Home About</div><p>own words of page {k}</p></body>"
    got = extracted(spark, [page(k) for k in range(6)] + [page(0)] * 30)
    assert all(got[k] == f"own words of page {k if k < 6 else 0}" for k in range(36))


def test_what_stands_inside_a_block_is_not_judged_apart(spark):
    page = "<article><h2>Summary</h2><p><strong>Note:</strong> text number {k} is unique.</p><ul><li><a href='x'>Link</a> to {k}</li></ul></article>"
    got = extracted(spark, [page.format(k=k) for k in range(8)])
    assert all(got[k] == f"Summary\n\nNote: text number {k} is unique.\n\nLink to {k}" for k in range(8))


def test_doubtful_names_inside_an_article_are_overruled_by_own_words(spark):
    page = '<article><p>body {k}</p><div class="related">own related words {k}</div><p class="alert">own alert {k}</p><div class="ad">own advert {k}</div><div class="share">Share this</div></article>'
    got = extracted(spark, [page.format(k=k) for k in range(8)])
    assert all(got[k] == f"body {k}\n\nown related words {k}\n\nown alert {k}" for k in range(8))


def test_reserved_parts_go_through_the_tree(spark):
    page = "<body><nav>Crumb {k}</nav><header>Site</header><main><p>own {k}</p></main><aside>own side {k}</aside><footer>Kept {k}</footer></body>"
    sources = [page.format(k=k) for k in range(3)]
    assert set(extracted(spark, sources).values()) == {f"own {k}" for k in range(3)}
    parsed = html_text.Page(sources[0])
    assert "Crumb 0" in html_text.kept_text(parsed, frozenset()) and html_text.main_text(sources[0]) == "own 0"


@pytest.fixture(scope="module")
def judged(spark):
    parsed = html_text.parsed_pages(spark.read.parquet(PAGES)).cache()
    low = {(r.host, r.path) for r in html_text.verdicts(html_text.style_tree(html_text.observations(parsed))).collect()}
    parsed.unpersist()
    return low


def test_the_low_set_makes_the_texts_of_the_given_pages(spark, judged):
    changed = 0
    rows = spark.read.parquet(PAGES).collect()
    for r in rows:
        page = html_text.Page(r.html or "")
        host = r.url.split("://")[1].split("/")[0].lower()
        changed += html_text.kept_text(page, {p for h, p in judged if h == host}) != html_text.kept_text(page, frozenset())
    assert changed > 0.9 * len(rows)


def test_without_names_what_repeats_on_a_host_goes(spark, monkeypatch):
    """All but texts of their own (adverts) and an article's headings is decided by entropy alone."""
    rows = [r for r in spark.read.parquet(PAGES).collect() if r.html]
    want = {r.page_id: html_text.main_text(r.html) for r in rows}
    for name in ("RESERVED", "FORMS", "SIDE_WORDS"):
        monkeypatch.setattr(html_text, name, frozenset())
    seen = {}
    for r in rows:
        host = r.url.split("://")[1].split("/")[0].lower()
        page = html_text.Page(r.html)
        for text, owner in zip(page.texts, page.owners):
            if text.strip():
                seen.setdefault(host, {}).setdefault((page.paths[owner], text.strip()), set()).add(r.html)
    pages = [(host, [x for x in rows if x.url.split("://")[1].split("/")[0].lower() == host]) for host in list(seen)[:3]]
    for host, own in pages:
        got = extracted_here(own)
        for r in own:
            for (path, text), sources in seen[host].items():
                if len(sources) == len({x.html for x in own}) >= 5 and text not in want[r.page_id]:
                    assert text not in got[r.page_id]


def extracted_here(rows):
    """The tree of one host in plain Python."""
    import math
    from collections import Counter

    pages = {r.page_id: html_text.Page(r.html) for r in rows}
    distinct = {r.html: pages[r.page_id] for r in rows}
    styles, texts, count, shift = {}, {}, Counter(), {}
    for page in distinct.values():
        for path, style, content, first, _, move in page.seen():
            styles.setdefault(path, Counter())[style] += 1
            if content:
                texts.setdefault(path, Counter())[content] += 1
            count[path] += first
            shift[path] = move
    spread = lambda c: sum(n * math.log(n) for n in c.values()) / sum(c.values())
    low = set()
    for path, c in texts.items():
        t = sum(styles[path].values())
        presentation = (math.log(t) - spread(styles[path])) / math.log(t + html_text.UNSEEN_PAGES)
        content = max(0.0, 1 - spread(c) / math.log(count[path] + html_text.UNSEEN_PAGES))
        if (1 - html_text.GAMMA) * presentation + html_text.GAMMA * content + shift[path] < html_text.THRESHOLD:
            low.add(path)
    return {k: html_text.kept_text(p, low) for k, p in pages.items()}
