"""HTML extraction by site style trees (after Yi, Liu and Li, 2003).

The pages of a host are merged into one tree of element paths (tag, class and
id). For each path the tree knows on how many pages it is, how its sequences of
child elements are spread (presentation), and how its texts are spread
(content). A node whose presentation hardly varies and whose text is the same
on page after page has low importance; a branch goes from a page if none of its
nodes with text of its own is important, at any depth. The tree is a table with
one row per host and path, made by grouped counts; no host's pages meet in one
task, and what a page needs to know of the tree comes back by path.

What an element is called is a prior, which is added to that importance and so
combines with it: elements that HTML reserves for menus, headers, footers,
sidebars and controls (``HARD``), and class words, ids and roles that name such
parts, and forms (``NAMED``, less for doubtful words inside an article), count
against a node and all that is in it; a heading inside an article, which labels
what follows, counts for it (``HEADING``). The site can overrule a name: where
the parts so called hold most of the text of their pages, they are no side
matter (a form around a whole page). A ``header`` inside ``article``, ``main`` or
``section`` is the article's own. Nodes are block elements and named parts:
other inline elements belong to the block they are in and are not judged apart.
Copies of a page on one host count once.

Each page is parsed once. The parse, its text in pieces by node, is written to
the shared folder; deciding and joining work on that.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import Scratch
from .url_filter import host_of
from .vectors import join_back

#: Importance below which a branch goes.
THRESHOLD = 0.2
#: Share of the content in a node's importance; the rest is presentation.
GAMMA = 0.9
#: Pages with other texts that every site is taken to have beside those seen: a few equal pages say little.
UNSEEN_PAGES = 2
#: What names add to the importance: reserved elements, named parts, doubtful words inside an article, headings inside one.
HARD, NAMED, DOUBTED, HEADING = -1.0, -0.9, -0.5, 0.3

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas textarea title head select".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table caption colgroup tbody "
    "td tfoot th thead tr ul".split()
)
PARAGRAPH_ENDS = BLOCK - {"html", "body", "td", "th", "tr", "caption"}
# fixed values: elements that are reserved for side matter, forms, and headings
RESERVED = frozenset("nav footer aside button menu dialog search".split())
FORMS = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# fixed values: words that name side matter in classes, ids and roles, and words that say nothing beside them
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner navigation nav navbar menu breadcrumb "
    "breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended comment comments disqus reply replies respond pagination pager toolbar "
    "skip complementary contentinfo search".split()
)
#: Words that can well name a part of an article.
DOUBTFUL_WORDS = frozenset("related recommended alert notice notices search share sharing social promo banner".split())
PLAIN_WORDS = frozenset(
    "area bar block body bottom box button buttons btn col column container content div footer form group header holder icons inner "
    "item items left link links list main module outer page panel post posts right row section site slot text thread title to top "
    "unit widget widgets wrap wrapper".split()
)
# fixed values: elements that may stand in a head; any other start tag, or text, ends a head left open
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=\"'>/]+)", re.S)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"[0-9]+")


class Node:
    __slots__ = ("tag", "name", "path", "items", "skipped", "shift", "inside")

    def __init__(self, tag, name, path, skipped, shift, inside):
        self.tag, self.name, self.path, self.skipped, self.shift, self.inside = tag, name, path, skipped, shift, inside
        self.items = []  # child nodes and strings, in order


def side_matter(mark: str) -> bool:
    """Whether one word of a class, id or role names side matter: ``ad-slot`` does, ``ad-hoc`` does not."""
    parts = [w for w in re.split(r"[^a-z]+", mark) if w]
    return any(w in SIDE_WORDS for w in parts) and all(w in SIDE_WORDS or w in PLAIN_WORDS for w in parts)


def _signed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def _named(marks: list[str], inside: bool) -> float:
    """What class words, ids and roles add."""
    side = [m for m in marks if side_matter(m)]
    if not side:
        return 0.0
    doubtful = inside and all(w in DOUBTFUL_WORDS or w in PLAIN_WORDS for m in side for w in re.split(r"[^a-z]+", m) if w)
    return DOUBTED if doubtful else NAMED


def _element(tag: str, attrs: str, parent: Node) -> Node:
    skipped, name, shift = tag in RAW, tag, 0.0
    if tag in RESERVED or tag == "header" and not parent.inside:
        shift = HARD
    elif tag in FORMS:
        shift = NAMED
    if attrs:
        values = {}
        for m in _ATTR.finditer(attrs):
            values.setdefault((m[1] or m[5]).lower(), m[2] or m[3] or m[4] or "")
        skipped = skipped or "hidden" in values or values.get("aria-hidden") == "true" or bool(_HIDDEN.search(values.get("style", "")))
        marks = f"{values.get('class', '')} {values.get('id', '')} {values.get('role', '')}".strip().lower()
        if marks:
            if tag not in ("body", "html"):
                shift = min(shift, _named(marks.split(), parent.inside))
            name = f"{tag}.{values.get('class', '')}#{_DIGITS.sub('0', values.get('id', ''))}"
    shift = min(shift, parent.shift)
    if not shift and parent.inside and tag in HEADINGS:
        shift = HEADING
    return Node(tag, name, _signed(f"{parent.path}/{name}"), skipped, shift, parent.inside or tag in ("article", "main", "section"))


def parse(source: str) -> Node:
    """Tree of the page. Unknown end tags are ignored; what is left open ends with its parent."""
    top = Node("", "", 0, False, 0.0, False)
    stack, at, end = [top], 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            _end_head(stack, source[at:])
            stack[-1].items.append(source[at:])
            break
        if m.start() > at:
            _end_head(stack, source[at : m.start()])
            stack[-1].items.append(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table", "article", "body") and tag not in BLOCK:
                    break
            continue
        if tag == "body":
            _close(stack, "head", stop=())
        elif tag not in HEAD:
            _end_head(stack, tag)
        if tag in PARAGRAPH_ENDS:
            _close(stack, "p", stop=("td", "th", "table", "button", "object"))
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            _close(stack, tag, stop=("ul", "ol", "dl", "table", "menu"))
        node = _element(tag, m[3], stack[-1])
        stack[-1].items.append(node)
        if tag in ("script", "style", "textarea", "title", "noscript", "iframe"):
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            at = close.end() if close else end
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            stack.append(node)
    return top


def _end_head(stack: list[Node], text: str) -> None:
    if stack[-1].tag == "head" and text.strip():
        del stack[-1]


def _close(stack: list[Node], tag: str, stop: tuple[str, ...]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in stop:
            return


def _children(node: Node) -> list[Node]:
    return [x for x in node.items if isinstance(x, Node)]


class Page:
    """What deciding needs of a page: its nodes, parents first, and its text in pieces of (node, block, text)."""

    def __init__(self, source: str):
        self.paths, self.parents, self.shifts, self.roots, self.styles = [], [], [], [], []
        self.owners, self.blocks, self.texts = [], [], []
        block, todo = 0, [(parse(source), -1)]
        while todo:
            x, node = todo.pop()
            if x is None:
                block += 1
            elif isinstance(x, str):
                self._piece(node, block, x)
            elif x.tag == "br":
                self._piece(node, block, " ")
            elif x.skipped:
                block += x.tag in BLOCK
            else:
                if x.tag in BLOCK:
                    block += 1
                    todo.append((None, -1))
                if x.tag in BLOCK or node < 0 or x.shift != self.shifts[node]:
                    node = self._node(x, node)
                todo.extend((k, node) for k in reversed(x.items))
        own = [[] for _ in self.paths]
        for owner, text in zip(self.owners, self.texts, strict=True):
            own[owner].append(text)
        texts = [_SPACE.sub(" ", "".join(t)).strip() for t in own]
        self.contents = [_signed(t) or 1 if t else 0 for t in texts]
        self.sizes = [len(t) for t in texts]
        for k in range(len(self.paths) - 1, 0, -1):
            self.sizes[self.parents[k]] += self.sizes[k]

    def _node(self, x: Node, parent: int) -> int:
        node = len(self.paths)
        self.paths.append(x.path)
        self.parents.append(parent)
        self.shifts.append(x.shift)
        # the outermost part with the name that counts
        self.roots.append(self.roots[parent] if parent >= 0 and x.shift == self.shifts[parent] else node)
        self.styles.append(_signed(" ".join(dict.fromkeys(k.name for k in _children(x) if k.tag not in RAW))))
        return node

    def _piece(self, node: int, block: int, text: str) -> None:
        if self.owners and self.owners[-1] == node and self.blocks[-1] == block:
            self.texts[-1] += text
        else:
            self.owners.append(node)
            self.blocks.append(block)
            self.texts.append(text)

    def share(self, k: int) -> float | None:
        """Share of the page's text in the named part that a node is in."""
        return self.sizes[self.roots[k]] / self.sizes[0] if self.shifts[k] < 0 and self.sizes[0] else None

    def seen(self) -> list[tuple]:
        """Distinct (path, style, content), whether the path's first, the share of the named part it is in, and what names add."""
        out, known = {}, set()
        for k, (path, style, content) in enumerate(zip(self.paths, self.styles, self.contents, strict=True)):
            if (path, style, content) not in out:
                out[path, style, content] = (path not in known, self.share(k), self.shifts[k])
                known.add(path)
        return [(*k, *v) for k, v in out.items()]

    def observed(self) -> list[tuple]:
        """``seen`` without what names add."""
        return [row[:5] for row in self.seen()]


def _alone(page) -> set[int]:
    """Paths of low importance on a page without a site, where every text is its own."""
    out = set()
    for k, path in enumerate(page.paths):
        overruled = max(0.0, 2 * (page.share(k) or 0.0) - 1) if page.shifts[k] > HARD else 0.0
        if page.shifts[k] < 0 and GAMMA + page.shifts[k] * (1 - overruled) < THRESHOLD:
            out.add(path)
    return out


def kept_text(page, low: frozenset[int] | set[int] | None = None) -> str:
    """Blocks of the page's own text, joined by two line feeds.

    ``low``: paths whose own text is of low importance on the site; without a
    site, names alone decide.
    """
    if low is None:
        low = _alone(page)
    important = [False] * len(page.paths)
    for owner, text in zip(page.owners, page.texts, strict=True):
        important[owner] = important[owner] or page.paths[owner] not in low and not text.isspace()
    for k in range(len(page.paths) - 1, 0, -1):
        important[page.parents[k]] = important[page.parents[k]] or important[k]
    blocks, open_, at = [], [], None
    for owner, block, text in zip([*page.owners, 0], [*page.blocks, -1], [*page.texts, ""], strict=True):
        if block != at:
            joined = _SPACE.sub(" ", html.unescape("".join(open_))).strip()
            if joined:
                blocks.append(joined)
            open_, at = [], block
        if important[owner]:
            open_.append(text)
    return "\n\n".join(blocks)


def main_text(source: str, low: frozenset[int] | set[int] | None = None) -> str:
    """The own text of one page."""
    return kept_text(Page(source), low)


_SEEN = "seen array<struct<page: int, host: string, path: long, style: long, content: long, first: boolean, share: double, shift: double>>"
_SEEN_TYPE = pa.list_(pa.struct([("page", pa.int32()), ("host", pa.string()), ("path", pa.int64()), ("style", pa.int64()), ("content", pa.int64()), ("first", pa.bool_()), ("share", pa.float64()), ("shift", pa.float64())]))
_SEEN_NAMES = ("page", "host", "path", "style", "content", "first", "share", "shift")
_MARKS = "marks array<struct<page: int, host: string, print: long>>"
_MARKS_TYPE = pa.list_(pa.struct([("page", pa.int32()), ("host", pa.string()), ("print", pa.int64())]))
_LISTS = (("paths", pa.int64()), ("parents", pa.int32()), ("owners", pa.int32()), ("blocks", pa.int32()), ("texts", pa.string()))
#: Verdicts that are sent to the workers, some 100 bytes each; more come back to the pages by a join.
SENT_VERDICTS = 100_000
#: Pages, and bytes of html, of one lot of parses.
LOT_PAGES, LOT_BYTES = 64, 1 << 20


def _parse_pages(batches):
    lot = TaskContext.get().partitionId() << 32
    for whole in batches:
        sizes = [len(x) + 1 if x else 1 for x in whole.column(3).to_pylist()]
        a = 0
        while a < whole.num_rows:
            b, size = a + 1, sizes[a]
            while b < whole.num_rows and b - a < LOT_PAGES and size + sizes[b] <= LOT_BYTES:
                size += sizes[b]
                b += 1
            batch = whole.slice(a, b - a)
            pages = [Page(x or "") for x in batch.column(3).to_pylist()]
            lists = [pa.array([getattr(p, name) for p in pages], pa.list_(kind)) for name, kind in _LISTS]
            parsed = pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], names=["i", "u", "host", *[name for name, _ in _LISTS]])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parsed.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
                out.write_batch(parsed)
            hosts = batch.column(2).to_pylist()
            seen = [dict(zip(_SEEN_NAMES, (k, host, *o), strict=True)) for k, (host, p) in enumerate(zip(hosts, pages, strict=True)) for o in p.seen()]
            marks = [{"page": k, "host": host, "print": own} for k, (host, own) in enumerate(zip(hosts, batch.column(4).to_pylist(), strict=True))]
            columns = [pa.array([lot], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([seen], _SEEN_TYPE), pa.array([marks], _MARKS_TYPE)]
            yield pa.RecordBatch.from_arrays(columns, names=["lot", "pages", "seen", "marks"])
            lot, a = lot + 1, b


def parsed_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Lots of parsed pages, packed, with a number of their own, the observations in them, and a print of each page. Save it before use."""
    url = F.col(url_col).cast("string")
    source = F.col(html_col).cast("string")
    base = pages.select(F.col(id_col).alias("i"), url.alias("u"), host_of(url).alias("host"), source.alias("h"), F.xxhash64(source).alias("print"))
    return base.mapInArrow(_parse_pages, f"lot long, pages binary, {_SEEN}, {_MARKS}")


def copied_pages(parsed: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(lot, copies) with the pages of a lot that an equal page of their host stands for; None if there are none."""
    marks = parsed.select("lot", F.explode("marks").alias("m")).select("lot", "m.*")
    groups = marks.groupBy("host", "print").agg(F.count("*").alias("n"), F.min(F.struct("lot", "page")).alias("one")).where("n > 1")
    groups = scratch.save(groups, "copies")
    if groups.isEmpty():
        return None
    again = join_back(marks, groups, ["host", "print"], "n", marks.count()).where("lot <> one.lot OR page <> one.page")
    return scratch.save(again.groupBy("lot").agg(F.collect_list("page").alias("copies")), "copied")


def observations(parsed: DataFrame, copied: DataFrame | None = None) -> DataFrame:
    """(lot, page, host, path, style, content, first, share, shift) of the pages' nodes, without those of ``copied`` pages."""
    rows = parsed.select("lot", "seen")
    if copied is not None:
        rows = rows.join(copied, "lot", "left")
        fresh = F.filter("seen", lambda o: ~F.array_contains("copies", o["page"]))
        rows = rows.select("lot", F.when(F.col("copies").isNull(), F.col("seen")).otherwise(fresh).alias("seen"))
    return rows.select("lot", F.explode("seen").alias("o")).select("lot", "o.*")


def style_tree(seen: DataFrame) -> DataFrame:
    """(host, path, pages, presentation, content, share, shift): the merged tree with the importance of each path.

    presentation is the entropy of the child sequences, content one minus the
    mean logarithm of the number of pages that have the same text; both in
    logarithms to the number of pages, ``UNSEEN_PAGES`` more than were seen, and
    between 0 and 1. content is null without text. share is the mean share that
    named parts have of their pages' text, shift what names add.
    """
    both = seen.groupBy("host", "path", "style", "content").agg(F.count("*").alias("n"), F.sum(F.col("first").cast("long")).alias("pages"), F.sum("share").alias("share"), F.count("share").alias("shares"), F.min("shift").alias("shift"))
    styles = both.groupBy("host", "path", "style").agg(*[F.sum(c).alias(c) for c in ("n", "pages", "share", "shares")], F.min("shift").alias("shift"))
    styles = styles.groupBy("host", "path").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"), *[F.sum(c).alias(c) for c in ("pages", "share", "shares")], F.min("shift").alias("shift"))
    texts = both.where("content <> 0").groupBy("host", "path", "content").agg(F.sum("n").alias("n"))
    texts = texts.groupBy("host", "path").agg(F.sum("n").alias("tt"), F.sum(F.col("n") * F.log("n")).alias("st"))
    many = lambda n: F.log(F.col(n).cast("double") + UNSEEN_PAGES)
    presentation = (F.log("t") - F.col("s") / F.col("t")) / many("t")
    content = F.greatest(F.lit(0.0), 1 - F.col("st") / F.col("tt") / many("pages"))
    share = F.when(F.col("shares") > 0, F.col("share") / F.col("shares"))
    joined = styles.join(texts, ["host", "path"], "left")
    return joined.select("host", "path", "pages", presentation.alias("presentation"), F.when(F.col("tt").isNotNull(), content).alias("content"), share.alias("share"), "shift")


def verdicts(tree: DataFrame) -> DataFrame:
    """(host, path) of the paths of low importance."""
    own = (1 - F.lit(GAMMA)) * F.col("presentation") + F.lit(GAMMA) * F.col("content")
    overruled = F.when((F.col("shift") < 0) & (F.col("shift") > HARD), F.greatest(F.lit(0.0), 2 * F.coalesce("share", F.lit(0.0)) - 1)).otherwise(0.0)
    return tree.where(own + F.col("shift") * (1 - overruled) < THRESHOLD).select("host", "path")


class _Stored:
    __slots__ = tuple(name for name, _ in _LISTS)

    def __init__(self, *columns):
        self.paths, self.parents, self.owners, self.blocks, self.texts = columns


def _texts(blob: bytes, verdict_of) -> pa.RecordBatch:
    """The texts of a lot; ``verdict_of(page, host, paths)`` gives its low paths."""
    batch = pa.ipc.open_stream(blob).read_next_batch()
    hosts = batch.column(2).to_pylist()
    stored = zip(*(batch.column(k).to_pylist() for k in range(3, 8)), strict=True)
    texts = [kept_text(_Stored(*page), verdict_of(k, hosts[k], page[0])) for k, page in enumerate(stored)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["i", "u", "text", "n_chars"])


def _with_sent(get):
    def run(batches):
        low = get()
        for lots in batches:
            for blob in lots.column(0).to_pylist():
                yield _texts(blob, lambda _, host, paths: {p for p in paths if (host, p) in low})

    return run


def _with_joined(batches):
    for lots in batches:
        for blob, verdict in zip(lots.column(0).to_pylist(), lots.column(1).to_pylist(), strict=True):
            own = {}
            for v in verdict or ():
                own.setdefault(v["page"], set()).add(v["path"])
            yield _texts(blob, lambda page, _host, _paths, own=own: own.get(page, frozenset()))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars) for every row of ``pages``.

    Null or empty html gives an empty text. Repeated rows, and pages with equal
    html, are rows of their own with the same text, and one page to their host's
    tree. Null hosts share one tree under the empty host. Very long pages are
    taken whole, whatever their depth. Ties of importance do not arise: a path
    goes below the threshold only. Other columns are ignored, whatever their
    names. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "html-text")
    parsed = scratch.save(parsed_pages(pages, id_col, url_col, html_col), "parsed")
    seen = observations(parsed, copied_pages(parsed, scratch))
    judged = scratch.save(verdicts(style_tree(seen)), "verdicts")
    schema = T.StructType([T.StructField("i", pages.schema[id_col].dataType), T.StructField("u", T.StringType())])
    schema = schema.add("text", "string").add("n_chars", "long")
    if judged.count() <= SENT_VERDICTS:
        rows = judged.collect()
        sent = spark.sparkContext.broadcast({(r["host"], r["path"]) for r in rows})
        done = parsed.select("pages").mapInArrow(_with_sent(lambda: sent.value), schema)
    else:
        # a path of a host comes back to each page that has it, not the host's whole list to each of its pages
        own = observations(parsed).where("first").select("lot", "page", "host", "path").join(judged, ["host", "path"])
        own = own.groupBy("lot").agg(F.collect_list(F.struct("page", "path")).alias("verdict"))
        done = parsed.select("lot", "pages").join(own, "lot", "left").select("pages", "verdict").mapInArrow(_with_joined, schema)
    return done.select(F.col("i").alias(id_col), F.col("u").alias(url_col), "text", "n_chars")
