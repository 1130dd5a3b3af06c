"""Main text of web pages by site style trees.

Pages of a host are merged node by node, a node being a style path (the labels from the root down). Importance by
entropy decides about every node that enough pages hold; what elements and names say is kept for the
rest: for hosts of few pages, and for what differs on every page and still is no article (reader comments,
rotating adverts).
"""

import hashlib
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.tasks import lean
from corpusgraph.plans.loops import cut

# Element names of HTML by what they do to the text around them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp
small span strike strong sub sup time tt u var wbr""".split())
UNSEEN = set("script style template noscript head title iframe object embed svg math canvas audio video map datalist".split())
HEAD_CONTENT = set("html head title base basefont bgsound link meta style script noscript noframes template".split())
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                 "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = set("ul ol dl table article section div main body td th blockquote".split())
# Elements and names that say what a branch is for.
ASIDE_TAGS = set("nav header footer aside form menu dialog button select textarea fieldset".split())
ASIDE_NAMES = set("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr
notice notices alert popup modal overlay newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs
header masthead footer sidebar aside widget related recommended share sharing social comment comments commentlist discussion
respond replies disqus search form""".split())
MAIN_TAGS = {"article", "main"}
MAIN_NAMES = set("article content post entry story maincontent main".split())
#: What readers write: parts of names that always count, and branches in which an article is a reader's.
READER_NAMES = set("comment comments commentlist discussion respond replies disqus".split())
CLOSED_TAGS = set("nav footer aside menu dialog".split())
#: Parts of names that tell a state ("has-sidebar", "comments-open"), not what the branch is.
STATE_NAMES = set("has with without no not is open closed enabled disabled active layout page".split())
#: Share of a node's importance that its content has; the rest is its parent's presentation.
CONTENT_SHARE = 0.9
#: Branches below this importance are removed, in nodes that at least this many pages hold; a part of a name
#: ("promo-box") asks for more importance, and a text inside the article must be on nearly all of more pages to go.
LEAST_IMPORTANCE = 0.3
LEAST_NAMED = 0.6
LEAST_INSIDE = 0.1
LEAST_PAGES = 3
PAGES_INSIDE = 8


def _names(attributes) -> tuple[str, ...]:
    words = []
    for key, value in attributes:
        if key in ("class", "id", "role") and value:
            words += value.lower().replace("_", "-").split()
    return tuple(words)


@lru_cache(maxsize=10_000)
def _role(tag: str, names: tuple[str, ...]) -> str:
    """``-`` for a branch that is no part of the article, ``+`` for the article, ``~`` if only a part of a name speaks against it."""
    if tag in ("html", "body"):
        return ""
    whole = set(names)
    parts = [set(n.split("-")) for n in names if "-" in n]
    parts = set().union(*(p for p in parts if not p & STATE_NAMES))
    if tag in ASIDE_TAGS or whole & ASIDE_NAMES or parts & READER_NAMES:
        return "-"
    if tag in MAIN_TAGS or whole & MAIN_NAMES:
        return "+"
    if parts & ASIDE_NAMES:
        return "~"
    return "+" if parts & MAIN_NAMES else ""


@lru_cache(maxsize=10_000)
def _closed(tag: str, names: tuple[str, ...]) -> bool:
    """No article begins inside such a branch."""
    return tag in CLOSED_TAGS or any(p in READER_NAMES for n in names for p in n.split("-"))


def _inner_role(above: str, closed: bool, tag: str, own: str) -> str:
    """The role of a branch with role ``own`` below one with role ``above``."""
    if above == "+" and tag == "header":  # the article's own heading
        return "+"
    if above == "-" and (closed or own != "+"):
        return "-"
    return own or above


@lru_cache(maxsize=100_000)
def _number(above: int, label: str) -> int:
    """64 bits for a path: its parent's and one more label."""
    return int.from_bytes(hashlib.blake2b(f"{above}>{label}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Page(HTMLParser):
    """Blocks of text with the style path of each, and the child styles of every path.

    Paths are numbers, so that an open element takes the same memory at any depth. ``open`` lists the places of each tag on
    the stack, and ``bounds`` those of containers, so that no tag makes the parser walk the stack.
    ``unseen`` holds the open elements from the outermost unseen one on. A head without end tag ends at
    the first thing that no head holds, other unseen elements with the element around them.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [("", 0, 0, "", False)]
        self.open, self.bounds = {}, []
        self.unseen, self.pending = [], []
        self.blocks, self.children = [], {}

    def flush(self):
        text = " ".join("".join(self.pending).split())
        self.pending.clear()
        if text:
            _, parent, path, role, _ = self.stack[-1]
            self.blocks.append((path, parent, role, text))

    def cut_back(self, size: int):
        for tag, *_ in self.stack[size:]:
            self.open[tag].pop()
        del self.stack[size:]
        while self.bounds and self.bounds[-1] >= size:
            self.bounds.pop()

    def last(self, tag: str) -> int:
        return (self.open.get(tag) or [0])[-1]

    def handle_starttag(self, tag, attributes):
        if tag == "body" and self.unseen[:1] == ["head"]:
            self.unseen.clear()
        elif self.unseen[-1:] == ["head"] and tag not in HEAD_CONTENT:
            self.unseen.pop()
        if self.unseen or tag in UNSEEN:
            if tag not in VOID:
                self.unseen.append(tag)
            return
        if tag == "br":
            self.pending.append(" ")
        if tag in VOID or tag in INLINE:
            return
        self.flush()
        if tag in CLOSES_ITSELF:
            ended = max(map(self.last, CLOSES_ITSELF[tag]))
            if ended and ended >= (self.bounds or [0])[-1]:
                self.cut_back(ended)
        names = _names(attributes)
        label = ".".join([tag, *names])
        _, _, path, above, closed = self.stack[-1]
        self.children.setdefault(path, []).append(label)
        role = _inner_role(above, closed, tag, _role(tag, names))
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in CONTAINERS:
            self.bounds.append(len(self.stack))
        self.stack.append((tag, path, _number(path, label), role, closed or _closed(tag, names)))

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.unseen:
            del self.unseen[len(self.unseen) - 1 - self.unseen[::-1].index(tag):]
            return
        if self.unseen:
            if not self.last(tag):
                return
            self.unseen.clear()
        if tag in INLINE or tag in VOID:
            return
        if self.last(tag):
            self.flush()
            self.cut_back(self.last(tag))

    def handle_data(self, data):
        if self.unseen == ["head"] and data.strip():
            self.unseen.clear()
        if not self.unseen:
            self.pending.append(data)


def read_page(html: str) -> tuple[list, dict]:
    """``(blocks, styles)``: blocks ``(path, parent, role, text)`` in page order, and child styles by path."""
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    styles = {path: " ".join(x for k, x in enumerate(labels) if not k or labels[k - 1] != x) for path, labels in page.children.items()}
    return page.blocks, styles


BLOCK = "array<struct<path:bigint,parent:bigint,role:string,text:string>>"
STYLE = "array<struct<path:bigint,style:bigint>>"


@lean
def _reader(batches):
    block = pa.list_(pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    style = pa.list_(pa.struct([("path", pa.int64()), ("style", pa.int64())]))
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            read = [read_page(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                part.column("row"), part.column("page"), part.column("url"), part.column("host"),
                pa.array([[dict(zip(("path", "parent", "role", "text"), b)) for b in blocks] for blocks, _ in read], block),
                pa.array([[{"path": p, "style": _number(0, s)} for p, s in styles.items()] for _, styles in read], style)],
                ["row", "page", "url", "host", "blocks", "styles"])


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _article(blocks: str) -> Column:
    """Digest of the text that a page names as its article, of all its text if it names none."""
    inside = F.filter(blocks, lambda b: b["role"] == "+")
    return F.xxhash64(F.transform(F.when(F.size(inside) > 0, inside).otherwise(F.col(blocks)), lambda b: b["text"]))


def _pages(each: DataFrame) -> DataFrame:
    """``each (host, article, role, ...)`` without ``article``: inside articles one row for all pages of one article.

    So copies of an article look like one page there.
    """
    return each.filter("role = '+'").distinct().drop("article").unionByName(each.filter("role <> '+'").drop("article"))


def text_counts(read: DataFrame) -> DataFrame:
    """``(host, path, parent, role, feature, n)``: on how many pages of a host a text stands at a path."""
    each = read.select("host", "article", F.explode(F.array_distinct(F.transform(
        "blocks", lambda b: F.struct(b["path"].alias("path"), b["parent"].alias("parent"), b["role"].alias("role"),
                                     F.xxhash64(b["text"]).alias("feature"))))).alias("f"))
    return _pages(each.select("host", "article", "f.*")).groupBy("host", "path", "parent", "role", "feature").agg(F.count("*").alias("n"))


def node_importance(read: DataFrame, texts: DataFrame) -> DataFrame:
    """``(host, path, pages, importance)`` of every text node of each host's style tree.

    With m pages at a node, its content importance is 1 less the mean entropy of its texts over
    the pages, log n / log m for a text on n of them: 0 if all pages hold the same text, 1 if each
    has its own. The presentation importance of its parent is the entropy of the child styles there, to
    the base m. All are aggregations with partial sums, so a hot host is no hot task.
    """
    features = texts.groupBy("host", "path", "parent").agg(F.sum(F.log("n")).alias("logs"), F.count("*").alias("features"))
    pages = _pages(read.select("host", "article", F.explode(F.array_distinct(F.transform(
        "blocks", lambda b: F.struct(b["path"].alias("path"), b["role"].alias("role"))))).alias("f")).select("host", "article", "f.*")).groupBy(
        "host", "path").agg(F.count("*").alias("pages"))
    shown = read.select("host", F.explode("styles").alias("s")).groupBy("host", "s.path", "s.style").agg(F.count("*").alias("n")).groupBy(
        "host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn")).select(
        "host", F.col("path").alias("parent"),
        F.when(F.col("m") > 1, 1 - F.col("nlogn") / (F.col("m") * F.log("m"))).otherwise(1.0).alias("presentation"))
    content = F.when(F.col("pages") > 1, 1 - F.col("logs") / (F.col("features") * F.log("pages"))).otherwise(1.0)
    return features.join(pages, ["host", "path"]).join(shown, ["host", "parent"], "left").select("host", "path", "pages", (
        CONTENT_SHARE * content + (1 - CONTENT_SHARE) * F.coalesce("presentation", F.lit(1.0))).alias("importance"))


def _marks(read: DataFrame) -> DataFrame:
    """``(host, path, feature, mark, common)`` of texts that something speaks against.

    ``mark`` is 2 for a node below ``LEAST_IMPORTANCE``, and for one that a part of a name speaks against and too few
    pages hold; 1 below ``LEAST_NAMED``. ``common``: this text is on nearly all of the node's
    pages, of which there are ``PAGES_INSIDE``.
    """
    texts = cut(text_counts(read))
    few, low = F.col("pages") < LEAST_PAGES, F.col("importance")
    mark = F.when(few, F.when(F.col("role") == "~", 2).otherwise(0)).when(low < LEAST_IMPORTANCE, 2).when(low < LEAST_NAMED, 1).otherwise(0)
    common = (F.col("pages") >= PAGES_INSIDE) & (1 - F.log("n") / F.log("pages") < LEAST_INSIDE)
    return texts.filter("role <> '-'").join(node_importance(read, texts), ["host", "path"]).select(
        "host", "path", "feature", mark.alias("mark"), common.alias("common")).filter("mark > 0 OR common")


def read_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``(row, page, url, host, blocks, styles, article)``, written once: the parsed pages; ``host`` is a digest."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("page"), F.col(url_column).alias("url"),
        F.xxhash64(_host(F.col(url_column))).alias("host"), F.coalesce(F.col(html_column), F.lit("")).alias("html"))
    kind = rows.schema["page"].dataType.simpleString()
    made = rows.mapInArrow(_reader, f"row bigint, page {kind}, url string, host bigint, blocks {BLOCK}, styles {STYLE}")
    return cut(made.withColumn("article", _article("blocks")))


def decided(read: DataFrame) -> DataFrame:
    """``(row, verdicts)``: per page with such blocks a map from (path, text digest) to what is known: see :func:`_marks`.

    Named branches that are no article need no verdict.
    """
    marks = cut(_marks(read))
    asked = read.select("row", "host", F.explode(F.array_distinct(F.transform(
        F.filter("blocks", lambda b: b["role"] != "-"), lambda b: F.struct(b["path"].alias("path"), F.xxhash64(b["text"]).alias("feature"))))).alias("f"))
    # written, so that the planner knows how few rows these are and need not deal out the texts
    return cut(asked.select("row", "host", "f.*").join(marks, ["host", "path", "feature"]).groupBy("row").agg(F.map_from_entries(
        F.collect_list(F.struct(F.struct("path", "feature").alias("k"), F.struct("mark", "common").alias("v")))).alias("verdicts")))


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """The article of each page: ``page, url, text, n_chars``, one row per row.

    Pages are parsed once to blocks of text (character references decoded, white space
    inside a block made one space) with the style path of each; :func:`node_importance` rates
    the paths of each host. What stays is joined in page order by line breaks.

    - In a branch without a name a block goes if its path is below ``LEAST_IMPORTANCE`` on at least ``LEAST_PAGES`` pages.
    - If a part of a name speaks against the branch ("promo-box"), it goes below ``LEAST_NAMED``, and where
      fewer pages hold the path.
    - In a branch named as the article (``article``, ``main``, a whole name such as "post") a text goes if it stands at its path on
      nearly all of at least ``PAGES_INSIDE`` pages, say a notice inside every article; unless
      that is more than half of the page's article, for then it is a version of one article.
    - Branches that the page itself sets apart go (navigation, headers, footers, forms, whole names such as "sidebar" or "ad",
      reader comments). An article inside such a wrapper counts again, but not in navigation, footers, asides and comments.

    Inside articles, pages of a host with one and the same article count as one, so copies keep their text.

    A null html is empty and gives an empty text. Pages without a host in their url share the
    empty host. Null and repeated ids are kept, one row each. Broken markup never fails, at any depth: open
    elements end with the page, a head at its first other content, unseen elements with the one around.
    Other columns are ignored; an empty table gives an empty result.
    """
    read = read_pages(pages, id_column, url_column, html_column)

    def verdict(b):
        return F.element_at(F.col("verdicts"), F.struct(b["path"].alias("path"), F.xxhash64(b["text"]).alias("feature")))

    def length(blocks):
        return F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b["text"]))

    met = read.join(decided(read), "row", "left")
    known = met.filter("verdicts IS NOT NULL").select(
        "page", "url", F.transform("blocks", lambda b: F.struct(b["role"].alias("role"), b["text"].alias("text"), verdict(b).alias("v"))).alias("blocks"))
    inside = F.filter("blocks", lambda b: b["role"] == "+")
    common = F.filter(inside, lambda b: F.coalesce(b["v"]["common"], F.lit(False)))
    kept = F.filter("blocks", lambda b: F.when(b["role"] == "-", False)
                    .when(b["role"] == "+", ~(F.col("notices") & F.coalesce(b["v"]["common"], F.lit(False))))
                    .when(b["role"] == "~", F.coalesce(b["v"]["mark"] < 1, F.lit(True)))
                    .otherwise(F.coalesce(b["v"]["mark"] < 2, F.lit(True))))
    def joined(blocks):
        return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")

    judged = known.withColumn("notices", 2 * length(common) <= length(inside)).select("page", "url", joined(kept).alias("text"))
    free = met.filter("verdicts IS NULL").select("page", "url", joined(F.filter("blocks", lambda b: b["role"] != "-")).alias("text"))
    return free.unionByName(judged).withColumn(
        "n_chars", F.length("text").cast("long"))
