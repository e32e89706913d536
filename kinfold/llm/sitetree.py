"""Main text of web pages by site style trees.

All pages of a host are merged into one tree. A node of it is a path of block elements with their tags, classes, ids and
roles. Two importances are computed for a node over the m pages that have it:

* presentation: the entropy, to base m, of the distribution of the ways its children are laid out; 1 where m is 1;
* content of its own text: 1 less the mean entropy of its text blocks over the pages; a block on k of m pages has
  log k / log m, so text that every page repeats has none and text of one page has all.

A node with l layouts and something below it has the composite importance (1 - DECAY**l) * presentation + DECAY**l * the
mean importance of what is below it, children and text by the pages that have them; a node with text only, that of its
text. A branch counts for the highest importance in it.

Where the articles of a host end and its templates begin is learnt from the host: below the importances that hold the
uppermost ``TOP`` of its text, one looks down those of its text nodes for the first gap of ``GAP``, and the threshold lies
in its middle. A host without such a gap has no threshold. Branches below the threshold that stand on at least ``min_pages``
pages are taken out; inside what the markup names the article, those below ``STRICT`` (the same text on nearly all
pages). Headings, paragraphs and list items without a name of their own go with the branch that they stand in, never
alone; no branch that holds a whole article goes, and never all the text of a page.

A host with few pages, or whose menus differ from page to page, gives no such evidence. What the markup itself says is
used beside it: elements that hold no running text, roles, and whole tokens of classes and ids that name a menu, header,
footer, sidebar, notice, advert, form or comment, unless they are headings or paragraphs, or hold the article or most of
the text. Names that an article's own parts may have as well (``AMBIGUOUS_WORDS``) take nothing out of a marked article
without the evidence of the tree. Where the markup names the article, what lies outside it is left out.

Tree statistics are counts by (host, node, block); pages of one task are summed before they are shuffled, and no task
sees a whole host. The threshold of a host comes from a histogram of at most ``STEPS`` + 1 rows. What comes back to the
pages are the uppermost removed nodes of their host.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kinfold.llm.common import batch
from kinfold.llm.dom import BLOCK, Element, Page, parse
from kinfold.runtime import materialize, spread

DECAY = 0.9
MIN_PAGES = 10
#: The importances of a host are told apart in so many steps; templates lie so many of them below its articles.
STEPS, GAP = 100, 8
#: Part of a host's text that is its articles' at least.
TOP = 0.2
#: Importance below which a branch inside a marked article is a template, too.
STRICT = 0.1

#: Elements that hold no text of an article.
DROPPED = frozenset(
    "script style noscript template iframe object embed svg canvas audio video map head title nav aside form button select option optgroup datalist textarea input label fieldset "
    "legend dialog menu search footer noembed noframes xmp frameset".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar tablist tooltip note".split())
#: Words of a class or id that name a part beside the article.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored promo nav navbar navigation submenu sidebar sidebars masthead topbar cookie cookies consent gdpr popup popover modal "
    "newsletter subscribe subscription signup login signin paywall comment comments commentlist commenting disqus share sharing social breadcrumb breadcrumbs pagination pager searchform footer widgets toolbar".split()
)
#: Words that may name a part of an article as well.
AMBIGUOUS_WORDS = frozenset(
    "promotion promoted menu aside rail foot notice notices notification notifications overlay register respond reply replies discussion feedback related recommended recommendations widget skip copyright legal disclaimer search form hidden".split()
)
#: Words that may stand beside them in a name.
BESIDE_WORDS = frozenset("site top bottom left right primary secondary global box bar list links".split())
ARTICLE_WORDS = frozenset("article articlebody articlecontent articletext postbody postcontent posttext entry entrycontent entrybody storybody storycontent".split())
ARTICLE_PAIRS = (("article", "post", "entry", "story", "main", "page"), ("body", "content", "text"))
#: Elements of running text: without a name of their own repetition does not set them beside the article.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre tr td th caption figcaption summary hgroup address #root html body article main section".split())
#: Elements that no class or id sets beside the article.
UNNAMED = frozenset("#root html body h1 h2 h3 h4 h5 h6 hgroup pre caption figcaption".split())
#: Characters that the links of a menu have on average at most.
MENU_CHARS = 30
WORD = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def names(e: Element) -> list[str]:
    """Words of an element's class and id, lower-cased, camel case split."""
    raw = " ".join(e.attributes[k] for k in ("class", "id") if k in e.attributes)
    return WORD.findall(CAMEL.sub(" ", raw).lower()) if raw else []


def signature(e: Element) -> str:
    a = e.attributes
    return e.tag + "".join(f" {k}={a[k].strip()}" for k in ("class", "id", "role") if a.get(k)) if a else e.tag


def is_node(e: Element) -> bool:
    """Whether an element is a node of the tree: block elements are; what stands in a line is part of its text."""
    return e.tag in BLOCK or e.tag == "#root"


def paths(page: Page) -> list[int]:
    """The node of each element: a signed 64-bit hash of its path. An element within a line has that of its block."""
    out: list[int] = []
    for e in page.elements:
        up = out[e.parent] if out else 0
        out.append(xxhash.xxh64_intdigest(signature(e), up & 0xFFFFFFFFFFFFFFFF) if not out or is_node(e) else up)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def named(e: Element, words: frozenset[str], keys: tuple[str, ...] = ("class", "id")) -> bool:
    """Whether a whole token of the class or id is made of ``words``, but for digits and BESIDE_WORDS."""
    for k in keys:
        for token in e.attributes.get(k, "").split():
            own = [w for w in WORD.findall(CAMEL.sub(" ", token).lower()) if not w.isdigit() and w not in BESIDE_WORDS]
            if own and words.issuperset(own):
                return True
    return False


def beside(page: Page, node: list[int] | None = None, noise: frozenset[int] = frozenset()) -> list[bool]:
    """Which elements the markup itself sets beside the article, alone or through an ancestor.

    A class or id sets none beside that holds all text of article and main elements or, on a page without such, most of
    its text; nor an article or main element that is not within another one, nor headings. Ambiguous names need a branch
    in ``noise`` inside an article, and the id of a section, which may be that of a chapter, is none.
    """
    elements = page.elements
    bad: list[bool] = []
    within: list[bool] = []  # below an article or main element, or one itself
    out: list[bool] = []
    for e in elements:
        up, inside = (out[e.parent], within[e.parent]) if e.parent >= 0 else (False, False)
        within.append(inside or e.tag in ("article", "main"))
        a = e.attributes
        own = e.tag in DROPPED or e.tag == "header" and not within[-1]
        if a and not own and e.tag not in ("html", "body", "#root"):
            role = a.get("role", "").lower()
            style = a.get("style", "").replace(" ", "").lower()
            own = role in DROPPED_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
        bad.append(own)
        out.append(up or own)
    held, marked = [0] * len(elements), [0] * len(elements)  # characters below an element, and those of them in an article
    for o, t, _ in page.blocks:
        if not out[o]:
            held[o] += len(t)
            marked[o] += len(t) * within[o]
    upward(page, held)
    upward(page, marked)
    low: list[bool] = []
    for i, e in enumerate(elements):
        up, inside = (out[e.parent], within[e.parent]) if e.parent >= 0 else (False, False)
        out[i] = up or bad[i]
        low.append(e.parent >= 0 and low[e.parent] or bool(noise) and is_node(e) and node[i] in noise)
        if out[i] or not e.attributes or e.tag in UNNAMED or e.tag in ("article", "main") and not inside:
            continue
        if marked[i] == marked[0] if marked[0] else 2 * held[i] > held[0]:
            continue
        out[i] = named(e, DROPPED_WORDS if inside else DROPPED_WORDS | {"header"})
        if not out[i] and (not inside or low[i]):
            out[i] = named(e, AMBIGUOUS_WORDS | DROPPED_WORDS, ("class",) if e.tag == "section" else ("class", "id"))
    return out


def upward(page: Page, numbers: list[int]) -> None:
    """Add what each element has to its ancestors."""
    for i in range(len(numbers) - 1, 0, -1):
        numbers[page.elements[i].parent] += numbers[i]


def is_article(e: Element) -> bool:
    a = e.attributes
    if e.tag in ("article", "main"):
        return True
    if not a or e.tag not in ("div", "section", "td"):
        return False
    if a.get("role", "").lower() in ("main", "article") or a.get("itemprop", "").lower() == "articlebody":
        return True
    words = names(e)
    return not ARTICLE_WORDS.isdisjoint(words) or any(p in words for p in ARTICLE_PAIRS[0]) and any(p in words for p in ARTICLE_PAIRS[1])


def articles(page: Page, out: list[bool]) -> list[bool]:
    """Which elements stand in the article or are its element: article elements that hold text if there are any, else a
    main element or what a name marks."""
    for tags in (("article",), ("main",), ()):
        inside: list[bool] = []
        for i, e in enumerate(page.elements):
            inside.append(e.parent >= 0 and inside[e.parent] or not out[i] and (e.tag in tags if tags else is_article(e)))
        if any(inside[o] and not out[o] for o, _, _ in page.blocks):
            return inside
    return [False] * len(page.elements)


def link_lists(page: Page, out: list[bool]) -> list[bool]:
    """Which elements stand in a menu: a branch of three text blocks or more, each a link, short on average."""
    blocks, linked, chars = ([0] * len(page.elements) for _ in range(3))
    for o, t, n in page.blocks:
        if not out[o]:
            blocks[o] += 1
            linked[o] += n >= 0.8 * len(t)
            chars[o] += len(t)
    for numbers in (blocks, linked, chars):
        upward(page, numbers)
    found: list[bool] = []
    for i, e in enumerate(page.elements):
        found.append(e.parent >= 0 and found[e.parent] or 3 <= blocks[i] == linked[i] < blocks[0] and chars[i] <= MENU_CHARS * blocks[i])
    return found


def main_text(html: str | None, noise: frozenset[int] = frozenset(), strict: frozenset[int] = frozenset()) -> str:
    """The article of a page, a block a line, without the branches at the nodes in ``noise`` and, inside what the markup
    names the article, at those in ``strict``."""
    if not html:
        return ""
    page = parse(html)
    node = paths(page) if noise else None
    out = beside(page, node, noise)
    inside = articles(page, out)
    marked = any(inside)
    if noise:
        size = [0] * len(page.elements)
        for o, _, _ in page.blocks:
            size[o] += not out[o] and (inside[o] or not marked)
        upward(page, size)
        left = list(out)
        for i, e in enumerate(page.elements):
            if e.parent >= 0:
                left[i] = left[i] or left[e.parent] or is_node(e) and node[i] in (strict if inside[i] else noise) and size[i] < size[0]
        if any(not left[o] and (inside[o] or not marked) for o, _, _ in page.blocks):  # repetition never takes all the text of a page
            out = left
    kept = [(o, t) for o, t, _ in page.blocks if not out[o]]
    if marked:
        return "\n".join(t for o, t in kept if inside[o])
    links = link_lists(page, out)
    return "\n".join(t for o, t in kept if not links[o])


def weighted_pages(pages: DataFrame) -> DataFrame:
    """``pages(host, html)`` with ``weight``: pages of a host with the same text between their tags count as one together.

    Only digests are shuffled, and of these only what has copies comes back.
    """
    hidden = r"<(?:script|style)\b[^<]*+(?:<(?!/?(?:script|style)[\s/>])[^<]*+)*+"  # up to the next such tag: no text is searched twice
    text = F.regexp_replace("html", rf"(?i){hidden}|<[^<>]*+>", " ")
    marked = pages.where("html <> ''").withColumn("digest", F.unhex(F.md5(F.regexp_replace(text, r"\s+", " "))))
    copied = marked.groupBy("host", "digest").agg(F.count("*").alias("copies")).where("copies > 1")
    return marked.join(materialize(copied, "copied"), ["host", "digest"], "left").select("host", "html", F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("weight"))


def tree_counts(pages: DataFrame) -> DataFrame:
    """``(host, node, parent, running, kind, item, pages, chars)``: on how many pages of a host a node that holds text is
    (kind 0), a text block of so many characters stands at it (kind 1), or it has a layout of children (kind 2).

    ``pages`` is (host, html) and may have a ``weight``, what a page counts for.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            seen: defaultdict = defaultdict(float)
            for host, html, weight in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not html:
                    continue
                page = parse(html)
                node = paths(page)
                texts = [0] * len(node)
                for o, _, _ in page.blocks:
                    texts[o] += 1
                upward(page, texts)
                nearest, layouts = [0] * len(node), {0: []}  # the block element that each one stands in; children of these
                for i, e in enumerate(page.elements):
                    nearest[i] = i if not i or is_node(e) else nearest[e.parent]
                    if nearest[i] == i and i:
                        layouts[i] = []
                        layouts[nearest[e.parent]].append(signature(e))
                own = set()
                for i, below in layouts.items():
                    if texts[i]:
                        e = page.elements[i]
                        up = node[nearest[e.parent]] if i else 0
                        own.add((host, node[i], up, e.tag in RUNNING and not names(e), 0, 0, 0))
                        own.add((host, node[i], 0, False, 2, xxhash.xxh64_intdigest("\0".join(below)) >> 1 if below else 0, 0))
                for o, text, _ in page.blocks:
                    own.add((host, node[o], 0, False, 1, xxhash.xxh64_intdigest(text) >> 1, len(text)))
                for key in own:
                    seen[key] += weight
            if seen:
                host, node, up, running, kind, item, chars = zip(*seen, strict=True)
                yield batch(
                    host=pa.array(host, pa.string()), node=pa.array(node, pa.int64()), parent=pa.array(up, pa.int64()), running=pa.array(running), kind=pa.array(kind, pa.int32()),
                    item=pa.array(item, pa.int64()), chars=pa.array(chars, pa.int64()), pages=pa.array(seen.values(), pa.float64()),
                )

    weight = F.col("weight") if "weight" in pages.columns else F.lit(1.0)
    found = pages.select("host", "html", weight.alias("weight")).mapInArrow(run, "host string, node long, parent long, running boolean, kind int, item long, chars long, pages double")
    return found.groupBy("host", "node", "parent", "running", "kind", "item", "chars").agg(F.round(F.sum("pages"), 6).alias("pages"))


def importance(counts: DataFrame) -> DataFrame:
    """``(host, node, parent, running, m, presentation, content, importance, highest, chars)`` from ``tree_counts``.

    ``importance`` is the composite of a node, ``highest`` the maximum in its branch (null without text). Both rise
    through the tree by doubling: after r rounds a node has heard of what is less than 2**r levels below it, so rounds
    grow with the logarithm of the depth.
    """
    pages = F.col("pages")
    kind = lambda k: F.col("kind") == k
    tree = counts.groupBy("host", "node").agg(
        F.max(F.when(kind(0), F.col("parent"))).alias("parent"), F.max(F.when(kind(0), F.col("running"))).alias("running"), F.sum(F.when(kind(0), pages)).alias("m"),
        F.coalesce(F.sum(F.when(kind(1), pages)), F.lit(0)).alias("n"), F.sum(F.when(kind(1), pages * F.log(pages))).alias("logs"), F.coalesce(F.sum(F.when(kind(1), pages * F.col("chars"))), F.lit(0)).alias("chars"),
        F.sum(kind(2).cast("int")).alias("layouts"), F.sum(F.when(kind(2), pages)).alias("laid"), F.sum(F.when(kind(2), pages * F.log(pages))).alias("s"),
    )
    m, log_m = F.col("m"), F.log(F.greatest(F.col("m"), F.lit(2)))
    bounded = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    tree = tree.withColumn("presentation", F.when(m > 1, bounded((F.log("laid") - F.col("s") / F.col("laid")) / log_m)).otherwise(1.0))
    tree = tree.withColumn("content", F.when(F.col("n") > 0, F.when(m > 1, bounded(1 - F.col("logs") / F.col("n") / log_m)).otherwise(1.0)))
    # What hangs below a node counts by the pages that have it.
    below = tree.where("parent <> 0").groupBy("host", F.col("parent").alias("node")).agg(F.sum("m").alias("children"))
    tree = materialize(tree.join(below, ["host", "node"], "left").fillna(0, ["children"]), "tree")
    own, decay = F.least("n", "m").cast("double"), F.pow(F.lit(DECAY), F.col("layouts"))
    every = own + F.col("children")
    inner = F.col("children") > 0
    base = F.when(inner, (1 - decay) * F.col("presentation") + decay * own / every * F.coalesce("content", F.lit(0.0))).otherwise(F.col("content"))
    share = tree.select("host", F.col("node").alias("parent"), (decay / every).alias("share"))
    rising = tree.withColumn("base", base).join(share, ["host", "parent"], "left")
    rising = rising.select("host", "node", F.col("parent").alias("up"), F.col("base").alias("sum"), F.coalesce(F.col("share") * m, F.lit(0.0)).alias("weight"), "content", F.col("m"))
    level = materialize(rising.select("host", "node", "up", "sum", "weight"), "level")
    while not (risen := level.where("up <> 0")).isEmpty():
        more = risen.groupBy("host", F.col("up").alias("node")).agg(F.sum(F.col("weight") * F.col("sum")).alias("more"))
        on = level.select("host", F.col("node").alias("up"), F.col("up").alias("further"), F.col("weight").alias("on"))
        met = level.join(more, ["host", "node"], "left").join(on, ["host", "up"], "left")
        level = materialize(met.select("host", "node", F.coalesce("further", F.lit(0)).alias("up"), (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum"), (F.col("weight") * F.coalesce("on", F.lit(0.0))).alias("weight")), "level")
    scored = tree.join(level.select("host", "node", bounded(F.col("sum")).alias("importance")), ["host", "node"])
    scored = materialize(scored.select("host", "node", "parent", "running", "m", "presentation", "content", "importance", "chars"), "scored")
    level = scored.select("host", "node", F.col("parent").alias("up"), F.col("importance").alias("highest"))
    while not (risen := level.where("up <> 0")).isEmpty():
        more = risen.groupBy("host", F.col("up").alias("node")).agg(F.max("highest").alias("more"))
        on = level.select("host", F.col("node").alias("up"), F.col("up").alias("further"))
        met = level.join(more, ["host", "node"], "left").join(on, ["host", "up"], "left")
        level = materialize(met.select("host", "node", F.coalesce("further", F.lit(0)).alias("up"), F.greatest("highest", "more").alias("highest")), "level")
    return scored.join(level.select("host", "node", "highest"), ["host", "node"])


def thresholds(scored: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, threshold)`` of the hosts whose text nodes fall apart, from a histogram of their contents by characters."""
    step = F.floor(F.col("content") * STEPS).cast("int")
    bars = scored.where((F.col("m") >= min_pages) & F.col("content").isNotNull()).groupBy("host", step.alias("step")).agg(F.sum("chars").alias("chars"))
    down = Window.partitionBy("host").orderBy(F.desc("step"))  # at most STEPS + 1 rows a host
    bars = bars.withColumn("upto", F.sum("chars").over(down)).withColumn("all", F.sum("chars").over(Window.partitionBy("host"))).withColumn("above", F.lag("step").over(down)).withColumn("before", F.lag("upto").over(down))
    low = bars.where((F.col("above") - F.col("step") >= GAP) & (F.col("before") >= F.col("all") * TOP))
    return low.groupBy("host").agg((F.max(F.struct("step", "above"))["step"] + F.max(F.struct("step", "above"))["above"] + 1).alias("twice")).select("host", (F.col("twice") / (2 * STEPS)).alias("threshold"))


def removed(scored: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, node, strict)``: the uppermost nodes of the branches that are templates; ``strict`` inside articles, too."""
    low = scored.where((F.col("m") >= min_pages) & ~F.col("running")).join(thresholds(scored, min_pages), "host").where(F.col("highest") < F.col("threshold"))
    low = materialize(low.select("host", "node", "parent", (F.col("highest") < F.least(F.col("threshold"), F.lit(STRICT))).alias("strict")), "low")
    above = low.select("host", F.col("node").alias("parent"), F.col("strict").alias("same"))
    return low.join(above, ["host", "parent"], "left").where(F.col("same").isNull() | (F.col("same") != F.col("strict"))).select("host", "node", "strict")


def host_of(url: str = "url") -> Column:
    """Lower-cased host of a URL; the empty string where it has none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, column: str = "text") -> DataFrame:
    """``pages`` with its main text in ``column``, in place of ``html``; a column of that name is replaced.

    Null, empty and broken pages give what can be read of them, at worst the empty text; null URLs form one host;
    repeated rows stay. Columns may have any names but those starting with ``_site_``.
    """
    others = [c for c in pages.columns if c not in (html, column)]
    hosted = spread(pages.withColumn("_site_host", host_of(url)))
    seen = weighted_pages(hosted.select(F.col("_site_host").alias("host"), F.col(f"`{html}`").alias("html")))
    gone = removed(materialize(importance(materialize(tree_counts(seen), "counts")), "importance"), min_pages)
    nodes = gone.groupBy(F.col("host").alias("_site_host")).agg(F.collect_set(F.when(~F.col("strict"), F.col("node"))).alias("_site_noise"), F.collect_set(F.when(F.col("strict"), F.col("node"))).alias("_site_strict"))
    joined = hosted.join(materialize(nodes, "noise"), "_site_host", "left")  # one small row a host; a hot host is split by adaptive execution

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            read, loose, strict = (b.column(b.num_columns - i).to_pylist() for i in (3, 2, 1))
            found = [main_text(h, frozenset((*(n or ()), *(s or ()))), frozenset(s or ())) for h, n, s in zip(read, loose, strict, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(found, pa.string())], [*b.schema.names[:-3], column])

    schema = StructType([*(pages.schema[c] for c in others), StructField(column, StringType())])
    return joined.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{html}`"), "_site_noise", "_site_strict").mapInArrow(run, schema)


def op2_query(pages: DataFrame) -> DataFrame:
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
