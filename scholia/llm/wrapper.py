"""Main text of web pages by wrapper induction over the pages of one host.

The pages of a host are put into layouts by the tags they use; of its most frequent ``LAYOUTS`` layouts one page each
(not a blank one) is a reference.  Every page's element tree is aligned by simple tree matching with the reference that
is most like it.  Over all pages of the host it is counted how often each element of a reference was aligned, how often
the aligned block had the same text, and how much of its text was links.  An element that was the same in ``CONSTANT``
of at least ``PAGES`` pages is template; one whose text was links by more than ``LINKS`` over at least ``PAGES`` pages
is a menu; the others are slots of content.  A page none of whose blocks differs from its reference is a copy of it and
tells nothing of the template, so it isn't counted.  Counts are summed by host and element before they are shuffled, so
a host with a third of all pages is no heavier than another.

Marks in the page are a prior to that evidence.  An element that is an article, main, or named as content by its class
or id is template only once ``MARKED_PAGES`` pages say so, and never a menu; on pages that have article or main elements
only these are kept, all of them.  Elements whose tag, role, class or id names what isn't the article (menus, adverts,
comments and footers that vary from page to page, which no template shows) go, unless they hold content: an element
with one of ``LAYOUT``'s words or a form stays if it has a content region of any kind below it, or half of the text of a
page without any.  Inside an article element the words of classes are weak evidence (a discussion, a legal or a social history
may be its subject): there only words of adverts, readers' comments and notices (``FOREIGN``) take an element out by themselves,
and the others only if most of its text is links.  Blocks with over 60 % link text go where they stand outside all content regions of a page that has
some.  If nothing is left of a page, only tags, roles and the template decide; if the template leaves nothing of marked
content, that content stays.

Blocks are elements that stand on lines of their own; table rows are one block each, and a line break is white
space.

Defined cases: a null or empty page has an empty text; null URLs are one host; a host of few pages has no
template; repeated rows give repeated rows; very long and deeply nested pages are read in linear time, and aligned in
the product of their differing shapes; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .dom import BLOCK, INLINE, Node, clean, layout_kids, match, number, parse
from .url_trees import parts

PAGES, MARKED_PAGES = 4, 20
CONSTANT, LINKS = 0.9, 0.6
LAYOUTS = 3
#: References of at most so many hosts and characters are sent to all tasks; more meet their pages by a shuffle.
SENT_HOSTS, SENT_CHARS = 4000, 16 << 20
#: Pages of one host that go to one task then.
HOST_PAGES = 100_000
#: Hosts of so many templates are sent to all tasks.
SENT_TEMPLATES = 50_000

DROPPED = frozenset("head nav footer aside button select menu dialog input label".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar status".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead topbar footer foot sidebar aside rail widget widgets related recommended recommendations comment comments commentlist discussion disqus reply replies respond responses "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login signin share sharing social follow "
    "toolbar pagination pager copyright legal disclaimer skip search hidden paywall".split()
)
#: Of these, the ones that also name layouts, which may wrap the page's content.
LAYOUT = frozenset("banner nav navbar navigation menu header masthead topbar footer foot sidebar aside rail widget widgets share sharing social follow toolbar copyright legal disclaimer skip search overlay modal".split())
#: What others than the author put into an article.
FOREIGN = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot adsense sponsored promo comment comments commentlist disqus cookie cookies consent gdpr notice notices newsletter paywall".split())
#: A class that begins so says what else the page has; a header of one of these is a title.
HAS, TITLED = frozenset("has no with without".split()), frozenset("post entry article story title".split())
ARTICLE = frozenset("article content main post entry story body text".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def words_of(n: Node) -> set[str]:
    return {w.lower() for key in ("class", "id") if key in n.attrs for w in _WORD.findall(n.attrs[key])}


def is_article(n: Node) -> int:
    """3: an article element, 2: main, 1: by its class or id."""
    if n.tag == "article" or n.attrs.get("itemprop") == "articleBody":
        return 3
    if n.tag == "main" or n.attrs.get("role") == "main":
        return 2
    return int(n.tag in ("div", "section", "td") and bool(words_of(n) & ARTICLE))


def boilerplate(n: Node) -> set[str]:
    """The words of its classes and ids that name what isn't the article."""
    out: set[str] = set()
    for key in ("class", "id"):
        for token in n.attrs.get(key, "").split():
            words = [w.lower() for w in _WORD.findall(token)]
            if words and words[0] not in HAS:
                out |= WORDS.intersection(words) - ({"header"} if TITLED.intersection(words) else set())
    return out


def measure(root: Node) -> bool:
    """Sets what elements hold: chars, size (characters that aren't links'), holds (the highest is_article below, but that of
    boilerplate), text (characters that aren't dropped) and heading (one is below); and story (it is in an article element).

    On a page without any content region, elements with half of its text or more count as holding one.
    Gives whether the page has a region.
    """
    order = number(root)
    for n in order:
        for x in n.kids:
            x.story = n.story or is_article(n) == 3
    for n in reversed(order):
        n.chars = sum(len(p.strip()) if isinstance(p, str) else p.chars for p in n.parts)
        n.size = 0 if n.tag == "a" else sum(len(p.strip()) if isinstance(p, str) else p.size for p in n.parts)
        n.heading = any(x.tag in HEADINGS or x.heading for x in n.kids)
        n.holds = 0
        for x in n.kids:
            k = is_article(x)
            n.holds = max(n.holds, x.holds, 0 if k == 1 and (not x.size or boilerplate(x)) else k)
    regional = root.holds > 0
    if not regional:
        for n in order:
            n.holds = int(0 < n.size and 2 * n.size >= root.size)
    for n in reversed(order):
        n.text = sum(len(p) if isinstance(p, str) else 0 if dropped(p, True) else p.text for p in n.parts)
    return regional


def _links(n: Node) -> int:
    return n.chars - n.size


def dropped(n: Node, inside: bool, words: bool = True) -> bool:
    """Whether an element and all in it isn't part of the article; inside: it is in one; words: not by its tag and role alone."""
    a = n.attrs
    if n.tag in DROPPED or a.get("role") in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return True
    if n.tag == "header" and not inside:
        return True
    if not words:
        return False
    if n.tag == "form" and not n.holds:
        return True
    if ("class" in a or "id" in a) and n.tag not in ("html", "body", "article", "main") and n.tag not in HEADINGS and (found := boilerplate(n)):
        if n.story and not found & FOREIGN and _links(n) <= LINKS * n.chars:
            return False
        return n.holds < (1 if found <= LAYOUT else 2)
    return n.tag in ("article", "section") and bool(words_of(n) & {"comment", "comments", "reply", "replies", *(() if n.story else ("related",))})


def regions(root: Node) -> tuple[list[Node], list[Node]]:
    """The parts of the page that hold its content (main and article elements that have text, else the whole page), and those that are its own articles."""
    tops, articles = [], []
    stack = [(root, False)]
    while stack:
        n, below = stack.pop()
        if n is not root and dropped(n, False):
            continue
        k = is_article(n)
        if k >= 2 and (below or n.text):
            if not below:
                tops.append(n)
            if k == 3:
                articles.append(n)
            below = True
        if k < 3:  # an article inside an article is part of it
            stack.extend((x, below) for x in reversed(n.kids))
    return tops or [root], [n for n in articles if n.text] or tops


class Block:
    """A block of text: the layout element it stands in, whether that is marked as content, its links' characters, and whether it is inside the article."""

    __slots__ = ("element", "inside", "links", "marked", "text")

    def __init__(self, n: Node, text: str, marked: bool, inside: bool, links: int):
        while n.tag in INLINE and n.up is not None:
            n = n.up
        self.element, self.text, self.marked, self.inside, self.links = n.index, text, marked, inside, links


def blocks(root: Node) -> list[Block]:
    """Blocks of text in page order, but those in dropped elements.  Where that leaves nothing, words of classes and forms drop nothing."""
    out = _blocks(root, True)
    return out if any(b.inside for b in out) else _blocks(root, False)


def _blocks(root: Node, words: bool) -> list[Block]:
    out: list[Block] = []
    regional = measure(root) and words
    tops, articles = regions(root) if words else ([root], [])
    entered, owners = {id(n) for n in tops}, {id(n) for n in articles}
    buffer: list[str] = []
    link = 0

    def flush(n: Node, inside: bool, marked: bool, content: bool) -> None:
        nonlocal link
        text = clean(buffer)
        own = marked and n.tag not in ("div", "section", "span", "ul", "ol", "article", "main")
        # lists of links aren't content where the page has regions of content and they stand outside them
        if text and (own or content or not regional or link <= 0.6 * len(text)):
            out.append(Block(n, text, own or content, inside, min(link, len(text))))
        buffer.clear()
        link = 0

    stack: list[tuple[Node, int, bool, bool, bool, bool]] = [(root, 0, False, id(root) in entered, False, False)]
    while stack:
        n, k, anchor, inside, marked, content = stack.pop()
        article = inside and tops[0] is not root
        while k < len(n.parts):
            p = n.parts[k]
            k += 1
            if isinstance(p, str):
                buffer.append(p)
                if anchor:
                    link += len(p.strip())
                continue
            out_of_text = dropped(p, article, words) or p.tag == "header" and not p.heading
            if p.tag in ("br", "td", "th"):
                buffer.append(" ")
            elif p.tag in BLOCK or id(p) in entered or id(p) in owners:
                flush(n, inside, marked, content)
            if not out_of_text:
                stack.append((n, k, anchor, inside, marked, content))
                stack.append((p, 0, anchor or p.tag == "a", inside or id(p) in entered, marked or id(p) in owners, content or bool(is_article(p))))
                break
        else:
            if n.tag in BLOCK or n is root or id(n) in entered or id(n) in owners:
                flush(n, inside, marked, content)
    return out


class Reference:
    def __init__(self, page: str):
        self.root = parse(page)
        self.labels = Counter(n.label for n in number(self.root))
        self.texts: dict[int, set[str]] = {}
        for b in blocks(self.root):
            self.texts.setdefault(b.element, set()).add(b.text)


#: Of an element of a reference: pages that aligned with it, those with the same text, characters, those of links.
Counts = dict[int, list[int]]


def aligned(page: str, refs: list[Reference] | None) -> tuple[list[str], list[int], list[bool], Counts]:
    """Of the blocks: texts, places in a reference (element * LAYOUTS + reference; -1: none) and whether they are marked; and COUNTS of the page.

    A place below -1 is that of a block that differs from the reference's: -2 - place.
    """
    root = parse(page)
    labels = Counter(n.label for n in number(root))
    found = blocks(root)
    inside = [b for b in found if b.inside]
    texts, marked = [b.text for b in inside], [b.marked for b in inside]
    if not refs or not found:
        return texts, [-1] * len(inside), marked, {}
    which = max(range(len(refs)), key=lambda k: ((refs[k].labels & labels).total() / (refs[k].labels | labels).total(), -k))
    ref = refs[which]
    to = match(ref.root, root, layout_kids)
    slots, counts, differs = [], {}, False
    for b in found:
        r = to.get(b.element, -1)
        known = r in ref.texts
        equal = known and b.text in ref.texts[r]
        differs |= not equal
        place = r * LAYOUTS + which
        if known:
            c = counts.setdefault(place, [0, 0, 0, 0])
            c[0] += 1
            c[1] += equal
            c[2] += len(b.text)
            c[3] += b.links
        if b.inside:
            slots.append(-1 if not known else place if equal else -2 - place)
    return texts, slots, marked, counts if differs else {}


COUNTS = "array<struct<host: string, place: int, n: long, same: long, chars: long, links: long>>"
BLOCKS = "page_id long, url string, host string, bucket int, texts array<string>, slots array<int>, marked array<boolean>, counts " + COUNTS


def layout(html: Column) -> Column:
    """A key of the tags that a page uses."""
    tags = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower))
    return F.xxhash64(F.sort_array(F.array_except(tags, F.array(*map(F.lit, sorted(INLINE))))))


def references(rows: DataFrame) -> DataFrame:
    """host, ref (from 0), html, n (pages of the host) of the most frequent layouts of each host."""
    keyed = rows.where(F.col("html").rlike(r"\S")).select("host", layout(F.col("html")).alias("layout"), F.xxhash64("html").alias("o"), "html")
    small = common.save(keyed.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("o").alias("o")), "layouts")
    most = Window.partitionBy("host").orderBy(F.desc("n"), "o", "layout")
    chosen = small.withColumn("ref", F.row_number().over(most) - 1).where(F.col("ref") < LAYOUTS).select("host", "layout", "o", "ref")
    chosen = common.save(chosen, "chosen")
    pages = keyed.join(common.small_or_shuffled(chosen, 200_000), ["host", "layout", "o"]).groupBy("host", "ref").agg(F.min("html").alias("html"))
    return common.save(pages.join(small.groupBy("host").agg(F.sum("n").alias("n")), "host"), "references")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", template: bool = True) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.  template: False keeps what the host's template would remove."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), parts(F.col(url_col))[0].alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    refs = references(rows)
    hosts, size = refs.agg(F.count("*"), F.coalesce(F.sum(F.length("html")), F.lit(0))).first()
    sent = None
    if hosts <= SENT_HOSTS and size <= SENT_CHARS:
        sent = {}
        for r in sorted(refs.collect(), key=lambda r: (r["host"], r["ref"])):
            sent.setdefault(r["host"], []).append(r["html"])
    shared = spark.sparkContext.broadcast(sent)
    columns = ["page_id", "url", "host", F.lit(0).alias("bucket"), "html", F.lit(None).cast("int").alias("ref")]
    if sent is None:
        # pages of a host meet its references in buckets of HOST_PAGES: in each, references come first
        large = refs.where("ref = 0").select("host", F.ceil(F.col("n") / HOST_PAGES).cast("int").alias("buckets")).where("buckets > 1")
        large = common.save(large, "hosts")
        bucketed = rows.join(common.small_or_shuffled(large, 1_000_000), "host", "left").withColumn("bucket", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("buckets", F.lit(1))).cast("int"))
        firsts = refs.join(common.small_or_shuffled(large, 1_000_000), "host", "left").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.coalesce("buckets", F.lit(1)) - 1)))
        firsts = firsts.select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), "host", "bucket", "html", F.col("ref").cast("int"))
        rows = bucketed.select("page_id", "url", "host", "bucket", "html", F.lit(None).cast("int").alias("ref")).unionByName(firsts)
        rows = rows.repartition("host", "bucket").sortWithinPartitions("host", "bucket", F.asc_nulls_last("ref"))
        columns = ["page_id", "url", "host", "bucket", "html", "ref"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Reference]] = {}
        for b in common.batches(batches, 1000):
            pages_ = b.filter(pa.compute.is_null(b.column(5)))
            texts, slots, marked, sums = [], [], [], {}
            for host, html, ref in zip(*(b.column(k).to_pylist() for k in (2, 4, 5)), strict=True):
                if ref is not None:
                    if ref == 0:
                        known.clear()
                    known.setdefault(host, []).append(Reference(html))
                    continue
                if host not in known and shared.value is not None:
                    if len(known) >= 500:
                        known.clear()
                    known[host] = [Reference(x) for x in shared.value.get(host, ())]
                t, s, m, counts = aligned(html, known.get(host))
                texts.append(t)
                slots.append(s)
                marked.append(m)
                for place, c in counts.items():
                    old = sums.setdefault((host, place), [0, 0, 0, 0])
                    for k in range(4):
                        old[k] += c[k]
            if not texts:
                continue
            told = [[] for _ in texts]
            told[0] = [{"host": h, "place": e, "n": c[0], "same": c[1], "chars": c[2], "links": c[3]} for (h, e), c in sums.items()]
            kind = pa.list_(pa.struct([("host", pa.string()), ("place", pa.int32()), *((k, pa.int64()) for k in ("n", "same", "chars", "links"))]))
            arrays = [*(pages_.column(k) for k in range(4)), pa.array(texts, pa.list_(pa.string())), pa.array(slots, pa.list_(pa.int32())), pa.array(marked, pa.list_(pa.bool_())), pa.array(told, kind)]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "host", "bucket", "texts", "slots", "marked", "counts"])

    common.arrow_bytes(spark)
    found = common.save(rows.select(*columns).mapInArrow(look, BLOCKS), "blocks")
    counts = found.select(F.inline("counts")).groupBy("host", "place").agg(*(F.sum(k).alias(k) for k in ("n", "same", "chars", "links")))
    constant, menu = F.col("same") >= CONSTANT * F.col("n"), F.col("links") > LINKS * F.col("chars")
    counts = counts.where((F.col("n") >= PAGES) & (constant | menu))
    # per host: constant elements, those of them that are so even where marked, and menus
    of = lambda c, name: F.collect_set(F.when(c, F.col("place"))).alias(name)
    removed = common.save(counts.groupBy("host").agg(of(constant, "same"), of(constant & (F.col("n") >= MARKED_PAGES), "always"), of(menu, "menus")), "template")
    out = found.select("page_id", "url", "host", "bucket", "texts", "slots", "marked")
    if common.within(removed, SENT_TEMPLATES):
        out = out.join(F.broadcast(removed), "host", "left")
    else:
        buckets = found.groupBy("host").agg(F.max("bucket").alias("buckets"))
        removed = removed.join(buckets, "host").withColumn("bucket", F.explode(F.sequence(F.lit(0), "buckets"))).drop("buckets")
        out = out.join(removed, ["host", "bucket"], "left")
    has = lambda name, x: F.coalesce(F.array_contains(name, x), F.lit(False))

    def stays(x: Column) -> Column:
        place = F.when(x["slots"] <= -2, -2 - x["slots"]).otherwise(x["slots"])
        same = x["slots"] >= 0
        return ~F.when(x["marked"], same & has("always", place)).otherwise((same & has("same", place)) | has("menus", place))

    all_ = F.arrays_zip("texts", "slots", "marked")
    kept = F.filter(all_, stays) if template else all_
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.filter(all_, lambda x: x["marked"]))
    text = F.array_join(F.transform(kept, lambda x: x["texts"]), "\n\n")
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))

