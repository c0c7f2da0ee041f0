"""Main text of web pages by two-pass block rules.

A page is read once, tag by tag. Text outside what is never article (menus, site headers and footers, asides, forms,
scripts, styles, and containers named as adverts, notices, comments and the like) falls into blocks. Pass one decides
blocks by length, link density and stop-word density: links can make a block false, stop words only true. Pass two gives
the label of the nearest decided neighbours to blocks that pass one left open: of two that differ, that of the nearer
one, and if both are as near, text in an ``article`` or ``main`` and not text elsewhere; a paragraph is text if either is; a heading goes with what follows. An ``article`` or ``main`` element allows more
links and decides where nothing else does; blocks outside are judged as if it were not there.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, table

#: Elements by what they mean for blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head nav footer aside form script style noscript template iframe object svg math canvas select button textarea dialog menu audio video map title".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of containers that hold no article text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies copyright disclaimer disqus footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination popup privacy promo promotion recommended related reply respond search "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: Words that tell where or how a container stands. Any other word in a name says that it is about something.
FRAME = frozenset(
    "area articles bar block body bottom box btn button buttons card cards center col collapse column container content count desktop fixed follow "
    "global grid group head hidden icon icons inner item items js latest layout left line link links list main media message mobile module more news "
    "outer page panel posts primary right row secondary section side site slot sticky stories text theme title tools top unit wrap wrapper zone".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status".split())
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with his they at be this have from or had by not but what all were we when your "
    "der die das und ist im von zu den mit des auf ein eine nicht als auch es an sich dem er sie nach bei um aus wie "
    "le la les un une et est dans que qui pour pas sur au du avec ce il par plus "
    "el los las una y en es por con para su se lo como mas pero sus del al".split()
)

_TAG = re.compile(r"<!--|<[!?]|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|</?([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.I)
_PART = re.compile(r"[^\W\d_]?[^\W\d_A-Z]+|[A-Z]+|\d+")
_WORD = re.compile(r"[^\W\d_]+")

SHORT, LONG = 70, 200
LINKS, ARTICLE_LINKS = 0.33, 0.8
STOP_HIGH = 0.32


def _named(name: str, in_article: bool) -> bool:
    """Whether a class or id names a container of no article text: its words are of ``NAMES``, but for words of ``FRAME``
    and fewer others than hits, so that "share-buttons" does and "share-price" or "ad-free" do not."""
    parts = [p.lower() for p in _PART.findall(name)]
    if not parts or not {"has", "with", "no", "not", "without"}.isdisjoint(parts):
        return False
    names = NAMES - {"header"} if in_article else NAMES
    hits = sum(p in names for p in parts)
    others = sum(p not in names and p not in FRAME and len(p) > 2 and not p.isdigit() for p in parts)
    return "".join(parts) in names or hits > others


def _closed(attributes: str) -> bool:
    """Whether a tag closes itself: its last slash is not the end of an unquoted value."""
    if not attributes.endswith("/"):
        return False
    last = attributes.split()[-1]
    return "=" not in last or last[-2:-1] in ("'", '"')


def _dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NEVER or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for name, *values, hidden in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if hidden or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and any(_named(v, in_article) for v in value.split()):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def blocks(page: str) -> Iterator[tuple[str, int, bool, bool]]:
    """Text, characters of it in links, whether in an article, and whether a heading, of blocks outside dropped containers."""
    stack: list[str] = []
    drop_at = None  # depth of the outermost dropped container
    inside = links = linked = 0
    text: list[str] = []
    at = 0

    def take(raw: str) -> int:
        if drop_at is not None or not raw:
            return 0
        plain = entities.unescape(raw)
        text.append(plain)
        return len(plain.strip()) if links else 0

    def block() -> Iterator[tuple[str, int, bool, bool]]:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                yield joined, linked, inside > 0, any(t in HEADINGS for t in stack)
        linked = 0

    while at < len(page):
        found = _TAG.search(page, at)
        if not found:
            linked += take(page[at:])
            break
        linked += take(page[at : found.start()])
        at = found.end()
        if found[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        if found[0] in ("<!", "<?"):
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            continue
        tag, attributes = (found[1] or found[3]).lower(), found[2] or found[4] or ""
        if tag not in INLINE:
            yield from block() if tag != "br" else ()
        if tag == "br" and drop_at is None:
            text.append(" ")
        if found[0][1] == "/":
            if tag in stack:
                while stack:
                    top = stack.pop()
                    links -= top == "a"
                    inside -= top in ARTICLE
                    if drop_at is not None and len(stack) < drop_at:
                        drop_at = None
                    if top == tag:
                        break
            continue
        if tag in VOID or _closed(attributes):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ("p", "li", "a", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1] == tag:
            stack.pop()
            links -= tag == "a"
            if drop_at is not None and len(stack) < drop_at:
                drop_at = None
        stack.append(tag)
        links += tag == "a"
        inside += tag in ARTICLE
        if drop_at is None and _dropped(tag, attributes, inside > 0):
            drop_at = len(stack)
    yield from block()


def first_pass(text: str, linked: int, in_article: bool) -> bool | None:
    """Whether a block is text; None if open. In an article, more links are let pass, and few make no block false."""
    density = linked / max(1, len(text))
    if density > LINKS:
        return None if in_article and density < ARTICLE_LINKS else False
    if "©" in text or len(text) < SHORT:
        return False if density and not in_article else None
    words = _WORD.findall(text.lower())
    return True if sum(w in STOP_WORDS for w in words) >= STOP_HIGH * max(1, len(words)) else None


def second_pass(labels: list[bool | None], headings: list[bool] | None = None, full: list[bool] | None = None, level: bool = False) -> list[bool]:
    """Open blocks take the label of their nearest decided neighbours; of two that differ, the nearer one's, ``level`` if both are as near.

    Open headings take the label of what follows; ``full`` blocks (paragraphs rather than labels) are text if either
    neighbour is. Where nothing is decided, open blocks are not text.
    """
    n = len(labels)
    headings, full = headings or [False] * n, full or [False] * n
    before, after = [(None, n + 1)] * n, [(None, n + 1)] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = (None, n + 1)
        for i in order:
            last = (labels[i], 0) if labels[i] is not None else (last[0], last[1] + 1)
            side[i] = last
    out = []
    for i, label in enumerate(labels):
        if label is None:
            (a, da), (b, db) = before[i], after[i]
            label = bool(b) if headings[i] else bool(a or b) if full[i] else bool(a) if da < db else bool(b) if db < da else bool(a or b) if level else bool(a and b)
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """The article's blocks joined by one space; empty if there are none.

    Blocks in and outside marked articles are judged in the same way, but each by neighbours of their own kind. Where
    stop words tell no text (the page's language may be none of the listed ones), open blocks with few links are text:
    all those in an article, outside those of ``SHORT`` characters, or of ``LONG`` if an article is marked as well.
    """
    found = list(blocks(page or ""))
    marked = any(b[2] for b in found)
    kept = [False] * len(found)
    for inside in (True, False):
        at = [k for k, b in enumerate(found) if b[2] == inside]
        labels = [first_pass(*found[k][:3]) for k in at]
        if True not in labels:
            least = 0 if inside else LONG if marked else SHORT
            labels = [True if x is None and len(found[k][0]) >= least and (inside or "©" not in found[k][0]) else x for k, x in zip(at, labels, strict=True)]
        full = [len(found[k][0]) >= SHORT and "©" not in found[k][0] for k in at]
        for k, x in zip(at, second_pass(labels, [found[k][3] for k in at], full, level=inside), strict=True):
            kept[k] = x
    return " ".join(b[0] for b, own in zip(found, kept, strict=True) if own)


def extract(pages: DataFrame, *keep: str) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages``, and text columns ``keep``; other columns are left out."""
    prepare(pages.sparkSession)
    names = ["page_id", "url", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h) for h in batch.column("html").to_pylist()]
            own = [*map(batch.column, names), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]
            yield pa.RecordBatch.from_arrays(own, [*names, "text", "n_chars"])

    kept = "".join(f", {k} string" for k in keep)
    return pages.select(*names, "html").mapInArrow(run, f"page_id long, url string{kept}, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``, from the whole html.

    A null or empty page has an empty text, markup that never ends is read as far as it goes, repeated rows and null ids
    are returned as they come, an empty table gives no rows, other columns are not read.
    """
    return extract(table(spark, sf_dir, "pages"))


#: The same for pages whose whole article is marked, without names or links in it, as those of the tables are.
ORACLE = r"""
SELECT page_id, url, text, length(text) AS n_chars FROM (SELECT page_id, url, trim(regexp_replace(
  regexp_replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM pages)
"""
