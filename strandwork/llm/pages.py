"""Main text of web pages, by differencing pages of neighbouring addresses.

A page is read as lines: the text of each block element, with the place of the block in the page's
structure. Pages of a host are sorted by path, and every page is paired with its nearest ones, up to
NEAR before and NEAR after it; their lines are aligned by longest common subsequence, and lines that a
neighbour shares are deleted, as a site's own. A neighbour whose own lines are all the page's is a copy
of it, no page of one template, and is passed over. Structure corrects what differencing alone gets
wrong: a line inside an article or main element may be a passage that pages quote, so it stays; and
lines in navigation, forms, comments, adverts and the like go even if no neighbour shares them.
"""

from __future__ import annotations

import bisect
import collections
import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s>/]*)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s>/]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose text is no text of the page; void elements; elements that begin a line.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg", "math", "object", "canvas", "audio", "video", "select", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
SPACES = {"br", "td", "th", "wbr"}
#: An element that a following one of the same set ends, if none of the stoppers is open between.
SIBLINGS = [({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"tr"}, {"table"}), ({"td", "th"}, {"tr", "table"}), ({"option"}, {"select"})]
#: Boilerplate: elements, roles, and words of class and id.
DROP_TAGS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "header", "fieldset", "search"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
DROP_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "aside", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "disclaimer",
    "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion", "recommended",
    "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
#: These may head an article of their own.
TITLES = {"header"}
CONTENT_WORDS = {"article", "articlebody", "content", "entry", "main", "post", "story"}
#: Places of a line: boilerplate, the bare page, a block called content, main, article.
BOILER, BARE, CALLED, MAIN, ARTICLE = range(5)
#: Words that may stand beside one of DROP_WORDS in a class or id; beside any other word, it names something else.
NEUTRAL_WORDS = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "container", "footer", "form", "global", "group", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer",
    "page", "panel", "primary", "right", "secondary", "section", "site", "text", "thread", "top", "wrap", "wrapper",
}
#: Pages before and after a page that it is compared with.
NEAR = 4


def named(value: str, words: set[str]) -> bool:
    """Whether a class or id has a name made of one of ``words``, and of nothing else but neutral words."""
    for name in re.findall(r"[^\s]+", value):
        parts = {x.lower() for x in re.findall(r"[a-z]+|[A-Z][a-z]*|[A-Z]+", name)}
        if parts & words and parts <= words | NEUTRAL_WORDS:
            return True
    return False


def place_of(tag: str, attributes: str, place: int) -> int:
    """The place of an element's text, given that of the element around it."""
    if place == BOILER:
        return BOILER
    drop = DROP_WORDS - TITLES if place >= CALLED else DROP_WORDS
    role, hidden, bad, words = "", False, False, set()
    if attributes.strip() and tag not in ("html", "body"):
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "")
            if name in ("class", "id", "itemprop"):
                bad |= named(value, drop)
                words |= set(re.findall(r"[a-z]+", value.lower()))
            elif name == "role":
                role = value.lower()
            hidden |= name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower())
    if hidden or role in DROP_ROLES or bad or (tag in DROP_TAGS and not (place >= CALLED and tag in TITLES)):
        return BOILER
    if tag == "article" or "articlebody" in words:
        return ARTICLE
    if tag == "main" or role == "main":
        return max(place, MAIN)
    return max(place, CALLED) if words & CONTENT_WORDS else place


def lines(page: str | None) -> list[tuple[str, int]]:
    """The page's lines and their places, in order: references decoded, white space made one space, empty lines left out."""
    page = page or ""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = [("", BARE)]

    def close() -> None:
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                out.append((text, stack[-1][1]))
            held.clear()

    def pop(names: set[str], stoppers: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in stoppers:
                return

    at, endless = 0, set()
    while m := TAG.search(page, at):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in BLOCKS:
            close()
        elif name in SPACES:
            held.append(" ")
        if ends:
            if name not in VOID and any(x[0] == name for x in stack):
                pop({name}, set())
            continue
        if name in VOID:
            continue
        if name in RAW and not attributes.endswith("/"):
            # once an element's end is not found, no later one of its name has an end either
            end = None if name in endless else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if not end:
                endless.add(name)
            if end or name in ("script", "style", "textarea", "title"):
                at = end.end() if end else len(page)
            continue
        if name in BLOCKS:
            pop({"p"}, {x for x in BLOCKS if x != "p"} | {"td", "th"})
        for names, stoppers in SIBLINGS:
            if name in names:
                pop(names, stoppers)
        if attributes.endswith("/") and name not in BLOCKS:
            continue
        place = place_of(name, attributes, stack[-1][1])
        if place != stack[-1][1]:
            close()
        stack.append((name, place))
    held.append(page[at:])
    close()
    return out


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """The places in ``a`` of a longest common subsequence of ``a`` and ``b``, by bit-parallel rows."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    found = {*range(lo), *range(len(a) - hi, len(a))}
    both = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    x = [i for i in range(lo, len(a) - hi) if a[i] in both]
    y = [v for v in b[lo : len(b) - hi] if v in both]
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    # a zero at bit j of row i: the longest common subsequence of the first i lines grows at line j of y
    full = (1 << len(y)) - 1
    rows = [full]
    for i in x:
        row = rows[-1]
        hit = row & where[a[i]]
        rows.append((row + hit | row - hit) & full)
    i, j = len(x), len(y)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.add(x[i])
    return found


def address(url: str | None) -> tuple[str, str]:
    """The host and path of an address; both empty if there is none."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or ""), parts.path.rstrip("/") or "/"
    except ValueError:
        return "", ""


Line = tuple[str, int]


def own_keys(own: list[Line], keys: list[int]) -> set[int]:
    """A page's lines outside boilerplate."""
    return {k for (_, p), k in zip(own, keys, strict=True) if p > BOILER}


def kept(own: list[Line], keys: list[int], others: list[tuple[list[Line], list[int]]]) -> tuple[str, int]:
    """The main text of a page, given its lines and those of its neighbours, the nearest first; and how many lines differencing deleted."""
    mine = own_keys(own, keys)
    shared: set[int] = set()
    for lines_, other in others:
        theirs = own_keys(lines_, other)
        if mine <= theirs or theirs <= mine and theirs:
            continue  # a copy, of the whole page or of a part
        shared |= common_lines(keys, other)
    gone = {i for i in shared if own[i][1] < MAIN}
    rest = [x for i, x in enumerate(own) if i not in gone]
    # the bare page counts only where nothing is called content
    least = CALLED if any(p >= CALLED for _, p in rest) else BARE
    return "\n".join(t for t, p in rest if p >= least), len(gone)


def edges(names: DataFrame, bounds: list[tuple]) -> list[tuple[list[tuple], list[tuple]]]:
    """The NEAR first and the NEAR last distinct keys (host, path, key) of each range between ``bounds``; a task passes on no more of a range than these."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, set[tuple]] = collections.defaultdict(set)
        for batch in batches:
            for key in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "key")), strict=True):
                own = found[bisect.bisect_right(bounds, key)]
                own.add(key)
                if len(own) > 64:
                    held = sorted(own)
                    own -= set(held[NEAR:-NEAR])
        rows = [(b, *key) for b, own in found.items() for key in {*sorted(own)[:NEAR], *sorted(own)[-NEAR:]}]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 4, (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["block", "host", "path", "key"])

    out = [([], []) for _ in range(len(bounds) + 1)]
    key = F.struct("host", "path", "key")
    lists = names.mapInArrow(some, "block int, host string, path string, key long").distinct().groupBy("block").agg(F.array_sort(F.collect_list(key)).alias("keys"))
    for r in lists.select("block", F.slice("keys", 1, NEAR).alias("first"), F.expr(f"slice(keys, -least({NEAR}, size(keys)), {NEAR})").alias("last")).collect():
        out[r["block"]] = ([tuple(x) for x in r["first"]], [tuple(x) for x in r["last"]])
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) and n_shared (lines that differencing deleted) of every row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages of boilerplate only, have an empty text. Pages without a host are
    neighbours of one another. Of pages that repeat an address, the order is by page_id, null first,
    then by content. Hosts of any size are dealt over tasks: a task takes a range of (host, path,
    page_id) and also gets the NEAR pages before and after it, so the text doesn't depend on the
    ranges. Other columns are ignored; a page of any length is one row, read in one pass.
    """
    spark = pages.sparkSession
    n = common.shuffle_partitions(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def read_address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [address(u) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), batch.column("page_id").fill_null(-(1 << 63))], names=["host", "path", "key"])

    names = common.checkpointed(pages.select("url", "page_id").mapInArrow(read_address, "host string, path string, key long"))
    bounds = common.boundaries(names, ["host", "path", "key"], n)
    ends = edges(names, bounds)
    # to which ranges besides its own a key goes: as one of the NEAR after a range, or before it
    also: dict[tuple, list[int]] = collections.defaultdict(list)
    for b in range(len(ends)):
        after = [k for first, _ in ends[b + 1 : b + 1 + NEAR] for k in first][:NEAR]
        before = [k for _, last in ends[max(0, b - NEAR) : b] for k in last][-NEAR:]
        for k in {*after, *before}:
            also[k].append(b)
    row = "block int, guest boolean, host string, path string, key long, tie long, page_id long, url string, lines array<string>, places array<int>, keys array<long>"

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            found = lines(page)
            key = (*address(url), -(1 << 63) if page_id is None else page_id)
            tie = xxhash.xxh3_64_intdigest((page or "").encode()) - (1 << 63)
            rest = (*key, tie, page_id, url, [t for t, _ in found], [p for _, p in found], [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in found])
            out.append((bisect.bisect_right(bounds, key), False, *rest))
            out += [(b, True, *rest) for b in also.get(key, ())]
        kinds = [pa.int32(), pa.bool_(), pa.string(), pa.string(), *[pa.int64()] * 3, pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in row.split(", ")])

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: collections.deque[dict] = collections.deque()  # up to NEAR pages before the next one to be done, and those after it
        done = 0  # pages of the window that are done

        def text() -> tuple | None:
            now = window[done]
            if now["guest"]:
                return None
            near = []
            for k in range(1, NEAR + 1):
                for at in (done + k, done - k):
                    if 0 <= at < len(window) and (window[at]["block"], window[at]["host"]) == (now["block"], now["host"]):
                        near.append((window[at]["own"], window[at]["keys"]))
            found, n_shared = kept(now["own"], now["keys"], near)
            return now["page_id"], now["url"], found, len(found), n_shared

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "text", "n_chars", "n_shared"])

        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                page = batch.slice(i, 1).to_pylist()[0]
                page["own"] = list(zip(page["lines"], page["places"], strict=True))
                window.append(page)
                if len(window) - done > NEAR:
                    rows.append(text())
                    done += 1
                    if done > NEAR:
                        window.popleft()
                        done -= 1
            if rows := [r for r in rows if r]:
                yield out(rows)
        rows = []
        while done < len(window):
            rows.append(text())
            done += 1
        if rows := [r for r in rows if r]:
            yield out(rows)

    dealt = common.map_texts(pages, ["page_id", "url", "html"], "html", read, row).repartitionById(n, F.col("block"))
    return dealt.sortWithinPartitions("block", "host", "path", "key", "tie").mapInArrow(difference, "page_id long, url string, text string, n_chars long, n_shared long")
