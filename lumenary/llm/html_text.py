"""The main text of web pages: hints of the markup choose the article, recurring subtrees of a host are its template and go.

A page's markup becomes a tree; elements that are menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or comments by their tag, role or class go. What is left of the article (by tag or role, else by class, else the
whole page without lists of links) is cut into blocks. Each block carries the hash of the innermost block element around
it, with all that element's text. Spark counts on how many pages of a host each subtree stands, and deletes those of
most pages. A subtree within one that recurs recurs itself at least as often, so deleting innermost ones deletes whole
templates. Pages that tell the same don't count as many: each page gives one block, drawn by a hash with a chance in
proportion to its length, as its signature; copies mostly draw the same one, and pages are counted by distinct signatures.
"""

from __future__ import annotations

import hashlib
import math
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: A subtree is template if, at two standard deviations, it stands on this share of a host's pages at least (by Wilson's
#: bound, which asks for four pages out of four, 9 of 10, 60 of 100 and 52 % of many).
SHARE, DEVIATIONS = 0.5, 2.0
#: Hosts with one page in so many are joined by a broadcast: so many rows at most.
FREQUENT = 1_000

TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|<[!?/][^>]*+(?:>|\Z)""", re.S)
HINTS = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Class names of this start say what stands beside an element, not what it is.
ABOUT_OTHERS = re.compile(r"(?:has|with|without|no|is|hide|show)[-_]", re.I)


def _set(words: str) -> frozenset:
    return frozenset(words.split())


VOID = _set("area base br col embed hr img input link meta param source track wbr")
#: Elements whose contents are no markup; all go.
RAW = _set("script style title textarea xmp iframe noembed noframes noscript template svg")
BLOCKS = _set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul")
CELLS = _set("td th")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
#: What an element's start ends: open elements of the second set, looked for up to one of the third.
ENDS = {"li": (_set("li"), _set("ul ol menu dir")), "dt": (_set("dt dd"), _set("dl")), "dd": (_set("dt dd"), _set("dl")), "tr": (_set("tr td th caption"), _set("table")), "td": (CELLS, _set("tr table")), "th": (CELLS, _set("tr table")), "option": (_set("option"), _set("select datalist")), "tbody": (_set("tbody thead tfoot tr td th caption"), _set("table"))}
ENDS |= {"thead": ENDS["tbody"], "tfoot": ENDS["tbody"]}
WALLS = _set("table td th")

DROPPED = _set("nav aside footer form menu dialog button select datalist object canvas audio video map applet search")
ROLES = _set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar")
COMMENTS = _set("comment comments commentlist commenter disqus reply replies respond")
OTHERS = COMMENTS | _set("ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense adsbygoogle sponsor sponsored sponsors promo promos promoted promotion related recommended recommendations teaser teasers")
FRAME = OTHERS | _set("nav navbar navigation menu menus submenu breadcrumb breadcrumbs topbar toolbar pagination pager footer copyright colophon sidebar sidebars aside rail widget widgets banner cookie cookies consent gdpr notice notices popup modal overlay share sharing social newsletter subscribe subscription signup login search searchbox form")
HEADER = _set("header masthead")
CONTENT = _set("article articlebody post entry story content main")


class Node:
    __slots__ = ("tag", "kids", "up", "gone", "role", "words", "size", "links", "within")

    def __init__(self, tag: str, up: Node | None, hints: str = ""):
        self.tag, self.up, self.kids = tag, up, []
        self.size = self.links = self.within = 0
        self.role, self.words = "main" if tag == "main" else "", frozenset()
        if hints and "=" in hints:
            words = set()
            for name, *values in HINTS.findall(hints):
                value, name = "".join(values), name.lower()
                if name == "role" or name == "itemprop":
                    self.role = self.role or ("main" if value.lower() == "main" or value == "articleBody" else value.lower() if name == "role" else "")
                else:
                    words.update(p.lower() for one in value.split() if not ABOUT_OTHERS.match(one) for p in PARTS.findall(one))
            self.words = frozenset(words)
        self.gone = self._gone()

    def _gone(self) -> bool:
        if self.tag in DROPPED or self.role in ROLES:
            return True
        if self.tag == "article" or self.role == "main":
            return bool(self.words & OTHERS)
        if self.words & FRAME:
            return True
        if self.tag == "header" or self.words & HEADER:
            at = self.up  # the head of an article holds its title
            while at is not None and at.tag != "article" and at.role != "main" and not at.words & CONTENT:
                at = at.up
            return at is None and not self.words & CONTENT
        return False


def tree(markup: str) -> Node:
    """The elements of a page, as browsers would nest them, nearly: end tags may be missing or astray."""
    root = Node("", None)
    at, pos, end = root, 0, len(markup)

    def ended(tags, walls, node):
        """The element that contains the nearest open one of `tags`, unless a wall stands before it; else `node` itself."""
        up = node
        while up.up is not None and up.tag not in walls:
            if up.tag in tags:
                return up.up
            up = up.up
        return node

    while pos < end:
        m = TOKEN.search(markup, pos)
        if m is None:
            tail = markup[pos:]
            cut = re.search(r"<[A-Za-z/!?]", tail)  # a tag that the page's end cuts off is none of its text
            at.kids.append(tail[: cut.start()] if cut else tail)
            break
        if m.start() > pos:
            at.kids.append(markup[pos : m.start()])
        pos = m.end()
        name = (m[2] or "").lower()
        if not name or name in ("html", "head", "body"):
            continue
        if m[1]:
            if name in BLOCKS or name in CELLS:
                at = ended((name,), WALLS - {name} if name not in ("tr", "tbody", "thead", "tfoot", "caption") else ("table",), at)
            else:
                at = ended((name,), BLOCKS | CELLS, at)
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(markup, pos)
            pos = close.end() if close else end
            continue
        if name in BLOCKS:
            at = ended(("p",), BLOCKS - {"p"} | CELLS, at)
        if name in HEADINGS and at.tag in HEADINGS:
            at = at.up
        if name in ENDS:
            at = ended(*ENDS[name], at)
        if name in VOID:
            at.kids.append("\n" if name == "br" else Node("hr", at) if name == "hr" else "")
            continue
        node = Node(name, at, m[3])
        at.kids.append(node)
        at = node
    return root


def _walk(top: Node):
    """(node, whether it begins) for each element under `top` that isn't gone, in page order; None and a text for texts."""
    yield top, True
    todo = [(top, iter(top.kids))]
    while todo:
        node, kids = todo[-1]
        for kid in kids:
            if isinstance(kid, str):
                yield None, kid
            elif not kid.gone:
                yield kid, True
                todo.append((kid, iter(kid.kids)))
                break
        else:
            todo.pop()
            yield node, False


def _measure(root: Node) -> list[Node]:
    """All elements that aren't gone, with the length of their text and of that in links, and the number of links."""
    found, open_, linked = [], [], 0
    for node, what in _walk(root):
        if node is None:
            n = len("".join(what.split()))
            open_[-1].size += n
            open_[-1].links += n if linked else 0
        elif what:
            node.size = node.links = node.within = 0
            found.append(node)
            open_.append(node)
            linked += node.tag == "a"
        else:
            open_.pop()
            linked -= node.tag == "a"
            if open_:
                up = open_[-1]
                up.size, up.links, up.within = up.size + node.size, up.links + node.links, up.within + node.within + (node.tag == "a")
    return found


def _outer(nodes: list[Node]) -> list[Node]:
    """Those that none of the others contains, in page order."""
    chosen = {id(n) for n in nodes}

    def inside(n):
        up = n.up
        while up is not None:
            if id(up) in chosen:
                return True
            up = up.up
        return False

    return [n for n in nodes if not inside(n)]


def _roots(root: Node) -> list[Node]:
    """The elements that hold the main text."""
    found = _measure(root)
    if not root.size:  # all of it within one form, or an element of a misleading class: what it holds counts
        def opened(node):
            return [k for k in node.kids if isinstance(k, Node)]

        todo, best = opened(root), None
        while todo:
            node = todo.pop()
            if node.gone and node.tag not in ("nav", "aside", "footer", "menu", "button", "select") and not node.words & OTHERS:
                node.gone = False
                best = node
            todo += opened(node)
        if best is not None:
            found = _measure(root)
    articles = _outer([n for n in found if n.tag == "article" and n.size])
    mains = _outer([n for n in found if n.role == "main" and n.size])
    held = sum(n.size for n in articles)
    if mains and 3 * held < sum(n.size for n in mains):
        return mains
    if articles and 5 * held >= root.size:
        return articles
    named = _outer([n for n in found if n.words & CONTENT and n.tag in BLOCKS and 2 * n.size > root.size])
    for n in found:
        if n.up is not None and n.tag in BLOCKS and n.within >= 3 and 5 * n.links >= 4 * n.size:
            n.gone = True
    return named or [root]


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def blocks(markup: str | None) -> list[tuple[int, str]]:
    """The blocks of a page's main text in page order: (hash of the innermost block element, text)."""
    if not markup:
        return []
    out: list[list] = []
    for top in _roots(tree(markup)):
        pieces, around = [], [[top.tag, [], []]]  # of each open block element: tag, what it holds, its own blocks

        def flush():
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                out.append([0, text])
                around[-1][1].append(text)
                around[-1][2].append(out[-1])

        def close():
            tag, held, own = around.pop()
            mark = _hash(tag, *held)
            for block in own:
                block[0] = mark
            if around:
                around[-1][1].append(f"\x01{mark}")

        for node, what in _walk(top):
            if node is None:
                pieces.append(unescape(what) if "&" in what else what)
            elif node.tag in CELLS:
                pieces.append(" ")
            elif node.tag in BLOCKS and node is not top:
                flush()
                if what:
                    around.append([node.tag, [], []])
                else:
                    close()
        flush()
        close()
    return [(mark, text) for mark, text in out]


def signature(found: list[tuple[int, str]]) -> int | None:
    """One of a page's blocks, by hash, each with a chance in proportion to its length; None for a page without any."""
    if not found:
        return None
    best = min(((-math.log((_hash("s", text) + (1 << 63) + 0.5) / (1 << 64)) / len(text), text) for _, text in found))
    return _hash(best[1])


def _parse(batches):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("mark", pa.int64()), ("text", pa.string())]))
    for batch in batches:
        marks, rows = [], []
        for markup in batch.column(3):
            found = blocks(markup.as_py())
            marks.append(signature(found))
            rows.append([{"mark": m, "text": t.encode("utf-8", "replace").decode()} for m, t in found])
        yield pa.record_batch([*batch.columns[:3], pa.array(marks, pa.int64()), pa.array(rows, kind)], names=["page_id", "url", "host", "sign", "blocks"])


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, sign, blocks) of `pages` (page_id, url, html); host is null where the url has none."""
    url = F.col("url").cast("string")
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]+)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.nullif(host, F.lit("")).alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(T.trimmed(_parse), "page_id long, url string, host string, sign long, blocks array<struct<mark: long, text: string>>")


def templates(rows: DataFrame) -> DataFrame:
    """(host, marks): the subtrees of each host's template, from parsed pages.

    A host has at most 1 / SHARE times as many as its pages have blocks on average, whatever their number.
    """
    seen = rows.where("host is not null and sign is not null")
    pages = seen.select("host", "sign").distinct().groupBy("host").agg(F.count("*").alias("n"))
    marks = seen.select("host", "sign", F.explode(F.array_distinct("blocks.mark")).alias("mark")).distinct()
    held = marks.groupBy("host", "mark").agg(F.count("*").alias("k")).where(F.col("k") >= 2)
    p, z = F.col("k") / F.col("n"), DEVIATIONS
    low = (p + z * z / (2 * F.col("n")) - z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    return held.join(pages, "host").where(low >= SHARE).groupBy("host").agg(F.collect_list("mark").alias("marks"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages` (page_id, url, html).

    Null and empty html give an empty text; pages without a host in their url have no template; page_id may be null or
    repeat, each row gets a row, and equal pages of a host count as one; very long pages are read whole; an empty table
    gives an empty one; other columns are ignored, whatever their names. Character references are decoded, white space
    within a block is one space (line breaks and table cells too), blocks are joined by a line feed.
    """
    rows = T.checkpoint(parsed(pages))
    common = T.checkpoint(templates(rows))
    counts = rows.where("host is not null").groupBy("host").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    often = counts.crossJoin(F.broadcast(total)).where(F.col("n") * FREQUENT >= F.col("total")).select("host", F.lit(True).alias("often"))  # one row
    often = T.checkpoint(often.join(common, "host", "left"))
    split = rows.join(F.broadcast(often), "host", "left")  # FREQUENT rows at most
    few = split.where("host is not null and often is null").drop("often", "marks").join(common.hint("merge"), "host", "left")
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("marks", b["mark"]), F.lit(False)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    both = split.where("host is null or often").select("page_id", "url", text.alias("text")).unionByName(few.select("page_id", "url", text.alias("text")))
    return both.withColumn("n_chars", F.char_length("text").cast("long"))


def op13_html(spark, sf_dir: str) -> DataFrame:
    return main_text(T.table(spark, sf_dir, "pages"))
