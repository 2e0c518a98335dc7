"""HTML extraction by consensus host paths.

Every page's containers are scored by the words of their text, less what stands in links and in parts that are not
content. A page votes for its best container's path of tags and classes, generalised (digits dropped, classes in
order). The votes of a host are added up in Spark; then every page is read again and the text is taken from the
containers on the winning path with most votes that holds a fair share (``FAIR``) of the score of the page's own best
container, else from that. A path does not take content away: text of the page's own best container stays too, unless its path
is one that more of the host's pages leave out of their best containers than hold in them.

A path wins if at least two pages and ``SHARE`` of the host's vote are for it, so a host has 1 / ``SHARE`` (1,000) winning paths at
most; beyond them pages are read from their own best containers, whose text stays anyway. A path that one page alone has voted for is that page's own best container.

Plan: two maps over the pages with a small aggregation between. Votes are summed before the shuffle, so a host with a
third of all pages costs no more than its few paths. Paths are 64-bit hashes, made step by step. The winning paths go to
the pages by broadcast if they are at most ``BROADCAST``, else by a join that adaptive execution can split. Reading a page
takes time in proportion to its length, however deep its elements are and whatever it leaves open.

Defined results: a null or empty page gives empty text and 0 characters; pages of a null or odd url have no host and are read
from their own best container; repeated rows and null page_ids keep one result row each; an empty table gives an empty result; other columns are
ignored. Unclosed and crossed tags are repaired; a quoted value that never ends goes up to the next ``>``; a tag that the end of the page
cuts off is dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, strings, written

#: The part of its host's vote that a path must have to win.
SHARE = 0.001
#: The part of the score of a page's own best container that the containers on a winning path must have.
FAIR = 0.2
#: Winning paths, and paths that are left out, that are broadcast at most.
BROADCAST = 1_000_000

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
COMMENT_END = re.compile(r"--!?>")
#: An attribute's name, and the equals sign and what begins its value, if it has one.
NAME = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*([^\s>])?)?")
GAP = re.compile(r"[\s/]*")
BARE = re.compile(r"[^\s>]*")
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = set("article body div main section td".split())
#: Elements whose text is never content.
SKIPPED = set("nav footer aside form script style noscript template svg math iframe object audio video canvas button select textarea title head dialog menu xmp noembed noframes datalist fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words that mark an element as something else than content, if its class or id is made of them and of LAYOUT words alone.
MARKS = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pager pagination share sharing social comment comments respond reply replies disqus related recommended newsletter subscribe signup login footer masthead toolbar widget".split())
#: Words that may stand beside those in a class or id ("cookie-bar", "comment-list"); beside others ("share-price") they mark nothing.
LAYOUT = set("area bar block body bottom box btn button buttons card center column container content count desktop dropdown entry fixed float form frame group head header holder icon icons inner item items label layer left link links list main mobile module notification outer overlay page panel post posts primary right row secondary section site slot sticky text thread title top unit view wrap wrapper".split())
#: An opening tag of the first kind closes an open element of the second, up to the nearest of the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


#: For every kind of list or table part: the tags that are told apart when one of them opens.
SCOPES = sorted({(frozenset(ends), frozenset(walls)) for ends, walls in CLOSES.values()}, key=lambda x: sorted(x[0]) + sorted(x[1]))
SCOPE_OF = {tag: SCOPES.index((frozenset(ends), frozenset(walls))) for tag, (ends, walls) in CLOSES.items()}
IN_SCOPES = {tag: [k for k, (ends, walls) in enumerate(SCOPES) if tag in ends or tag in walls] for tag in set().union(*(e | w for e, w in SCOPES))}


class Node:
    """An element that is no inline one: what it is, whether its text counts, and the words in it and below it."""

    __slots__ = ("tag", "key", "parent", "skip", "content", "noise", "order", "depth", "level", "scopes", "titled", "header", "in_article")

    def __init__(self, tag: str, key: int, parent: Node | None, skip: bool, order: int, depth: int):
        self.tag, self.key, self.parent, self.skip, self.order, self.depth = tag, key, parent, skip, order, depth
        self.content = self.noise = 0.0
        self.titled = False
        #: The nearest header that this stands in, and whether it stands in an article.
        self.header = self if tag == "header" else parent.header if parent else None
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))
        self.level = parent.level + 1 if parent else 0
        #: For each kind of scope, where the nearest element of it stands on the stack.
        self.scopes = parent.scopes if parent else (0,) * len(SCOPES)
        if tag in IN_SCOPES:
            self.scopes = tuple(depth if k in IN_SCOPES[tag] else x for k, x in enumerate(self.scopes))


def _marked(given: dict[str, str]) -> bool:
    style = given.get("style", "").replace(" ", "").lower()
    if (
        given.get("role", "").lower() in ROLES
        or "hidden" in given
        or given.get("aria-hidden", "").lower() == "true"
        or "display:none" in style
        or "visibility:hidden" in style
    ):
        return True
    for name in f"{given.get('class', '')} {given.get('id', '')}".split():
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if not MARKS.isdisjoint(words) and all(w in MARKS or w in LAYOUT or len(w) < 3 for w in words):
            return True
    return False


def step(tag: str, given: dict[str, str]) -> str:
    """One step of a generalised path: the tag, and its classes without digits, in order."""
    classes = sorted({c for x in given.get("class", "").lower().replace(">", " ").split() if (c := re.sub(r"\d+", "", x).strip("-_"))})
    return ".".join([tag, *classes])


def path_key(path: str) -> int:
    """The hash of a path that is written out, as ``>html>body>div.post``."""
    key = 0
    for x in path.split(">")[1:]:
        key = _below(key, x)
    return key


def _below(key: int, step: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(step.encode(errors="surrogatepass"), key)


def read_tag(html: str, at: int, open_quotes: set[str]) -> tuple[dict[str, str], bool, int]:
    """The attributes of the tag whose name ends at ``at``, whether it closes itself, and where it ends (-1: not at all).
    Quotes that are in ``open_quotes`` stand nowhere behind."""
    given: dict[str, str] = {}
    while True:
        found = NAME.match(html, at)
        if not found:
            end = GAP.match(html, at).end()
            return given, html[at:end].endswith("/"), end + 1 if end < len(html) else -1
        name, first = found[1].lower(), found[2]
        at = found.end()
        value = ""
        if first in ("'", '"'):
            end = -1 if first in open_quotes else html.find(first, at)
            if end < 0:
                open_quotes.add(first)
                end = html.find(">", at)
                if end < 0:
                    return given, False, -1
                value, at = html[at:end], end
            else:
                value, at = html[at:end], end + 1
        elif first:
            at = BARE.match(html, at - 1).end()
            value = html[found.end() - 1 : at]
        given.setdefault(name, unescape(value) if "&" in value else value)


def read_page(html: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The block elements of a page, each after those around it, and its blocks of text in page order, each with the element it stands in."""
    top = Node("", 0, None, False, 0, 0)
    nodes, blocks = [top], []
    stack: list[tuple[str, Node]] = [("", top)]  # open elements; inline ones carry the block element around them
    count: Counter[str] = Counter()  # how many of each block element are open
    inline: list[Counter[str]] = [Counter()]  # open inline elements, above each open block element
    text: list[str] = []
    linked = words_in_links = 0

    def flush() -> None:
        nonlocal words_in_links
        if text:
            words = unescape("".join(text)).split()
            text.clear()
            if words:
                node = stack[-1][1]
                blocks.append((node, " ".join(words)))
                links = min(words_in_links, len(words))
                node.content += 0 if node.skip else len(words) - links
                node.noise += len(words) if node.skip else links
        words_in_links = 0

    def close(depth: int) -> None:
        nonlocal linked
        if len(stack) == depth:
            return
        if stack[-1][1].depth >= depth:
            flush()
        while len(stack) > depth:
            tag = stack.pop()[0]
            if tag in INLINE:
                inline[-1][tag] -= 1
                linked -= tag == "a"
            else:
                inline.pop()
                count[tag] -= 1

    def add(raw: str) -> None:
        nonlocal words_in_links
        text.append(raw)
        if linked:
            words_in_links += len(raw.split())

    at, size, missing = 0, len(html), set()
    while at < size:
        start = html.find("<", at)
        if start < 0:
            add(html[at:])
            break
        if start > at:
            add(html[at:start])
        found = TAG.match(html, start)
        if not found:
            if html.startswith("<!--", start):
                end = COMMENT_END.search(html, start + 2)
                at = end.end() if end else size
            elif html.startswith("<![CDATA[", start):
                end = html.find("]]>", start)
                add(html[start + 9 : end if end >= 0 else size].replace("&", "&amp;"))
                at = end + 3 if end >= 0 else size
            elif html.startswith(("<!", "<?"), start):
                end = html.find(">", start)
                at = end + 1 if end >= 0 else size
            else:
                add("<")
                at = start + 1
            continue
        tag = found[2].lower()
        given, alone, at = read_tag(html, found.end(), missing)
        if at < 0:
            break
        if found[1]:
            if tag in INLINE:
                if inline[-1][tag]:  # an inline end tag does not close blocks
                    depth = len(stack) - 1
                    while stack[depth][0] != tag:
                        depth -= 1
                    close(depth)
                elif tag == "br":
                    flush()
            elif count[tag]:
                depth = stack[-1][1].depth
                while stack[depth][0] != tag:
                    depth -= 1
                close(depth)
            elif tag in ("p", "br"):
                flush()
            continue
        if tag in INLINE:
            if tag not in VOID and not alone:
                stack.append((tag, stack[-1][1]))
                inline[-1][tag] += 1
                linked += tag == "a"
            continue
        flush()
        if tag in VOID:
            continue
        if tag in SCOPE_OF:
            depth = stack[-1][1].scopes[SCOPE_OF[tag]]
            if depth and stack[depth][0] in CLOSES[tag][0]:
                close(depth)
        elif stack[-1][1].tag == "p":
            close(stack[-1][1].depth)
        parent = stack[-1][1]
        skip = parent.skip or tag in SKIPPED or tag not in ("html", "body", "article", "main") and _marked(given)
        node = Node(tag, _below(parent.key, step(tag, given)), parent, skip, len(nodes), len(stack))
        nodes.append(node)
        if tag in ("h1", "h2"):
            above = parent.header
            while above is not None and not above.titled:
                above.titled = True
                above = above.parent.header
        stack.append((tag, node))
        count[tag] += 1
        inline.append(Counter())
        if tag in RAW:
            end = RAW[tag].search(html, at)
            at = end.start() if end else size
    flush()
    for node in reversed(nodes[1:]):
        node.parent.content += node.content
        node.parent.noise += node.noise
    return nodes, blocks


def _usable(node: Node) -> bool:
    """Whether the text of a block counts: it is in no skipped part, nor in a header, but for one of an article that holds its title."""
    return not node.skip and (node.header is None or node.header.titled and node.header.in_article)


def score(node: Node) -> float:
    """Words of text, weighed by their share of all that stands in the container."""
    total = node.content + node.noise
    return node.content * node.content / total * (1.2 if node.tag in ("article", "main") else 1.0) if total else 0.0


def best(nodes: list[Node]) -> Node | None:
    """The container with the highest score; the innermost of equals."""
    found = [n for n in nodes if n.tag in CONTAINERS and not n.skip and n.content > 0]
    return max(found, key=lambda n: (score(n), n.level, -n.order), default=None)


def extract(html: str, paths: list[str], left: list[str] = ()) -> str:
    """The text in the containers on the first of ``paths`` that holds a fair share of the page, with what else stands in the page's best
    container and on no path of ``left``; else that in its best container, else all of the page's."""
    return extract_by_keys(html, [path_key(p) for p in paths], {path_key(p) for p in left})


def _within(nodes: list[Node], roots: set[int]) -> list[bool]:
    """For each node, whether it or one above it is among ``roots``."""
    out = [False] * len(nodes)
    for n in nodes:
        out[n.order] = n.order in roots or n.parent is not None and out[n.parent.order]
    return out


def extract_by_keys(html: str, keys: list[int], left: set[int] | frozenset[int] = frozenset()) -> str:
    nodes, blocks = read_page(html)
    own = best(nodes)
    mine = within = _within(nodes, {(own or nodes[0]).order})
    if keys and own is not None:
        wanted, on = set(keys), {}
        for n in nodes:
            if n.key in wanted and not n.skip and n.content > 0:
                on.setdefault(n.key, []).append(n)
        for key in keys:
            if key in on and sum(map(score, on[key])) >= FAIR * score(own):
                within = _within(nodes, {n.order for n in on[key]})
                break
    return " ".join(text for node, text in blocks if (within[node.order] or mine[node.order] and node.key not in left) and _usable(node))


def with_host(pages: DataFrame, url: str) -> DataFrame:
    return pages.withColumn("_host", F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html", share: float = SHARE) -> DataFrame:
    """(_host, _paths, _left): the hashes of each host's winning paths, those with most votes first, and of the paths of text that more of
    its pages leave out than hold in their best containers. A page's vote weighs as the logarithm of its container's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math

        for batch in slices(batches, "html"):
            rows = []
            for host, page in zip(batch.column("_host").to_pylist(), strings(batch.column("html")), strict=True):
                nodes, blocks = read_page(page)
                won = best(nodes)
                if won is not None:
                    rows.append((host, signed(won.key), round(1000 * math.log1p(score(won))), 0))
                    mine = _within(nodes, {won.order})
                    inside = {n.key for n, _ in blocks if _usable(n) and mine[n.order]}
                    outside = {n.key for n, _ in blocks if _usable(n) and not mine[n.order]}
                    rows += [(host, signed(k), 0, -1) for k in inside - outside] + [(host, signed(k), 0, 1) for k in outside - inside]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["_host", "path", "vote", "out"])

    votes = with_host(pages, url).where("_host <> ''").select("_host", F.col(html).alias("html")).mapInArrow(run, "_host string, path long, vote long, out long")
    votes = votes.groupBy("_host", "path").agg(F.sum("vote").alias("vote"), F.count_if(F.col("vote") > 0).alias("pages"), F.sum("out").alias("out"))
    # A host's whole vote by partial sums, since a host may hold a third of all pages and have many paths.
    whole = votes.groupBy("_host").agg(F.sum("vote").alias("whole"))
    top = votes.where("pages > 1 OR out > 1").join(whole, "_host")
    wins = (F.col("pages") > 1) & (F.col("vote") >= share * F.col("whole"))
    listed = top.groupBy("_host").agg(F.array_sort(F.collect_list(F.when(wins, F.struct(-F.col("vote"), "path")))).alias("won"), F.collect_list(F.when(F.col("out") > 1, F.col("path"))).alias("_left"))
    return listed.select("_host", F.transform("won", lambda x: x["path"]).alias("_paths"), "_left")


def signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    paths = written(host_paths(pages, url, html), "paths")
    count = paths.agg(F.sum(F.size("_paths") + F.size("_left"))).first()[0] or 0
    near = F.broadcast(paths) if count <= broadcast else paths
    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts, known = [], {}
            for page, host, keys, left in zip(strings(batch.column("html")), *(batch.column(c).to_pylist() for c in ("_host", "_paths", "_left")), strict=True):
                if host not in known:
                    known[host] = [k % (1 << 64) for k in keys or []], {k % (1 << 64) for k in left or []}
                texts.append(extract_by_keys(page, *known[host]))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = with_host(pages, url).select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), "_host").join(near, "_host", "left")
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
