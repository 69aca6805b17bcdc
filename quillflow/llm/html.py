"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of their paragraphs without links. A
container votes for its generalised path, tags with classes in which digits are
blurred; votes are summed per host in Spark. In a second pass the text is taken from
the containers at the winning path, or from the page's own best one where the page
has none there. A page takes time and memory in proportion to its length, however
broken its markup: tags are found by plain searches, open elements by their places,
and a path is a running hash.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm.graph import spread_join
from quillflow.llm.staging import small_batches, stage, table

#: Hosts whose winning paths are broadcast at most (some 100 bytes each); more are joined by a shuffle.
BROADCAST_HOSTS = 200_000
NAME, PLAIN = re.compile(r"[a-zA-Z][^\s/>]*+"), re.compile("[^>\"']*+")
ATTR = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))")
#: After so many tags whose end lies in quotes up to the end of the page, quotes don't count in it any more.
BROKEN = 16
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body div main section td".split())
#: An opening tag that ends an open element of these tags, unless one of SCOPE lies between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article aside blockquote body div dl footer form header html main nav ol section table td th ul".split())
AWAY = frozenset("aside button dialog footer form head header iframe input menu nav noscript object option script select style svg template textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in a class or id that mark what isn't the article.
MARKS = frozenset(
    "ad adbox ads adslot advert advertisement advertising adverts alert alerts banner breadcrumb breadcrumbs comment commentform commentlist comments complementary consent contentinfo cookie cookies disqus "
    "footer form gdpr header login mainmenu mainnav masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related replies reply respond "
    "search share sharing sidebar sidenav signup sitenav social sponsor sponsored submenu subnav subscribe subscription toolbar topbar topnav widget".split()
)
#: Words that say nothing beside one of MARKS; next to any other word a mark is only a suspicion.
GENERIC = frozenset(
    "area articles bar block body bottom box button buttons center col column container content contents desktop entry fixed global group head holder icon icons inner item items left link links list main message "
    "mobile module more outer page panel policy post posts primary region right row secondary section site slot small sticky stories story text thread title top unit wrap wrapper zone".split()
)
#: Words in a class or id that suggest the whole article.
WHOLE = frozenset("article content entry post story".split())
#: Whether an element counts, is left out, counts only by its headings, or counts unless it is mostly links.
KEPT, AWAY_ALL, HEADED, SUSPECT = range(4)
_LOWER = {c: c + 32 for c in range(65, 91)}


def host_of(url: str | None) -> str:
    m = re.search(r"://([^/?#]*)", url or "")
    return m[1].translate(_LOWER) if m else ""


def marked(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """How an element and all in it counts.

    Away are tags and roles that say so, and what has a class or id of marks and generic
    words only. An article's own header counts by its headings. A mark beside other
    words, as in ``share-price``, is a suspicion.
    """
    if tag == "header" and in_article:
        return HEADED
    if tag in AWAY or attrs.get("role", "").lower() in ROLES:
        return AWAY_ALL
    if tag in ("html", "body", "main"):
        return KEPT
    found = KEPT
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        words = set(re.split(r"[^a-z0-9]+", name))
        marks = words & ({"comment", "comments", "reply"} if tag == "article" else MARKS)
        if not marks or name.startswith(("has-", "with-", "no-")):
            continue
        if marks == {"header"} and words & WHOLE:
            found = found or HEADED
        elif all(w in marks or w in GENERIC or not w.isalpha() for w in words):
            return AWAY_ALL
        else:
            found = SUSPECT
    return found


@functools.lru_cache(4096)
def described(tag: str, rest: str, in_article: bool) -> tuple[int, str, float]:
    """How a tag with its attributes counts, its step of a path, and its weight as a container."""
    attrs = {k.lower(): x or y or z for k, x, y, z in ATTR.findall(rest)}
    classes = ".".join(sorted(re.sub(r"\d+", "#", x) for x in attrs.get("class", "").split()))
    names = set(re.split(r"[^a-z0-9]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    weight = 1.3 if tag == "article" else 1.1 if tag == "main" or tag != "body" and names & WHOLE else 0.0
    return marked(tag, attrs, in_article), f"{tag}{'.' + classes if classes else ''}", weight


class Page:
    """The text blocks of a page, each with the containers around it."""

    def __init__(self, source: str | None):
        #: path, parent's index, weight of all text within (0: that of its parents fades with each level)
        self.nodes: list[tuple[str, int, float]] = []
        #: text, characters in links, index of the innermost container
        self.blocks: list[tuple[str, int, int]] = []
        self._parse(source or "")

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int, int, bytes, int]] = []  # tag, how it counts, container, path, first block if suspect
        places: dict[str, list[int]] = {}  # where in the stack a tag is open
        scopes: list[int] = []
        parts: list[str] = []
        sums = [(0, 0)]  # characters, and those in links, before each block
        linked, links, at, broken = 0, 0, 0, 0
        last_end, last_quote = source.rfind(">"), {q: source.rfind(q) for q in "\"'"}

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    n = min(linked, len(text))
                    self.blocks.append((text, n, stack[-1][2] if stack else -1))
                    sums.append((sums[-1][0] + len(text), sums[-1][1] + n))
                parts.clear()
            linked = 0

        def close(n: int) -> None:
            """Close open elements down to n of them."""
            nonlocal links
            while len(stack) > n:
                tag, _, _, _, first = stack[-1]
                if tag in BLOCK:
                    flush()
                if first >= 0:  # a suspect is left out if it is mostly links
                    flush()
                    if first < len(self.blocks) and 3 * (sums[-1][1] - sums[first][1]) > sums[-1][0] - sums[first][0]:
                        del self.blocks[first:], sums[first + 1 :]
                links -= tag == "a"
                stack.pop()
                places[tag].pop()
                if scopes and scopes[-1] == len(stack):
                    scopes.pop()

        def said(text: str) -> None:
            nonlocal linked
            if text and not (stack and stack[-1][1] in (AWAY_ALL, HEADED)):
                text = html.unescape(text) if "&" in text else text
                parts.append(text)
                linked += len(text) if links else 0

        def within(tags: tuple[str, ...], floor: int) -> int:
            """The place of the innermost open element of these tags above a place, else -1."""
            found = max((places[t][-1] for t in tags if places.get(t)), default=-1)
            return found if found >= floor else -1

        def tag_end(start: int) -> int:
            """Where the tag ends whose name ends at a place, or -1; a ``>`` in quotes doesn't end it."""
            nonlocal broken
            i = start
            while broken < BROKEN and i <= last_end:
                i = PLAIN.match(source, i).end()
                if i >= len(source):
                    break
                if source[i] == ">":
                    return i
                i = source.find(source[i], i + 1) + 1 if i < last_quote[source[i]] else i + 1
            if start > last_end:
                return -1
            broken += 1
            return source.find(">", start)

        said_to = 0  # what lies before has been said
        while (lo := source.find("<", at)) >= 0:
            at = lo + 1
            if source.startswith("<!--", lo):
                said(source[said_to:lo])
                end = source.find("-->", lo + 4)
                at = said_to = end + 3 if end >= 0 else len(source)
                continue
            if source.startswith(("<!", "<?"), lo):
                if lo < last_end:
                    said(source[said_to:lo])
                    at = said_to = source.find(">", lo) + 1
                continue
            closing = source.startswith("</", lo)
            m = NAME.match(source, lo + 1 + closing)
            end = tag_end(m.end()) if m else -1
            if end < 0:
                continue
            said(source[said_to:lo])
            at = said_to = end + 1
            tag, rest = m[0].translate(_LOWER), source[m.end() : end]
            if closing:
                i = within((tag,), 0 if tag in SCOPE else scopes[-1] + 1 if scopes else 0)
                if i >= 0:
                    close(i)
                continue
            if tag == "br":
                said(" ")
                continue
            if tag in VOID:
                if tag in BLOCK:
                    flush()
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}\b", re.I).search(source, at)
                end = source.find(">", stop.end()) if stop else -1
                at = said_to = end + 1 if end >= 0 else len(source)
                continue
            if tag in BLOCK:
                if (i := within(("p",), scopes[-1] + 1 if scopes else 0)) >= 0:
                    close(i)
                flush()
            if tag in ENDS:
                if tag in ("tr", "td", "th"):
                    floor = places["table"][-1] + 1 if places.get("table") else 0
                else:
                    floor = scopes[-1] + 1 if scopes else 0
                if (i := within(ENDS[tag], floor)) >= 0:
                    close(i)
            _, above, node, path, _ = stack[-1] if stack else ("", KEPT, -1, b"", -1)
            own, step, weight = (described if len(rest) < 200 else described.__wrapped__)(tag, rest, bool(places.get("article")))
            out = above if above == AWAY_ALL or own in (KEPT, SUSPECT) else own
            if above == HEADED:
                out = KEPT if tag in HEADINGS and own in (KEPT, SUSPECT) else HEADED if own != AWAY_ALL else AWAY_ALL
            path = hashlib.blake2b(path + step.encode("utf-8", "replace"), digest_size=12).digest()
            if tag in CONTAINER and out not in (AWAY_ALL, HEADED):
                self.nodes.append((f"{path.hex()}/{step[-200:]}", node, weight))
                node = len(self.nodes) - 1
            if not rest.rstrip().endswith("/") or tag not in ("svg", "path"):
                suspect = own == SUSPECT and out == KEPT
                if suspect:
                    flush()
                places.setdefault(tag, []).append(len(stack))
                if tag in SCOPE:
                    scopes.append(len(stack))
                stack.append((tag, out, node, path, len(self.blocks) if suspect else -1))
                links += tag == "a"
        said(source[said_to:])
        close(0)
        flush()

    def scores(self) -> dict[int, float]:
        """Containers by the text that they hold: all of their own blocks, less of those deeper in.

        An article, or what is named like one, counts all text within in full, so a part of it doesn't win over the whole.
        """
        faded, whole = [0.0] * len(self.nodes), [0.0] * len(self.nodes)
        for text, linked, node in self.blocks:
            if node >= 0:
                worth = max(0, len(text) - 2 * linked)
                faded[node] += worth
                whole[node] += worth
        for i in range(len(self.nodes) - 1, -1, -1):  # those around have smaller indexes
            above = self.nodes[i][1]
            if above >= 0:
                faded[above] += faded[i] / 2
                whole[above] += whole[i]
        return {i: whole[i] * weight if weight else faded[i] for i, (_, _, weight) in enumerate(self.nodes) if whole[i]}

    def votes(self) -> dict[str, float]:
        """Each path's part of the best container's score."""
        scores = self.scores()
        top, found = max(scores.values(), default=0), {}
        for node, s in scores.items():
            path = self.nodes[node][0]
            found[path] = max(found.get(path, 0), s / top)
        return found

    def text(self, path: str | None) -> str:
        """The blocks within the containers at the path, else within the best container, else all."""
        inside = self._inside({i for i, (p, _, _) in enumerate(self.nodes) if p == path})
        if not any(n >= 0 and inside[n] for _, _, n in self.blocks):
            scores = self.scores()
            if not scores:
                return "\n".join(t for t, _, _ in self.blocks)
            inside = self._inside({max(scores, key=lambda i: (scores[i], -i))})
        return "\n".join(t for t, _, n in self.blocks if n >= 0 and inside[n])

    def _inside(self, chosen: set[int]) -> list[bool]:
        """Of each container, whether it is one of the chosen or lies in one."""
        found: list[bool] = []
        for i, (_, above, _) in enumerate(self.nodes):
            found.append(i in chosen or above >= 0 and found[above])
        return found


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[tuple[str, str], float] = {}
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for path, v in Page(source.as_py()).votes().items():
                key = host_of(url), path
                sums[key] = sums.get(key, 0) + v
        hosts, paths = ([k[i] for k in sums] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(sums.values(), pa.float64())], ["host", "path", "votes"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(s.as_py()).text(p) for s, p in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes of each host, the first in order if several."""
    votes = pages.select("url", "html").mapInArrow(_votes, "host string, path string, votes double")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.round("votes", 6), "path")).alias("path"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text and n_chars.

    Blocks are joined by one line feed, white space within a block is one space. A page
    that is null, empty or has no text outside what is left out has an empty text. Pages
    without a host share the empty host. Of paths or containers with equal votes or
    scores the first counts. Pages are read whole, however long or broken. Ids may repeat
    or be null; other columns, whatever their names, aren't read; an empty table gives an
    empty result.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    paths = stage(host_paths(rows), "paths")
    address = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rows.withColumn("host", address)
    if paths.count() <= BROADCAST_HOSTS:
        both = rows.join(F.broadcast(paths), "host", "left")
    else:  # a host may have any share of the pages
        both = spread_join(rows, stage(rows.select("host").distinct().join(paths, "host", "left"), "hosts"), ["host"], "url")
    both = both.select("page_id", "url", "html", "path")
    return both.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract(table(spark, sf_dir, "pages"))
