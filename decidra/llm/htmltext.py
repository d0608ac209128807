"""Main-text extraction by consensus host paths.

First pass: every page is parsed, its containers are scored by the share of the page's
prose that they hold, and the best one votes.  A vote names a generalised path: tags and
classes from the root, without digits.  Spark sums the votes per host and path, and every
path with at least SHARE of its host's votes wins.  Second pass: every page is parsed again
and the elements on that of its host's winning paths that holds most of the page's prose are read (of equal ones, the first).  A path fits if
its elements hold nearly all the prose, of whatever blocks, of the page's own best container.  A page that no path fits is read from its own best container.
Pages vote as well on what stands beside their containers: paths with a class that do so on TEMPLATE of a host's pages are parts of its template, and don't
count as prose of a container around them, as on pages whose best container is the whole body.
The page's body as a whole never votes.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are never prose, wherever they stand.  A class name that only begins like one of
them, such as `share-price`, names one outside an article or if half of its text is links.
A header inside the article keeps its headings.  White space (Unicode's, with no-break spaces) inside a block becomes one space; a
line break is white space.

Defined cases: null html gives an empty text; pages without a host share the empty host;
a page without any text outside the parts named above gives an empty text; equal votes go to
the path that sorts first; repeated rows are extracted each; an empty table gives an empty
result; only `page_id`, `url` and `html` are read, so extra columns can't clash; html of any
length is read whole, and nesting may be of any depth.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Winning paths of a host have at least this share of its votes, so they are at most 50.
SHARE = 0.02
#: Shares of a page's prose: to be its best container; of the best container's prose: for a path to be as good as that, for what surrounds it to belong to it.
HOLDS, FITS, NEARLY = 0.8, 0.95, 1.25
#: Share of a host's pages that must have a path beside their containers.
TEMPLATE = 0.5
#: Winning paths of so many bytes in all are broadcast.
BROADCAST_BYTES = 20 << 20

# Element and class names with a meaning.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea title select svg math object canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article body center div main section td html details".split())
CLOSES_P = BLOCKS - frozenset("caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split()) | frozenset("li dd dt".split())
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",), "option": ("option",),
}
#: Elements that an element's implied end can't leave.
SCOPES = frozenset("html body article main section div table ul ol dl td th aside nav footer header form blockquote".split())
BAD_TAGS = frozenset("nav footer aside menu dialog search button label input fieldset".split())
BAD_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar".split())
BAD_WORDS = frozenset("ad ads nav menu rail notice alert gdpr pager share social login related respond reply replies search topbar toolbar".split())
BAD_STARTS = (
    "advert", "adsense", "adslot", "adbox", "adunit", "sponsor", "promo", "banner", "navbar", "navigation", "menu", "breadcrumb", "sidebar", "footer",
    "masthead", "comment", "disqus", "cookie", "consent", "popup", "modal", "overlay", "newsletter", "subscri", "signup", "sharing", "recommend", "widget", "pagination",
)
#: Words of which a class name consists that means the part named; others may mean the article's own matter.
PARTS = frozenset(
    "area bar block body bottom box button buttons center col column container content current fixed fluid footer form group header heading holder icon icons "
    "inner item items large left link links list lower main mini mobile outer page panel posts primary right row secondary section site slot small sticky sub text title top upper wrap wrapper".split()
)
#: Words that make a header one of the article, not of the page.
TITLED = frozenset("entry post article story content".split())
UNLESS = ("has-", "with-", "no-", "without-", "is-", "not-")

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z_:][-a-zA-Z0-9_:.]*)")
NAMES = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "step", "key", "bad", "classes", "attributes", "prose", "has_article", "headed")

    def __init__(self, tag: str, parent: int, step: str, key: int, classes: list[str], attributes: dict[str, str]):
        self.tag, self.parent, self.step, self.key, self.classes, self.attributes = tag, parent, step, key, classes, attributes
        self.bad, self.prose, self.has_article, self.headed = 0, 0, False, False


def key_of(step: str, above: int) -> int:
    """A path's hash from its last step's and the hash of the path above."""
    import xxhash

    return xxhash.xxh3_64_intdigest(step.encode(), above)


def path_key(path: str) -> int:
    out = 0
    for step in path.split(">"):
        out = key_of(step, out)
    return out


def is_bad_class(name: str) -> bool:
    if name.startswith(UNLESS):
        return False
    return any(w in BAD_WORDS or w.startswith(BAD_STARTS) for w in NAMES.findall(name))


def is_doubtful(name: str) -> bool:
    """Whether a bad class name has words that don't belong to the name of such a part."""
    words = NAMES.findall(name)
    return words[0] not in ("ad", "ads") and any(w not in BAD_WORDS and w not in PARTS and not w.startswith(BAD_STARTS) for w in words)


class Page:
    """A parsed page: nodes in document order, and blocks (node, text, characters in links)."""

    def __init__(self, source: str | None):
        self.nodes = [Node("", -1, "", 0, [], {})]
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(source or "")
        self._judge()

    def _parse(self, source: str) -> None:
        stack, open_, linked = [0], [], [0, 0]
        nodes, blocks = self.nodes, self.blocks
        # Of each open element the block that its text belongs to, and how many elements of a tag are open: neither is searched for in the stack.
        holder, opened = [0], Counter()

        def flush() -> None:
            if open_:
                text = " ".join(entities.unescape("".join(open_)).split())
                if text:
                    blocks.append((holder[-1], text, linked[1]))
                open_.clear()
            linked[1] = 0

        def pop(to: int) -> None:
            while len(stack) > to:
                tag = nodes[stack[-1]].tag
                if tag in BLOCKS:
                    flush()
                elif tag == "a":
                    linked[0] -= 1
                opened[tag] -= 1
                holder.pop()
                stack.pop()

        at, size = 0, len(source)
        while at < size:
            m = TOKEN.match(source, at)
            at = m.end()
            text = m["text"]
            if text is not None:
                open_.append(text)
                if linked[0] > 0:
                    linked[1] += len(text.strip())
                continue
            tag = m["tag"] or m["tag2"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"] or m["end2"]:
                if tag in VOID or tag in RAW:
                    if tag == "br":
                        open_.append(" ")
                    continue
                for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if nodes[stack[k]].tag == tag:
                        pop(k)
                        break
                    if tag not in BLOCKS and nodes[stack[k]].tag in SCOPES:
                        break
                continue
            rest = m["rest"] or m["rest2"] or ""
            if tag in RAW:
                if not rest.endswith("/") or tag not in ("svg", "math", "object", "canvas"):
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    at = end.end() if end else size
                open_.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                else:
                    open_.append(" " if tag == "br" else "")
                continue
            if tag in ("html", "body") and opened[tag]:
                continue
            if tag in CLOSES_P:
                self._close(stack, ("p",), opened, pop)
            if tag in CLOSED_BY:
                self._close(stack, CLOSED_BY[tag], opened, pop)
            if tag in HEADINGS and nodes[stack[-1]].tag in HEADINGS:
                pop(len(stack) - 1)
            if tag in BLOCKS:
                flush()
            attributes = {}
            if rest:
                for a in ATTRIBUTE.finditer(rest):
                    attributes.setdefault((a[1] or a[5]).lower(), entities.unescape(a[2] or a[3] or a[4] or ""))
            classes = attributes.get("class", "").lower().split()
            general = sorted({re.sub(r"[0-9>]+", "", c) for c in classes} - {""})
            step = ".".join([tag, *general])
            nodes.append(Node(tag, stack[-1], step, key_of(step, nodes[stack[-1]].key), classes, attributes))
            if tag == "a":
                linked[0] += 1
            opened[tag] += 1
            holder.append(len(nodes) - 1 if tag in BLOCKS else holder[-1])
            stack.append(len(nodes) - 1)
        flush()

    def _close(self, stack: list[int], tags: tuple[str, ...], opened: Counter, pop) -> None:
        """The implied end of the nearest open element of `tags`, and of those above it in turn."""
        while any(opened[t] for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                tag = self.nodes[stack[k]].tag
                if tag in tags:
                    pop(k)
                    break
                if tag in SCOPES:
                    return
            else:
                return

    def _judge(self) -> None:
        nodes = self.nodes
        for n in nodes[:0:-1]:
            if n.tag in ("article", "main", "h1") or n.has_article:
                n.has_article = True
                nodes[n.parent].has_article = True
        inside, sizes = [False] * len(nodes), None
        for i, n in enumerate(nodes):
            if not i:
                continue
            over = nodes[n.parent]
            inside[i] = inside[n.parent] or n.tag in ("article", "main")
            own = 0
            if n.tag not in ("html", "body", "main"):
                names = [*n.classes, n.attributes.get("id", "").lower()]
                heads = n.tag == "header" or any(not c.startswith(UNLESS) and "header" in NAMES.findall(c) for c in names)
                style = n.attributes.get("style", "").replace(" ", "").lower()
                bad = list(filter(is_bad_class, names))
                if n.tag in BAD_TAGS or n.tag == "form" and not n.has_article or n.attributes.get("role", "").lower() in BAD_ROLES:
                    own = 1
                elif bad and not (inside[i] and all(map(is_doubtful, bad))):
                    own = 1
                elif bad:
                    sizes = sizes or self._sizes()
                    own = int(2 * sizes[i][1] >= sizes[i][0])
                elif "hidden" in n.attributes or n.attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
                    own = 1
                elif heads and n.tag not in HEADINGS:
                    titled = any(w in TITLED for c in names for w in NAMES.findall(c))
                    own = 2 if inside[n.parent] or titled else 1
            n.bad = 1 if over.bad == 1 or own == 1 else 2 if over.bad == 2 or own == 2 else 0
            n.headed = n.tag in HEADINGS or i > 0 and over.headed
        for at, text, in_links in self.blocks:
            if self.good(at):
                nodes[at].prose += max(0, len(text) - 2 * in_links)
        # Nodes come after their parents, so sums go up in one pass from the end.
        for n in nodes[:0:-1]:
            nodes[n.parent].prose += n.prose

    def _sizes(self) -> list[list[int]]:
        """Of each node the characters of its text, and those of them in links."""
        out = [[0, 0] for _ in self.nodes]
        for at, text, in_links in self.blocks:
            out[at][0] += len(text)
            out[at][1] += in_links
        for i in range(len(self.nodes) - 1, 0, -1):
            for k in (0, 1):
                out[self.nodes[i].parent][k] += out[i][k]
        return out

    def good(self, at: int) -> bool:
        """Whether a block is prose: a header inside the article keeps its headings."""
        n = self.nodes[at]
        return not n.bad or n.bad == 2 and n.headed

    def best(self) -> int:
        """The container that holds most of the prose and as little else as can be."""
        nodes = self.nodes
        least = HOLDS * nodes[0].prose
        if not least:
            return 0
        articles = [i for i, n in enumerate(nodes) if n.tag == "article" and not n.bad and 2 * n.prose >= nodes[0].prose]
        if articles:
            # The outermost of those that hold most of the prose.
            return max(articles, key=lambda i: (nodes[i].prose, -i))
        at = max((i for i, n in enumerate(nodes) if n.prose >= least and (n.tag in CONTAINERS or not i) and not n.bad), default=0)
        up, main = at, None
        while up > 0:
            main = up if nodes[up].tag == "main" else main
            up = nodes[up].parent
        if main:
            return main
        heading = next((i for i, n in enumerate(nodes) if n.tag == "h1" and self.good(i)), 0)
        at = self._around(at, heading) if heading else at
        up = nodes[at].parent
        while up > 0 and nodes[up].tag in CONTAINERS and nodes[up].tag not in ("body", "html") and nodes[up].prose <= NEARLY * nodes[at].prose:
            # A little more prose beside it: headings, short blocks.
            at, up = (up if nodes[up].prose > nodes[at].prose else at), nodes[up].parent
        return at

    def _around(self, at: int, heading: int) -> int:
        """The nearest container of both, unless that is the page itself."""
        above, up = {at}, at
        while up > 0:
            up = self.nodes[up].parent
            above.add(up)
        up = heading
        while up not in above:
            up = self.nodes[up].parent
        return at if self.nodes[up].tag in ("body", "html", "") else up

    def votes(self) -> list[tuple[str, float]]:
        """(path, share of the prose) of the best container, unless that is the page itself."""
        at, nodes = self.best(), self.nodes
        if not nodes[0].prose or nodes[at].tag in ("", "html", "body"):
            return []
        share, steps = nodes[at].prose / nodes[0].prose, []
        while at > 0:
            steps.append(nodes[at].step)
            at = nodes[at].parent
        return [(">".join(reversed(steps)), share)]

    def beside(self) -> set[int]:
        """Hashes of the paths, with a class, of what stands beside the best container or one around it, unless that is the page itself."""
        at, nodes = self.best(), self.nodes
        if not nodes[0].prose or nodes[at].tag in ("", "html", "body"):
            return set()
        around, up = set(), at
        while up >= 0:
            around.add(up)
            up = nodes[up].parent
        return {n.key for i, n in enumerate(nodes) if i not in around and n.parent in around and n.parent != at and "." in n.step and not n.bad}

    def read(self, paths: list[str] | None, beside: list[str] | None = None) -> str:
        """The text of the elements on the path that fits and holds most, or else of the best container; `beside` are hashes of paths of the host's template."""
        nodes = self.nodes
        own = self.best()
        places: dict[int, list[int]] = {path_key(p): [] for p in paths or ()}
        template = {int(p) for p in beside or ()} - set(places)
        parts = set()
        for i, n in enumerate(nodes):
            if n.key in places and i and n.bad != 1:
                places[n.key].append(i)
            elif n.key in template and i != own:
                parts.add(i)
        within = self._below({own})
        if parts:
            within = [w and not part for w, part in zip(within, self._below(parts), strict=True)]
        least = FITS * self._held(within)
        most = 0
        for found in places.values():
            taken = found and self._below(set(found))
            held = self._held(taken) if taken else 0
            if held >= least and held > most:
                best, most = taken, held
        if most:
            within = best
        return "\n\n".join(text for at, text, _ in self.blocks if within[at] and self.good(at))

    def _below(self, wanted: set[int]) -> list[bool]:
        """Of each node whether it is one of `wanted` or inside one."""
        out = [False] * len(self.nodes)
        for i, n in enumerate(self.nodes):
            out[i] = i in wanted or (i > 0 and out[n.parent])
        return out

    def _held(self, taken: list[bool]) -> int:
        return sum(max(0, len(text) - 2 * in_links) for at, text, in_links in self.blocks if taken[at] and self.good(at))


def host(url: Column) -> Column:
    """The lower-case host of a url, empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def ballots(pages: DataFrame) -> DataFrame:
    """host, path, beside, votes: summed over all pages of a host.  A page has a thousand votes at most for its container, and one for each path (its hash) beside it."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(host(F.col("url")).alias("__host"), F.col("html").alias("__html"))

    def run(batches):
        for batch in batches:
            found = []
            for name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source)
                found += [(name, path, False, round(share * 1000), 1) for path, share in page.votes()]
                found += [(name, str(path), True, 1, 1) for path in page.beside()]
            columns = list(zip(*found, strict=True)) or [()] * 5
            types = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "path", "beside", "votes", "pages"])

    cast = rows.mapInArrow(run, "host string, path string, beside boolean, votes long, pages long")
    return cast.groupBy("host", "path", "beside").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages"))


def winners(votes: DataFrame) -> DataFrame:
    """host, its winning paths, those of most votes first, and the paths of its template; `votes` is a materialized table."""
    every = votes.where("NOT beside").groupBy("host").agg(F.sum("votes").alias("all"), F.sum("pages").alias("all_pages"))
    leading = (~F.col("beside")) & (F.col("votes") >= SHARE * F.col("all"))
    common = F.col("beside") & (F.col("pages") >= TEMPLATE * F.col("all_pages"))
    # At most 1 / SHARE leading rows of a host are left, and 1 / TEMPLATE times as many common ones as a page has on average.
    left = votes.join(every, "host").where(leading | common)
    row = F.struct((-F.col("votes")).alias("v"), "path")
    paths = F.transform(F.sort_array(F.collect_list(F.when(~F.col("beside"), row))), lambda x: x["path"])
    return left.groupBy("host").agg(paths.alias("paths"), F.sort_array(F.collect_list(F.when(F.col("beside"), F.col("path")))).alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of `pages`."""
    chosen = materialize(winners(materialize(ballots(pages), "ballots")), "hosts").withColumnRenamed("host", "__host")
    size = chosen.agg(F.sum(F.octet_length("__host") + F.aggregate(F.concat("paths", "template"), F.lit(64), lambda a, p: a + 16 + F.octet_length(p)))).first()[0]
    small = (size or 0) <= BROADCAST_BYTES
    rows = pages.select("page_id", "url", F.col("html").alias("__html")).withColumn("__host", host(F.col("url")))
    # Beyond that size, a shuffle join, whose hot hosts adaptive execution splits.
    rows = rows.join(F.broadcast(chosen) if small else chosen, "__host", "left").select("page_id", "url", "__html", "paths", "template")
    ids = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [Page(source).read(paths, template) for source, paths, template in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {ids}, url string, text string, n_chars long")


def op1(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
