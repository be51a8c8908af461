"""Main-text extraction from HTML with wrappers inferred per host.

A page is read as a stream of block tags and text slots.  A host's wrapper is a union-free regular expression over such streams
(tags, text slots, optional and repeated groups).  It is inferred by aligning streams one after the other: repeats within a
stream are folded into groups; two streams are aligned on their longest common subsequence; a sequence that is repeated in
one and single in the other becomes a repeated group; what only one has becomes optional; texts that differ make a slot
variable.  Alignment also works between wrappers, so a host's pages are folded where they lie and only wrappers are merged.
Pages of one shape merge into one wrapper in any order; different shapes are aligned in a tree, grouped and ordered by their
hashes, at most about ``FAN`` in a task, so the result does not depend on where pages lie and no task needs all of a host.  A
wrapper that would pass ``MAX_NODES`` nodes is not extended: the host then has a second one, and what both say is added up.

The wrapper selects the text of every page of a host with ``MIN_PAGES`` different pages or more: the slots of all containers
whose text changes and is not mostly links, without the texts that stand on ``CONSTANT_SHARE`` of the host's different pages.
Copies of a page count once.  ``article`` and ``main`` only check that choice, and stand in for it on hosts with fewer pages.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are known by their elements,
roles and class words.

Nulls: a null page is read like an empty one, with an empty text; a null URL has the empty host; null page_ids are kept.
Equal rows give equal texts.  An empty table gives an empty result.
"""

from __future__ import annotations

import difflib
import functools
import hashlib
import html
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import arrow_map, cut, skew_join
from emberlog.llm.urls import host_of

#: Elements by their part in a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
LEFT_OUT = frozenset("head title nav footer aside form button select option menu dialog iframe object canvas audio video label fieldset".split())
ROLES_LEFT_OUT = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())
CLASS_LEFT_OUT = re.compile(r"(?i)(?:^|[-_\s])(?:ads?|advert\w*|banner|cookies?|consent|gdpr|notices?|newsletter|promo\w*|side-?bar|menus?|nav\w*|breadcrumbs?|footer|comments?|respond|disqus|share|sharing|social|related|recommend\w*|popup|modal|overlay|sponsor\w*|subscribe|subscription|skip|toolbar|widget|login|search)(?:[-_\s]|$)")
CLASS_HEADER = re.compile(r"(?i)(?:^|[-_\s])(?:header|masthead|topbar)(?:[-_\s]|$)")
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|math)\b(?>(?:[^>"']|"[^"]*"|'[^']*')*)>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>(?:[^>"']|"[^"]*"|'[^']*')*))>|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
#: Numbers in classes tell pages apart, not places.
_DIGITS = re.compile(r"\d+")
#: A host's wrapper decides from so many different pages; a text on this share of them (and on so many) is boilerplate.
MIN_PAGES, CONSTANT_SHARE = 3, 0.5
#: A container with a larger share of its characters in links is navigation.
LINK_SHARE = 0.5
#: Wrappers merged in one task, and nodes up to which a wrapper grows.
FAN, MAX_NODES = 32, 3_000
#: Elements that are parts of a text; the container of a slot is the innermost element that is none of them.
TEXT_PARTS = frozenset("p li ul ol blockquote h1 h2 h3 h4 h5 h6 pre".split())


class Block:
    """A text block: its text, the path of its containers, whether it is left out, whether an article holds it, linked characters."""

    __slots__ = ("article", "left_out", "links", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], left_out: bool, article: int, links: int):
        self.text, self.path, self.left_out, self.article, self.links = text, path, left_out, article, links


def read_page(source: str) -> tuple[list[Block], list[str | Block]]:
    """(blocks, stream): the stream has the block tags in order, and the blocks in their places."""
    stack: list[tuple[str, str, bool, int]] = []  # name, label, left out, article rank
    blocks: list[Block] = []
    stream: list[str | Block] = []
    pieces: list[str] = []
    linked, link = 0, None  # characters of the pieces in links; depth of the open link

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            links, linked = linked, 0
            if text:
                left, rank = (stack[-1][2], stack[-1][3]) if stack else (False, 0)
                block = Block(text, tuple(s[1] for s in stack), left, rank, min(links, len(text)))
                blocks.append(block)
                stream.append(block)

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            pieces.append(source[at : m.start()])
            if link is not None:
                linked += len(pieces[-1].strip())
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name == "br":
            pieces.append(" ")
            continue
        if name == "a":
            link = None if m["end"] else len(stack)
        block = name in BLOCKS
        if m["end"]:
            if any(s[0] == name for s in stack):
                flush()
                while stack.pop()[0] != name:
                    pass
                if link is not None and len(stack) < link:  # its end tag is missing
                    link = None
            elif block:
                flush()
            if block and name not in CLOSED_BY_SAME:  # those ends may be left out, so they tell nothing
                stream.append("/" + name)
            continue
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(m["rest"])} if m["rest"] else {}
        marks = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        role = attributes.get("role", "").lower()
        parent_left, rank = (stack[-1][2], stack[-1][3]) if stack else (False, 0)
        own = 2 if name == "article" or "articleBody" in attributes.get("itemprop", "") else 1 if name == "main" or role == "main" else 0
        header = name == "header" or bool(CLASS_HEADER.search(marks))
        left = name in LEFT_OUT or role in ROLES_LEFT_OUT or "hidden" in attributes or (header and not rank) or (own == 0 and name not in ("body", "html") and bool(CLASS_LEFT_OUT.search(marks)))
        if not block and not left:
            continue
        flush()
        if name in CLOSED_BY_SAME and stack and stack[-1][0] == name or name in BLOCKS and name != "p" and stack and stack[-1][0] == "p":
            stack.pop()
        label = name + "".join("." + _DIGITS.sub("0", c) for c in attributes.get("class", "").split())
        if block:
            stream.append(label)
        if name not in VOID and not m["rest"].endswith("/"):
            stack.append((name, label, parent_left or left, max(rank, own)))
    tail = source[at:]
    pieces.append(tail)
    flush()
    return blocks, stream


# A wrapper is a list of nodes [kind, name, kids, optional, pages, constant, mass, links].  Kinds: t (tag), s (slot), r (repeated
# group).  A slot's name is its path, its constant the hash of its text, or None once texts differed; mass is the characters it
# held, links those in links.


def node_key(node: list) -> str:
    return "r" + ",".join(map(node_key, node[2])) if node[0] == "r" else node[0] + node[1]


def text_hash(path: str, text: str) -> int:
    return zlib.crc32(f"{path}\n{text}".encode("utf-8", "surrogatepass"))


def merge_nodes(a: list, b: list) -> list:
    kids = [merge_nodes(x, y) for x, y in zip(a[2], b[2], strict=True)]
    return [a[0], a[1], kids, a[3] or b[3], a[4] + b[4], a[5] if a[5] == b[5] else None, a[6] + b[6], a[7] + b[7]]


def merge_same(a: list, b: list) -> list:
    """The wrapper of two wrappers of one shape (of two whose shapes only share a hash: aligned)."""
    if list(map(node_key, a)) != list(map(node_key, b)):
        return align(a, b)
    return [merge_nodes(x, y) for x, y in zip(a, b, strict=True)]


def fold(nodes: list) -> list:
    """Turn adjacent repeats into repeated groups, short periods first; a period is a distance at which some node recurs."""
    done = 0
    while True:
        keys, seen, periods = [node_key(n) for n in nodes], {}, set()
        for k, key in enumerate(keys):
            if key in seen:
                periods.add(k - seen[key])
            seen[key] = k
        numbers = {key: k for k, key in enumerate(seen)}
        codes = np.array([numbers[key] for key in keys])
        for period in sorted(p for p in periods if p > done):
            breaks = np.flatnonzero(np.r_[True, codes[:-period] != codes[period:], True])
            if np.diff(breaks).max() > period:  # a whole period is repeated somewhere
                break
        else:
            return nodes
        done, out, k = period, [], 0
        while k < len(nodes):
            times = 1
            while keys[k : k + period] == keys[k + times * period : k + (times + 1) * period] and len(keys[k : k + period]) == period:
                times += 1
            if times == 1:
                out.append(nodes[k])
                k += 1
                continue
            kids = nodes[k : k + period]
            for t in range(1, times):
                kids = [merge_nodes(x, y) for x, y in zip(kids, nodes[k + t * period : k + (t + 1) * period], strict=True)]
            for kid in kids:
                kid[4] = 1
            out.append(kids[0] if period == 1 and kids[0][0] == "r" else ["r", "", kids, False, 1, None, 0, 0])
            k += times * period
        nodes = out


def page_wrapper(stream: list) -> list:
    nodes = []
    for x in stream:
        if isinstance(x, str):
            nodes.append(["t", x, [], False, 1, None, 0, 0])
        else:
            path = "/".join(x.path)
            nodes.append(["s", path, [], False, 1, text_hash(path, x.text), *((0, 0) if x.left_out else (len(x.text), x.links))])
    return fold(nodes)


def group_singles(nodes: list, other: list) -> list:
    """Where ``other`` has a repeated group, make the same single sequence in ``nodes`` a group of its own."""
    for kids in [n[2] for n in other if n[0] == "r"]:
        want = [node_key(k) for k in kids]
        out, k = [], 0
        while k < len(nodes):
            if [node_key(n) for n in nodes[k : k + len(want)]] == want:
                out.append(["r", "", nodes[k : k + len(want)], False, nodes[k][4], None, 0, 0])
                k += len(want)
            else:
                out.append(nodes[k])
                k += 1
        nodes = out
    return nodes


def align(a: list, b: list) -> list:
    """The wrapper of both."""
    a, b = group_singles(a, b), group_singles(b, a)
    keys = [node_key(n) for n in a], [node_key(n) for n in b]
    if keys[0] == keys[1]:
        return [merge_nodes(x, y) for x, y in zip(a, b, strict=True)]
    out = []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
        if tag == "equal":
            out += [merge_nodes(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [[*n[:3], True, *n[4:]] for n in a[i:j] + b[k:m]]
    return out


def expression(nodes: list) -> str:
    """The wrapper as a regular expression, for reading: # is a slot, (..)? optional, (..)+ repeated."""

    def one(n: list) -> str:
        inside = "#" if n[0] == "s" else f"<{n[1]}>" if n[0] == "t" else "(" + "".join(map(one, n[2])) + ")+"
        return f"({inside})?" if n[3] else inside

    return "".join(map(one, nodes))


def container_of(path: tuple[str, ...]) -> str:
    end = len(path)
    while end and path[end - 1].split(".")[0] in TEXT_PARTS:
        end -= 1
    return "/".join(path[:end])


def page_slots(blocks: list[Block]) -> str:
    """What tells different pages apart: the hashes of a page's texts that are not left out, each once."""
    return ",".join(map(str, sorted({text_hash("/".join(b.path), b.text) for b in blocks if not b.left_out})))


def masses(nodes: list, constants: set[int]) -> dict[str, list[int]]:
    """Per container the characters of changing text that a wrapper's slots hold, and those of them in links."""
    mass: dict[str, list[int]] = {}

    def walk(n: list):
        for kid in n[2]:
            walk(kid)
        if n[0] == "s" and n[6] and n[5] not in constants:
            held = mass.setdefault(container_of(tuple(n[1].split("/"))), [0, 0])
            held[0] += n[6]
            held[1] += n[7]

    for n in nodes:
        walk(n)
    return mass


def summary(constants: str, containers: list[str]) -> str:
    """What extraction needs of a host's wrapper, as JSON: the constant texts' hashes, and the containers of main text."""
    return json.dumps([sorted(int(c) for c in constants.split(",") if c), sorted(containers)])


@functools.lru_cache(64)
def _summarized(text: str) -> tuple[frozenset, frozenset]:
    constant, containers = json.loads(text)
    return frozenset(constant), frozenset(containers)


def choose(source: str, summarized: str | None) -> tuple[str, list[Block]]:
    """(who decides, blocks of the main text): wrapper; or article, or page where there is no article either."""
    held = [b for b in read_page(source)[0] if not b.left_out]
    best = max((b.article for b in held), default=0)
    article = [b for b in held if b.article == best] if best else []
    if summarized:
        constant, containers = _summarized(summarized)
        changing = [b for b in held if text_hash("/".join(b.path), b.text) not in constant]
        inside = [b for b in changing if container_of(b.path) in containers]
        # an article whose changing text was missed altogether shows that the wrapper is wrong about this page
        if inside and (any(b.article == best for b in inside) or not any(b.article == best for b in changing)):
            return "wrapper", inside
    return ("article", article) if article else ("page", held)


def main_text(source: str, summarized: str | None) -> str:
    """The main text of a page, given its host's summarized wrapper."""
    return "\n\n".join(b.text for b in choose(source, summarized)[1])


def _source(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def merged_in_order(texts: list[str]) -> list[list]:
    """Wrappers of all given ones, aligned one after the other; a wrapper that would grow too long is followed by another."""
    out: list[list] = []
    for text in texts:
        nodes = json.loads(text)
        if out and max(len(out[-1]), len(nodes)) <= MAX_NODES and len(both := align(out[-1], nodes)) <= MAX_NODES:
            out[-1] = both
        else:
            out.append(nodes)
    return out


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, rows, wrapper, pages, constants) of ``pages`` (host, html): a row per host, few more where one wrapper cannot
    hold all; the wrapper is JSON.

    ``rows`` counts the host's pages, ``pages`` the different ones; ``constants`` has the hashes of the texts on a large share of them.
    """

    def local(hosts, sources) -> Iterator[tuple]:
        found: dict[tuple[str, str], tuple[int, list]] = {}
        for host, source in zip(hosts, sources, strict=True):
            blocks, stream = read_page(source)
            nodes = page_wrapper(stream)
            shape = "".join(map(node_key, nodes))
            seen = found.get((host, shape))
            found[host, shape] = (1, nodes) if seen is None else (seen[0] + 1, merge_same(seen[1], nodes))
            yield host, None, None, None, page_slots(blocks)
        for (host, shape), (n, nodes) in found.items():
            yield host, int.from_bytes(hashlib.blake2b(shape.encode("utf-8", "surrogatepass"), digest_size=7).digest()), n, json.dumps(nodes), None

    def same(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = None
        for text in frame["wrapper"]:
            more = json.loads(text)
            nodes = more if nodes is None else merge_same(nodes, more)
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "shape": [frame["shape"].iloc[0]], "rows": [int(frame["rows"].sum())], "wrapper": [json.dumps(nodes)]})

    def aligned(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["shape", "part"])
        found = merged_in_order(list(frame["wrapper"]))
        size = len(found)
        rows = [int(frame["rows"].sum())] + [0] * (size - 1)
        return pd.DataFrame({"host": [frame["host"].iloc[0]] * size, "shape": [int(frame["shape"].iloc[0])] * size, "part": range(size), "rows": rows, "wrapper": [json.dumps(f) for f in found]})

    schema = "host string, shape long, rows long, wrapper string"
    read = cut(arrow_map(pages.select("host", _source("html")), local, schema + ", slots string"))
    shapes = read.where(F.col("slots").isNull()).drop("slots")
    most = shapes.groupBy("host", "shape").count().agg(F.max("count")).first()[0] or 0
    while most > 1:  # one shape: the order does not matter, so rows are dealt as they lie
        parts = -(-most // (8 * FAN))
        dealt = shapes.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))
        shapes = cut(dealt.groupBy("host", "shape", "salt").applyInPandas(same, schema))
        most = parts if parts == 1 else shapes.groupBy("host", "shape").count().agg(F.max("count")).first()[0] or 0
    most = shapes.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    levels = 0 if most <= 1 else max(1, math.ceil(math.log(most, FAN)))
    found = shapes.withColumn("part", F.lit(0).cast("long"))
    for level in range(levels):  # shapes are 56-bit hashes; a group has those that agree in their first bits
        shift = 56 - round((levels - 1 - level) * math.log2(FAN))
        group = F.shiftright("shape", shift) if shift < 56 else F.lit(0)
        found = cut(found.groupBy("host", group.alias("group")).applyInPandas(aligned, "host string, shape long, part long, rows long, wrapper string"))
    different = read.where(F.col("slots").isNotNull()).select("host", "slots").distinct()
    # the empty slot counts the pages; no more than 1 / CONSTANT_SHARE times a page's texts are constant, so lists are short
    slots = different.select("host", F.explode(F.concat(F.array(F.lit("")), F.array_remove(F.split("slots", ","), ""))).alias("slot"))
    counted = cut(slots.groupBy("host", "slot").count().where((F.col("slot") == "") | (F.col("count") >= MIN_PAGES)))
    totals = counted.where(F.col("slot") == "").select("host", F.col("count").alias("pages"))
    total = totals.agg(F.sum("pages")).first()[0] or 0
    often = skew_join(counted.where(F.col("slot") != ""), totals, "host", "pages", total).where(F.col("count") >= F.col("pages") * CONSTANT_SHARE)
    constants = often.groupBy("host").agg(F.concat_ws(",", F.sort_array(F.collect_list("slot"))).alias("constants"))
    return found.select("host", "rows", "wrapper").join(totals, "host").join(constants, "host", "left").withColumn("constants", F.coalesce("constants", F.lit("")))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages`` (page_id, url, html)."""
    return decided(pages).drop("decided_by")


def decided(pages: DataFrame) -> DataFrame:
    """``extract`` with the column ``decided_by``: wrapper, article or page."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")

    def weighed(hosts, sizes, found, constants) -> Iterator[tuple]:
        for host, n, text, fixed in zip(hosts, sizes, found, constants, strict=True):
            yield host, n, "", 0, 0  # carries the number of pages
            for container, (mass, links) in masses(json.loads(text), {int(c) for c in fixed.split(",") if c}).items():
                yield host, 0, container, mass, links

    def summaries(hosts, sizes, different, constants, containers) -> Iterator[tuple]:
        for host, n, m, fixed, main in zip(hosts, sizes, different, constants, containers, strict=True):
            yield host, n, summary(fixed, main) if m >= MIN_PAGES else None

    inferred = cut(wrappers(rows))
    held = arrow_map(inferred.select("host", "rows", "wrapper", "constants"), weighed, "host string, rows long, container string, mass long, links long")
    held = held.groupBy("host", "container").agg(*(F.sum(c).alias(c) for c in ("rows", "mass", "links")))
    main = F.when((F.col("mass") > 0) & (F.col("links") <= LINK_SHARE * F.col("mass")), F.col("container"))
    hosts = held.groupBy("host").agg(F.sum("rows").alias("rows"), F.collect_list(main).alias("containers"))
    learned = hosts.join(inferred.groupBy("host").agg(F.max("pages").alias("pages"), F.max("constants").alias("constants")), "host")
    learned = cut(arrow_map(learned.select("host", "rows", "pages", "constants", "containers"), summaries, "host string, rows long, wrapper string"))
    total = learned.agg(F.sum("rows")).first()[0] or 0
    joined = skew_join(rows, learned, "host", "rows", total, "left")

    def texts(ids, urls, sources, found) -> Iterator[tuple]:
        for page, url, source, summarized in zip(ids, urls, sources, found, strict=True):
            by, blocks = choose(source, summarized)
            text = "\n\n".join(b.text for b in blocks)
            yield page, url, text, len(text), by

    return arrow_map(joined.select(F.col("page_id").cast("long"), F.col("url").cast("string"), _source("html"), "wrapper"), texts, "page_id long, url string, text string, n_chars long, decided_by string")
