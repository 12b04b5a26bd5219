"""Main text of web pages by equivalence-class template deduction.

Per host, tokens (tags with their class and id words, and whole runs of text) that occur
equally often in the same pages form an equivalence class. The largest class of tokens that
occur once a page is the root: its tokens, in the order of their mean places, are the host's
frame, less those that in more than a tenth of the pages stand out of that order. Every other
class is valid if in nine tenths of the pages its tokens repeat in one order, all of them
between the same two tags of the frame; nesting is one level deep.

What lies between a page's template tokens are its slots. Runs of text that stand in their
place in the template are the template's and never text; the same words out of that place are.
The slots decide where the text is: each page votes for the innermost element of the frame whose
slots hold half of its text or more and the text of its first-level headings, and the element with most votes of a host's pages is where
its pages have their text, whatever it is called and whatever it stands in. Inside it the
contract's own list (menus, forms, scripts, marked notices, adverts and comments) still goes.

Where no such element is smaller than the body, or a page lacks it, element rules decide: the
text is inside article and main elements, else outside menus, headers, footers and the like.

Pages of a host whose main text by the element rules alone is equal count as one page, so
copies of an article make no template. Html is read twice: once for a page's tokens, 64-bit
hashes that all the deduction works on, and once for the text. Occurrence vectors are summed
as hashes (two numbers per host and token), so a host with a third of all pages is
pre-aggregated like any other and never gathered.

A header inside an article or main element is the article's own; any other is the page's.
Markup is read in time linear in the page: a tag whose quotes never close ends at the next
'>', and what follows the last '>' is text.

Null and empty html give an empty text. A host of fewer than three different pages has no
template: the element rules alone decide. Ties of votes go to the smaller token. Pages with equal ids are extracted one by one; a
null url is a host of its own.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy

#: Elements that never hold the main text, that end a block, and class words that mark boilerplate.
SKIP = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea dialog head title menu canvas object audio video".split())
BLOCK = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody blockquote pre figure figcaption hr body html address details summary nav header footer aside form".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("p b i em strong span a u small".split())
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|cookie\w*|consent|comments?|sidebar|menu|nav\w*|breadcrumbs?|footer|header|share|social|related|promo\w*|sponsor\w*|popup|modal|newsletter|subscribe|notice|widget|pagination|disclaimer)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</?[a-zA-Z][^\s/>]*+(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^>]*>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: A class is valid in hosts of so many pages, in so many tenths of them.
LEAST_PAGES, LEAST_TENTHS = 3, 9
_ENDS = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}


#: Bits of a tag's token: it is a tag, it opens, it stands alone, and below the hash the name's.
_TAG, _OPENS, _ALONE, _NAME_SHIFT, _LOW = 1, 2, 4, 3, (1 << 11) - 1
#: Share of a page's text that an element must hold to be voted for, as 1 / HALF.
HALF = 2


class Tag(NamedTuple):
    """What the extraction needs to know of a tag; token is odd."""

    opens: bool
    name: str
    token: int
    marked: bool
    single: bool


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace")) - (1 << 63)


@lru_cache(maxsize=20_000)
def read_tag(markup: str) -> Tag | None:
    """The tag of a piece of markup; null for comments and declarations."""
    found = _NAME.match(markup)
    if found is None:
        return None
    name, opens = found.group(1).lower(), markup[1] != "/"
    words = [a or b or c for a, b, c in _CLASS.findall(markup)] if "=" in markup else []
    single = name in VOID or markup.endswith("/>")
    token = _hash(("o" if opens else "c") + name + " " + " ".join(w for w in words if w)) & ~_LOW
    token |= _TAG | opens * _OPENS | single * _ALONE | name_bits(name) << _NAME_SHIFT
    return Tag(opens, name, token, any(MARKED.search(w) for w in words), single)


def name_bits(name: str) -> int:
    return _hash(name) & 0xFF


def pieces(page: str) -> list[tuple[str, Tag | None]]:
    """(text, none) or (markup, tag) in page order.

    A closed raw element (script, style ...) is one piece, so markup in it is not read as tags.
    """
    out: list[tuple[str, Tag | None]] = []
    at, last, unclosed = 0, page.rfind(">"), set()
    while True:
        found = _TOKEN.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        start = found.start() if found else len(page)
        if start > at:
            out.append((page[at:start], None))
        if found is None:
            return out
        at, markup = found.end(), found.group()
        tag = read_tag(markup) if len(markup) <= 2000 else read_tag.__wrapped__(markup)
        if tag is None:
            continue
        out.append((markup, tag))
        if tag.opens and tag.name in RAW and not tag.single and tag.name not in unclosed:
            if end := _ENDS[tag.name].search(page, at):
                at = end.start()
            else:
                unclosed.add(tag.name)


def page_tokens(parts: list[tuple[str, Tag | None]]) -> list[int]:
    """Token of every piece of a page: odd for tags, even for runs of text, 0 for blank text."""
    out = []
    for content, tag in parts:
        if tag is not None:
            out.append(tag.token)
        else:
            run = " ".join(content.split())
            out.append((_hash("=" + run) & ~1 or 2) if run else 0)
    return out


def _places(tokens: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for at, token in enumerate(tokens):
        if token:
            out.setdefault(token, []).append(at)
    return out


def _in_order(places: list[int]) -> list[int]:
    """Indices of a longest increasing part of ``places``."""
    if all(x < y for x, y in zip(places, places[1:], strict=False)):
        return list(range(len(places)))
    ends: list[int] = []
    held: list[int] = []
    before: list[int] = []
    for i, place in enumerate(places):
        k = bisect_left(ends, place)
        before.append(held[k - 1] if k else -1)
        ends[k : k + 1], held[k : k + 1] = [place], [i]
    out, i = [], held[-1] if held else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _frame(classes: list[list[int]], places: dict[int, list[int]], among: frozenset[int] | None = None) -> dict[int, int]:
    """Place of every token of the root class that stands in order on this page."""
    once = [t for t in classes[0] if len(places.get(t, ())) == 1 and (among is None or t in among)]
    return {once[i]: places[once[i]][0] for i in _in_order([places[t][0] for t in once])}


def _nested(tokens: list[int], places: dict[int, list[int]], bounds: list[int]) -> int | None:
    """Number of the slot all tuples of a class lie in, each in order and apart from the next; else null."""
    rows = [places.get(t, ()) for t in tokens]
    if not rows[0] or any(len(r) != len(rows[0]) for r in rows):
        return None
    flat = [r[j] for j in range(len(rows[0])) for r in rows]
    if any(x >= y for x, y in zip(flat, flat[1:], strict=False)):
        return None
    slot = bisect_right(bounds, flat[0])
    return slot if slot == bisect_right(bounds, flat[-1]) else None


def _bounds(frame: dict[int, int]) -> tuple[list[int], list[int]]:
    """Places and tokens of the frame's tags on this page."""
    held = sorted((at, t) for t, at in frame.items() if t & 1)
    return [at for at, _ in held], [t for _, t in held]


def owned_pieces(tokens: list[int], classes: list[list[int]], valid: list[tuple[int, int]]) -> tuple[frozenset[int], dict[int, int]]:
    """Numbers of the page's pieces that are its host's template, and the places of the frame's tokens."""
    places = _places(tokens)
    frame = _frame(classes, places, frozenset(t for c, t in valid if c == 0))
    bounds, names = _bounds(frame)
    out = set(frame.values())
    for c, before in valid:
        if c and (slot := _nested(classes[c], places, bounds)) is not None and (names[slot - 1] if slot else 0) == before:
            out.update(at for t in classes[c] for at in places[t])
    return frozenset(out), frame


def content_vote(tokens: list[int], sizes: list[int], owned: frozenset[int], frame: dict[int, int]) -> int:
    """Token of the innermost frame element whose slots hold half the page's text or more, and its headings'; 0 if there is none below the body."""
    upto, total = [], 0
    for at, size in enumerate(sizes):
        upto.append(total)
        total += 0 if at in owned or tokens[at] & _TAG else size
    open_, found, titles = [], [], []
    for at, token in zip(*_bounds(frame), strict=True):
        name = token >> _NAME_SHIFT & 0xFF
        if token & _ALONE:
            continue
        if token & _OPENS:
            open_.append((name, at, token))
        elif any(n == name for n, _, _ in open_):
            while open_[-1][0] != name:
                open_.pop()
            _, start, opened = open_.pop()
            if name == _TITLE and upto[at] > upto[start]:
                titles.append((start, at))
            if total and HALF * (upto[at] - upto[start]) >= total and name not in _WHOLE:
                found.append((at - start, opened, start, at))
    whole = [(width, token) for width, token, a, b in found if all(a <= x and y <= b for x, y in titles)]
    return min(whole, default=(0, 0))[1]


_WHOLE, _TITLE = frozenset(map(name_bits, ("html", "body"))), name_bits("h1")


def blocks(parts: list[tuple[str, Tag | None]], owned: frozenset[int] = frozenset(), inner: int | None = None) -> list[str]:
    """Text blocks of the main content, in page order, less the pieces the template owns.

    ``inner`` is the place of the tag that opens the element with the text; null, the element rules find it.
    """
    stack: list[tuple[str, bool, bool]] = []
    opened: Counter[str] = Counter()
    found: list[tuple[bool, str]] = []
    run: list[str] = []
    skip = main = hidden = 0
    any_main = inner is not None

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                found.append((main > 0, text))
            run.clear()

    def leave() -> str:
        nonlocal skip, main, hidden
        name, was_skip, was_main = stack.pop()
        opened[name] -= 1
        skip -= was_skip
        main -= was_main
        if was_main and inner is not None:  # what the element stands in counts again
            skip, hidden = hidden, 0
        return name

    for at, (content, tag) in enumerate(parts):
        if tag is None:
            if not skip:
                run.append(" " if at in owned else content)
            continue
        name = tag.name
        if name in BLOCK or name in SKIP:
            flush()
        elif name == "br" and not skip:
            run.append(" ")
        if tag.opens:
            if tag.single:
                continue
            if name == "body" and opened["head"]:  # an end tag of head may be left out
                while leave() != "head":
                    pass
            elif name == "p" and opened["p"]:  # a new paragraph ends an open one
                while stack and stack[-1][0] in INLINE and opened["p"]:
                    leave()
            own_header = name == "header" and main > 0
            opens = (name in SKIP and not own_header) or (tag.marked and name not in ("html", "body", "article", "main"))
            if inner is None:
                holds = name in ("article", "main") and not skip
                any_main = any_main or holds
            elif holds := at == inner:
                opens, hidden, skip = False, skip, 0
            stack.append((name, opens, holds))
            opened[name] += 1
            skip += opens
            main += holds
        elif opened[name]:
            while leave() != name:
                pass
    flush()
    return [t for inside, t in found if inside or not any_main]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: host, html -> host, hash of the main text by the element rules alone, tokens, sizes of runs of text."""
    for batch in batches:
        marks, tokens, sizes = [], [], []
        for page in batch.column(1):
            parts = pieces(page.as_py() or "")
            marks.append(_hash("\n\n".join(blocks(parts))))
            tokens.append(page_tokens(parts))
            sizes.append([len(content) if tag is None else 0 for content, tag in parts])
        lists = [pa.array(tokens, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64()), *lists], ["host", "mark", "tokens", "sizes"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: host, mark, tokens -> host, token, numbers of pages and occurrences, mean places summed, occurrence vector."""
    for batch in batches:
        sums: dict[tuple[str, int], list] = {}
        for host, mark, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            digests: dict[int, int] = {}
            for token, places in _places(tokens).items():
                n = len(places)
                if n not in digests:
                    digests[n] = xxhash.xxh3_64_intdigest(f"{mark} {n}".encode())
                new = (1, n, sum(places) / n, digests[n] & 0x7FFFFFFF, digests[n] >> 33)
                at = sums.get((host, token))
                sums[host, token] = [x + y for x, y in zip(at, new, strict=True)] if at else list(new)
        columns = list(zip(*sums.values(), strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
            ["host", "token", "pages", "times", "place", "v1", "v2"],
        )


class Templates:
    """Templates by host as they come with a batch's rows, each unpacked once."""

    def __init__(self, hosts: list[str], packed: pa.Array, valid: pa.Array | None = None):
        self.hosts, self.packed, self.valid, self.known = hosts, packed, valid, {}

    def at(self, row: int) -> tuple[list[list[int]], list[tuple[int, int]]]:
        host = self.hosts[row]
        if host not in self.known:
            flat, classes, at = self.packed[row].values.to_pylist(), [], 0
            while at < len(flat):
                classes.append(flat[at + 1 : at + 1 + flat[at]])
                at += 1 + flat[at]
            pairs = self.valid[row].values.to_pylist() if self.valid is not None else []
            self.known[host] = classes, list(zip(pairs[::2], pairs[1::2], strict=True))
        return self.known[host]


def _fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: host, tokens, classes -> host, class, token, number of the pages where it fits.

    For the root class the token is one of its own, for others the tag before their slot.
    """
    for batch in batches:
        sums: Counter[tuple[str, int, int]] = Counter()
        hosts = batch.column(0).to_pylist()
        known = Templates(hosts, batch.column(2))
        for row, tokens in enumerate(batch.column(1).to_pylist()):
            host, (classes, _) = hosts[row], known.at(row)
            places = _places(tokens)
            frame = _frame(classes, places)
            bounds, names = _bounds(frame)
            sums.update((host, 0, t) for t in frame)
            for c in range(1, len(classes)):
                if (slot := _nested(classes[c], places, bounds)) is not None:
                    sums[host, c, names[slot - 1] if slot else 0] += 1
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64()), pa.array(sums.values(), pa.int64())],
            ["host", "class", "token", "pages"],
        )


def templates(pages: DataFrame) -> DataFrame:
    """host, classes (the root first, tokens in order, each class after its length), valid (class, token, class, token ...), content (the element with the text, or 0).

    A token goes with class 0 if it is of the frame; with another class it is the tag before the slot.
    """
    hosted = pages.select(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit("")).alias("host"), "html")
    read = hosted.mapInArrow(tidy(_read), "host string, mark long, tokens array<long>, sizes array<int>")
    # of the pages of a host with one main text, one stands for all
    chosen = read.groupBy("host", "mark").agg(F.min(F.struct("tokens", "sizes")).alias("page")).select("host", "mark", "page.*")
    chosen = materialise(chosen, "template-pages")
    large = chosen.groupBy("host").agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= LEAST_PAGES)
    enough = 10 * F.col("pages") >= LEAST_TENTHS * F.col("host_pages")
    counted = chosen.select("host", "mark", "tokens").mapInArrow(tidy(_vectors), "host string, token long, pages long, times long, place double, v1 long, v2 long")
    tokens = counted.groupBy("host", "token").agg(*[F.sum(n).alias(n) for n in ("pages", "times", "place", "v1", "v2")])
    tokens = tokens.join(large, "host").where(enough)
    # tokens of one vector are one class; a class holds at most a page's worth of tokens, and so does a host
    once = (F.col("times") == F.col("pages")).alias("once")
    classes = tokens.groupBy("host", "v1", "v2", once).agg(F.sort_array(F.collect_list(F.struct(F.round(F.col("place") / F.col("pages"), 6).alias("place"), "token"))).alias("tokens"))
    ranked = F.struct((~F.col("once")).alias("often"), (-F.size("tokens")).alias("fewer"), "v1", "v2", F.col("tokens.token").alias("tokens"))
    classes = classes.groupBy("host").agg(F.sort_array(F.collect_list(ranked)).alias("ranked"), F.max("once").alias("framed")).where("framed")
    packed = F.flatten(F.transform("ranked.tokens", lambda t: F.concat(F.array(F.size(t).cast("long")), t)))
    classes = materialise(classes.select("host", packed.alias("classes")), "template-classes")
    fits = chosen.join(classes, "host").select("host", "tokens", "classes").mapInArrow(tidy(_fits), "host string, class long, token long, pages long")
    fits = fits.groupBy("host", "class", "token").agg(F.sum("pages").alias("pages")).join(large, "host").where(enough)
    pair = F.sort_array(F.collect_list(F.struct("class", "token")))
    valid = fits.groupBy("host").agg(F.flatten(F.transform(pair, lambda p: F.array(p["class"], p["token"]))).alias("valid"))
    known = materialise(classes.join(valid, "host"), "template-known")
    votes = chosen.join(known, "host").select("host", "tokens", "sizes", "classes", "valid").mapInArrow(tidy(_votes), "host string, content long, votes long")
    votes = votes.groupBy("host", "content").agg(F.sum("votes").alias("votes"))
    most = votes.groupBy("host").agg(F.min_by("content", F.struct(-F.col("votes"), F.col("content"))).alias("content"))
    return known.join(most, "host", "left")


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: host, tokens, sizes, classes, valid -> host, element with the text, votes."""
    for batch in batches:
        hosts = batch.column(0).to_pylist()
        known, votes = Templates(hosts, batch.column(3), batch.column(4)), Counter()
        for row, (tokens, sizes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            votes[hosts[row], content_vote(tokens, sizes, *owned_pieces(tokens, *known.at(row)))] += 1
        columns = [pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.int64()), pa.array(votes.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "content", "votes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: page_id, url, html, host, classes, valid, content -> page_id, url, text."""
    for batch in batches:
        out = []
        classes, contents = batch.column(4), batch.column(6).to_pylist()
        known = Templates(batch.column(3).to_pylist(), classes, batch.column(5))
        has = np.asarray(classes.is_valid())
        for row, page in enumerate(batch.column(2)):
            parts = pieces(page.as_py() or "")
            owned, frame = owned_pieces(page_tokens(parts), *known.at(row)) if has[row] else (frozenset(), {})
            out.append("\n\n".join(blocks(parts, owned, frame.get(contents[row]))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row of ``pages(page_id, url, html)``."""
    learned = materialise(templates(pages), "templates")
    host = F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit(""))
    with_template = pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("host")).join(learned, "host", "left")
    return with_template.select("page_id", "url", "html", "host", "classes", "valid", "content").mapInArrow(tidy(_extract), "page_id long, url string, text string")


def html_digest(pages: DataFrame) -> DataFrame:
    """The contract's columns per page."""
    return extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
