"""Main text of web pages by wrappers, union-free regular expressions inferred for each host.

A page is a stream of tokens: tags that open and close blocks, and texts. A wrapper is a sequence of tags, text slots, optional parts and
repeated groups that all pages of a host match. It is inferred step by step: the stream of a page is folded (neighbours alike, and squares of
several neighbours, become repeated groups) and aligned with the wrapper so far; where texts differ, the place becomes a slot that varies;
where tags differ, the tags of one side become optional, or a repeated group. Wrappers align with wrappers as pages do, so each task infers
one for every host from its own pages, and a few rounds over salted groups join those, however many pages a host has. All pages count.

A wrapper's parts are then told apart over the whole host: parts whose names say what they are (menus, forms, comments ...), lists and texts made
of links, texts that stay the same on all pages, and the part that holds the article. Each page is matched against its host's wrapper, and the
texts in the article's slots are its main text.
"""

from __future__ import annotations

import html as references
import json
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored

#: Wrappers of one host that a task joins in a round, about; hosts and parts that a task holds before it passes its wrappers on.
FAN, HELD_HOSTS, HELD_PARTS = 16, 2000, 200_000
#: Nested blocks that are told apart; deeper ones count as text of the last.
DEEPEST = 128
#: Parts of a block from which on they are told by tag alone, in any order; and pairs of parts that are aligned exactly.
MOST_PARTS, MOST_PAIRS = 64, 40_000
#: Neighbours of a square, at most.
LONGEST_SQUARE = 6

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>?|<[!?/][^>]*>?|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " label legend li main menu nav object ol optgroup option output p pre section select summary svg table tbody td tfoot th thead tr ul video audio template math hgroup".split()
)
#: What a tag that opens ends, as far as the tags named second.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}

DROPPED_TAGS = frozenset("head nav aside footer form button select option fieldset label menu dialog svg object canvas video audio template".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe"
    " subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments commentlist disqus reply replies respond share sharing social related"
    " recommended widget login search pagination pager toolbar topbar copyright".split()
)
NOT_WORDS = frozenset(("no", "has", "with", "without", "is"))
ARTICLE_WORDS = frozenset("article post entry story content".split())
#: Tags of running text, which a text that stays the same isn't reason enough to drop.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption".split())


class Part:
    """A part of a wrapper: a text slot (key '#'), a block, or a repeated group of several parts (key in brackets).

    pages and times: pages with it, and how often it comes in all. chars and links: characters of its slots' texts, and of those in links. text: a
    slot's text where it is always the same, as a hash. many: it may repeat. loose: its parts are told by tag, in any order.
    own: places of a page's own texts, while the page is matched.
    """

    __slots__ = ("key", "pages", "times", "chars", "links", "text", "many", "loose", "kids", "own")

    def __init__(self, key, pages=1, times=1, chars=0, links=0, text=None, many=False, loose=False, kids=(), own=()):
        self.key, self.pages, self.times, self.chars, self.links, self.text, self.many, self.loose = key, pages, times, chars, links, text, many, loose
        self.kids, self.own = list(kids), list(own)

    def told(self) -> list:
        return [self.key, self.pages, self.times, self.chars, self.links, self.text, int(self.many), int(self.loose), [k.told() for k in self.kids]]

    @classmethod
    def read(cls, told: list) -> Part:
        return cls(*told[:6], bool(told[6]), bool(told[7]), [cls.read(k) for k in told[8]])

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids)

    def pattern(self) -> str:
        """The wrapper as a regular expression over tags and texts (#), optional parts and groups marked ? and +."""
        if self.key == "#":
            return "#"
        inner = "".join(f"({k.pattern()})?" if k.pages < self.pages else k.pattern() for k in self.kids)
        if self.key[0] != "(":
            tag = self.key.split(" ", 1)[0]
            inner = f"<{self.key}>{inner}</{tag}>"
        return f"({inner})+" if self.many else inner


# -- a page as folded parts -------------------------------------------------------------------------


@lru_cache(65536)
def named(tag: str, attributes: str) -> str:
    """The key of a block: its tag and, where they tell anything, what its attributes say. '!' marks what isn't article by its name, '^'
    an article's block, with a number: 1 where the tag or role says so, 2 for the main part, 3 by a word of its class."""
    values = {}
    for m in ATTRIBUTE.finditer(attributes):
        values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    mark = ""
    role = values.get("role", "").strip().lower()
    spoken = f"{values.get('class', '')} {values.get('id', '')}"
    groups = [[w.lower() for w in WORD.findall(x)] for x in spoken.split()]
    words = {w for g in groups for w in g}
    if tag in ("html", "body"):
        return tag
    hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "").lower())
    out = any(w in DROPPED_WORDS for g in groups if not NOT_WORDS & set(g) for w in g)
    if tag in DROPPED_TAGS or role in DROPPED_ROLES or hidden or out and tag not in ("article", "main"):
        mark = "!"
        if tag == "article" and not hidden:
            mark = "^1"
    elif tag == "article":
        mark = "!" if any(w.startswith("comment") or w in ("reply", "replies") for w in words) else "^1"
    elif role == "article" or values.get("itemprop", "").lower() == "articlebody":
        mark = "^1"
    elif tag == "main" or role == "main":
        mark = "^2"
    elif tag == "header" or "header" in words:
        mark = "^3" if tag != "header" and words & ARTICLE_WORDS else "~"
    elif words & ARTICLE_WORDS and tag in ("div", "section", "td"):
        mark = "^3"
    # numbers of identifiers, and long ones of classes, tell pages apart and not parts
    plain = " ".join(sorted([re.sub(r"\d{3,}", "0", x.lower()) for x in values.get("class", "").split()] + [re.sub(r"\d+", "0", x.lower()) for x in values.get("id", "").split()]))
    return f"{tag} {mark}{plain}".rstrip()


def stripped(key: str) -> str:
    """A key by its tag and mark alone."""
    tag, _, rest = key.partition(" ")
    mark = rest[:2] if rest[:1] == "^" else rest[:1] if rest[:1] in ("!", "~") else ""
    return f"{tag} {mark}".rstrip()


def page_parts(page: str, texts: list[str] | None = None) -> Part:
    """A page's blocks and texts, neighbours folded. texts receives each text, decoded, with white space as single spaces."""
    root = Part("page")
    stack: list[tuple[str, Part | None]] = [("", root)]  # inline tags have no part
    open_: dict[str, int] = {}
    skipped: dict[str, int] = {}
    blocks = links = 0
    run: list[str] = []
    linked = 0

    def flush():
        nonlocal run, linked
        if run:
            text = " ".join(references.unescape("".join(run)).split())
            if text:
                n = len(text)
                part = Part("#", 1, 1, n, min(linked, n), xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 12)
                if texts is not None:
                    part.own.append(len(texts))
                    texts.append(text)
                parent = next(p for _, p in reversed(stack) if p is not None)
                parent.kids.append(part)
            run, linked = [], 0

    def close(depth: int):
        """End all blocks and inline tags from depth on."""
        nonlocal blocks, links
        while len(stack) > depth:
            tag, part = stack.pop()
            open_[tag] -= 1
            if part is None:
                links -= tag == "a"
                continue
            blocks -= 1
            part.kids = folded(part.kids)
            parent = next(p for _, p in reversed(stack) if p is not None)
            last = parent.kids[-1] if parent.kids else None
            if last is not None and last.key == part.key:
                joined(last, part, False)
            else:
                parent.kids.append(part)

    def find(tags, barriers) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in barriers:
                return 0
        return 0

    at, end = 0, len(page)
    match = TOKEN.match
    while at < end:
        m = match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or at - m.start() == 1:
                run.append(m[0])
                if links:
                    linked += at - m.start()
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if m[1]:
            if skipped.get(tag):
                skipped[tag] -= 1
                if not inline:
                    flush()
                continue
            if tag == "br" or not open_.get(tag):
                if tag == "br":
                    run.append(" ")
                elif not inline:
                    flush()
                continue
            place = find((tag,), ())
            if stack[place][1] is None:
                del stack[place]
                open_[tag] -= 1
                links -= tag == "a"
            else:
                flush()
                close(place)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = stop.start() if stop else end
            if stop:
                at = page.find(">", at) + 1 or end
            if tag != "noscript":
                run.append(" ")
            continue
        if tag in ("br", "img", "wbr"):
            if tag == "br":
                run.append(" ")
            continue
        key = named(tag, m[3].rstrip("/")) if m[3].strip(" /") else tag if tag not in DROPPED_TAGS and tag not in ("article", "main", "header") else named(tag, "")
        if inline and not key.startswith(f"{tag} !"):
            if len(stack) - blocks > DEEPEST:
                skipped[tag] = skipped.get(tag, 0) + 1
                continue
            if tag == "a" and open_.get("a"):
                place = find(("a",), ())
                if stack[place][1] is None:
                    del stack[place]
                    open_["a"] -= 1
                    links -= 1
            stack.append((tag, None))
            open_[tag] = open_.get(tag, 0) + 1
            links += tag == "a"
            continue
        flush()
        if tag in VOID:
            continue
        if tag not in BLOCKS and not inline:
            key = stripped("x" + key[len(tag) :])
        if tag in ENDS:
            place = find(*ENDS[tag])
            if place:
                close(place)
        if not inline and open_.get("p"):
            place = find(("p",), ("td", "th", "button", "object", "table", "caption"))
            if place:
                close(place)
        if tag == "html" or tag == "body":
            if open_.get(tag):
                continue
        if tag == "body" and open_.get("head"):
            close(find(("head",), ()))
        if blocks >= DEEPEST:
            skipped[tag] = skipped.get(tag, 0) + 1
            continue
        stack.append((tag, Part(key)))
        open_[tag] = open_.get(tag, 0) + 1
        blocks += 1
    flush()
    close(1)
    root.kids = folded(root.kids)
    _total(root)
    return root


def _total(part: Part) -> None:
    """Sum the characters of a block's parts."""
    for kid in part.kids:
        if kid.key != "#":
            _total(kid)
    if part.key != "#":
        part.chars, part.links = sum(k.chars for k in part.kids), sum(k.links for k in part.kids)


# -- folding and alignment --------------------------------------------------------------------------


def joined(a: Part, b: Part, across: bool) -> Part:
    """a, after b has been folded into it: the same part of another page, or another turn of it on the same page."""
    a.times += b.times
    a.chars += b.chars
    a.links += b.links
    if across:
        a.pages += b.pages
        a.many |= b.many
    else:
        a.many = True
        a.pages = max(a.pages, b.pages)
    if a.text != b.text:
        a.text = None
    if b.own:
        a.own += b.own
    if b.kids or a.kids:
        a.kids = aligned(a, b, across)
    return a


def _group(kids: list[Part]) -> Part:
    top = max(kids, key=lambda k: k.pages)
    return Part("(" + "|".join(k.key for k in kids) + ")", top.pages, top.times, sum(k.chars for k in kids), sum(k.links for k in kids), None, True, False, kids)


def folded(parts: list[Part], across: bool = False) -> list[Part]:
    """Neighbours of one key as one part that repeats, and squares of several parts as a repeated group."""
    if len(parts) < 2:
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        if p.key == out[-1].key and p.key != "#":
            out[-1].many = True
            joined(out[-1], p, across)
        else:
            out.append(p)
    size = 2
    while size <= LONGEST_SQUARE and 2 * size <= len(out):
        keys = [p.key for p in out]
        i = 0
        hit = False
        while i + 2 * size <= len(out):
            if keys[i : i + size] == keys[i + size : i + 2 * size] and not any(k[0] == "(" for k in keys[i : i + size]):
                while keys[i + size : i + 2 * size] == keys[i : i + size]:
                    for k in range(size):
                        joined(out[i + k], out[i + size + k], False)
                    del out[i + size : i + 2 * size], keys[i + size : i + 2 * size]
                group = _group(out[i : i + size])
                out[i : i + size], keys[i : i + size] = [group], [group.key]
                hit = True
            i += 1
        size += 1 if not hit else 0
        if hit:
            size = 2
    return out


def grouped(parts: list[Part], like: list[Part]) -> list[Part]:
    """parts with single turns of the repeated groups in like taken together, so that they align with them."""
    for group in like:
        if group.key[0] != "(":
            continue
        inner = [k.key for k in group.kids]
        size, i = len(inner), 0
        while i + size <= len(parts):
            if [p.key for p in parts[i : i + size]] == inner:
                parts[i : i + size] = [_group(parts[i : i + size])]
            i += 1
    return parts


def pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places in a and b of a longest common subsequence; between long sequences, of one found from left to right."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < min(len(a), len(b)) - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(start)]
    x, y = a[start : len(a) - tail], b[start : len(b) - tail]
    if x and y:
        if len(x) * len(y) <= MOST_PAIRS:
            best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i in range(len(x) - 1, -1, -1):
                row, below = best[i], best[i + 1]
                for j in range(len(y) - 1, -1, -1):
                    row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
            i = j = 0
            while i < len(x) and j < len(y):
                if x[i] == y[j]:
                    out.append((start + i, start + j))
                    i, j = i + 1, j + 1
                elif best[i + 1][j] >= best[i][j + 1]:
                    i += 1
                else:
                    j += 1
        else:
            later: dict[str, list[int]] = {}
            for j in range(len(y) - 1, -1, -1):
                later.setdefault(y[j], []).append(j)
            j = -1
            for i, key in enumerate(x):
                places = later.get(key, [])
                while places and places[-1] <= j:
                    places.pop()
                if places and places[-1] - j <= 64:
                    j = places.pop()
                    out.append((start + i, start + j))
    return out + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def loosened(parts: list[Part], across: bool) -> list[Part]:
    """Parts told by tag and mark alone, one of each, in the order of their keys."""
    found: dict[str, Part] = {}
    todo = list(parts)
    while todo:
        p = todo.pop()
        if p.key[0] == "(":
            todo += p.kids
            continue
        if p.key != "#":
            p.key = stripped(p.key)
        if p.key in found:
            joined(found[p.key], p, across)
        else:
            found[p.key] = p
        found[p.key].many = True
    return [found[k] for k in sorted(found)]


def aligned(a: Part, b: Part, across: bool) -> list[Part]:
    """The parts of a and b as one sequence: those of one key that align are joined, others stay as they are, optional by their counts."""
    x, y = a.kids, b.kids
    if not x or not y:
        a.loose |= b.loose
        return x or y
    if len(x) == len(y) and not (a.loose or b.loose) and all(p.key == q.key for p, q in zip(x, y, strict=True)):
        for p, q in zip(x, y, strict=True):
            joined(p, q, across)
        return x
    a.loose |= b.loose
    if not a.loose:
        x, y = grouped(x, y), grouped(y, x)
        out, i, j = [], 0, 0
        for p, q in [*pairs([k.key for k in x], [k.key for k in y]), (len(x), len(y))]:
            out += x[i:p] + y[j:q]
            if p < len(x):
                out.append(joined(x[p], y[q], across))
            i, j = p + 1, q + 1
        out = folded(out, across)
        if len(out) <= MOST_PARTS:
            return out
        a.loose, x, y = True, out, []
    return loosened([*x, *y], across)


# -- what the parts of a wrapper are ----------------------------------------------------------------


class Judged:
    """A wrapper's parts with what they are: drop, or the rank of the article's part they are in (1 to 3, 4 elsewhere in the part that holds
    most text, 5 elsewhere)."""

    def __init__(self, wrapper: Part):
        self.wrapper = wrapper
        self.rank: dict[int, int] = {}
        self.varied = self._varied(wrapper)
        self._mark(wrapper, 5, False, "")
        main = self._main(wrapper)
        if main is not wrapper:
            self._raise(main)

    def _varied(self, part: Part) -> int:
        if part.key == "#":
            return 0 if part.text is not None else part.chars
        return sum(self._varied(k) for k in part.kids)

    def _holds_article(self, part: Part) -> bool:
        return any(k.key.startswith(("article ^", "main ^")) or self._holds_article(k) for k in part.kids)

    def _mark(self, part: Part, rank: int, dropped: bool, tag: str) -> None:
        mark = part.key.partition(" ")[2]
        if part.key == "#":
            same = part.text is not None and part.times == part.pages >= 3 and part.pages >= 0.5 * self.wrapper.pages
            if same and 2 * self.varied > self.wrapper.chars and tag not in RUNNING:
                dropped = True
            if rank > 1 and part.links > 0.8 * part.chars and 2 * self.wrapper.links < self.wrapper.chars and (tag not in RUNNING or tag in ("td", "th")):
                dropped = True
            self.rank[id(part)] = 9 if dropped else rank
            return
        if part.key[0] != "(":
            own = part.key.partition(" ")[0]
            if mark[:1] == "!":
                dropped = dropped or own in DROPPED_TAGS or not self._holds_article(part)
            elif mark[:1] == "~":
                dropped = dropped or rank > 2 and not self._holds_article(part)
            elif mark[:1] == "^":
                rank = min(rank, int(mark[1]))
            elif own in ("ul", "ol", "dl", "table") and rank > 1 and part.links > 0.8 * part.chars:
                dropped = True
            tag = own
        self.rank[id(part)] = 9 if dropped else rank
        for kid in part.kids:
            self._mark(kid, rank, dropped, tag)

    def _weight(self, part: Part) -> int:
        if part.key == "#":
            return part.chars - part.links if self.rank[id(part)] < 9 else 0
        return sum(self._weight(k) for k in part.kids)

    def _main(self, part: Part) -> Part:
        """The part that holds seven tenths of the text of every part around it."""
        whole = self._weight(part)
        for kid in part.kids:
            if kid.key != "#" and kid.key.partition(" ")[0] not in RUNNING and not kid.many and whole and self._weight(kid) >= 0.7 * whole:
                return self._main(kid)
        return part

    def _raise(self, part: Part) -> None:
        if self.rank[id(part)] == 5:
            self.rank[id(part)] = 4
        for kid in part.kids:
            self._raise(kid)

    def texts(self, page: Part, count: int) -> list[int]:
        """The rank of each of a page's texts; titles outside the article count as in the part with most text."""
        ranks = [9] * count
        self._match(self.wrapper, page, ranks, False)
        return ranks

    def _match(self, w: Part, p: Part, ranks: list[int], title: bool) -> None:
        if p.key == "#":
            rank = self.rank[id(w)]
            for i in p.own:
                ranks[i] = 4 if title and rank == 5 else rank
            return
        title = title or p.key.partition(" ")[0] == "h1"
        kids = loosened(p.kids, False) if w.loose else grouped(p.kids, w.kids)
        found = dict((j, i) for i, j in pairs([k.key for k in w.kids], [k.key for k in kids]))
        by_key: dict[str, Part] = {}
        for j, kid in enumerate(kids):
            if j in found:
                self._match(w.kids[found[j]], kid, ranks, title)
                continue
            if not by_key:
                todo = list(w.kids)
                while todo:
                    k = todo.pop()
                    by_key[k.key] = k
                    if k.key[0] == "(":
                        todo += k.kids
            if kid.key in by_key:
                self._match(by_key[kid.key], kid, ranks, title)
            elif kid.key[0] == "(":
                for k in kid.kids:
                    if k.key in by_key:
                        self._match(by_key[k.key], k, ranks, title)
                    else:
                        self._fill(k, self.rank[id(w)], ranks)
            else:
                self._fill(kid, self.rank[id(w)], ranks)

    def _fill(self, p: Part, rank: int, ranks: list[int]) -> None:
        """A block that the wrapper doesn't have at its place: by its names and what it is in."""
        mark = p.key.partition(" ")[2]
        if p.key != "#" and p.key[0] != "(":
            rank = 9 if mark[:1] == "!" or mark[:1] == "~" and rank > 2 else min(rank, int(mark[1])) if mark[:1] == "^" and rank < 9 else rank
        for i in p.own:
            ranks[i] = rank
        for k in p.kids:
            self._fill(k, rank, ranks)


def main_text(judged: Judged, page: str | None) -> str:
    """The texts of a page that its host's wrapper has in the article, or failing that in the best part that has any; one a line."""
    texts: list[str] = []
    parts = page_parts(page or "", texts)
    ranks = judged.texts(parts, len(texts))
    best = min(ranks, default=9)
    return "\n".join(t for t, r in zip(texts, ranks, strict=True) if r == best) if best < 9 else ""


# -- wrappers of all hosts --------------------------------------------------------------------------


def host(url) -> F.Column:
    """A URL's host in lower case, without port; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(url.cast("string"))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _emit(held: dict) -> pa.RecordBatch:
    hosts = sorted(held)
    told = [json.dumps(held[h].told(), separators=(",", ":")) for h in hosts]
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(told, pa.string()), pa.array([held[h].pages for h in hosts])], names=["host", "wrapper", "pages"])


def _first(batches):
    """A wrapper for each host of a task's pages."""
    held: dict[str, Part] = {}
    parts = 0
    for batch in batches:
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            one = page_parts(page or "")
            if name in held:
                joined(held[name], one, True)
                parts += 1
            else:
                held[name] = one
                parts += one.size()
            if len(held) > HELD_HOSTS or parts > HELD_PARTS:
                parts = sum(h.size() for h in held.values())  # pages of known form add next to nothing
                if len(held) > HELD_HOSTS or parts > HELD_PARTS // 2:
                    yield _emit(held)
                    held, parts = {}, 0
    if held:
        yield _emit(held)


def _next(batches):
    """The wrappers of a sorted group (host, salt) as one, one group after the other."""
    key, held = None, None
    for batch in batches:
        for name, salt, told in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "wrapper")), strict=True):
            one = Part.read(json.loads(told))
            if key == (name, salt):
                joined(held, one, True)
                continue
            if key:
                yield _emit({key[0]: held})
            key, held = (name, salt), one
    if key:
        yield _emit({key[0]: held})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages): the wrapper of each host, told as JSON, inferred from all rows of pages (url, html).

    Null and empty pages count as pages without parts, null URLs and those without host as one host. Repeated rows count each. An
    empty table gives no rows. Wrappers depend on the order of a table's rows where pages can be aligned in several ways.
    """
    schema = "host string, wrapper string, pages long"
    found = stored(pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_first, schema), "wrappers")
    while True:
        counts = stored(found.groupBy("host").agg(F.count("*").alias("n")), "counts")
        several = counts.agg(F.max("n"), F.count("*")).head()
        if not several[0] or several[0] == 1:
            return found
        with_n = found.join(F.broadcast(counts) if several[1] <= BROADCAST_ROWS else counts, "host")
        salt = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / FAN)).cast("int")
        dealt = with_n.select("host", salt.alias("salt"), "wrapper").repartition("host", "salt").sortWithinPartitions("host", "salt", F.xxhash64("wrapper"), "wrapper")
        found = stored(dealt.mapInArrow(_next, schema), "wrappers")


@lru_cache(4096)
def _judged(told: str) -> Judged:
    return Judged(Part.read(json.loads(told)))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html): its main text, blocks a line each, and its length.

    Null and empty pages, and pages without text of their own, give an empty text. Null page_ids and URLs are carried; repeated
    rows are told each. Blocks nested deeper than DEEPEST count as text of the block around them. An empty table gives no rows. Other
    columns are ignored.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    found = wrappers(pages)
    kind = pages.schema["page_id"].dataType.simpleString(), pages.schema["url"].dataType.simpleString()

    def told(batches):
        for batch in batches:
            texts = [main_text(_judged(w), page) for page, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    total = found.agg(F.count("*"), F.sum("pages")).head()
    if (total[0] or 0) <= BROADCAST_ROWS:
        matched = rows.join(F.broadcast(found.drop("pages")), "host")
    else:  # hosts with over a thousandth of all pages, at most a thousand, by broadcast; the others are dealt by host
        hot = F.broadcast(found.where(F.col("pages") > total[1] // 1000).drop("pages"))
        rest = rows.join(hot, "host", "left_anti").join(found.where(F.col("pages") <= total[1] // 1000).drop("pages"), "host")
        matched = rows.join(hot, "host").unionByName(rest)
    return matched.select("page_id", "url", "html", "wrapper").mapInArrow(told, f"page_id {kind[0]}, url {kind[1]}, text string, n_chars long")
