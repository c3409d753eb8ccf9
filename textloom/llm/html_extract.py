"""Main text of web pages by wrappers inferred from the pages of a host.

A wrapper is a union-free regular expression over tags and text slots (after Crescenzi, Mecca and Merialdo 2001), nested as the
elements are: an element's content is a sequence of elements and text slots with optional items ``( )?`` and repeated groups ``( )+``. A page's
token stream is folded first: neighbours with the same tag, and tandem repeats of several items, become one repeated group whose bodies are aligned.
Then the streams of a host's pages are aligned one after the other: what mismatches is resolved to a repeated group if it
repeats its neighbour, else to an optional item. All pages take part: those of a host in a batch are aligned in the map
over the pages, and the batches' wrappers in salted groups and then by host, so a hot host is spread over many tasks.

A wrapper's slots count pages, characters, characters in links, and up to a few different texts as pages are aligned. From them and the slot's
place in the wrapper it is judged: slots under menus, headers, footers, sidebars, notices, adverts, forms or reader comments (by element, class
or id) are templates; so are, outside of an ``article`` or ``main``, those that have the same text on at least ``constant_pages`` different pages, and
those that are mostly links. Each page is then matched against its host's wrapper, and its text is that of the content slots in an ``article`` or
``main`` if it has any, else of its other content slots; a page that they leave empty keeps its long blocks.

Elements deeper than ``DEEPEST`` have no items of their own: their text belongs to slots of the element at that depth.

Defined results: a null or empty html, and a page without content, give an empty text; a null or odd url counts as host ""; pages
cut short are read as far as they go, as are unclosed quotes; repeated pages are read each.
"""

from __future__ import annotations

import bisect
import html as html_lib
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import settle
from textloom.llm.url_filter import url_host

# Fixed values of the HTML standard.
SKIPPED = "script style noscript template head title svg math iframe object textarea select canvas audio video".split()
INLINE = "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
IMPLIED = "p li td th tr dt dd option thead tbody tfoot".split()
BOXES = "ul ol table dl".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BOILERPLATE = "nav header footer aside form menu dialog button".split()
NAMES = re.compile(r"(?<![a-z])(ads?|adverts?|advertisement|sponsor(ed)?|promo|banner|cookies?|consent|notice|notices|alert|popup|modal|nav|navbar|navigation|menu|breadcrumbs?|sidebar|header|masthead|footer|foot|comments?|disqus|replies|reply|social|related|recommended|newsletter|subscribe|signup|login|widget|toolbar|pagination|pager)(?![a-z])")
#: Words that tell of boilerplate only if a name has nothing but them; inside of an article this goes for those above, too.
WEAK = set("side share skip sharing".split())
PLAIN = set("area bar block body box button buttons container content form group icons inner item items link links list outer page panel post posts row section slot text title top wrap wrapper 0".split())
#: Names of what lies around the page, not of its part.
LAYOUT = re.compile(r"^(has|with|no|without)[-_]|[-_](wrap|wrapper|container|layout|page)$")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Where a quote never ends, quotes are like other characters.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
CUT = re.compile(r"</?[a-zA-Z][^<>]*\Z")
ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SKIP_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in SKIPPED}
DEEPEST = 64
TEXT, BELOW = "#", "#!"


def _key(tag: str, attrs: str) -> str:
    """The tag with its classes, ids and roles; digits are all alike."""
    if "=" not in attrs:
        return tag
    names = {w for a in ATTR.finditer(attrs) for w in (a[1] or a[2] or a[3] or "").lower().split()}
    return tag + "".join("." + re.sub(r"\d+", "0", w).replace("/", "") for w in sorted(names))


def events(page: str | None) -> list[tuple]:
    """The page as (key,) for an element's start, () for its end, and (None, text, characters in links) for a block of text."""
    page = page or ""
    out: list[tuple] = []
    open_: list[str] = []
    depths: dict[str, list[int]] = {}
    pieces: list[str] = []
    links, in_link, at, quoted, last_end = 0, False, 0, TAG, page.rfind(">")

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join(html_lib.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append((None, text, links))
        links = 0

    def close(depth: int) -> None:
        while len(open_) > depth:
            depths[open_.pop()].pop()
            out.append(())

    def last(tag: str) -> int:
        found = depths.get(tag)
        return found[-1] if found else -1

    while at < len(page):
        start = page.find("<", at)
        stop = len(page) if start < 0 else start
        if stop > at:
            pieces.append(page[at:stop])
            if in_link:
                links += stop - at
        if start < 0:
            break
        m = COMMENT.match(page, start) if page[start + 1 : start + 2] in ("!", "?") else None
        if m:
            at = m.end()
            continue
        m = quoted.match(page, start) if start < last_end else None
        if not m and (page[start + 1 : start + 2].isalpha() or page.startswith("</", start)):
            if start > last_end:
                if CUT.match(page, start):
                    break
            elif PLAIN_TAG.match(page, start):  # a quote that never ends
                quoted = PLAIN_TAG
                m = quoted.match(page, start)
        if not m:
            pieces.append("<")
            at = start + 1
            continue
        at, ends, tag = m.end(), bool(m[1]), m[2].lower()
        if tag in SKIP_END and not ends:
            if not m[3].rstrip().endswith("/"):
                end = SKIP_END[tag].search(page, at)
                at = end.end() if end else (len(page) if tag not in ("head", "object") else at)
            pieces.append(" ")
        elif tag in INLINE:
            if tag == "a":
                in_link = not ends
            elif tag in ("br", "img", "input", "wbr"):
                pieces.append(" ")
        else:
            flush()
            if ends:
                if last(tag) >= 0:
                    close(last(tag))
                in_link = False
            elif tag not in VOID:
                if tag in IMPLIED and last(tag) >= 0:  # a new paragraph or item ends the one before
                    if max(map(last, BOXES)) < last(tag):
                        close(last(tag))
                elif tag not in IMPLIED and open_ and open_[-1] == "p":
                    close(len(open_) - 1)
                depths.setdefault(tag, []).append(len(open_))
                open_.append(tag)
                out.append((_key(tag, m[3]),))
    flush()
    close(0)
    return out


# Wrappers are lists: an element [key, how, items, ranges] with items in order and the index ranges that are repeated as groups; a slot
# [key, how, pages, chars, links, texts, wholes] with the least hashes of different texts and of different pages. ``how``: "", "?", "+" or "*".
def _joined(a: str, b: str) -> str:
    many, none = "+" in a + b or "*" in a + b, "?" in a + b or "*" in a + b
    return ("*" if none else "+") if many else ("?" if none else "")


def _few(a: list[int], b: list[int], most: int) -> list[int]:
    return a if a == b else sorted({*a, *b})[:most]


def _merged(a: list, b: list, most: int) -> list:
    """What fits both: two elements or two slots with the same key. Without ``most`` they are of one page, whose texts in a slot count as one."""
    if len(a) == 7:
        if not most:
            return [a[0], _joined(a[1], b[1]), 1, a[3] + b[3], a[4] + b[4], [zlib.crc32(b"%d %d" % (a[5][0], b[5][0]))], a[6]]
        return [a[0], _joined(a[1], b[1]), a[2] + b[2], a[3] + b[3], a[4] + b[4], _few(a[5], b[5], 2), _few(a[6], b[6], most)]
    return [a[0], _joined(a[1], b[1]), *_aligned(a[2], a[3], b[2], b[3], most)]


def _pairs(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence; of very long sequences a common one."""
    if x == y:
        return [(i, i) for i in range(len(x))]
    if len(x) * len(y) > 40_000:
        places: dict[str, list[int]] = {}
        for j in range(len(y) - 1, -1, -1):
            places.setdefault(y[j], []).append(j)
        out, at = [], -1
        for i, k in enumerate(x):
            own = places.get(k, [])
            while own and own[-1] <= at:
                own.pop()
            if own:
                at = own.pop()
                out.append((i, at))
        return out
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _optional(item: list) -> list:
    return [item[0], _joined(item[1], "?"), *item[2:]]


def _aligned(a: list, ranges_a: list, b: list, ranges_b: list, most: int) -> tuple[list, list]:
    """(items, ranges) that fit what ``a`` and what ``b`` fit: common items stay, all else becomes optional."""
    items, at_a, at_b, i, j = [], [], [], 0, 0
    for x, y in [*_pairs([k[0] for k in a], [k[0] for k in b]), (len(a), len(b))]:
        for rest, end, start, at in ((a, x, i, at_a), (b, y, j, at_b)):
            for k in range(start, end):
                at.append(len(items))
                items.append(_optional(rest[k]))
        if x < len(a):
            at_a.append(len(items))
            at_b.append(len(items))
            items.append(_merged(a[x], b[y], most))
        i, j = x + 1, y + 1
    ranges = [[at[r[0]], at[r[1] - 1] + 1] for at, own in ((at_a, ranges_a), (at_b, ranges_b)) for r in own]
    return _folded(items, ranges, most)


def _folded(items: list, ranges: list, most: int, widest: int = 8) -> tuple[list, list]:
    """Neighbours with the same key become one repeated item, tandem repeats of several items one repeated range."""
    out, place = [], []
    for item in items:
        if out and out[-1][0] == item[0]:
            out[-1] = _merged(out[-1], item, most)
            out[-1][1] = "*" if "?" in (out[-1][1], item[1]) or "*" in (out[-1][1], item[1]) else "+"
        else:
            out.append(item)
        place.append(len(out) - 1)
    ranges = [[place[s], place[e - 1] + 1] for s, e in ranges]
    for width in range(2, widest + 1):
        i = 0
        while i + 2 * width <= len(out):
            keys = [k[0] for k in out[i : i + width]]
            n = 1
            while [k[0] for k in out[i + n * width : i + (n + 1) * width]] == keys:
                n += 1
            if n > 1:
                for k in range(width, n * width):
                    out[i + k % width] = _merged(out[i + k % width], out[i + k], most)
                gone, end = (n - 1) * width, i + n * width
                del out[i + width : end]
                moved = lambda p: p if p <= i + width else max(i + width, p - gone) if p >= end else i + width  # noqa: E731, B023
                ranges = [[s if s < i + width else (i if s < end else s - gone), moved(e)] for s, e in ranges] + [[i, i + width]]
            i += 1
    joined: list = []
    for s, e in sorted(map(list, {(s, e) for s, e in ranges if e > s})):
        if joined and s < joined[-1][1]:
            joined[-1][1] = max(e, joined[-1][1])
        else:
            joined.append([s, e])
    return out, joined


def page_wrapper(found: list[tuple]) -> list:
    """The folded stream of one page, as a wrapper that fits it."""
    whole = 0
    for e in found:
        if e and e[0] is None:
            whole = zlib.crc32(e[1].encode("utf-8", "replace"), whole)
    stack: list[list] = [["", "", []]]
    below: list[bool] = []
    for e in found:
        if not e:
            if below:
                below.pop()
                continue
            key, how, items = stack.pop()
            stack[-1][2].append([key, how, *_folded(items, [], 0)])
        elif e[0] is None:
            key = BELOW if below and below[-1] else TEXT
            stack[-1][2].append([key, "", 1, len(e[1]), e[2], [zlib.crc32(e[1].encode("utf-8", "replace"))], [whole]])
        elif len(stack) > DEEPEST:
            below.append(_is_boilerplate(e[0]) or (bool(below) and below[-1]))
        else:
            stack.append([e[0], "", []])
    return ["", "", *_folded(stack[0][2], [], 0)]


def align(a: list, b: list, most: int = 5) -> list:
    """The wrapper that fits what ``a`` and what ``b`` fit."""
    return _merged(a, b, most)


def written(wrapper: list) -> str:
    """The regular expression as text, over the tokens ``<key>``, ``</key>`` and ``#``."""

    def of(item: list) -> str:
        body = item[0] if len(item) == 7 else f"<{item[0]}>{sequence(item[2], item[3])}</{item[0]}>"
        return f"({body}){item[1]}" if item[1] else body

    def sequence(items: list, ranges: list) -> str:
        parts = [of(i) for i in items]
        for s, e in ranges:
            parts[s], parts[e - 1] = "(" + parts[s], parts[e - 1] + ")+"
        return "".join(parts)

    return sequence(wrapper[2], wrapper[3])


def _is_boilerplate(key: str, in_main: bool = False, around: bool = False) -> bool:
    tag, *names = key.split(".")
    if tag in BOILERPLATE:
        return True

    def tells(name: str) -> bool:
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        telling = [w for w in words if w in WEAK or NAMES.fullmatch(w)]
        return bool(telling) and all(w in PLAIN or w in telling for w in words) or not in_main and bool(NAMES.search(name))

    return tag not in ("html", "body") and any(tells(n) for n in names if not (around and LAYOUT.search(n)))


def is_main(key: str) -> bool:
    tag, *names = key.split(".")
    return tag in ("article", "main") or any(n.startswith(("article", "main")) for n in names)


def judged(wrapper: list, constant_pages: int) -> list:
    """The wrapper with its slots as [key, how, kind]: 0 template, 1 template by name only, 2 content, 3 content in the main region;
    elements have the places of their items' keys instead of ranges."""

    def has_main(item: list) -> bool:
        return len(item) == 4 and (is_main(item[0]) or any(map(has_main, item[2])))

    def of(item: list, main: bool, named: bool, tag: bool) -> list:
        key = item[0]
        if len(item) == 7:
            _, how, _, chars, links, texts, wholes = item
            shared = (len(wholes) >= constant_pages and len(texts) == 1) or 2 * links > chars
            kind = 0 if tag or key == BELOW or (shared and not main) else 1 if named else 3 if main else 2
            return [key, how, kind]
        tag = tag or key.split(".")[0] in BOILERPLATE
        named = named or _is_boilerplate(key, main, any(map(has_main, item[2])))
        main = main or is_main(key)
        items, places = [of(i, main, named, tag) for i in item[2]], {}
        for k, i in enumerate(items):
            places.setdefault(i[0], []).append(k)
        return [key, item[1], items, places]

    return of(wrapper, False, False, False)


def matched(found: list[tuple], wrapper: list | None) -> list[tuple[str, int, int]]:
    """(text, characters in links, kind of its slot) of the page's blocks, by matching the page against the wrapper from left to right.

    In a sequence the next item with the key is taken; behind the last one a repeated range starts over. Others with the key stay possible
    until a later token tells them apart."""
    stack: list[tuple[list, list[int]]] = [([wrapper] if wrapper else [], [0])]
    below: list[bool] = []
    out = []
    for e in found:
        if not e:
            if below:
                below.pop()
            else:
                stack.pop()
            continue
        if e[0] is not None and len(stack) > DEEPEST:
            below.append(_is_boilerplate(e[0]) or (bool(below) and below[-1]))
            continue
        key = e[0] if e[0] is not None else BELOW if below and below[-1] else TEXT
        elements, at = stack[-1]
        able: list = []
        for n, element in enumerate(elements):
            own = element[3].get(key)
            if own:
                if not able:  # what has no such item isn't the one
                    del elements[:n]
                    first = bisect.bisect_left(own, at[0]) % len(own) if not n else 0
                    at[0] = own[first]
                    able = [element[2][k] for k in (*own[first:], *own[:first])]
                    if key in (TEXT, BELOW):
                        break
                else:
                    able += [element[2][k] for k in own]
        if e[0] is None:
            out.append((e[1], e[2], able[0][2] if able else 0))
        else:
            stack.append((able, [0]))
    return out


def page_text(page: str | None, wrapper: list | None, long: int = 200) -> str:
    """The text of the page's main region if it has one, else of its content slots; a page that they leave empty keeps
    its long blocks outside of boilerplate elements that aren't links."""
    found = matched(events(page), wrapper)
    for kept in ([t for t, _, k in found if k == 3], [t for t, _, k in found if k >= 2], [t for t, n, k in found if k == 1 and len(t) >= long and 2 * n <= len(t)]):
        if kept:
            return "\n".join(kept)
    return ""


def _batch_wrappers(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """(host, wrapper, pages): the pages of each host in the batch, aligned."""
    for batch in batches:
        found: dict[str, list] = {}
        for host, page in zip(batch["host"].tolist(), batch["html"].tolist()):
            own, row = page_wrapper(events(page)), found.get(host or "")
            if row:
                row[:] = align(row[0], own, most), row[1] + 1
            else:
                found[host or ""] = [own, 1]
        yield pd.DataFrame([(h, json.dumps(w), n) for h, (w, n) in found.items()], columns=["host", "wrapper", "pages"])


def _folder(most: int):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        wrapper = None
        for own in sorted(pdf["wrapper"]):
            own = json.loads(own)
            wrapper = own if wrapper is None else align(wrapper, own, most)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(wrapper)], "pages": [int(pdf["pages"].sum())]})

    return fold


def infer_wrappers(pages: DataFrame, constant_pages: int = 5, salts: int = 64) -> DataFrame:
    """pages(host, html) -> (host, wrapper, pages): each host's wrapper with its slots' figures, as JSON; ``written`` makes it text."""
    schema = "host string, wrapper string, pages long"
    made = settle(pages.select("host", "html").mapInPandas(lambda x: _batch_wrappers(x, constant_pages), schema), "batch-wrappers")
    fold = _folder(constant_pages)
    salted = made.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    return salted.groupBy("host", "salt").applyInPandas(fold, schema).groupBy("host").applyInPandas(fold, schema)


def _reader(constant_pages: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[str, list] = {}
            texts = []
            for page, w in zip(batch["html"].tolist(), batch["wrapper"].tolist()):
                if w is not None and w not in known:
                    known[w] = judged(json.loads(w), constant_pages)
                texts.append(page_text(page, known.get(w)))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return read


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", most_broadcast: int = 20_000, constant_pages: int = 5) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. Wrappers are broadcast up to ``most_broadcast`` hosts, else joined by host."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), url_host(F.col(url_col)).alias("host"))
    wrappers = settle(infer_wrappers(rows, constant_pages), "wrappers").select("host", "wrapper")
    wrappers = F.broadcast(wrappers) if wrappers.count() <= most_broadcast else wrappers
    return rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper").mapInPandas(_reader(constant_pages), "page_id long, url string, text string, n_chars long")
