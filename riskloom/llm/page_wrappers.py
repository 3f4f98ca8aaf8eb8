"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of tokens: start tags (element name, with class, id and role where
they say something), text slots, end tags. Elements that only format text are no tokens.
The wrapper of a host is a regular expression without unions over such tokens, made of
sequences, optional parts, repeated groups and text slots, and is inferred by aligning
the host's pages one after another:

* text against text becomes a slot, which remembers whether all pages had the same text;
* a run or an alternation that comes back (``li li li``, ``dt dd dt dd``) becomes a
  repeated group, in which what is missing in some rounds is optional;
* a token without counterpart becomes optional. Which side skips is decided by searching
  for the counterpart across the mismatch in both streams, the nearer one wins.

Within a level every kind of token occurs once, since what comes back lies in a repeated
group, so an expression is no larger than the kinds of tokens a host has. Expressions are
aligned with each other as pages are: each task aligns its own pages by host, and the
results are aligned ``FAN_IN`` at a time in a tree, so no task sees all pages of a host.

From a wrapper follows which slots are main text: none inside menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments (by element, role
and words of class and id). Of the others those inside an article, else inside a main or
content element, else those of the smallest element that holds most of the text outside
of links, without slots that have the same text on all of several different pages.
Every page is then read with its host's wrapper; a page on which that finds nothing is
read with a wrapper of its own.

Character references are decoded, white space (any Unicode white space) inside a block
becomes one space, blocks are trimmed and joined by an empty line in page order. A null
html counts as empty; a page without text gives an empty text. A page whose url is null
or has no host is read with a wrapper of its own. Repeated rows are read each. Elements
nested deeper than ``DEPTH`` are taken as children of that depth. Columns other than the
url, the html and those named to be kept are not looked at.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import stored, unused
from riskloom.operators.joins import many_to_one

# Expressions aligned at a time, and hosts a task holds before it hands them on.
FAN_IN, HOSTS = 16, 2_000
# Bytes of programs that may go to every task.
BROADCAST = 32 << 20
DEPTH = 150

# --- fixed values: elements of HTML and words that name parts of pages ----------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "button iframe math noembed noframes noscript script select style svg template textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label map mark meter "
    "nobr object output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
# An element of the key's group ends open ones of the same group, up to the elements named.
ENDS = {
    **dict.fromkeys(("li",), (("li",), ("ul", "ol", "menu", "dir"))),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
    **dict.fromkeys(("tr",), (("tr", "td", "th"), ("table",))),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",))),
    **dict.fromkeys(("body",), (("head",), ())),
}
NOT_MAIN = frozenset(
    "aside button dialog footer form head header iframe input label menu nav noscript option script search select "
    "style svg template textarea title".split())
NOT_MAIN_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOT_MAIN_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination paywall popup promo promoted recommended related replies "
    "reply respond share sharing sidebar sidenav signup skip skyscraper social sponsor sponsored subscribe "
    "subscription toolbar topbar widget widgets".split())
# A name with one of these says what its element goes with, not what it is.
BESIDE_WORDS = frozenset("has no with without".split())
# Elements that are what their name says, whatever their class.
CLEAR = frozenset("article body h1 h2 h3 h4 h5 h6 html main".split())
MAIN_WORDS = frozenset("article content entry main maincontent post story".split())
# --- end of fixed values ---------------------------------------------------------------

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_SKIPPED_END = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I) for name in SKIPPED}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LETTER = re.compile(r"[a-zA-Z]")
_KIND_NAME = re.compile(r"[!~.\[]")


def _words(token: str) -> set[str]:
    """The words of a class or id; numbers at a word's end don't matter."""
    out = set()
    for piece in re.split(r"[-_:.]+", token):
        piece = piece.strip("0123456789")
        if piece.isalpha():
            out |= {piece.lower(), *(w.lower() for w in _WORD.findall(piece))}
    return out


@lru_cache(4096)
def _label(name: str, attributes: str) -> tuple[str, bool]:
    """What stands for a start tag in the stream, and whether nothing in it can be main text.

    The element's name, ``!`` if it is barred by more than that, ``~`` if it is named as
    main text, and the classes and id that hold no digit (others differ by page).
    """
    names, role, shown, barred, main = set(), "", True, False, False
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "role":
            role = value.lower().strip()
        elif key == "hidden":
            shown = False
        elif key == "aria-hidden":
            shown = shown and value.lower() != "true"
        else:
            for token in value.split():
                words = _words(token)
                barred |= bool(words & NOT_MAIN_WORDS) and not words & BESIDE_WORDS
                main |= bool(words & MAIN_WORDS)
                if not any(c.isdigit() for c in token):
                    names.add(token.lower())
    barred = not shown or role in NOT_MAIN_ROLES or (barred and name not in CLEAR)
    if name in NOT_MAIN:
        label = name
    else:
        label = name + ("!" if barred else "~" if main or role == "main" else "")
    if names and name not in ("html", "body"):
        label += "." + ".".join(sorted(names))
    return label, barred or name in NOT_MAIN


class Element:
    """Label, whether it is barred, and children: elements and runs of text [text, link characters]."""

    __slots__ = ("name", "label", "barred", "children")

    def __init__(self, name: str, label: str, barred: bool) -> None:
        self.name, self.label, self.barred, self.children = name, label, barred, []

    def kind(self) -> str:
        """The token; containers without a name are told apart by what they hold."""
        if self.label not in ("div", "section", "td"):
            return self.label
        held = {"#" if isinstance(c, tuple) else c.label for c in self.children}
        return f"{self.label}[{','.join(sorted(held))}]"


def _no_tag(page: str, start: int) -> int:
    """Where what starts with "<" ends: a comment, a declaration, a lone "<"; ``start`` if it is a tag."""
    if page.startswith("<!--", start):
        close = page.find("-->", start + 4)
        return len(page) if close < 0 else close + 3
    if page.startswith(("<!", "<?"), start) or page.startswith("</", start) and not _LETTER.match(page, start + 2):
        close = page.find(">", start)
        return len(page) if close < 0 else close + 1
    return start if _LETTER.match(page, start + 1) or page.startswith("</", start) else start + 1


def parse(page: str) -> Element:
    """The page as a tree; implied end tags are added, formatting elements left out."""
    root = Element("#root", "#root", False)
    stack, text, links = [root], [], 0
    # Formatting elements open since each element of the stack: (name, barred).
    formats: list[list[tuple[str, bool]]] = [[]]
    quiet = inside_link = 0
    at, end = 0, len(page)

    def add(run: str) -> None:
        nonlocal links
        if run and not quiet:
            text.append(run)
            if inside_link:
                links += len(run)

    def flush() -> None:
        nonlocal links
        run = "".join(text)
        if not run.isspace():
            # Text ends a head that is left open.
            (stack[-2] if stack[-1].name == "head" else stack[-1]).children.append((run, links))
        text.clear()
        links = 0

    def drop(n: int) -> None:
        """End all elements from the n-th of the stack on."""
        nonlocal quiet, inside_link
        if text:
            flush()
        for opened in formats[n:]:
            for name, barred in opened:
                quiet -= barred
                inside_link -= name == "a"
        del stack[n:], formats[n:]

    def end_open(group: tuple[str, ...], limits: tuple[str, ...]) -> None:
        for n in range(len(stack) - 1, 0, -1):
            if stack[n].name in limits:
                return
            if stack[n].name in group:
                # The outermost one of a run of them: a row ends its cells.
                while n > 1 and stack[n - 1].name in group:
                    n -= 1
                drop(n)
                return

    while at < end:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        tag = _TAG.match(page, start)
        if tag is None:
            at = _no_tag(page, start)
            if at > start:
                if at == start + 1:
                    add("<")
                continue
            tag = _LOOSE_TAG.match(page, start)
            if tag is None:
                break  # the page ends inside a tag
        at = tag.end()
        closing, name, attributes = tag[1], tag[2].lower(), tag[3]
        if name in INLINE:
            if name == "br" or name == "wbr":
                add(" " if name == "br" else "")
            elif name not in VOID:
                if not closing:
                    barred = _label(name, attributes)[1]
                    formats[-1].append((name, barred))
                    quiet += barred
                    inside_link += name == "a"
                else:
                    own = formats[-1]
                    for n in range(len(own) - 1, -1, -1):
                        if own[n][0] == name:
                            quiet -= own[n][1]
                            inside_link -= name == "a"
                            del own[n]
                            break
            continue
        if closing:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].name == name:
                    drop(n)
                    break
            continue
        if name in SKIPPED:
            if not attributes.rstrip().endswith("/"):
                found = _SKIPPED_END[name].search(page, at)
                at = found.end() if found else end
            continue
        if text:
            flush()
        if name in ENDS_PARAGRAPH:
            end_open(("p",), ("button", "td", "th", "table", "object", "li", "div", "article", "section"))
        if name in ENDS:
            end_open(*ENDS[name])
        if name in VOID:
            continue
        if stack[-1].name == "head":
            drop(len(stack) - 1)
        element = Element(name, *_label(name, attributes))
        if name in ("html", "body") and any(e.name == name for e in stack):
            continue
        stack[-1].children.append(element)
        if len(stack) < DEPTH:
            stack.append(element)
            formats.append([])
    drop(1)
    if text:
        flush()
    return root


# Expressions ---------------------------------------------------------------------------
#
# A level is {"items": {kind: item}, "groups": [[first, last], ...]}: items in their order,
# each kind once; groups are disjoint ranges of it that repeat. An item is [times, level]
# or, for the kind "#", [times, slot]; times is 1, "?", "+" or "*". A slot is [texts,
# characters, characters in links, hash of its text or None if texts differ].


def _slot(run: str, links: int) -> list:
    return [1, len(run), links, zlib.crc32(" ".join(run.split()).encode("utf-8", "surrogatepass"))]


def _either(a: str, b: str) -> str:
    """How often, if either may hold."""
    repeated, missing = a in "+*" or b in "+*", a in "?*" or b in "?*"
    return ("*" if missing else "+") if repeated else "?" if missing else "1"


def _again(times: str) -> str:
    return "*" if times in "?*" else "+"


def _join_groups(groups: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(groups):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _merge_content(kind: str, a, b):
    if kind != "#":
        return align(a, b)
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] if a[3] == b[3] else None]


def expression(element: Element) -> dict:
    """The expression of one page: what comes back becomes a repeated group."""
    items: dict[str, list] = {}
    sequence: list[str] = []
    for child in element.children:
        if isinstance(child, tuple):
            kind, content = "#", _slot(*child)
        else:
            kind = child.kind()
            content = {"items": {}, "groups": []} if child.barred else expression(child)
        if kind in items:
            items[kind][1] = _merge_content(kind, items[kind][1], content)
        else:
            items[kind] = ["1", content]
        sequence.append(kind)
    place = {kind: n for n, kind in enumerate(items)}
    groups, runs = [], [sequence[0]] if sequence else []
    for kind in sequence[1:]:
        if kind == runs[-1]:
            items[kind][0] = "+"
        else:
            runs.append(kind)
    last = {}
    for n, kind in enumerate(runs):
        if kind in last:
            inside = [place[k] for k in runs[last[kind]:n + 1]]
            groups.append([min(inside), max(inside)])
        last[kind] = n
    groups = _join_groups(groups)
    if groups:
        _mark_optional(items, groups, [place[k] for k in runs])
    return {"items": items, "groups": groups}


def _mark_optional(items: dict[str, list], groups: list[list[int]], runs: list[int]) -> None:
    """In a group, what some round lacks is optional; a round ends where the order starts anew."""
    kinds = list(items)
    for first, last in groups:
        rounds, before, seen = 0, math.inf, dict.fromkeys(range(first, last + 1), 0)
        for n in runs:
            if first <= n <= last:
                rounds += n <= before
                before = n
                seen[n] += 1
        for n, times in seen.items():
            if times < rounds:
                items[kinds[n]][0] = _either(items[kinds[n]][0], "?")


def align(a: dict, b: dict) -> dict:
    """One expression for what either of two accepts.

    Items of the same kind are aligned with each other. At a mismatch the counterparts
    are searched across it in both streams, and the nearer one decides which side has
    something optional. Kinds that come in another order on both sides form a repeated
    group of optional items.
    """
    ia, ib = a["items"], b["items"]
    if list(ia) == list(ib):
        order = list(ia)
    else:
        ka, kb = list(ia), list(ib)
        pa_, pb = {k: n for n, k in enumerate(ka)}, {k: n for n, k in enumerate(kb)}
        order, i, j = [], 0, 0
        while i < len(ka) and j < len(kb):
            if ka[i] == kb[j]:
                order.append(ka[i])
                i, j = i + 1, j + 1
                continue
            across_b = pb.get(ka[i], math.inf) - j
            across_a = pa_.get(kb[j], math.inf) - i
            if 0 < across_b <= across_a or across_a < 0:
                order.append(kb[j])
                j += 1
            else:
                order.append(ka[i])
                i += 1
        order += ka[i:] + kb[j:]
    place: dict[str, int] = {}
    again: list[tuple[int, str]] = []
    for kind in order:
        if kind in place:
            again.append((len(place) - 1, kind))
        else:
            place[kind] = len(place)
    items = {}
    for kind in place:
        x, y = ia.get(kind), ib.get(kind)
        if x and y:
            items[kind] = [_either(x[0], y[0]), _merge_content(kind, x[1], y[1])]
        else:
            times, content = x or y
            items[kind] = [_either(times, "?"), content]
    kinds = list(items)
    groups = []
    for side in (a, b):
        own = list(side["items"])
        groups += [sorted((place[own[f]], place[own[l]])) for f, l in side["groups"]]
    groups += [sorted((place[kind], upto)) for upto, kind in again]
    groups = _join_groups(groups)
    for first, last in groups:
        in_both = [set(), set()]
        for n, side in enumerate((a, b)):
            own = list(side["items"])
            for f, l in side["groups"]:
                in_both[n] |= set(own[f:l + 1])
        for n in range(first, last + 1):
            # What did not belong to the repeated group on a side that has it need not come back.
            if any(kinds[n] not in held for held, side in zip(in_both, (a, b)) if kinds[n] in side["items"]):
                items[kinds[n]][0] = _either(items[kinds[n]][0], "?")
    return {"items": items, "groups": groups}


def wrapper_of(page: str) -> dict:
    """The expression of a page with its number of pages and the range of their contents' hashes."""
    tree = expression(parse(page))
    digest = zlib.crc32(page.encode("utf-8", "surrogatepass"))
    return {"level": tree, "pages": 1, "least": digest, "most": digest}


def align_wrappers(a: dict, b: dict) -> dict:
    return {
        "level": align(a["level"], b["level"]), "pages": a["pages"] + b["pages"],
        "least": min(a["least"], b["least"]), "most": max(a["most"], b["most"]),
    }


def pattern(level: dict) -> str:
    """A level as a regular expression in words, for reading."""
    out = []
    starts, ends = {f for f, _ in level["groups"]}, {l for _, l in level["groups"]}
    for n, (kind, (times, content)) in enumerate(level["items"].items()):
        inner = "#text" if kind == "#" else f"<{kind}> {pattern(content)} </{kind}>".replace("  ", " ")
        times = "" if times == "1" else times
        out.append(("(" if n in starts else "") + (f"({inner}){times}" if times else inner) + (")+" if n in ends else ""))
    return " ".join(out)


# Which slots are main text -----------------------------------------------------------------


def _name(kind: str) -> str:
    return _KIND_NAME.split(kind, maxsplit=1)[0]


def _barred(kind: str) -> bool:
    name = _name(kind)
    return name in NOT_MAIN or kind.startswith(name + "!")


def _slots(level: dict, path: tuple[str, ...], out: list) -> None:
    for kind, (_, content) in level["items"].items():
        if kind == "#":
            out.append((path, content))
        elif not _barred(kind):
            _slots(content, (*path, kind), out)


def program(wrapper: dict) -> dict:
    """The main slots as nested kinds, ``{"html": {"body": {"p": {"#": 1}}}}``; empty if there are none."""
    slots: list[tuple[tuple[str, ...], list]] = []
    _slots(wrapper["level"], (), slots)

    chosen = [s for s in slots if any(_name(k) == "article" for k in s[0])]
    if not chosen:
        chosen = [s for s in slots if any(_name(k) == "main" or k.startswith(_name(k) + "~") for k in s[0])]
    if not chosen:
        several = wrapper["least"] != wrapper["most"]
        free = [s for s in slots if s[1][2] * 2 <= s[1][1] and not (several and s[1][3] is not None and s[1][0] >= wrapper["pages"])]
        chosen = _densest(free or slots)
    out: dict = {}
    for path, _ in chosen:
        level = out
        for kind in path:
            level = level.setdefault(kind, {})
        level["#"] = 1
    return out


def _densest(slots: list) -> list:
    """The slots of the smallest element that holds most of the text outside of links."""
    weight, own = {}, {}
    for path, (_, chars, links, _) in slots:
        own[path] = own.get(path, 0) + chars - links
        for n in range(len(path) + 1):
            weight[path[:n]] = weight.get(path[:n], 0) + chars - links
    at: tuple[str, ...] = ()
    while True:
        below = [p for p in weight if len(p) == len(at) + 1 and p[:len(at)] == at]
        best = max(below, key=lambda p: (weight[p], p), default=None)
        # An element whose text is its own is a block of text, no container.
        if best is None or weight[best] * 10 < weight[()] * 7 or own.get(best, 0) * 2 >= weight[best]:
            return [s for s in slots if s[0][:len(at)] == at]
        at = best


# Reading a page -------------------------------------------------------------------------


def _read(element: Element, level: dict, out: list[str]) -> None:
    for child in element.children:
        if isinstance(child, tuple):
            if "#" in level:
                out.append(child[0])
        elif not child.barred:
            below = level.get(child.kind())
            if below:
                _read(child, below, out)


def blocks(root: Element, main: dict) -> list[str]:
    runs: list[str] = []
    _read(root, main, runs)
    texts = (" ".join(entities.unescape(run).split()) for run in runs)
    return [t for t in texts if t]


def main_text(page: str, main: dict | None = None) -> str:
    """The main text of a page by its host's program, or else by its own."""
    root = parse(page)
    found = blocks(root, main) if main else []
    if not found:
        own = {"level": expression(root), "pages": 1, "least": 0, "most": 0}
        found = blocks(root, program(own))
    return "\n\n".join(found)


# On Spark -------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """The url's host with A-Z lower-cased; null if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.nullif(F.translate(host, upper, lower), F.lit(""))


def _text_udf():
    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[str | None, dict | None] = {None: None}
        for pages, plans in batches:
            out = []
            for page, plan in zip(pages.to_pylist(), plans.to_pylist()):
                if plan not in known:
                    if len(known) > HOSTS:
                        known = {None: None}
                    known[plan] = json.loads(plan)
                out.append(main_text(page, known[plan]))
            yield pa.array(out, pa.string())

    return run


def _dump(wrapper: dict) -> bytes:
    return zlib.compress(json.dumps(wrapper, separators=(",", ":")).encode("utf-8", "surrogatepass"), 1)


def _load(blob: bytes) -> dict:
    return json.loads(zlib.decompress(blob).decode("utf-8", "surrogatepass"))


def _rows(hosts: dict[str, dict], part: int) -> pa.RecordBatch:
    names = sorted(hosts)
    return pa.RecordBatch.from_pydict({
        "host": pa.array(names, pa.string()), "part": pa.array([part] * len(names), pa.int64()),
        "wrapper": pa.array([_dump(hosts[h]) for h in names], pa.binary())})


def infer(pages: DataFrame) -> DataFrame:
    """host and its wrapper, from rows of host and html; rows without host take no part."""

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, hosts = TaskContext.get().partitionId(), {}
        for batch in batches:
            for host, html in zip(batch["host"], batch["html"]):
                host, found = host.as_py(), wrapper_of(html.as_py())
                hosts[host] = align_wrappers(hosts[host], found) if host in hosts else found
                if len(hosts) >= HOSTS:
                    yield _rows(hosts, part)
                    hosts = {}
        if hosts:
            yield _rows(hosts, part)

    def together(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["part"].to_pylist(), table["wrapper"].to_pylist()))
        whole = _load(rows[0][1])
        for _, blob in rows[1:]:
            whole = align_wrappers(whole, _load(blob))
        return pa.table({
            "host": table["host"][:1], "part": pa.array([rows[0][0] // FAN_IN], pa.int64()),
            "wrapper": pa.array([_dump(whole)], pa.binary())})

    kinds = "host string, part bigint, wrapper binary"
    wrappers = stored(pages.where("host IS NOT NULL").select("host", "html").mapInArrow(by_task, kinds), "wrappers")
    parts = (wrappers.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        group = F.floor(F.col("part") / FAN_IN)
        wrappers = wrappers.groupBy("host", group.alias("group")).applyInArrow(together, kinds)
        parts = math.ceil(parts / FAN_IN)
        if parts <= 1:
            return wrappers.select("host", "wrapper")


def programs(wrappers: DataFrame) -> DataFrame:
    """host and which slots of its wrapper are main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(program(_load(w.as_py())), separators=(",", ":")) for w in batch["wrapper"]]
            yield pa.RecordBatch.from_pydict({"host": batch["host"], "program": pa.array(found, pa.string())})

    return wrappers.mapInArrow(run, "host string, program string")


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html") -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` of every page."""
    whole = F.coalesce(F.col(html).cast("string"), F.lit(""))
    found = stored(programs(infer(pages.select(host_of(F.col(url).cast("string")).alias("host"), whole.alias("html")))), "programs")
    size = found.agg(F.sum(F.length("host") + F.length("program"))).first()[0] or 0
    h = unused(pages, "host")
    rows = pages.select(
        *keep, host_of(F.col(url).cast("string")).alias(h), whole.alias(f"{h}_html"))
    by_host = found.select(F.col("host").alias(h), F.col("program").alias(f"{h}_program"))
    if size <= BROADCAST:
        rows = rows.join(F.broadcast(by_host), h, "left")
    else:
        rows = many_to_one(rows, by_host, [h])

    texts = rows.select(*keep, _text_udf()(f"{h}_html", f"{h}_program").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
