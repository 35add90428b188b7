"""A small tree of a captured page, built from the tag stream as browsers do it: implied ends, formatting that goes on.

Nothing here recurses, and the tree is at most DEEPEST levels deep (further elements become siblings, as in
browsers), so a page costs time in proportion to its length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Kinds of elements in the rules for parsing HTML.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr listing main menu nav ol p pre search section summary table ul xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SPECIAL = BLOCKS | HEADINGS | frozenset(
    "root applet area base body br button caption col colgroup dd dt embed frame frameset head html iframe img input keygen li link marquee meta noembed noframes noscript "
    "object param plaintext script select source style tbody td template textarea tfoot th thead title tr track wbr".split()
)
TABLE_PARTS = frozenset("table caption colgroup tbody thead tfoot tr td th".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_SCOPE = frozenset("root applet caption html table td th marquee object template".split())
_BUTTON, _P, _OBJECTS = _SCOPE | {"button"}, frozenset(("p",)), frozenset("applet marquee object".split())
_STRUCTURE = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
_CELLS, _ROWS = frozenset("td th caption".split()), frozenset("table tbody tfoot thead tr".split())
_TABLE, _BODIES, _ROW = frozenset(("table", "root")), frozenset("table tbody tfoot thead root".split()), _ROWS | {"root"}
#: Start tags before which formatting doesn't go on.
_QUIET = frozenset("param source track base link meta script style template title noscript noframes iframe textarea".split())
#: Levels of a tree, equal formatting elements that go on after their block, and such elements in all.
DEEPEST, EQUAL, ACTIVE = 512, 3, 32
#: Elements whose content is text up to their own end tag; entities count only in the second kind.
RAW, ESCAPED = frozenset("script style iframe xmp noembed noframes".split()), frozenset(("textarea", "title"))
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*(?:([^\s/>][^\s/>=]*)\s*(?:(=)\s*)?)?")
_VALUE = re.compile(r"[^\s>]*")
#: The rest of a tag with nothing but quoted attributes, as most have; and one of these.
_QUOTED = re.compile(r"""(?:\s+[^\s/>"'=]+=(?:"[^"]*"|'[^']*'))*+\s*>""")
_PAIR = re.compile(r"""\s+([^\s/>"'=]+)=(?:"([^"]*)"|'([^']*)')""")
_SPACE = re.compile(r"[\t\n\x0b\f\r    -     　﻿]+")


def clean(s: str) -> str:
    """White space collapsed and trimmed."""
    return _SPACE.sub(" ", s).strip(" ")


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "open", "_classes")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, up: Node | None = None) -> None:
        self.tag, self.attrs, self.up, self.open, self._classes = tag, attrs or {}, up, False, None
        self.kids: list[Node | str] = []

    def append(self, kid: Node | str) -> None:
        self.kids.append(kid)
        if isinstance(kid, Node):
            kid.up = self

    def _place_of(self, kid: Node) -> int:
        """Searched from the end, where those that are still open stand."""
        return next(i for i in range(len(self.kids) - 1, -1, -1) if self.kids[i] is kid)

    def insert_before(self, kid: Node | str, before: Node) -> None:
        self.kids.insert(self._place_of(before), kid)
        if isinstance(kid, Node):
            kid.up = self

    def leave(self) -> None:
        if self.up:
            del self.up.kids[self.up._place_of(self)]
            self.up = None

    def hand_over(self, to: Node) -> None:
        """Gives all that is inside to another element."""
        to.kids, self.kids = self.kids, []
        for k in to.kids:
            if isinstance(k, Node):
                k.up = to

    def walk(self) -> Iterator[Node]:
        """The elements inside, in document order."""
        stack = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def text(self, skip: Callable[[Node], bool] = lambda n: n.tag in ("script", "style")) -> str:
        out, stack = [], list(reversed(self.kids))
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                out.append(k)
            elif not skip(k):
                stack += reversed(k.kids)
        return "".join(out)

    def classes(self) -> frozenset[str]:
        if self._classes is None:
            self._classes = frozenset(self.attrs.get("class", "").split())
        return self._classes

    def above(self) -> Iterator[Node]:
        """The elements around, nearest first."""
        n = self.up
        while n:
            yield n
            n = n.up

    def inside(self, *tags: str) -> bool:
        return any(n.tag in tags for n in self.above())

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        for n in self.walk():
            if test(n):
                return n
        return None

    def every(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if test(n)]

    def nearest(self, test: Callable[[Node], bool]) -> Node | None:
        n = self.up
        while n:
            if test(n):
                return n
            n = n.up
        return None

    def markup(self, skip: Callable[[Node], bool] = lambda n: False) -> str:
        """The element as HTML, without what ``skip`` holds for."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                out.append(k)
            elif not skip(k) or k is self:
                attrs = "".join(f' {a}="{entities.escape(v)}"' for a, v in k.attrs.items())
                out.append(f"<{k.tag}{attrs}>")
                if k.tag not in VOID:
                    stack.append(f"</{k.tag}>")
                    raw = k.tag in ("script", "style")
                    stack += [(x if raw else entities.escape(x, False)) if isinstance(x, str) else x for x in reversed(k.kids)]
        return "".join(out)


def unescape(s: str) -> str:
    try:
        return entities.unescape(s) if "&" in s else s
    except ValueError:  # a number of thousands of digits
        return s


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text, {}), ("start", tag, attributes) and ("end", tag, {}) of a page. What never ends, ends with the page."""
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", unescape(page[at:]), {}
            return
        if lt > at:
            yield "text", unescape(page[at:lt]), {}
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = end + 3 if end >= 0 else size
            continue
        close = page.startswith("/", lt + 1)
        name = _NAME.match(page, lt + 1 + close)
        if not name:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
            else:
                yield "text", "<", {}
                at = lt + 1
            continue
        tag, attrs, at = name[0].lower(), {}, name.end()
        if page.startswith(">", at):
            pass
        elif plain := _QUOTED.match(page, at):
            for key, one, two in _PAIR.findall(page, at, plain.end()):
                attrs.setdefault(key.lower(), unescape(one or two))
            at = plain.end() - 1
        while at < size and page[at] != ">":
            m = _ATTR.match(page, at)
            at = m.end()
            if m[1] is None:
                continue
            value = ""
            if m[2]:
                quote = page[at : at + 1]
                if quote in ("'", '"'):
                    end = page.find(quote, at + 1)
                    if end < 0:
                        return
                    value, at = page[at + 1 : end], end + 1
                else:
                    v = _VALUE.match(page, at)
                    value, at = v[0], v.end()
            attrs.setdefault(m[1].lower(), unescape(value))
        if at >= size:
            return
        at += 1
        if close:
            yield "end", tag, {}
            continue
        yield "start", tag, attrs
        if tag in RAW or tag in ESCAPED:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            text = page[at : end.start() if end else size]
            if text:
                yield "text", unescape(text) if tag in ESCAPED else text, {}
            at = end.start() if end else size


class _Builder:
    """Builds the tree by the public rules for parsing HTML, as far as they show in a page's content.

    Kept: implied ends, scopes, formatting that goes on after its block (at most EQUAL equal ones), marks that cells,
    captions and objects set for it, the adoption agency for formatting that overlaps blocks, an anchor ending the
    anchor before it, table structure from tags alone, and foster parents for what stands in a table outside its
    cells. Left out: frames, templates' own modes and the inner rules of svg and select.
    """

    def __init__(self) -> None:
        self.root = Node("root")
        self.root.open = True
        self.open = [self.root]
        self.tables: list[Node] = []  # the open parts of tables, innermost last
        self.active: list[Node | None] = []  # formatting not ended by its own tag; None is a mark
        self.count: dict[str, int] = {}  # open elements of each tag

    # the stack of open elements

    def _push(self, node: Node) -> None:
        if len(self.open) >= DEEPEST:
            return
        node.open = True
        self.open.append(node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1
        if node.tag in TABLE_PARTS:
            self.tables.append(node)

    def _shut(self, node: Node) -> None:
        node.open = False
        self.count[node.tag] -= 1
        if node.tag in TABLE_PARTS:
            self.tables.remove(node) if self.tables[-1] is not node else self.tables.pop()

    def _pop(self) -> Node:
        node = self.open.pop()
        self._shut(node)
        return node

    def _pop_to(self, node: Node) -> None:
        """Ends node and all that is open inside it."""
        while self._pop() is not node:
            pass

    def _scoped(self, tags: frozenset[str], stop: frozenset[str]) -> Node | None:
        """The innermost open element of tags, unless one of stop is further in."""
        if not any(self.count.get(t) for t in tags):
            return None
        for node in reversed(self.open):
            if node.tag in tags:
                return node
            if node.tag in stop:
                return None
        return None

    def _implied(self, but: str = "") -> None:
        while self.open[-1].tag in IMPLIED and self.open[-1].tag != but:
            self._pop()

    def _end_p(self) -> None:
        if p := self._scoped(_P, _BUTTON):
            self._pop_to(p)

    # where nodes go

    def _place(self, node: Node | str, over: Node | None = None) -> None:
        """Into the current element; what may not stand in a table goes before the table."""
        into = over or self.open[-1]
        if into.tag in _ROWS and self.fostering:
            table = next((t for t in reversed(self.tables) if t.tag == "table"), None)
            if table and table.up:
                table.up.insert_before(node, table)
                return
        into.append(node)

    fostering = False

    def _add(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self._place(node)
        return node

    def _enter(self, tag: str, attrs: dict[str, str]) -> Node:
        node = self._add(tag, attrs)
        self._push(node)
        return node

    # formatting

    def _mark(self) -> None:
        self.active.append(None)

    def _to_mark(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def _remember(self, node: Node) -> None:
        same, n = [], 0
        for f in reversed(self.active):
            if f is None:
                break
            n += 1
            if f.tag == node.tag and f.attrs == node.attrs:
                same.append(f)
        if len(same) >= EQUAL:
            self.active.remove(same[-1])
        elif n >= ACTIVE:
            del self.active[len(self.active) - n]
        self.active.append(node)

    def _resume(self) -> None:
        """Formatting that its block has ended goes on here."""
        at = len(self.active)
        while at and self.active[at - 1] is not None and not self.active[at - 1].open:
            at -= 1
        for i in range(at, len(self.active)):
            if len(self.open) >= DEEPEST:
                return
            self.active[i] = self._enter(self.active[i].tag, self.active[i].attrs)

    def _adopt(self, tag: str) -> None:
        """The end of formatting: blocks that it overlaps take copies of it inside."""
        if self.open[-1].tag == tag and self.open[-1] not in self.active:
            self._pop()
            return
        for _ in range(8):
            mine = None
            for f in reversed(self.active):
                if f is None or f.tag == tag:
                    mine = f
                    break
            if mine is None:
                self._end_other(tag)
                return
            if not mine.open:
                self.active.remove(mine)
                return
            at = len(self.open) - 1
            block = -1
            while self.open[at] is not mine:
                if self.open[at].tag in SPECIAL:
                    block = at
                if self.open[at].tag in _SCOPE:
                    return  # not in scope
                at -= 1
            if block < 0:
                self._pop_to(mine)
                self.active.remove(mine)
                return
            self._overlap(mine, at, block)

    def _overlap(self, mine: Node, at: int, block: int) -> None:
        around, furthest = self.open[at - 1], self.open[block]
        mark = self.active.index(mine)
        last, inner = furthest, 0
        for k in range(block - 1, at, -1):
            inner += 1
            node = self.open[k]
            held = node in self.active
            if inner > 3 and held:
                i = self.active.index(node)
                mark -= i < mark
                del self.active[i]
                held = False
            if not held:
                del self.open[k]
                self._shut(node)
                continue
            copy = Node(node.tag, node.attrs)
            i = self.active.index(node)
            self.active[i] = self.open[k] = copy
            node.open, copy.open = False, True
            if last is furthest:
                mark = i + 1
            last.leave()
            copy.append(last)
            last = copy
        last.leave()
        self.fostering, before = True, self.fostering
        self._place(last, around)
        self.fostering = before
        copy = Node(mine.tag, mine.attrs)
        furthest.hand_over(copy)
        furthest.append(copy)
        i = self.active.index(mine)
        mark -= i < mark
        del self.active[i]
        self.active.insert(mark, copy)
        self.open.remove(mine)
        self._shut(mine)
        copy.open = True
        self.open.insert(self.open.index(furthest) + 1, copy)
        self.count[copy.tag] = self.count.get(copy.tag, 0) + 1

    # tables

    def _table_start(self, tag: str, attrs: dict[str, str]) -> bool:
        """Handles a start tag by the innermost part of a table that is open; False leaves it to the rules of text."""
        part = self.tables[-1]
        if part.tag in _CELLS:
            if tag in _STRUCTURE:
                self._end_cell(part)
                return self._table_start(tag, attrs) if self.tables else True
            return False
        if tag in _STRUCTURE:
            if tag in _CELLS and tag != "caption":
                self._back_to(_ROW)
                if self.open[-1].tag != "tr":
                    self._table_start("tr", {})
                self._enter(tag, attrs)
                self._mark()
            elif tag == "tr":
                self._back_to(_BODIES)
                self._enter(tag, attrs)
            else:
                self._back_to(_TABLE)
                self._enter(tag, attrs)
                if tag == "caption":
                    self._mark()
                elif tag == "col":
                    self._pop()
            return True
        if tag == "table":
            table = next(t for t in reversed(self.tables) if t.tag == "table")
            self._pop_to(table)
            return self._table_start(tag, attrs) if self.tables else False
        if self.open[-1].tag == "colgroup":
            self._pop()
        if tag in ("style", "script", "template") or tag == "form" or tag == "input" and attrs.get("type", "").lower() == "hidden":
            if tag == "input":
                self._add(tag, attrs)
            elif tag != "form":
                self._enter(tag, attrs)
            return True
        self.fostering = True
        return False

    def _back_to(self, tags: frozenset[str]) -> None:
        while self.open[-1].tag not in tags:
            self._pop()

    def _end_cell(self, cell: Node) -> None:
        self._pop_to(cell)
        self._to_mark()

    def _table_end(self, tag: str) -> bool:
        """Handles the end of a part of a table."""
        if not self.tables or tag not in TABLE_PARTS:
            return tag in TABLE_PARTS
        mine = next((t for t in reversed(self.tables) if t.tag in (tag, "table")), None)
        if mine is None or mine.tag != tag:
            return True  # another table is nearer
        cell = next((t for t in reversed(self.tables) if t is mine or t.tag in _CELLS), mine)
        if cell is not mine:
            self._end_cell(cell)
        if mine.tag in _CELLS:
            self._end_cell(mine)
        else:
            self._pop_to(mine)
        return True

    # tokens

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        self.fostering = False
        if tag in ("html", "body", "head"):
            if self.count.get("head") and tag != "head":
                self._back_out("head")
            if not self.count.get(tag):
                self._enter(tag, attrs)
            return
        if self.open[-1].tag == "head" and tag not in HEAD_ONLY:
            self._pop()
        if self.tables:
            if self._table_start(tag, attrs):
                return
        elif tag in _STRUCTURE:
            return  # no table to be a part of
        self._text_start("img" if tag == "image" else tag, attrs)

    def _back_out(self, tag: str) -> None:
        node = next(n for n in reversed(self.open) if n.tag == tag)
        self._pop_to(node)

    def _text_start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in HEADINGS:
            self._end_p()
            if self.open[-1].tag in HEADINGS:
                self._pop()
        elif tag in ITEMS:
            for node in reversed(self.open):
                if node.tag in ITEMS[tag]:
                    self._implied(node.tag)
                    self._pop_to(node)
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self._end_p()
        elif tag in BLOCKS:
            self._end_p()
        elif tag == "button":
            if b := self._scoped(frozenset(("button",)), _SCOPE):
                self._pop_to(b)
            self._resume()
        elif tag in FORMATTING:
            if tag == "a":
                self._end_anchor()
            self._resume()
        elif tag == "option" and self.open[-1].tag == "option":
            self._pop()
        elif tag not in _QUIET:
            self._resume()
        node = self._add(tag, attrs)
        if tag in VOID:
            return
        self._push(node)
        if tag in FORMATTING and node.open:
            self._remember(node)
        elif tag in _OBJECTS:
            self._mark()

    def _end_anchor(self) -> None:
        for f in reversed(self.active):
            if f is None:
                return
            if f.tag == "a":
                self._adopt("a")
                if f in self.active:
                    self.active.remove(f)
                if f.open:
                    self.open.remove(f)
                    self._shut(f)
                return

    def end(self, tag: str) -> None:
        self.fostering = bool(self.tables) and self.tables[-1].tag not in _CELLS
        if tag in ("html", "body"):
            return
        if self._table_end(tag):
            return
        if tag in FORMATTING:
            self._adopt(tag)
        elif tag == "p":
            if not self._scoped(_P, _BUTTON):
                self._add("p", {})
            else:
                self._end_p()
        elif tag == "br":
            self._text_start("br", {})
        elif tag in HEADINGS:
            if node := self._scoped(HEADINGS, _SCOPE):
                self._pop_to(node)
        elif tag in BLOCKS or tag in ITEMS or tag in _OBJECTS or tag == "button":
            if node := self._scoped(frozenset((tag,)), _SCOPE | {"ul", "ol"} if tag == "li" else _SCOPE):
                self._pop_to(node)
                if tag in _OBJECTS:
                    self._to_mark()
        elif tag not in VOID:
            self._end_other(tag)

    def _end_other(self, tag: str) -> None:
        if not self.count.get(tag):
            return
        for node in reversed(self.open):
            if node.tag == tag:
                self._pop_to(node)
                return
            if node.tag in SPECIAL:
                return

    def text(self, data: str) -> None:
        blank = not data.strip()
        self.fostering = not blank and bool(self.tables) and self.tables[-1].tag not in _CELLS
        if not blank:
            if self.open[-1].tag == "head":
                self._pop()
            self._resume()
        self._place(data)


def parse(page: str | None) -> Node:
    b = _Builder()
    for kind, what, attrs in tokens(page or ""):
        if kind == "text":
            b.text(what)
        elif kind == "start":
            b.start(what, attrs)
        else:
            b.end(what)
    return b.root
