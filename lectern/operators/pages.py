"""Page jobs: links, Markdown and warning blocks of captured pages, as rows.

Each page is parsed once in an Arrow batch; everything after the rows is relational. No step recurses, and a
page costs time in proportion to its length. A page that still can't be read gives a row with its error.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import SiteConfig
from lectern.functions.urls import RED_NAMES, VIDEO_HOST, norm_url, skipped_media
from lectern.sources.captures import manifest_captures
from lectern.sources.html import Node, clean, parse

# Elements that carry nothing for a reader, classes that hide, blocks, inline elements, media.
SKIPPED = frozenset("script style noscript nav button input select textarea svg template head link meta option".split())
HIDDEN = frozenset(("accesshide", "sr-only", "visually-hidden"))
BLOCKS = frozenset("p div section article header footer main figure figcaption center aside address dl dt dd details summary fieldset legend form label".split())
INLINE = frozenset("span font strong b em i u a mark small big".split())
MEDIA = frozenset("iframe video audio embed object frame".split())
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "cite": "*", "s": "~~", "del": "~~", "strike": "~~"}
LINKED = {"a": "href", "img": "src", "video": "src", "audio": "src", "source": "src", "iframe": "src", "embed": "src", "frame": "src", "object": "data"}

_VIDEO = re.compile(VIDEO_HOST)
_NO_PAGE = re.compile(r"(?i)^(javascript|mailto|tel|data):|^#")
_CSS = re.compile(r"(?i)(?:^|;)\s*color\s*:\s*([^;]+)")
_LEAF_BREAKERS = frozenset("p div ul ol table h1 h2 h3 h4 h5 h6".split())
_HEADING = re.compile("h[1-6]")
_ERRATUM = re.compile(r"(?i)erratum\b")
_BREAK = ("break", None)


#: Plain addresses from a site's root, which are joined as they stand, and a site.
_ROOTED = re.compile(r"(?a:(?:/[\w~%+=-][\w~%+=.-]*)+(?:\?[\w~%+=&.-]+)?)")
_SITE = re.compile(r"https?://[a-z0-9.-]+(?::[0-9]+)?(?=[/?#]|\Z)")


def resolve(href: str | None, base: str | None) -> str | None:
    """The absolute address of a link; null if it leads to no page."""
    href = (href or "").strip()
    if not href or _NO_PAGE.match(href):
        return None
    if _ROOTED.fullmatch(href) and (site := _SITE.match(base or "")):
        return site[0] + href
    try:
        return urljoin(base or "", href)
    except ValueError:
        return None


def name_of(url: str) -> str:
    """The last part of an address's path, decoded."""
    try:
        parts = [p for p in urlsplit(url).path.split("/") if p]
    except ValueError:
        return ""
    return unquote(parts[-1]) if parts else ""


def is_red(n: Node) -> bool:
    if not n.attrs:
        return False
    if "text-danger" in n.classes():
        return True
    style = _CSS.search(n.attrs.get("style", ""))
    c = (n.attrs.get("color") or (style[1] if style else "")).strip().lower()
    if c in RED_NAMES:
        return True
    if m := re.match(r"#([0-9a-f]{3})\b", c):
        rgb = [int(x * 2, 16) for x in m[1]]
    elif m := re.match(r"#([0-9a-f]{6})", c):
        rgb = [int(m[1][i : i + 2], 16) for i in (0, 2, 4)]
    elif m := re.match(r"rgba?\(\s*(\d{1,9})[,\s]+(\d{1,9})[,\s]+(\d{1,9})", c):
        rgb = [int(x) for x in m.groups()]
    else:
        return False
    return rgb[0] >= 150 and max(rgb[1:]) <= 90


class Texts:
    """Of every element: length and first characters of its collapsed text, length of its red text, whether it
    holds blocks. One pass from the last element to the first."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root, *root.walk()]
        self.size: dict[Node, int] = {}
        self.head: dict[Node, str] = {}
        self.red: dict[Node, int] = {}
        self.broken: dict[Node, bool] = {}
        edges: dict[Node, tuple[bool, bool]] = {}  # white space before and after the text
        for n in reversed(self.nodes):
            size, head, red, broken, lead, gap = 0, "", 0, False, False, False
            for k in n.kids:
                if isinstance(k, str):
                    text = clean(k)
                    piece = (len(text), text[:8], k[:1].isspace(), k[-1:].isspace())
                elif k.tag in ("script", "style"):
                    continue
                else:
                    piece = (self.size[k], self.head[k], *edges[k])
                    red += self.size[k] if is_red(k) else self.red[k]
                    broken = broken or self.broken[k] or k.tag in _LEAF_BREAKERS
                if not piece[0]:
                    gap = gap or piece[2]
                    continue
                if size:
                    apart = gap or piece[2]
                    size, head = size + apart, head + " " * apart
                else:
                    lead = gap or piece[2]
                size, head, gap = size + piece[0], (head + piece[1])[:8], piece[3]
            self.size[n], self.head[n], self.red[n], self.broken[n] = size, head[:8], red, broken
            edges[n] = (lead, gap) if size else (gap, gap)

    def warns(self, n: Node) -> bool:
        """Red blocks, and leaf blocks that begin with "Erratum" or are red for the most part."""
        if not self.size[n]:
            return False
        if is_red(n):
            return True
        return not self.broken[n] and bool(_ERRATUM.match(self.head[n]) or self.red[n] >= 0.6 * self.size[n])


def media_address(n: Node, base: str) -> str | None:
    for key in ("data-setup-lazy", "data-setup"):
        try:
            source = json.loads(n.attrs.get(key) or "{}")["sources"][0]["src"]
        except (ValueError, LookupError, TypeError):
            continue
        if source and isinstance(source, str):
            return resolve(source, base)
    own = next((n.attrs[a] for a in ("src", "data", "data-src") if n.attrs.get(a)), None)
    inner = own or next((k.attrs["src"] for k in n.walk() if k.tag == "source" and k.attrs.get("src")), None)
    return resolve(inner or next((k.attrs["href"] for k in n.walk() if k.tag == "a" and k.attrs.get("href")), None), base)


def skipped(n: Node) -> bool:
    return n.tag in SKIPPED or "hidden" in n.attrs or bool(HIDDEN & n.classes()) or (n.tag in ("img", "i") and "icon" in n.classes())


class Markdown:
    """Renders a tree from its last element to its first.

    What an element gives is a flow: a row of inline texts, breaks, blocks (lists of lines) and loose list items.
    A flow is handed on to the element around it and merged into the longest of its neighbours.
    """

    def __init__(self, base: str | None, min_heading: int = 3, paths: dict[str, str] | None = None) -> None:
        self.base, self.min_heading, self.paths = base or "", min_heading, paths or {}

    def __call__(self, root: Node) -> str:
        texts = Texts(root)
        levels = [int(n.tag[1]) for n in texts.nodes if _HEADING.fullmatch(n.tag)]
        self.shift = self.min_heading - min(levels, default=1)
        self.made: dict[Node, deque] = {}
        order = self.contexts(root, texts)
        for n in reversed(order):
            self.made[n] = self.flow(n)
        return "\n".join(self.lines(self.made[root]))

    def contexts(self, root: Node, texts: Texts) -> list[Node]:
        """The visible elements in document order; notes what the elements around each say about it."""
        self.alert: set[Node] = set()  # elements shown as a warning
        self.again: set[Node] = set()  # marks that are open already
        self.player: set[Node] = set()
        self.rows: set[Node] = set()  # rows and cells of tables
        order, stack = [], [(root, False, frozenset(), False, False)]
        while stack:
            n, warned, marks, player, table = stack.pop()
            order.append(n)
            if not warned and ((n.tag in BLOCKS and n.tag != "label" and texts.warns(n)) or (n.tag in INLINE and is_red(n))):
                self.alert.add(n)
                warned = True
                marks = marks | {"**"} if n.tag in INLINE else marks
            if player:
                self.player.add(n)
            if table and n.tag in ("tr", "td", "th"):
                self.rows.add(n)
            mark = MARKS.get(n.tag)
            if mark in marks:
                self.again.add(n)
            marks = marks | {mark} if mark else marks
            player, table = player or "mediaplugin" in n.classes(), table or n.tag == "table"
            if n.tag not in MEDIA and n.tag not in ("pre", "code", "kbd", "samp"):
                stack += [(k, warned, marks, player, table) for k in reversed(n.kids) if isinstance(k, Node) and not skipped(k)]
        return order

    def target(self, url: str) -> str:
        path = self.paths.get(url, url)
        return f"<{path}>" if re.search(r"\s", path) else path

    def merged(self, n: Node) -> deque:
        parts = []
        for k in n.kids:
            if isinstance(k, str):
                parts.append(deque([("text", k.replace("\n", " "))]))
            elif k in self.made:
                f = self.made[k]
                if k.tag == "li" and n.tag not in ("ul", "ol"):
                    lines = self.lines(f) or [""]
                    f = deque([("item", [f"- {lines[0]}", *lines[1:]])])
                parts.append(f)
        if not parts:
            return deque()
        top = max(range(len(parts)), key=lambda i: len(parts[i]))
        whole = parts[top]
        for f in reversed(parts[:top]):
            whole.extendleft(reversed(f))
        for f in parts[top + 1 :]:
            whole.extend(f)
        return whole

    @staticmethod
    def lines(flow: deque) -> list[str]:
        """A flow as lines: blocks apart by a blank line, loose items next to text by none."""
        out: list[str] = []
        last, run = "", []

        def put(kind: str, lines: list[str]) -> None:
            nonlocal last
            if out and not (last and kind != last and {kind, last} == {"text", "item"}):
                out.append("")
            out.extend(lines)
            last = kind

        def flush() -> None:
            kept: list[str] = []
            for x in map(clean, "".join(run).split("\n")):
                if x or (kept and kept[-1]):
                    kept.append(x)
            while kept and not kept[-1]:
                kept.pop()
            run.clear()
            if kept:
                put("text", kept)

        for kind, value in flow:
            if kind == "text":
                run.append(value)
                continue
            flush()
            if kind == "break":
                last = ""
            else:
                put(kind, value)
        flush()
        return out

    @staticmethod
    def marked(flow: deque, mark: str, before: str = "", after: str = "") -> deque:
        """The flow with a mark before its first and after its last character that isn't white space."""
        has = [i for i, (kind, v) in enumerate(flow) if (kind == "text" and v.strip()) or kind in ("block", "item")]
        if not has:
            return flow
        kind, v = flow[has[0]]
        if kind == "text":
            at = len(v) - len(v.lstrip())
            flow[has[0]] = (kind, v[:at] + before + mark + v[at:])
        else:
            flow[has[0]] = (kind, [before + mark + v[0], *v[1:]])
        kind, v = flow[has[-1]]
        if kind == "text":
            at = len(v.rstrip())
            flow[has[-1]] = (kind, v[:at] + mark + after + v[at:])
        else:
            flow[has[-1]] = (kind, [*v[:-1], v[-1] + mark + after])
        return flow

    def flow(self, n: Node) -> deque:
        if n in self.alert:
            if n.tag in INLINE:
                return self.marked(self.element(n), "**", " ⚠️ ", " ")
            lines = self.lines(self.merged(n))
            return deque([("block", [f"> ⚠️ {lines[0]}", *(f"> {x}".rstrip() for x in lines[1:])])]) if lines else deque()
        return self.element(n)

    def element(self, n: Node) -> deque:
        tag = n.tag
        if tag in MEDIA:
            url = media_address(n, self.base)
            kind = "🎥 Video" if tag == "video" or n in self.player or _VIDEO.search(url or "") else "🔊 Audio" if tag == "audio" else "🧩 Embedded"
            return deque([("block", [f"{kind}: {self.paths.get(url, url)}"])]) if url else deque()
        if tag == "pre":
            text = n.text().replace("\r", "").removesuffix("\n")
            return deque([("block", ["```", *text.split("\n"), "```"])])
        if tag in ("code", "kbd", "samp"):
            return deque([("text", "`" + n.text().replace("`", "'").replace("\n", " ") + "`")])
        if tag == "br":
            return deque([("text", "\n")])
        if tag == "hr":
            return deque([("block", ["---"])])
        if tag == "img":
            return self.picture(n)
        if tag in ("ul", "ol"):
            lines = self.items(n)
            return deque([("block", lines)]) if lines else deque()
        if tag == "tr" and n in self.rows:
            return deque()  # its cells are read by the table
        if tag == "table":
            return self.table(n)
        inner = self.merged(n)
        if _HEADING.fullmatch(tag):
            text = clean(" ".join(self.lines(inner))).replace("**", "")
            level = int(tag[1]) + self.shift
            return deque([("block", [f"**{text}**" if level > 6 else f"{'#' * level} {text}"])]) if text else deque()
        if tag == "blockquote":
            lines = self.lines(inner)
            return deque([("block", [f"> {x}".rstrip() for x in lines])]) if lines else deque()
        if tag == "a":
            href, text = resolve(n.attrs.get("href"), self.base), clean(" ".join(self.lines(inner)))
            if not href:
                return deque([("text", f" {text} ")]) if text else deque()
            name = text or name_of(self.paths.get(href, href)) or self.paths.get(href, href)
            return deque([("text", f" [{name.replace('[', '').replace(']', '')}]({self.target(href)}) ")])
        if tag == "sup":
            inner.appendleft(("text", "^"))
        if tag in MARKS and n not in self.again:
            return self.marked(inner, MARKS[tag])
        if tag in BLOCKS:
            inner.appendleft(_BREAK)
            inner.append(_BREAK)
        return inner

    def picture(self, n: Node) -> deque:
        alt = clean(n.attrs.get("alt") or n.attrs.get("title") or "").replace("[", "").replace("]", "")
        if n.attrs.get("src", "").lower().startswith("data:"):
            return deque([("text", f" [image: {alt}] ")]) if alt else deque()
        src = resolve(n.attrs.get("src"), self.base)
        return deque([("text", f" ![{alt}]({self.target(src)}) ")]) if src else deque()

    def items(self, n: Node) -> list[str]:
        start = n.attrs.get("start", "").strip()
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) and int(start) else 1
        out: list[str] = []
        for k in n.kids:
            if isinstance(k, str) or k not in self.made:
                continue
            if k.tag in ("ul", "ol"):  # a list right inside a list
                out += ["   " + x for kind, v in self.made[k] if kind == "block" for x in v]
            elif k.tag == "li":
                marker = f"{number}." if n.tag == "ol" else "-"
                number += 1
                lines = [x for x in self.lines(self.made[k]) if x] or [""]
                pad = " " * (len(marker) + 1)
                out += [f"{marker} {lines[0]}", *(pad + x for x in lines[1:])]
        return out

    def table(self, n: Node) -> deque:
        rows, stack = [], [k for k in reversed(n.kids) if isinstance(k, Node)]
        while stack:
            r = stack.pop()
            if r.tag == "tr":
                cells = [" ".join(x for x in self.lines(self.made[k]) if x).replace("|", "\\|") for k in r.kids if isinstance(k, Node) and k.tag in ("td", "th") and k in self.made]
                if any(cells):
                    rows.append(cells)
            elif r.tag != "table":
                stack += [k for k in reversed(r.kids) if isinstance(k, Node)]
        if not rows:
            return deque()
        width = max(map(len, rows))
        lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
        return deque([("block", [lines[0], f"| {' | '.join(['---'] * width)} |", *lines[1:]])])


def read_captures(spark, path: str) -> DataFrame:
    """Captured responses: (course_id, url, final_url, status, content_type, disposition, html, content)."""
    return spark.read.schema(CAPTURE).parquet(path)


def read_capture_folder(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """Captures of a folder of files and its manifest.jsonl, in the same columns, and issues."""
    return manifest_captures(spark, folder, CAPTURE)


CAPTURE = "course_id string, url string, final_url string, status int, content_type string, disposition string, html string, content binary"


def _is_page(captures: DataFrame):
    html = F.coalesce(F.lower("content_type").contains("text/html"), F.lit(False))
    return html & ~F.coalesce(F.coalesce("final_url", "url").contains("/pluginfile.php/"), F.lit(False))


def html_pages(captures: DataFrame, cfg: SiteConfig = SiteConfig()) -> DataFrame:
    """Captures that are pages: HTML by content type, and not a file endpoint."""
    return captures.where(_is_page(captures))


def file_captures(captures: DataFrame, cfg: SiteConfig = SiteConfig()) -> DataFrame:
    return captures.where(~_is_page(captures))


def pages_to_markdown(df: DataFrame, key: str | list[str], html: str = "html", base: str = "url", min_heading: int | str = 3, url_map: str | None = None) -> DataFrame:
    """(key, md, n_chars, error) of each page; url_map: a map column from addresses to local paths.

    min_heading: level of the page's highest heading, or a column with it. A page that can't be read has a null md
    and an error.
    """
    keys = [key] if isinstance(key, str) else key
    level = F.col(min_heading) if isinstance(min_heading, str) else F.lit(min_heading)
    source = df.select(*keys, F.col(html).alias("_html"), F.col(base).alias("_base"), level.alias("_level"), (F.col(url_map) if url_map else F.create_map().cast("map<string,string>")).alias("_paths"))

    def one(page: str | None, base: str | None, level: int, paths) -> tuple[str | None, str | None]:
        try:
            return Markdown(base, int(level), dict(paths) if paths is not None and len(paths) else None)(parse(page)), None
        except Exception as e:  # one bad page doesn't end the job
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [one(*x) for x in zip(pdf["_html"], pdf["_base"], pdf["_level"], pdf["_paths"], strict=True)]
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "md": [m for m, _ in made], "n_chars": [len(m or "") for m, _ in made], "error": [e for _, e in made]})

    types = dict(source.dtypes)
    return source.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", md string, n_chars bigint, error string")


def linked(root: Node, base: str | None) -> list[tuple]:
    """(ord, tag, href, url, player) of links, images, frames and players' files in document order."""
    found = []
    for n in root.walk():
        href = n.attrs.get(LINKED.get(n.tag, ""))
        if href:
            player = n.tag if n.tag in ("video", "audio") else next((a.tag for a in n.above() if a.tag in ("video", "audio")), None)
            found.append((len(found), n.tag, href, resolve(href, base), player))
    return found


def page_rows(df: DataFrame, keys: list[str], html: str, base: Column, fields: dict[str, str], read: Callable[[Node, str | None], Iterable[tuple]]) -> DataFrame:
    """(keys, fields, error): the rows that ``read`` makes of each page's tree. A page that can't be read gives one row, with its error only."""
    source = df.select(*keys, F.col(html).alias("_html"), base.alias("_base"))
    width = len(fields)

    def rows(page: str | None, base: str | None) -> list[tuple]:
        try:
            return [(*r, None) for r in read(parse(page), base)]
        except Exception as e:  # one bad page doesn't end the job
            return [(*[None] * width, f"{type(e).__name__}: {e}")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [(*k, *r) for *k, h, b in pdf[[*keys, "_html", "_base"]].itertuples(index=False) for r in rows(h, b)]
            yield pd.DataFrame(made, columns=[*keys, *fields, "error"]).astype({f: "Int32" for f, t in fields.items() if t == "int"})

    types = dict(source.dtypes)
    return source.mapInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"{f} {t}" for f, t in fields.items()), "error string"]))


def extract_links(df: DataFrame, key: str | list[str], html: str = "html", base: str = "url") -> DataFrame:
    """(key, ord, tag, href, url, player, error): links, images, frames and players' files in document order, resolved."""
    fields = {"ord": "int", "tag": "string", "href": "string", "url": "string", "player": "string"}
    return page_rows(df, [key] if isinstance(key, str) else key, html, F.col(base), fields, linked)


def select_assets(links: DataFrame, cfg: SiteConfig = SiteConfig(), video: bool = False, audio: bool = False) -> DataFrame:
    """Links that become files: file endpoints but for unwanted media, resource pages, wanted players' own files."""
    ours = F.col("url").startswith(cfg.origin)
    file = ours & F.col("url").contains("/pluginfile.php/")
    wanted = F.when(F.col("player") == "audio", F.lit(audio)).otherwise(F.lit(video)) & (F.col("tag") != "a") & file
    plain = (file & skipped_media(F.col("url"), video, audio).isNull()) | (ours & F.col("url").rlike(r"/mod/resource/view\.php"))
    taken = F.col("tag").isin("a", "img", "video", "audio", "source")
    return links.where(taken & F.when(F.col("player").isNotNull(), wanted).otherwise(plain))


def asset_map(links: DataFrame, assets: DataFrame, key: str | list[str]) -> DataFrame:
    """(key, paths): for each page a map from linked addresses to the kept files' paths; assets: (key of url, path).

    Columns that both have (a course) are joined on as well.
    """
    keys = [key] if isinstance(key, str) else key
    scope = [k for k in assets.columns if k in links.columns and k not in ("key", "path")]
    kept = assets.where("path is not null").select(*scope, F.col("key").alias("_k"), "path")
    rows = links.where("url is not null").withColumn("_k", norm_url(F.col("url"))).join(kept, [*scope, "_k"]).select(*keys, "url", "path")
    one = rows.groupBy(*keys, "url").agg(F.min("path").alias("path"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("url", "path"))).alias("paths"))


def warnings_in(root: Node, base: str | None = None) -> Iterator[tuple]:
    """(ord, text) of the outermost warning blocks."""
    texts, stack, found = Texts(root), [root], 0
    while stack:
        n = stack.pop()
        if n.tag in BLOCKS and texts.warns(n):
            yield found, clean(n.text())
            found += 1
        else:
            stack += [k for k in reversed(n.kids) if isinstance(k, Node) and k.tag not in SKIPPED]


def extract_warnings(df: DataFrame, key: str | list[str], html: str = "html") -> DataFrame:
    """(key, ord, text, error) of the outermost warning blocks of each page."""
    return page_rows(df, [key] if isinstance(key, str) else key, html, F.lit(None).cast("string"), {"ord": "int", "text": "string"}, warnings_in)


def external_url(links: DataFrame, key: str | list[str], cfg: SiteConfig = SiteConfig()) -> DataFrame:
    """(key, external): target of a link activity: the workaround link, else a frame or object, else the first
    address off the site; null if there is none. links: extract_links with a column ``role`` ('workaround' or null)."""
    keys = [key] if isinstance(key, str) else key
    off = F.col("url").rlike("(?i)^https?://") & ~F.col("url").startswith(cfg.origin) & (F.col("tag") == "a")
    role = F.col("role") == "workaround" if "role" in links.columns else F.lit(False)
    rank = F.when(role, 0).when(F.col("tag").isin("iframe", "frame", "object"), 1).when(off, 2)
    ranked = links.where("url is not null").withColumn("_r", rank).where("_r is not null")
    return ranked.groupBy(*keys).agg(F.min_by("url", F.struct("_r", "ord")).alias("external"))
