"""Office packages read into rows: slides, blocks, styles, cells and pictures of one file at a time."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from itertools import chain, groupby
from xml.etree import ElementTree as ET
from xml.parsers import expat

#: Bytes of one part that are inflated at most; larger parts make the file an issue.
MAX_PART = 256 << 20
#: Bytes of an XML part that is inflated once and kept while its package is read, and of all such parts.
SMALL_PART, SMALL_PARTS = 64 << 10, 1 << 20
#: Rows of a package that leave at once.
SLICE = 5000
FIELDS = "path string, kind string, no int, ord int, row int, col int, text string, formula string, si string, style string, num_id string, ilvl int, name string, hidden boolean, data binary"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
#: Largest number of a row or column.
MAX_PLACE = (1 << 31) - 1


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


def under(e: ET.Element | None, name: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if local(x.tag) == name) if e is not None else iter(())


def first(e: ET.Element | None, name: str) -> ET.Element | None:
    return next(under(e, name), None)


def row(kind: str, **values) -> dict:
    return dict.fromkeys(NAMES) | {"kind": kind} | values


class Package:
    def __init__(self, data: bytes, folder: str = "media") -> None:
        self.folder = folder
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        self.small: dict[str, bytes] = {}  # XML parts that were looked at whole
        self.held = 0  # their bytes

    def read(self, name: str) -> bytes:
        if name in self.small:
            return self.small[name]
        if self.zip.getinfo(name).file_size > MAX_PART:
            raise ValueError(f"{name} is too large")
        return self.zip.read(name)

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.read(name)) if name in self.names else None

    def check(self) -> None:
        """Raises what a damaged part would raise while its rows leave."""
        for name in self.names:
            if not name.lower().endswith((".xml", ".rels")) or (size := self.zip.getinfo(name).file_size) > MAX_PART:
                continue
            if size <= SMALL_PART and self.held <= SMALL_PARTS:
                self.small[name] = self.zip.read(name)
                self.held += size
                expat.ParserCreate().Parse(self.small[name], True)
            else:
                with self.zip.open(name) as part:
                    expat.ParserCreate().ParseFile(part)

    def each(self, name: str, tag: str) -> Iterator[ET.Element]:
        """The elements of a tag, one after the other while the part is read; each is dropped when the next is asked for."""
        if name not in self.names:
            return
        if self.zip.getinfo(name).file_size > MAX_PART:
            raise ValueError(f"{name} is too large")
        with io.BytesIO(self.small[name]) if name in self.small else self.zip.open(name) as part:
            around: list[ET.Element] = []
            for event, e in ET.iterparse(part, ("start", "end")):
                if event == "start":
                    around.append(e)
                    continue
                around.pop()
                if local(e.tag) == tag:
                    yield e
                    if around:
                        around[-1].clear()

    def targets(self, part: str) -> dict[str, str]:
        """Relation id: part that it leads to."""
        folder, name = posixpath.split(part)
        rels = self.xml(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        out = {}
        for r in under(rels, "Relationship"):
            if r.get("TargetMode") != "External":
                to = r.get("Target", "")
                out[r.get("Id")] = to.lstrip("/") if to.startswith("/") else posixpath.normpath(posixpath.join(folder, to))
        return out

    def links(self, part: str) -> dict[str, tuple[str, bool]]:
        """Relation id: target, and whether it lies outside."""
        inner = self.targets(part)
        folder, name = posixpath.split(part)
        rels = self.xml(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        return {r.get("Id"): (r.get("Target", ""), True) if r.get("TargetMode") == "External" else (inner.get(r.get("Id"), ""), False) for r in under(rels, "Relationship")}

    def named_pictures(self) -> dict[str, str]:
        """Picture part: its name in the file's own folder, numbered in the order of parts where names are equal."""
        if not hasattr(self, "_pictures"):
            taken: set[str] = set()
            self._pictures = {}
            for part in sorted(n for n in self.names if re.search(r"(?:media|Pictures)/[^/]+$", n)):
                base = posixpath.basename(part)
                stem, ext = re.fullmatch(r"(.*?)(\.[A-Za-z0-9]{1,8})?", base, re.S).groups()
                name, i = base, 2
                while name.lower() in taken:
                    name, i = f"{stem} ({i}){ext or ''}", i + 1
                taken.add(name.lower())
                self._pictures[part] = name
        return self._pictures

    def picture(self, part: str | None, alt: str | None = "") -> str:
        """A picture as Markdown; empty if the package lacks it."""
        name = self.named_pictures().get(part or "")
        if not name:
            return ""
        to = f"{self.folder}/{name}"
        vector = " ⚠️ EMF/WMF picture (may not display)" if re.search(r"(?i)\.(emf|wmf)$", name) else ""
        return f"![{clean(alt or '').replace('[', '').replace(']', '')}]({f'<{to}>' if re.search(r'[^!-~]', to) and ' ' in to else to}){vector}"

    def pictures(self) -> Iterator[dict]:
        for part in self.named_pictures():
            yield row("image", text=part, name=posixpath.basename(part), data=self.read(part))


def clean(s: str) -> str:
    return " ".join(s.split())


def child(e: ET.Element | None, name: str) -> ET.Element | None:
    return next((k for k in e if local(k.tag) == name), None) if e is not None else None


def value(e: ET.Element | None) -> str | None:
    return attr(e, "val") if e is not None else None


def is_on(v: str | None) -> bool:
    return v is not None and v not in ("0", "false", "off")


#: A piece of text: (text, style); style is (bold, italic, link), or None for text that is Markdown already.
Piece = tuple[str, tuple | None]
_PLAIN = (False, False, None)


def inline(pieces: list[Piece]) -> str:
    """Pieces as Markdown on one line; neighbours of one style share their marks."""
    out = []
    for style, group in groupby(pieces, key=lambda p: p[1]):
        text = "".join(t for t, _ in group)
        core = text.strip()
        if style is not None and core:
            bold, italic, link = style
            done = f"**{core}**" if bold else core
            done = f"*{done}*" if italic else done
            done = f"[{done}]({f'<{link}>' if ' ' in link else link})" if link else done
            at = len(text) - len(text.lstrip())
            text = text[:at] + done + text[at + len(core) :]
        out.append(text)
    return clean("".join(out))


#: Linear forms of equations: names in braces are parts; with a mark, parts of several characters are put in brackets.
EQUATIONS = {
    "f": "{num!}/{den!}", "sSup": "{e}^{sup!}", "sSub": "{e}_{sub!}", "sSubSup": "{e}_{sub!}^{sup!}", "sPre": "_{sub!}^{sup!}{e}", "rad": "{deg!}√{e!}",
    "func": "{fName} {e}", "bar": "{e!}\u0305", "limLow": "{e}_{lim!}", "limUpp": "{e}^{lim!}",
}


def equation(e: ET.Element) -> str:
    """Office Math as one line."""
    tag = local(e.tag)
    if tag.endswith("Pr"):
        return ""
    if tag == "t":
        return e.text or ""

    def part(name: str, brackets: bool = True) -> str:
        k = child(e, name)
        text = equation(k) if k is not None else ""
        return f"({text})" if brackets and len(text) > 1 else text

    def sign(props: str, name: str, default: str) -> str:
        found = value(child(child(e, props), name))
        return default if found is None else found

    parts = lambda sep: sep.join(equation(k) for k in e if local(k.tag) == "e")
    if tag in EQUATIONS:
        return re.sub(r"\{(\w+)(!?)\}", lambda m: part(m[1], bool(m[2])), EQUATIONS[tag])
    if tag == "nary":
        low, high = part("sub"), part("sup")
        return sign("naryPr", "chr", "∫") + (f"_{low}" if low else "") + (f"^{high}" if high else "") + " " + part("e", False)
    if tag == "d":
        return sign("dPr", "begChr", "(") + parts(sign("dPr", "sepChr", ",")) + sign("dPr", "endChr", ")")
    if tag == "acc":
        return part("e") + sign("accPr", "chr", "\u0302")
    if tag == "eqArr":
        return parts("; ")
    if tag == "m" and "math" in e.tag.rpartition("}")[0].rsplit("/", 1)[-1]:
        return "[" + "; ".join(", ".join(equation(k) for k in r if local(k.tag) == "e") for r in e if local(r.tag) == "mr") + "]"
    return "".join(map(equation, e))


def equations(e: ET.Element | None) -> list[str]:
    return [t for t in (clean(equation(m)) for m in under(e, "oMath")) if t]


def grid(rows: list[list[str]]) -> str:
    """Rows of cells as a table; empty rows go."""
    rows = [[clean(x).replace("|", "\\|") for x in r] for r in rows]
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
    return "\n".join([lines[0], f"| {' | '.join(['---'] * width)} |", *lines[1:]])


# --- slides

_MONO = re.compile(r"(?i)consol|courier|mono|menlo|monaco|code|cascadia|lucida console|terminal")
_FURNITURE = ("sldNum", "dt", "ftr", "hdr")


class Paragraph:
    """One paragraph of a shape: its Markdown, plain text, level, kind of bullet, and whether all is in a fixed-width face."""

    def __init__(self, p: ET.Element, links: dict) -> None:
        props = child(p, "pPr")
        self.level = int((attr(props, "lvl") if props is not None else None) or 0)
        self.bullet = next((b for k, b in (("buNone", "none"), ("buAutoNum", "auto"), ("buChar", "char")) if child(props, k) is not None), None)
        pieces: list[Piece] = []
        plain, faces = [], []
        for k in p:
            tag = local(k.tag)
            if tag in ("r", "fld"):
                rp, t = child(k, "rPr"), child(k, "t")
                text = (t.text or "") if t is not None else ""
                click = child(rp, "hlinkClick")
                to, outside = links.get(attr(click, "id"), ("", False)) if click is not None else ("", False)
                pieces.append((text, (is_on(rp.get("b")), is_on(rp.get("i")), to if outside else None) if rp is not None else _PLAIN))
                plain.append(text)
                if text.strip():
                    latin = child(rp, "latin")
                    faces.append(bool(latin is not None and _MONO.search(latin.get("typeface", ""))))
            elif tag == "br":
                pieces.append((" ", _PLAIN))
                plain.append("\n")
            elif tag in ("m", "AlternateContent"):
                found = equations(k if tag == "m" else child(k, "Choice"))
                if found:
                    pieces.append((f" `{'; '.join(found)}` ", None))
                elif tag == "AlternateContent":
                    pieces.append(("".join(t.text or "" for t in under(child(k, "Fallback"), "t")), _PLAIN))
        self.text, self.plain, self.mono = inline(pieces), "".join(plain).rstrip(), bool(faces) and all(faces)


def paragraphs(body: ET.Element | None, links: dict) -> list[Paragraph]:
    return [Paragraph(p, links) for p in (body if body is not None else ()) if local(p.tag) == "p"]


def shape_lines(paras: list[Paragraph], bulleted: bool) -> list[str]:
    """Code where all is in a fixed-width face; bullets and numbers where the slide has them; else plain lines."""
    filled = [p for p in paras if p.text]
    if filled and all(p.mono for p in filled):
        return ["```", *"\n".join(p.plain for p in paras).strip("\n").split("\n"), "```"]
    out, numbers = [], {}
    for p in filled:
        if not (p.bullet in ("char", "auto") or (bulleted and p.bullet != "none")):
            out.append(p.text)
            continue
        numbers = {k: n for k, n in numbers.items() if k <= p.level}
        numbers[p.level] = numbers.get(p.level, 0) + 1 if p.bullet == "auto" else 0
        out.append("  " * p.level + (f"{numbers[p.level]}." if p.bullet == "auto" else "-") + f" {p.text}")
    return out


class Slide:
    def __init__(self, pkg: Package, part: str, tree: ET.Element) -> None:
        self.pkg, self.links, self.title, self.lines = pkg, pkg.links(part), "", []
        shapes = first(tree, "spTree")
        self.read(shapes if shapes is not None else tree, True)

    def show(self, blip: ET.Element | None, alt: str | None = "") -> None:
        to = self.links.get(attr(blip, "embed"), ("", True))[0] if blip is not None else ""
        if text := self.pkg.picture(to, alt):
            self.lines.append(text)

    def read(self, shapes: ET.Element | None, pictures: bool) -> None:
        for e in shapes if shapes is not None else ():
            tag = local(e.tag)
            if tag == "sp":
                self.shape(e, pictures)
            elif tag == "grpSp":
                self.read(e, pictures)
            elif tag == "pic" and pictures:
                self.media(e)
            elif tag == "graphicFrame":
                self.frame(e)
            elif tag == "AlternateContent":
                self.alternatives(e, pictures)

    def shape(self, e: ET.Element, pictures: bool) -> None:
        ph = first(child(e, "nvSpPr"), "ph")
        ph = ph if ph is not None else first(child(e, "nvPr"), "ph")
        kind = (ph.get("type") or "body") if ph is not None else ""
        if kind in _FURNITURE:
            return
        paras = paragraphs(child(e, "txBody"), self.links)
        if kind in ("title", "ctrTitle") and not self.title:
            self.title = " — ".join(p.text for p in paras if p.text)
        else:
            self.lines += shape_lines(paras, kind in ("body", "obj"))
        if pictures:
            self.show(first(child(e, "spPr"), "blip"))
        found = equations(e)
        if found and not any(p.text for p in paras):
            self.lines.append(f"🧮 Equation: `{'; '.join(found)}`")

    def media(self, e: ET.Element) -> None:
        """A picture; of embedded sound or film only a line, as its picture is an icon."""
        kinds = {local(x.tag) for x in under(child(e, "nvPicPr"), "nvPr") for x in x.iter()}
        film = kinds & {"videoFile", "quickTimeFile"}
        if film or kinds & {"audioFile", "wavAudioFile", "media"}:
            line = "🎥 Embedded video (play it in the original file)" if film else "🔊 Embedded audio narration (play it in the original file)"
            if line not in self.lines:
                self.lines.append(line)
            return
        about = first(e, "cNvPr")
        self.show(first(e, "blip"), (about.get("descr") or about.get("name")) if about is not None else "")

    def frame(self, e: ET.Element) -> None:
        to = lambda x, key: self.pkg.xml(self.links.get(attr(x, key), ("", True))[0])
        if (t := first(e, "tbl")) is not None:
            cells = lambda r: [" ".join(p.text for p in paragraphs(child(c, "txBody"), self.links) if p.text) for c in r if local(c.tag) == "tc"]
            self.lines += [x for x in grid([cells(r) for r in t if local(r.tag) == "tr"]).split("\n") if x]
        elif (chart := first(e, "chart")) is not None:
            title = clean(" ".join(t.text or "" for t in under(first(to(chart, "id"), "title"), "t")))
            self.lines.append("📊 Chart" + (f": {title}" if title else ""))
        elif (ids := first(e, "relIds")) is not None:
            self.lines.append("🔷 Diagram (SmartArt):")
            points = (clean("".join(t.text or "" for t in under(p, "t"))) for p in under(to(ids, "dm"), "pt"))
            self.lines += [f"  - {t}" for t in points if t]
        elif (ole := first(e, "oleObj")) is not None:
            kind = ole.get("progId") or "object"
            self.lines.append(f"🧮 Equation object ({kind})" if re.search("(?i)equation|dsmt|mathtype", kind) else f"📎 Embedded object ({kind})")
            self.show(first(e, "blip"), kind)

    def alternatives(self, e: ET.Element, pictures: bool) -> None:
        choice, fallback = child(e, "Choice"), child(e, "Fallback")
        before, found = len(self.lines), equations(choice)
        self.read(choice if choice is not None else e, pictures and not found)
        if found:
            told = [x for x in self.lines[before:] if not x.startswith("🧮")]
            self.lines[before:] = told or [f"🧮 Equation: `{'; '.join(found)}`"]
            for b in under(fallback, "blip"):
                self.show(b, "equation")
        elif len(self.lines) == before and fallback is not None:
            self.read(fallback, pictures)


def slides(pkg: Package) -> Iterator[dict]:
    deck = pkg.xml("ppt/presentation.xml")
    if deck is None:
        raise ValueError("no presentation in the package")
    to = pkg.targets("ppt/presentation.xml")
    for no, s in enumerate(under(deck, "sldId"), 1):
        part = to.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""), "")
        tree = pkg.xml(part)
        if tree is None:
            continue
        slide = Slide(pkg, part, tree)
        notes = next((pkg.xml(x) for x in pkg.targets(part).values() if "notesSlide" in x), None)
        said = [p.text for x in under(notes, "sp") if (h := first(x, "ph")) is not None and (h.get("type") or "body") == "body" for p in paragraphs(child(x, "txBody"), slide.links) if p.text]
        yield row("slide", no=no, name=slide.title, hidden=tree.get("show") == "0", text="\n".join(slide.lines), formula=" ".join(said))


# --- text documents


class Writing:
    """Paragraphs and tables of a text document."""

    def __init__(self, pkg: Package) -> None:
        self.pkg, self.links = pkg, pkg.links("word/document.xml")

    def drawing(self, x: ET.Element) -> Iterator[Piece]:
        blip, data = first(x, "blip"), first(x, "imagedata")
        ole, about = first(x, "OLEObject"), first(x, "docPr")
        if ole is not None and (kind := attr(ole, "ProgID")):
            yield (f" 🧮 Equation object ({kind}) " if re.search("(?i)equation|dsmt", kind) else f" 📎 Embedded object ({kind}) "), None
        key = attr(blip, "embed") if blip is not None else attr(data, "id") if data is not None else None
        if text := self.pkg.picture(self.links.get(key, ("", True))[0], about.get("descr") if about is not None else ""):
            yield f" {text} ", None

    def pieces(self, e: ET.Element, link: str | None = None) -> Iterator[Piece]:
        for k in e:
            tag = local(k.tag)
            if tag == "r":
                props = child(k, "rPr")
                on = lambda name: (x := child(props, name)) is not None and (value(x) is None or is_on(value(x)))  # noqa: B023, E731
                style = (on("b"), on("i"), link)
                for x in k:
                    inner = local(x.tag)
                    if inner == "t":
                        yield x.text or "", style
                    elif inner in ("tab", "br", "cr"):
                        yield " ", style
                    elif inner == "footnoteReference":
                        yield f"[^{attr(x, 'id')}]", None
                    elif inner in ("drawing", "pict", "object"):
                        yield from self.drawing(x)
            elif tag == "hyperlink":
                to, outside = self.links.get(attr(k, "id"), ("", False))
                yield from self.pieces(k, to if outside else None)
            elif tag in ("oMath", "oMathPara"):
                found = equations(k) if tag == "oMathPara" else [clean(equation(k))]
                yield f" `{'; '.join(found)}` ", None
            elif tag == "sdt":
                yield from self.pieces(child(k, "sdtContent") if child(k, "sdtContent") is not None else k, link)
            elif tag in ("ins", "smartTag", "fldSimple", "customXml", "sdtContent"):
                yield from self.pieces(k, link)

    def text(self, p: ET.Element) -> str:
        return inline(list(self.pieces(p)))

    def blocks(self, e: ET.Element | None) -> Iterator[dict]:
        for k in e if e is not None else ():
            tag = local(k.tag)
            if tag == "p":
                props = child(k, "pPr")
                num = child(props, "numPr")
                out = value(child(props, "outlineLvl"))
                ilvl = value(child(num, "ilvl")) if num is not None else None
                if text := self.text(k):
                    yield row("block", name="p", style=value(child(props, "pStyle")), num_id=value(child(num, "numId")), ilvl=int(ilvl or 0) if num is not None else None, col=int(out) if out and out.isdigit() else None, text=text)
            elif tag == "tbl":
                rows = [[" ".join(filter(None, (self.text(p) for p in c if local(p.tag) == "p"))) for c in r if local(c.tag) == "tc"] for r in k if local(r.tag) == "tr"]
                if text := grid(rows):
                    yield row("block", name="table", text=text)
            elif tag == "sdt":
                yield from self.blocks(child(k, "sdtContent") if child(k, "sdtContent") is not None else k)


def blocks(pkg: Package) -> Iterator[dict]:
    document = pkg.xml("word/document.xml")
    if document is None:
        raise ValueError("no text document in the package")
    for s in under(pkg.xml("word/styles.xml"), "style"):
        level = value(first(child(s, "pPr"), "outlineLvl"))
        yield row("style", style=attr(s, "styleId"), name=value(child(s, "name")), text=value(child(s, "basedOn")), ilvl=int(level) if level and level.isdigit() else None)
    writing = Writing(pkg)
    yield from (r | {"ord": i} for i, r in enumerate(writing.blocks(first(document, "body"))))
    for f in under(pkg.xml("word/footnotes.xml"), "footnote"):
        no = attr(f, "id") or ""
        text = " ".join(filter(None, (writing.text(p) for p in f if local(p.tag) == "p")))
        if attr(f, "type") is None and no.isdigit() and int(no) > 0 and text:
            yield row("footnote", ord=int(no), style=no, text=text)
    numbering = pkg.xml("word/numbering.xml")
    for n in under(numbering, "num"):
        yield row("num", num_id=attr(n, "numId"), style=value(child(n, "abstractNumId")))
    for a in under(numbering, "abstractNum"):
        for lvl in (k for k in a if local(k.tag) == "lvl"):
            yield row("level", style=attr(a, "abstractNumId"), ilvl=int(attr(lvl, "ilvl") or 0), text=value(child(lvl, "numFmt")))


def column_number(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n


def cells(pkg: Package) -> Iterator[dict]:
    """Sheets and their cells, row by row as the part is read. Rows and cells without an address follow the one before."""
    strings = ["".join(t.text or "" for t in under(si, "t")) for si in pkg.each("xl/sharedStrings.xml", "si")]
    to = pkg.targets("xl/workbook.xml")
    for no, s in enumerate(under(pkg.xml("xl/workbook.xml"), "sheet"), 1):
        part = to.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""), "")
        head = {"no": no, "name": s.get("name"), "hidden": s.get("state") in ("hidden", "veryHidden")}
        yield row("sheet", **head)
        at = 0
        for r in pkg.each(part, "row"):
            at = int(r.get("r")) if re.fullmatch("0*[1-9][0-9]{0,8}", r.get("r", "")) else at + 1
            col = 0
            for c in (k for k in r if local(k.tag) == "c"):
                m = re.fullmatch(r"([A-Z]{1,6})\d+", c.get("r", ""))
                col = column_number(m[1]) if m else col + 1
                v, f, kind = child(c, "v"), child(c, "f"), c.get("t")
                raw = v.text or "" if v is not None else None
                if kind == "s" and raw is not None:
                    raw = strings[int(raw)] if re.fullmatch("[0-9]{1,9}", raw) and int(raw) < len(strings) else ""
                elif kind == "inlineStr":
                    raw = "".join(t.text or "" for t in under(child(c, "is"), "t"))
                elif kind == "b":
                    raw = "TRUE" if raw == "1" else "FALSE"
                if raw is not None or f is not None:
                    yield row("cell", **head, row=at, col=col, text=raw, formula=f.text if f is not None else None, si=f.get("si") if f is not None and f.get("t") == "shared" else None)


#: A row's cells: a text and how many cells in succession hold it.
Runs = list[tuple[str, int]]


class OpenDocument:
    """Texts, lists and tables of an OpenDocument file."""

    def __init__(self, pkg: Package) -> None:
        self.pkg = pkg

    def pieces(self, e: ET.Element, link: str | None = None) -> Iterator[Piece]:
        yield e.text or "", (False, False, link)
        for k in e:
            tag = local(k.tag)
            if tag == "s":
                yield " " * min(int(attr(k, "c") or 1), 1), (False, False, link)  # white space is collapsed
            elif tag in ("tab", "line-break"):
                yield " ", (False, False, link)
            elif tag == "a":
                yield from self.pieces(k, attr(k, "href") or link)
            elif tag == "frame":
                yield f" {self.picture(k)} ", None
            elif tag not in ("note", "annotation", "bookmark", "bookmark-start", "bookmark-end"):
                yield from self.pieces(k, link)
            yield k.tail or "", (False, False, link)

    def text(self, e: ET.Element) -> str:
        return inline(list(self.pieces(e)))

    def picture(self, frame: ET.Element) -> str:
        image, title = first(frame, "image"), first(frame, "title")
        href = attr(image, "href") if image is not None else None
        if not href or re.match("(?i)[a-z]+:", href):
            return ""
        return self.pkg.picture(href.removeprefix("./"), "".join(title.itertext()) if title is not None else "")

    def rows(self, t: ET.Element) -> list[tuple[Runs, int]]:
        """Rows of a table that hold text: runs of equal cells up to the last one with text, and how often the row is repeated."""
        out: list[tuple[Runs, int]] = []
        for line in under(t, "table-row"):
            runs: Runs = []
            for c in line:
                if local(c.tag) == "table-cell" and (n := int(attr(c, "number-columns-repeated") or 1)) > 0:
                    formula = attr(c, "formula")
                    runs.append((" ".join(self.text(p) for p in c if local(p.tag) == "p") + (f" ({formula.removeprefix('of:')})" if formula else ""), n))
            while runs and not runs[-1][0]:
                runs.pop()
            times = int(attr(line, "number-rows-repeated") or 1)
            if runs and times > 0:
                out.append((runs, times))
        if sum(n for _, n in out) > MAX_PLACE or any(sum(n for _, n in runs) > MAX_PLACE for runs, _ in out):
            raise ValueError("more rows or columns than can be numbered")
        return out

    def table(self, t: ET.Element) -> str:
        """``grid`` of a table's rows, each different one made once; a text over MAX_PART makes the file an issue."""
        rows = [([(clean(x).replace("|", "\\|"), n) for x, n in runs], times) for runs, times in self.rows(t)]
        rows = [(runs, times) for runs, times in rows if any(x for x, _ in runs)]
        if not rows:
            return ""
        width = max(sum(n for _, n in runs) for runs, _ in rows)
        if sum(times * (2 + 3 * width + sum(len(x) * n for x, n in runs)) for runs, times in rows) + 6 * width > MAX_PART:
            raise ValueError("a table is too large")
        lines = [f"|{''.join(f' {x} |' * n for x, n in runs)}{'  |' * (width - sum(n for _, n in runs))}\n" * times for runs, times in rows]
        head, rest = "".join(lines).split("\n", 1)
        return f"{head}\n|{' --- |' * width}\n{rest}".removesuffix("\n")

    def lines(self, e: ET.Element, depth: int = 0) -> Iterator[str]:
        """Blocks of Markdown: headings, paragraphs, items by their depth, tables, pictures."""
        tag = local(e.tag)
        if tag == "h":
            if t := self.text(e):
                yield f"{'#' * min(6, int(attr(e, 'outline-level') or 1) + 1)} {t}"
        elif tag == "p":
            if t := self.text(e):
                yield f"{'  ' * (depth - 1)}- {t}" if depth else t
        elif tag == "list":
            for item in e:
                if local(item.tag) == "list-item":
                    for k in item:
                        yield from self.lines(k, depth + 1)
        elif tag == "table":
            if t := self.table(e):
                yield t
        elif tag == "frame":
            box = child(e, "text-box")
            if box is not None:
                yield from self.lines(box, depth)
            elif t := self.picture(e):
                yield t
            if (table := child(e, "table")) is not None:
                yield from self.lines(table, depth)
        elif tag in ("g", "section", "custom-shape", "text-box", "text"):
            for k in e:
                yield from self.lines(k, depth)


def open_document(pkg: Package) -> Iterator[dict]:
    content = pkg.xml("content.xml")
    if content is None:
        raise ValueError("no content in the package")
    body, doc = first(content, "body"), OpenDocument(pkg)
    inner = body[0] if body is not None and len(body) else None
    kind = local(inner.tag) if inner is not None else ""
    if kind == "spreadsheet":
        for no, name, rows in [(no, attr(t, "name"), doc.rows(t)) for no, t in enumerate(under(body, "table"), 1)]:
            yield row("sheet", no=no, name=name, hidden=False)
            at = 0
            for runs, times in rows:
                for r in range(at + 1, at + times + 1):
                    col = 0
                    for text, n in runs:
                        yield from (row("cell", no=no, name=name, hidden=False, row=r, col=k, text=text) for k in range(col + 1, col + n + 1) if text)
                        col += n
                at += times
    elif kind == "presentation":
        for no, page in enumerate(under(body, "page"), 1):
            title, lines, said = "", [], ""
            for e in page:
                if local(e.tag) == "notes":
                    said = clean(" ".join(doc.text(p) for p in under(e, "p")))
                elif local(e.tag) == "frame" and "title" in (attr(e, "class") or "") and not title:
                    title = clean(" ".join(doc.text(p) for p in under(e, "p")))
                else:
                    lines += doc.lines(e)
            yield row("slide", no=no, name=title, hidden=False, text="\n".join(lines), formula=said)
    elif inner is not None:
        yield from (row("block", ord=i, name="md", text=t) for i, t in enumerate(doc.lines(inner)))


READERS = {"pptx": slides, "docx": blocks, "xlsx": cells, "odt": open_document, "odp": open_document, "ods": open_document}


def read_package(path: str, ext: str, data: bytes) -> Iterator[list[dict]]:
    """Rows of one file, in slices; a damaged one is an issue row and nothing else.

    Every XML part is read through once before the first row leaves; only small ones are kept.
    """
    held: list[dict] = []
    try:
        pkg = Package(data, f"{posixpath.basename(path)}_media")
        pkg.check()
        for r in chain(READERS[ext](pkg), pkg.pictures()):
            r["path"] = path
            held.append(r)
            if len(held) == SLICE:
                yield held
                held = []
    except Exception as e:  # whatever a damaged package raises; the original file is kept
        held = [row("issue", path=path, text=f"{type(e).__name__}: {e}"[:200])]
    yield held
