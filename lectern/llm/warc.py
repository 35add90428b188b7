"""WARC derivative builder: responses become linked metadata and plain-text conversion records.

WARC files (plain or gzip, one member a record) are read into rows, one for each record, with the named fields of
their headers. Every response gives a ``metadata`` record (links, title, declared language, sizes and the HTTP
headers as JSON) and a ``conversion`` record (its visible text). Both keep the response's target URI and date,
refer to its record id, carry its payload digest as read (worked out where the record has none) and the
HTTP headers it came with, and have a SHA-1 digest in base 32 of their own block. A response without date takes the
moment given by the caller: the standard demands one. Record ids are name-based UUIDs of the
response's id and the derivative's kind, so a rerun gives equal ids.

A record that is cut off or has a malformed header line gives its readable fields and an ``issue``; malformed header
JSON of a table of responses gives an issue too, never an error. Null payload: a metadata record of size 0 and no
conversion record. Null url: no target URI line. Records whose text is empty are kept with length 0. Repeated rows give
equal records each. Other columns of the input aren't read, so their names can't clash.

An empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Date of derivatives of responses that have none.
UNDATED = "1970-01-01T00:00:00Z"
#: fixed values: elements whose content nobody reads, and those that stand on lines of their own
HIDDEN = frozenset("script style noscript template title".split())
BLOCK = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 br tr table section article nav header footer blockquote pre dd dt dl hr body html head".split())
LINKS = {"a": "href", "img": "src", "link": "href", "script": "src"}
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)|<!--|<[!?/]")
# a name is taken with or without a value, so that none is tried again from each of its letters
_ATTR = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


#: Targets that only need the site before them: an absolute path without dots, queries, fragments and empty parts.
_PATH = re.compile(r"/(?:[^\s/?#;.\\][^\s/?#;\\]*(?:/[^\s/?#;.\\][^\s/?#;\\]*)*/?)?")


def joiner(url: str | None) -> Callable[[str], str]:
    """Resolves targets against one address, as urljoin does; malformed ones stay as written."""
    try:
        base = urlsplit(url or "")
    except ValueError:
        base = urlsplit("")
    site = f"{base.scheme}://{base.netloc}" if base.scheme in ("http", "https") and base.netloc else None

    def join(target: str) -> str:
        if site and target.isprintable() and _PATH.fullmatch(target):
            return site + target
        try:
            return urljoin(url or "", target)
        except ValueError:
            return target

    return join


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def scanned(page: str, url: str | None) -> tuple[str, dict]:
    """A page's visible text, a line for each block, and its title, language and links: one pass from tag to tag.

    Links are read from every opening tag outside comments, scripts and styles. What never ends, ends with the page.
    """
    out: list[str] = []
    links: list[dict] = []
    title: list[str] = []
    lang, hidden, at, size, join = None, [], 0, len(page), joiner(url)
    while at < size:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else size]
        if hidden:
            if hidden[-1] == "title":
                title.append(text)
        elif text:
            out.append(text)
        if not m:
            break
        if m[2] is None:
            mark = "-->" if m[0] == "<!--" else ">"
            end = page.find(mark, m.end())
            at = end + len(mark) if end >= 0 else size
            continue
        end = page.find(">", m.end())
        tag, stop = m[2].lower(), end if end >= 0 else size
        if m[1]:
            if tag in HIDDEN and tag in hidden:
                del hidden[len(hidden) - 1 - hidden[::-1].index(tag) :]
        else:
            attrs = {}
            if tag in LINKS or tag == "html":
                for a in _ATTR.finditer(page, m.end(), stop):
                    value = next((v for v in a.groups()[1:] if v is not None), None)
                    if value is not None:
                        attrs.setdefault(a[1].lower(), entities.unescape(value).strip())
            target = attrs.get(LINKS.get(tag, ""))
            if target is not None:
                links.append({"path": tag, "url": join(target)})
            lang = lang or (attrs.get("lang") if tag == "html" else None)
            if tag in ("script", "style"):  # all up to their end tag is code
                close = re.compile(rf"</{tag}\b", re.I).search(page, stop)
                stop = page.find(">", close.end()) if close else size
                stop = stop if stop >= 0 else size
            elif tag in HIDDEN and tag not in hidden:
                hidden.append(tag)
        if tag in BLOCK:
            out.append("\n")
        at = stop + 1
    lines = (" ".join(x.split()) for x in entities.unescape("".join(out)).split("\n"))
    named = " ".join(entities.unescape("".join(title)).split()) or None
    return "\n".join(x for x in lines if x), {"title": named, "language": lang.lower() if lang else None, "links": links}


def record(kind: str, rid: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), *headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def http_headers(given: str | None) -> tuple[dict, str | None]:
    """Headers of a JSON object, and what is wrong with it."""
    try:
        got = json.loads(given) if given else {}
    except ValueError:
        return {}, "headers aren't JSON"
    return (got, None) if isinstance(got, dict) else ({}, "headers aren't an object")


def derive(seed: str, rid: str | None, url: str | None, date: str | None, headers: str | None, payload_digest: str | None, page: bytes | None, undated: str = UNDATED, whole: bool = True) -> list[dict]:
    payload, moment = page or b"", date or undated
    given, issue = http_headers(headers)
    readable = is_text(given.get("content-type"))
    text, meta = scanned(payload.decode("utf-8", "replace"), url) if readable else ("", {"title": None, "language": None, "links": []})
    source = payload_digest or digest(payload)
    meta |= {"payload_length": len(payload), "payload_digest": source, "response_headers": given}
    shared = [("WARC-Refers-To", rid), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", url), ("WARC-Date", moment)]
    made = [("metadata", "application/json", json.dumps(meta, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace"))]
    if page is not None and readable:
        made.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")))
    out = []
    for kind, content, block in made:
        own = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{rid or seed}/{kind}')}>"
        out.append({
            "warc_type": kind, "record_id": own, "refers_to": rid, "target_uri": url, "date": moment, "block_digest": digest(block), "payload_digest": source, "content_length": len(block),
            "block": block.decode("utf-8"), "issue": issue,
        } | ({"record": record(kind, own, [*shared, ("Content-Type", content)], block)} if whole else {}))
    return out


FIELDS = "warc_type string, record_id string, refers_to string, target_uri string, date string, block_digest string, payload_digest string, content_length bigint, block string, issue string, record binary"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}


def derivatives(responses: DataFrame, key: str, undated: str = UNDATED, whole: bool = True) -> DataFrame:
    """key and the derived records, with or without their bytes as a whole.

    responses: (key, record_id, url, date, headers as JSON, payload_digest, text = payload). A response without an id is told
    from others by a column ``place`` if there is one, else by its key, address and date. What isn't text by its content
    type has a metadata record only.
    """
    c.small_batches(responses.sparkSession)
    names = (key, "seed", "record_id", "url", "date", "headers", "payload_digest")
    seed = F.col("place") if "place" in responses.columns else F.concat_ws("|", F.col(key).cast("string"), "url", "date")
    source = responses.select(key, seed.alias("seed"), *names[2:], F.col("text").cast("binary").alias("text"))
    schema = FIELDS if whole else FIELDS.removesuffix(", record binary")
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.chunks(batch):
                keys, rows = [], []
                for k, *facts, page in zip(*(part.column(x).to_pylist() for x in (*names, "text")), strict=True):
                    got = derive(*facts, page, undated, whole)
                    rows += got
                    keys += [k] * len(got)
                cols = [pa.array([r[n] for r in rows], _KINDS[t]) for n, t in fields]
                yield pa.RecordBatch.from_arrays([pa.array(keys, part.column(key).type), *cols], [key, *(n for n, _ in fields)])

    return source.mapInArrow(run, f"`{key}` {dict(source.dtypes)[key]}, {schema}")


def split_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields (names in lower case), block and issue of every record of a WARC file.

    After a record that can't be read, the next line that begins one is looked for.
    """
    stream: io.BufferedIOBase = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    lost = False
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                if line.strip() and not lost:
                    yield {}, b"", "no WARC record"
                    lost = True
                continue
            head: dict[str, str] = {}
            issue, lost = None, False
            while (line := stream.readline()).strip():
                name, colon, value = line.decode("utf-8", "replace").partition(":")
                if not colon:
                    issue = "malformed header line"
                    continue
                head[name.strip().lower()] = value.strip()
            length = head.get("content-length", "")
            if not re.fullmatch("[0-9]{1,18}", length):
                yield head, b"", "no content length"
                lost = True
                continue
            block = stream.read(int(length))
            yield head, block, "cut off" if len(block) < int(length) else issue
    except (OSError, EOFError, zlib.error) as e:
        yield {}, b"", f"unreadable: {e}"


#: Bytes that a payload is inflated to at most.
MAX_PAYLOAD = 256 << 20
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def is_text(content_type: object) -> bool:
    """Whether a page or text may be read; so where no type is told."""
    kind = (content_type[0] if isinstance(content_type, list) and content_type else content_type) or "text/html"
    return bool(re.match(r"(?i)\s*(text/|application/(xhtml|xml|[\w.-]+\+xml))", str(kind)))


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; one that isn't stays as it is from there on."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]{1,8})[^\r\n]{0,200}\r\n").match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
    return b"".join(out) + body[at:]


def plain_payload(body: bytes, headers: dict[str, object]) -> tuple[bytes, str | None]:
    """The payload without transfer and content codings, text in UTF-8; and what is wrong with it."""
    said = lambda name: " ".join(v) if isinstance(v := headers.get(name) or "", list) else v
    if "chunked" in said("transfer-encoding").lower():
        body = unchunked(body)
    for coding in reversed(said("content-encoding").lower().replace(",", " ").split()):
        if coding in ("gzip", "x-gzip", "deflate"):
            # deflate is sent with and without a zlib header
            for window in (47, -15) if coding == "deflate" else (47,):
                inflater = zlib.decompressobj(window)
                try:
                    whole = inflater.decompress(body, MAX_PAYLOAD)
                    break
                except zlib.error:
                    whole = None
            if whole is None:
                return body, f"not {coding}"
            if not inflater.eof:
                return whole, "payload too large" if inflater.unconsumed_tail else f"incomplete {coding}"
            body = whole
        elif coding not in ("", "identity"):
            return body, f"content coding {coding}"
    kind = said("content-type")
    if is_text(kind):
        named = _CHARSET.search(kind) or _CHARSET.search(body[:1024].decode("latin-1"))
        charset = named[1].lower() if named else "utf-8"
        if charset not in ("utf-8", "utf8"):
            try:
                return body.decode(charset, "replace").encode("utf-8", "replace"), None
            except (LookupError, ValueError):
                return body, f"unknown charset {charset}"
    return body, None


def http_parts(block: bytes) -> tuple[dict[str, object], bytes]:
    """Headers (names in lower case; several of a name as a list) and body of an HTTP response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return {}, block
    status, *lines = head.decode("iso-8859-1").split("\r\n")
    found: dict[str, object] = {"status": status}
    for k, colon, v in (x.partition(":") for x in lines):
        if colon:
            k, v = k.strip().lower(), v.strip()
            found[k] = v if k not in found else [*(found[k] if isinstance(found[k], list) else [found[k]]), v]
    return found, body


RECORDS = "path string, ord bigint, warc_type string, record_id string, url string, date string, content_type string, refers_to string, block_digest string, payload_digest string, headers string, text binary, issue string"


def parse_files(files: DataFrame) -> DataFrame:
    """One row for each record of WARC files (path, content): named fields, HTTP headers as JSON, and the payload as text.

    Payloads are freed of chunks and compression, and texts of other charsets become UTF-8; the payload digest is that of the
    body as it was sent.
    """
    names = [f.split() for f in RECORDS.split(", ")]

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        for i, (head, block, issue) in enumerate(split_records(data)):
            web = head.get("content-type", "").startswith("application/http")
            headers, payload = http_parts(block) if web else (None, block)
            told = head.get("warc-payload-digest")
            if headers:
                told = told or digest(payload)
                payload, wrong = plain_payload(payload, headers)
                issue = issue or wrong
            yield (
                path, i, head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), head.get("content-type"), head.get("warc-refers-to"),
                head.get("warc-block-digest"), told, None if headers is None else json.dumps(headers), payload, issue,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, size = [], 0
                for r in rows(batch.column("path")[i].as_py(), batch.column("content")[i].as_py() or b""):
                    held.append(r)
                    size += len(r[11])
                    if size >= c.CHUNK_BYTES:
                        yield _batch(held, names)
                        held, size = [], 0
                if held:
                    yield _batch(held, names)

    return files.select("path", "content").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple], names: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, _KINDS[t]) for x, (_, t) in zip(zip(*rows, strict=True), names, strict=True)], [n for n, _ in names])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files of a folder; files are dealt to tasks by their size."""
    return parse_files(spark.read.format("binaryFile").load(path))


def responses_of(records: DataFrame) -> DataFrame:
    """Response records as ``derivatives`` reads them, with the file they are from."""
    return records.where("warc_type = 'response'").select("path", F.concat_ws("#", "path", "ord").alias("place"), "record_id", "url", "date", "headers", "payload_digest", "text")


def response_records(pages: DataFrame, date: str = UNDATED) -> DataFrame:
    """(page_id, record): response records of a table of pages (page_id, url, html), the form in which a crawl stores them."""

    def one(page_id, url: str | None, page: bytes | None) -> bytes:
        payload = page or b""
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
        rid = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}|{url}')}>"
        return record("response", rid, [("WARC-Target-URI", url), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload))], block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.chunks(batch):
                made = [one(*x) for x in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("text").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(made, pa.binary())], ["page_id", "record"])

    source = pages.select("page_id", "url", F.col("html").cast("binary").alias("text"))
    return source.mapInArrow(run, f"page_id {dict(source.dtypes)['page_id']}, record binary")


def write(records: DataFrame, path: str) -> None:
    """Writes derived records (UTF-8 throughout) as WARC files, one record after the other, in as many files as partitions."""
    # a record ends with two line ends, the writer adds the last one
    records.select(F.expr("cast(substring(record, 1, length(record) - 2) as string)").alias("value")).write.option("lineSep", "\r\n").text(path)


def op9_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    """The pages as WARC response records, parsed as such, and their derivatives."""
    stored = response_records(c.read(spark, sf_dir, "pages")).select(F.col("page_id").cast("string").alias("path"), F.col("record").alias("content"))
    return derivatives(responses_of(parse_files(stored)), "path", whole=False).withColumn("path", F.col("path").cast("bigint")).withColumnRenamed("path", "page_id")
