"""Stages on tables with clashing column names and on empty tables; texts that once took minutes."""

import gzip
import json
import random
import resource
import time
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import fertility, near_dup, patience, pieces, pii, rlz, templates, warc

CLASHING = "_id _text _lang _script _size _a0 _b0 _measured _measured_kept gone key hash row m verdict n kept doc text_sha256 h t rep bands part at".split()


def clashing(docs):
    return docs.withColumns({k: F.lit(f"own {k}") for k in CLASHING if k not in docs.columns})


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_with_clashing_names(spark, tmp_path, odd_docs, name, stage):
    spark.createDataFrame([(1, "What is the sum of three and twelve apples?")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = clashing(odd_docs)
    got = stage(spark, docs, str(tmp_path))
    if name == "encoding":
        assert got.count() == docs.count()
        return
    assert got.dtypes == docs.dtypes
    plain = stage(spark, odd_docs, str(tmp_path))
    assert sorted(map(repr, got.select("doc_id", "text").collect())) == sorted(map(repr, plain.select("doc_id", "text").collect()))
    assert all(r._id == "own _id" and r.gone == "own gone" for r in got.collect())


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_of_empty_tables(spark, tmp_path, odd_docs, name, stage):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert stage(spark, odd_docs.limit(0), str(tmp_path)).count() == 0


def test_empty_documents_give_no_rows(spark, odd_docs):
    none, bench = odd_docs.limit(0), spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert templates.contaminated(none, bench).count() == templates.clean(none, bench).count() == near_dup.one_of_each(none).count() == fertility.kept_only(none).count() == 0
    assert patience.scan(none).count() == fertility.quality(none).count() == pieces.encode(none).count() == pii.pseudonymised(none).count() == near_dup.near_duplicates(none).count() == 0
    assert rlz.without_repeats(none).count() == rlz.factors(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    records = warc.response_records(pages).select(F.col("page_id").cast("string").alias("path"), F.col("record").alias("content"))
    assert warc.derivatives(warc.responses_of(warc.parse_files(records)), "path").count() == 0


@pytest.mark.parametrize("text", ["a" * 100_000, "=" * 50_000, "ha" * 50_000, "ab" * 30_000 + "c"])
def test_ties_do_not_spread(text):
    m, began = pieces.load(pieces.MODEL), time.perf_counter()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = pieces.a_star(m, text, 4)
    assert time.perf_counter() - began < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
    assert len({ids for _, ids in found}) == 4 and all(pieces.decode(m, [m.ids[pieces.SPACE], *ids]) == text for _, ids in found)
    assert [x for x, _ in found] == sorted((x for x, _ in found), reverse=True)


def test_n_best_of_ties_equal_all_paths():
    m = pieces.load(pieces.MODEL)
    for text in ("aaaaaaa", "abab" * 2, "=" * 9, "hahah"):
        _, into = pieces.forward(m, text)
        ends = [[0.0]] + [[] for _ in text]
        for j in range(1, len(text) + 1):
            ends[j] = [x + w for i, w, _ in into[j] for x in ends[i]]
        for n in (1, 4, 9):
            assert [x for x, _ in pieces.a_star(m, text, n)] == pytest.approx(sorted(ends[-1], reverse=True)[:n])


@pytest.mark.parametrize("page", ["<a" + "x" * 400_000, "<a " + "x" * 400_000 + ">", "<a " + "x " * 200_000 + ">", "<a x" + " " * 400_000 + "=", "<a href='" * 50_000, "<a " + "x=" * 100_000 + ">", "<img src=\"" + "y" * 400_000])
def test_hostile_attributes_take_seconds(page):
    began = time.perf_counter()
    warc.scanned(page, "https://x.org/")
    assert time.perf_counter() - began < 5


def test_attributes_with_and_without_values():
    _, meta = warc.scanned("<html lang=en><a hidden class=x href = '/a' href='/z'>t</a><img alt src=b><a href>", "https://x.org/p/")
    assert meta["language"] == "en" and [x["url"] for x in meta["links"]] == ["https://x.org/a", "https://x.org/p/b"]


def test_targets_are_joined_as_the_standard_library_does():
    from urllib.parse import urljoin

    rng = random.Random(12)
    alphabet = "ab/.?#;: é%\\\t=&"
    targets = ["/", "/a", "/a/", "//h/x", "/a//b", "/a/../b", "/.a", "/a.html", "/a b", "/a?", "/a#", "", "x", "?q", "#f", "http://o/", "http://[bad", "/a\x01", "/\u2028", "/für", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in range(3000))]
    for url in ("http://h.org/p/q?x=1", "https://h.org", "HTTP://User@H.org:80/p", "ftp://h/p", "", None, "relative", "http://[bad"):
        join = warc.joiner(url)
        for t in targets:
            try:
                want = urljoin(url or "", t)
            except ValueError:
                want = t
            assert join(t) == want, (url, t)


def response(body, *headers, rid="<urn:uuid:1>"):
    block = b"HTTP/1.1 200 OK\r\n" + b"".join(h.encode() + b"\r\n" for h in headers) + b"\r\n" + body
    return warc.record("response", rid, [("WARC-Target-URI", "https://x.org/"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response")], block)


def test_real_responses(spark):
    """Compressed, chunked, other charsets, images, repeated headers, no ids, broken records among good ones."""
    html, packed = "<p>caf\u00e9 \u20ac</p>", gzip.compress("<p>caf\u00e9 \u20ac</p>".encode())
    chunked = b"".join(b"%x;e=1\r\n%s\r\n" % (len(packed[i : i + 7]), packed[i : i + 7]) for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    records = [
        response(packed, "Content-Type: text/html; charset=utf-8", "Content-Encoding: gzip"), response(chunked, "Content-Type: text/html", "Content-Encoding: gzip", "Transfer-Encoding: chunked"),
        response(html.encode("cp1252"), "Content-Type: text/html; charset=windows-1252"), response(b"<meta charset='iso-8859-15'>" + html.encode("iso-8859-15"), "Content-Type: text/html"),
        response(raw.compress(html.encode()) + raw.flush(), "Content-Encoding: deflate"), response(b"\x89PNG\r\n\r\n", "Content-Type: image/png"), response(b"x", "Content-Type: text/plain", "Set-Cookie: a", "Set-Cookie: b", "Set-Cookie: c"),
        response(b"y", "Content-Encoding: br"), response(b"zzzz", "Content-Encoding: gzip"), response(b"w", "Content-Type: text/html; charset=no-such"),
    ]
    noid = response(b"same").replace(b"WARC-Record-ID: <urn:uuid:1>\r\n", b"")
    broken = b"WARC/1.1\r\nWARC-Type: response\r\n\r\nno length\r\nlines\r\n\r\n"
    data = b"garbage\r\n" + b"".join(records[:5]) + broken + b"".join(records[5:]) + noid + noid
    for content in (data, b"".join(gzip.compress(x) for x in (b"garbage\r\n", *records[:5], broken, *records[5:], noid, noid))):
        found = warc.parse_files(spark.createDataFrame([("f.warc", bytearray(content))], "path string, content binary"))
        rows = sorted(found.collect(), key=lambda r: r.ord)
        good = [r for r in rows if r.warc_type == "response" and r.issue != "no content length"]
        assert [bytes(r.text).decode() for r in good[:5]] == [html, html, html, "<meta charset='iso-8859-15'>" + html, html] and good[0].payload_digest == warc.digest(packed)
        assert json.loads(good[6].headers)["set-cookie"] == ["a", "b", "c"] and [r.issue for r in good[7:10]] == ["content coding br", "not gzip", "unknown charset no-such"]
        assert [r.issue for r in rows if r not in good] == ["no WARC record", "no content length"] and len(good) == 12
        made = warc.derivatives(warc.responses_of(found), "path").collect()
        of = [r for r in made if r.warc_type == "conversion"]
        assert sorted(r.block for r in of if "caf" in r.block) == ["caf\u00e9 \u20ac"] * 5 and not any("PNG" in r.block for r in of)
        loose = [r.record_id for r in made if r.refers_to is None]
        assert len(loose) == len(set(loose)) == 6  # both without an id, and the broken one
