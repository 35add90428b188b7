"""Literal cases of the column functions and helpers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import dates, naming, text, urls
from lectern.functions.text import _fold
from lectern.operators import deadlines, office, pages, relational
from lectern.sources.office import read_package


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize(
    ("prose", "want"),
    [
        ("6 octobre 2025, 23:59", "2025-10-06 23:59"), ("Ouvert le 1er février 2026 à 14h05", "2026-02-01 14:05"), ("September 15, 2025 2:30 PM", "2025-09-15 14:30"),
        ("15/09/25 08:00", "2025-09-15 08:00"), ("31 février 2025", "2025-03-03 23:59"), ("15 Sept. 2025 12:10 AM", "2025-09-15 00:10"), ("3 mai 2025 - rendu pour 10:00", "2025-05-03 23:59"), ("bientôt", None), (None, None), ("", None),
    ],
)
def test_parse_date(spark, prose, want):
    got = one(spark, F.date_format(dates.parse_date(F.lit(prose).cast("string")), "yyyy-MM-dd HH:mm"))[0]
    assert got == want


@pytest.mark.parametrize(
    ("name", "want"),
    [("a<b>: c?.pdf", "a_b__ c_.pdf"), ("  x\t y . ", "x y"), ("con", "_con"), ("nul.txt", "_nul.txt"), ("", "untitled"), (None, "untitled"), ("é" * 100 + ".pdf", "é" * 76 + ".pdf"), ("é", "é"), (" a ", "a")],
)
def test_sanitize(spark, name, want):
    assert one(spark, naming.sanitize(F.lit(name).cast("string")))[0] == want


def test_names_from_headers(spark):
    cd = F.lit("attachment; filename=\"a.pdf\"; filename*=UTF-8''b%20%C3%A9.pdf")
    assert one(spark, naming.filename_from_disposition(cd), naming.filename_from_disposition(F.lit('inline; filename="100%.pdf"')), naming.filename_from_disposition(F.lit("inline"))) == ("b é.pdf", "100%.pdf", None)
    assert one(spark, naming.fix_mojibake(F.lit("Ã©tÃ©")), naming.fix_mojibake(F.lit("漢Ã©"))) == ("été", "漢Ã©")


def test_unique_names_repairs_collisions(spark):
    rows = [("d", n, i) for i, n in enumerate(["a.pdf", "a (2).pdf", "A.pdf", "a.pdf", "b.txt", "b.txt", "c"])]
    got = {r.ord: r.unique_name for r in naming.unique_names(spark.createDataFrame(rows, "dir string, name string, ord int"), ["dir"]).collect()}
    assert got == {0: "a.pdf", 1: "a (2).pdf", 2: "A (3).pdf", 3: "a (4).pdf", 4: "b.txt", 5: "b (2).txt", 6: "c"}


def test_status(spark):
    now = F.lit("2026-01-10 12:00:00").cast("timestamp_ntz")
    s = lambda **k: deadlines.deadline_status(*(F.lit(k.get(x, "")) for x in ("opens", "closes", "due", "cutoff")), now)
    got = one(spark, s(), s(due="01/01/2026", cutoff="01/02/2026"), s(closes="01/01/2026"), s(opens="01/02/2026"), s(opens="01/01/2026"), s(due="plus tard"), s(closes="x", due="01/01/2026"))
    assert got == ("no dates", "overdue (cut-off later)", "closed", "upcoming", "open", "?", "?")


def test_guard_and_keys(spark):
    f = lambda u: urls.is_forbidden(F.lit(u))
    assert one(spark, f("https://campus.example.org/a"), f("https://campus.example.org/mod/quiz/StartAttempt.php"), f("https://evil.example.org/"), f("not a url")) == (False, True, True, True)
    assert one(spark, urls.norm_url(F.lit("https://x/mod/resource/view.php?id=3#a")), urls.norm_url(F.lit("https://x/f.pdf?forcedownload=1&a=2#b"))) == ("resource:3", "https://x/f.pdf?a=2")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"], blacklist_characters="\r\n"), max_size=300))
def test_fold_round_trip(line):
    folded = _fold(line)
    assert folded.replace("\r\n ", "") == line
    assert all(len(x.encode()) <= 75 for x in folded.split("\r\n"))


def test_parameters_are_encoded(spark):
    set_ = lambda u, v: urls.set_param(F.lit(u), "k", F.lit(v))
    got = one(spark, set_("https://x/a?k=1&b=2#f", "a $1\\b&c"), set_("https://x/a", "é"), set_("https://x/a?b=1", "2"))
    assert got == ("https://x/a?k=a+%241%5Cb%26c&b=2#f", "https://x/a?k=%C3%A9", "https://x/a?b=1&k=2")


def test_custom_range(spark):
    r = lambda a, b: dates.compute_range(F.lit("custom"), F.to_date(F.lit("2026-01-01")), F.to_date(F.lit(a)), F.to_date(F.lit(b)))
    good, bad, open_ = one(spark, r("2026-02-01", "2026-02-03"), r("2026-02-03", "2026-02-01"), r("2026-02-03", None))
    assert (str(good.start), str(good.end)) == ("2026-02-01", "2026-02-03") and bad is None and open_ is None


def test_stamps_in_every_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("Europe/Brussels", "America/Los_Angeles", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert one(spark, text.utc_stamp(F.timestamp_seconds(F.lit(1767225600))), text.utc_stamp(F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))) == ("20260101T000000Z", "20260101T000000Z")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_values_stay_apart(spark):
    many = lambda *v: text.decode_many(F.array(*(F.lit(x).cast("string") for x in v)))
    got = one(spark, many("x < 5", "<b>y</b>", "z", None), many("a &lt;b&gt;", "<i>c", "d &amp; <e>"), text.decode_html(F.lit("1 < 2 <b>3</b>")))
    assert got == (["x < 5", "y", "z", ""], ["a <b>", "c", "d &"], "1 < 2 3")


def test_shifted_formulas():
    assert office.shifted('A1+$B$1+LOG10(C2)&"A1"', 2, 1) == 'B3+$B$1+LOG10(D4)&"A1"'


def test_damaged_package():
    assert [r["kind"] for rows in read_package("x.docx", "docx", b"no zip") for r in rows] == ["issue"]


def test_first_wins_is_stable_under_partitions(spark):
    df = spark.createDataFrame([(i % 5, i, f"v{i}") for i in range(100)], "k int, o int, v string")
    for n in (1, 8):
        assert sorted(r.v for r in relational.first_wins(df.repartition(n), ["k"], ["o"]).collect()) == ["v0", "v1", "v2", "v3", "v4"]
    assert relational.first_wins(df.limit(0), ["k"], ["o"]).count() == 0


def test_decode_html(spark):
    assert one(spark, text.decode_html(F.lit("<b>a</b>&nbsp;&amp;&#233;\n c")), text.decode_html(F.lit(None).cast("string"))) == ("a &é c", "")


def test_clean_changes_only_what_it_must(spark):
    """Single blanks are no match; every other white space and every run is one blank."""
    assert text._UNCLEAN.count("x20") == 1
    rows = [("a b", "a b"), ("a  b", "a b"), ("\ta b\n", "a b"), ("  a \r\n b ", "a b"), ("", ""), (None, "")]
    df = spark.createDataFrame(rows, "s string, want string")
    assert [r.c for r in df.select(text.clean(F.col("s")).alias("c")).collect()] == [w for _, w in rows]


def test_zip_dir_names_its_prefix_once(spark):
    """A path's prefix is worked out once for a row: the plan doesn't grow by copies of it."""
    df = spark.createDataFrame([(["p" * 70, "q" * 70, "leaf"],), (None,), (["a", None],)], "parts array<string>")
    made = df.select(naming.zip_dir(F.col("parts")).alias("dir"))
    assert [r.dir for r in made.collect()] == [f"files/{'p' * 40}/{'q' * 40}/leaf", "files", "files/a"]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") < 60, plan.count("transform(")
