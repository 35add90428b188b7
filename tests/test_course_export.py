"""Captured pages and files to the course's tables and document."""

import glob

import pytest
from pyspark.sql import functions as F

from lectern.operators import course, course_export, pages
from lectern.operators.stored import shared_folder

from .course_fixture import captures


@pytest.fixture(scope="module")
def export(spark):
    rows = [("7031", u, f, 200, t, d, h, None) for u, f, t, d, h in captures()]
    df = spark.createDataFrame(rows, pages.CAPTURE)
    out = course_export.course_export(df, F.lit("2030-02-03 12:00:00").cast("timestamp_ntz"))
    return {k: [r.asDict() for r in v.collect()] for k, v in out.items()}


def test_sections_inside_subsections(export):
    tree = {r["section_id"]: (r["titles"], r["level"], r["depth"]) for r in export["sections"]}
    assert tree == {
        "5010": (["Welcome"], 2, 0), "5020": (["Trees"], 2, 0), "6010": (["Trees", "Conifers"], 3, 1), "6020": (["Trees", "Conifers", "Pines"], 4, 2), "5030": (["Section 2"], 2, 0), "5040": (["Late"], 2, 0),
    }
    assert all(r["reached"] and r["problem"] is None for r in export["sections"])


def test_each_module_once_where_it_comes_first(export):
    placed = {r["cmid"]: r["titles"][-1] for r in export["activities"]}
    assert placed == {"9101": "Welcome", "9102": "Welcome", "9103": "Trees", "9106": "Pines", "9107": "Conifers", "9108": "Section 2", "9109": "Section 2", "9110": "Late", "9111": "Late", "9112": "Late", "9113": "Late"}
    acts = {r["cmid"]: r for r in export["activities"]}
    assert [k for k, r in acts.items() if r["breadcrumb_mismatch"]] == ["9107"] and acts["9103"]["completion"] == "Done"
    assert acts["9101"]["external_url"] == "https://herbarium.example.net/sheet/9"  # an object goes before other links


def test_facts_of_pages(export):
    acts = {r["cmid"]: r for r in export["activities"]}
    assert acts["9106"]["info_lines"] == ["Attempts allowed: 3", "Time limit: 20 mins", "Open book"]
    assert [acts["9106"][k] for k in ("attempts", "opens", "closes")] == ["3", "1 March 2030, 09:00", "8 March 2030, 17:30"]
    assert (acts["9106"]["meta"]["timeLimit"], acts["9107"]["due"], acts["9107"]["cutoff"]) == ("20 mins", "2 February 2030, 12:00", None)
    assert (acts["9107"]["meta"]["submissionStatus"], acts["9107"]["meta"]["timeRemaining"]) == ("Draft", "2 days")


def test_one_file_asked_for_in_several_ways(export):
    """A direct link to where a resource ended up is that resource's file; a file of the same name elsewhere isn't."""
    assert sorted(r["path"] for r in export["assets"] if r["path"]) == [
        "files/Section 2/Note/tree key.pdf", "files/Section 2/Photos/May trip/oak.jpg", "files/Section 2/Photos/oak.jpg", "files/Trees/Tree key/tree key.pdf", "files/Welcome/Rules/map.png", "files/Welcome/plan.pdf",
    ]
    (doc,) = export["documents"]
    assert "Same key: [here](<files/Trees/Tree key/tree key.pdf>) ; another [tree key](<files/Section 2/Note/tree key.pdf>)" in doc["text"]
    assert [r["line"] for r in export["issues"]] == ['- ❌ Download "form.odt": not captured (https://campus.example.org/pluginfile.php/34/mod_assign/introattachment/0/form.odt?forcedownload=1)']


def test_document_in_order(export):
    (doc,) = export["documents"]
    text = doc["text"]
    assert text.startswith("# Field Botany\n\n- URL: https://campus.example.org/course/view.php?id=7031\n- Scraped: 2030-02-03T12:00:00\n- Activities: 11 · Files: 6\n")
    due = [x.strip("| ").split(" | ") for x in text.split("## Welcome")[0].split("\n") if x.startswith("| ") and "---" not in x][1:]
    assert [(r[0], r[2], r[-1]) for r in due] == [("Survey", "Trees › Conifers", "closed"), ("Needles", "Trees › Conifers › Pines", "upcoming"), ("Walk", "Late", "no dates")]
    order = [
        "## Welcome\n\nRead *this* first, then [the plan](files/Welcome/plan.pdf)", "### 🔗 Herbarium", "### 📃 Rules", "Short rules\n\n#### Outdoors\n\n> ⚠️ Erratum: bring water\n\n- hat\n- boots",
        "[first](https://campus.example.org/one) [second](https://campus.example.org/two) ![map](files/Welcome/Rules/map.png)", "## Trees", "### 📄 Tree key", "How to tell trees apart", "### Conifers", "#### Pines", "##### 📝 Needles", "Look at the **needles**",
        "**Your attempts:**\n\n| Try | Mark |\n| --- | --- |\n| A | 7\\|10 |", "#### 📌 Survey", "Count the trees", "**Submission status:**", "## Section 2", "### 📁 Photos", "🔊 song.ogg (not downloaded)", "## Late", "### 💬 Finds", "**10 most recent discussions:**",
        "#### Seen 8801\n\n_by B, 4 May_ — https://campus.example.org/mod/forum/discuss.php?d=8801\n\nOrchid no. 8801", "#### Find 8810\n\n_(first post not found)_", "### 🎓 Walk", "#### 1. Gate\n\nStart at the gate", "#### Pond\n\nNewts live here", "### ▫️ Pool", "### 📘 Flora", "#### Ferns\n\nspores", "## Scrape errors",
    ]
    at = -1
    for x in order:
        assert text.find(x, at + 1) > at, (x, text)
        at = text.find(x, at + 1)
    # the eleventh discussion, what only the index lists, and a module's second place are left out
    assert "8811" not in text and "in the index only" not in text and text.count("Tree key\n") == 1


def test_pages_of_one_split_are_parsed_by_many_tasks(spark):
    """Small pages that lie in one split are dealt out before they are parsed, and read for links, and rendered; names are worked out once."""
    rows = [("1", f"https://campus.example.org/mod/page/view.php?id={i}", None, 200, "text/html", "", f"<div role='main'><div class='generalbox'>{i}</div></div>", None) for i in range(40)]
    course_page = ("1", "https://campus.example.org/course/view.php?id=1", None, 200, "text/html", "", "<h1>C</h1><div id='region-main'><ul><li class='section' data-for='section' data-id='1'><h3 class='sectionname'>S</h3><ul>" + "".join(f"<li class='activity modtype_page' data-id='{i}'><a class='aalink' href='/mod/page/view.php?id={i}'>p{i}</a></li>" for i in range(40)) + "</ul></li></ul></div>", None)
    before = {name: set(glob.glob(f"{shared_folder(spark)}/lectern/*/{name}")) for name in ("parts", "fragments", "markdown", "named")}
    course_export.course_export(spark.createDataFrame([*rows, course_page], pages.CAPTURE).coalesce(1), F.lit("2030-02-03 12:00:00").cast("timestamp_ntz"))
    for name, old in before.items():
        (new,) = set(glob.glob(f"{shared_folder(spark)}/lectern/*/{name}")) - old
        if name in ("parts", "fragments"):
            assert len(glob.glob(f"{new}/part-*")) > 1, name


def test_section_paths_of_any_depth(spark):
    deep = [("c", str(i), str(i - 1) if i else None, f"t{i}") for i in range(40)] + [("c", "lone", "gone", "x"), ("c", "kid", "lone", "y"), ("c", "a", "b", "A"), ("c", "b", "a", "B")]
    got = {r.section_id: r for r in course.section_paths(spark.createDataFrame(deep, "course_id string, section_id string, parent_section_id string, title string")).collect()}
    assert len(got) == len(deep) and got["39"].depth == 39 and got["39"].level == 6 and got["39"].titles == [f"t{i}" for i in range(40)]
    assert (got["kid"].titles, got["kid"].problem, got["a"].problem, got["a"].titles) == (["x", "y"], "orphan", "cycle", ["A"])
