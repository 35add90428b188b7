"""Exact dedup: groups by a 128-bit hash of the content, bytes compared inside groups.

Texts are equal if they are identical after each run of ``[\\x20\\x09-\\x0D]`` became one space. Of equal texts
the row with the smallest doc_id stays.

Each row is reduced to its hash once; groups are counted with map-side combining, so a group of a third of all
rows sends a row a task. Only texts of groups with two rows or more are compared: they are grouped by
(hash, text), again combined on the map side, and a hash that more than one text shares is settled by the texts
themselves. No text of a single row is shuffled while the hashes of groups can be broadcast (their number is
counted first, GROUPS at most); beyond that all texts are grouped, with the same result. Nothing of a group is
gathered: a group is its smallest row and a count.

Null text counts as empty. A null doc_id counts as larger than any other. Rows of one group with the same
smallest doc_id: exactly one of them stays (they differ in nothing that is read here). An empty table gives no
rows. Other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Hashes (16 bytes) of groups that are broadcast at most.
GROUPS = 1_000_000


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash, groups: int = GROUPS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row for each row of docs."""
    texts = docs.select("doc_id", normalised("text").alias("t")).select("doc_id", "t", hashed(F.col("t")).alias("h"))
    sha = F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256")
    # written, so that a row keeps its number
    rows = c.store(texts.select("doc_id", "h", sha, F.monotonically_increasing_id().alias("row")), "hashed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    many = c.store(rows.groupBy("h").agg(first, F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    small = many.count() <= groups
    suspects = texts.join(F.broadcast(many.select("h")), "h", "left_semi") if small else texts
    collided = c.store(suspects.groupBy("h", "t").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"), "collisions")
    named = rows.join(many.select("h", "first", "group_size"), "h", "left").select(
        "h", "doc_id", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"), "text_sha256",
    )
    if collided.isEmpty():
        return named.drop("h")
    return named.join(collided, "h", "left_anti").drop("h").unionByName(_by_text(texts.join(collided, "h", "left_semi"), sha))


def _by_text(texts: DataFrame, sha: Column) -> DataFrame:
    """The same result for rows whose hash doesn't tell their texts apart. Expected for no hash of any corpus."""
    rows = c.store(texts.select("doc_id", "t", sha, F.monotonically_increasing_id().alias("row")), "settled")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    of = rows.groupBy("t").agg(first, F.count("*").alias("group_size"))
    return rows.join(of.hint("merge"), "t").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("first.row") == F.col("row")).alias("kept"), "text_sha256")


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(c.read(spark, sf_dir, "documents"))
