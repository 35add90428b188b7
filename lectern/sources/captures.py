"""Folders of captured responses, one file each.

Spark's own reader of whole files lists the folders and deals files out to tasks by their bytes, from any store that
Spark reads. A file that can't be used is an issue row with its path, never a failed job.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.relational import unused

#: Bytes of a captured file that is read at most; larger ones are issues, and their content isn't read.
MAX_BYTES = 256 << 20


def issue(source: str, message: Column | str, url: Column, severity: str = "error") -> list[Column]:
    """The columns of an issue row."""
    return [F.lit(source).alias("source"), F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"), url.alias("url")]


def files(spark: SparkSession, folder: str, glob: str = "*", max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(path, length, content) of the files at any depth, and issues for those that are too large."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    large = found.where(F.col("length") > max_bytes).select(*issue("files", F.concat(F.lit("too large: "), F.col("length").cast("string")), F.col("path")))
    return found.where(F.col("length") <= max_bytes).select("path", "length", "content"), large


def json_files(spark: SparkSession, folder: str, pattern: str, fields: list[str], max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(fields, path, body) of the .json files whose path fits the pattern, a field for each of its groups, and issues."""
    found, large = files(spark, folder, "*.json", max_bytes)
    named, text = F.col("path").rlike(pattern), F.is_valid_utf8("content")
    # a mark of UTF-8 is no part of the text
    body = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    good = found.where(named & text).select(*(F.regexp_extract("path", pattern, i).alias(f) for i, f in enumerate(fields, 1)), "path", body.alias("body"))
    bad = found.where(~named | ~text).select(*issue("files", F.when(named, "not UTF-8").otherwise("name doesn't tell what it answers"), F.col("path")))
    return good, large.unionByName(bad)


def manifest_captures(spark: SparkSession, folder: str, schema: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Captures that a manifest lists, with their contents, and issues.

    manifest.jsonl has an object a line: the fields of ``schema`` and ``file``, the path below the folder. The contents
    come from the files, joined on that path: the field ``content`` of every file, ``html`` of those that are HTML by
    content type, in UTF-8 or else as Latin-1.
    """
    # lines as text first: a scan of the corrupt lines alone would read no field that tells them
    parsed = F.from_json("value", f"{schema}, file string, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    given = spark.read.text(f"{folder}/manifest.jsonl").where("trim(value) <> ''").select(parsed.alias("m")).select("m.*")
    columns = [c for c in given.columns if c not in ("file", "_corrupt_record", "html", "content")]
    unread = given.where(F.col("_corrupt_record").isNotNull() | F.col("file").isNull()).select(*issue("manifest", "not a capture", F.coalesce(F.substring("_corrupt_record", 1, 80), F.col("url"))))
    found, large = files(spark, folder, max_bytes=max_bytes)
    (base,) = unused(given, "base")
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", folder).rstrip("/") + "/"  # as every store spells it in its paths
    below = F.expr("substring(path, locate({0}, path) + length({0}))".format("'" + root.replace("\\", "\\\\").replace("'", "\\'") + "'")).alias(base)
    held = found.select(below, "content")
    asked = given.where(F.col("_corrupt_record").isNull() & F.col("file").isNotNull())
    joined = asked.drop("html", "content", "_corrupt_record").join(held, F.col("file") == F.col(base), "left")
    missing = joined.where(F.col("content").isNull()).select(*issue("manifest", F.concat(F.lit("no file "), "file"), F.col("url")))
    page = F.coalesce(F.lower("content_type").contains("text/html"), F.lit(False))
    html = F.when(page, F.when(F.is_valid_utf8("content"), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1")))
    return joined.where(F.col("content").isNotNull()).select(*columns, html.alias("html"), "content"), unread.unionByName(large).unionByName(missing)
