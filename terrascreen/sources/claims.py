"""Checks of numbers and references quoted in text against tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascreen.functions.numbers import to_number


def claim_ledger(texts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each claim's quoted number against its value; a pattern that no longer matches is a failure.

    ``ledger`` has doc_id, claim, pattern, value, tolerance and may have ``word``: where that is not
    null, the quoted text itself must equal it. ``texts`` has doc_id, text.
    """
    joined = ledger.join(texts.select("doc_id", "text"), "doc_id", "left")
    quoted = F.expr("regexp_extract(text, pattern, 1)")
    word = F.col("word") if "word" in ledger.columns else F.lit(None).cast("string")
    rows = joined.select("doc_id", "claim", "value", "tolerance", word.alias("_word"), F.col("text").isNull().alias("_gone"), quoted.alias("quoted"))
    number = to_number(F.replace(F.col("quoted"), F.lit(","), F.lit("")))
    status = (F.when(F.col("_gone"), "missing_document").when(F.col("quoted") == "", "pattern_vanished")
              .when(F.col("_word").isNotNull(), F.when(F.col("quoted") == F.col("_word"), "ok").otherwise("differs")).when(number.isNull(), "not_a_number")
              .when(F.abs(number - F.col("value")) <= F.col("tolerance"), "ok").otherwise("differs"))
    return rows.select("doc_id", "claim", "quoted", status.alias("status"))


# References that point outside the checked tree, and marks of a placeholder.
SKIP_PREFIXES = ("http:", "https:", "mailto:", "javascript:", "#")
PLACEHOLDERS = ("*", "<", "{", "…")


def references(texts: DataFrame, text: str, pattern: str) -> DataFrame:
    """Distinct references per document: fragments cut, outside links and placeholders dropped."""
    found = texts.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("token"))
    token = F.regexp_extract("token", r"^[^#]*", 0)
    found = found.select("doc_id", token.alias("token")).where(F.col("token") != "")
    for prefix in SKIP_PREFIXES:
        found = found.where(~F.col("token").startswith(prefix))
    for mark in PLACEHOLDERS:
        found = found.where(~F.col("token").contains(mark))
    return found.distinct()


def normalised(folder, token):
    """``token`` seen from ``folder`` when it starts with a dot, without ``.`` and ``..``; otherwise as it is."""
    empty = F.array().cast("array<string>")
    parts = F.split(F.concat_ws("/", folder, token), "/")
    step = lambda path, part: (F.when((part == "") | (part == "."), path)
                               .when((part == "..") & (F.size(path) > 0) & (F.element_at(path, -1) != ".."), F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))))
                               .otherwise(F.concat(path, F.array(part))))
    joined = F.array_join(F.aggregate(parts, empty, step), "/")
    return F.when(token.startswith("."), joined).otherwise(token)


def misplaced_references(found: DataFrame, paths: DataFrame, name: str = "name") -> DataFrame:
    """References that resolve to nothing, seen from the document that makes them.

    A token with a slash is a path (from the document's folder if it starts with a dot) or a folder
    of one; a token without is the last part of some path; one that starts with a slash is not checked.
    """
    folder = F.regexp_replace(F.col(name), "/?[^/]*$", "")
    rows = found.where(~F.col("token").startswith("/")).withColumn("_path", F.regexp_replace(normalised(folder, F.col("token")), "/+$", ""))
    slash = F.col("token").contains("/")
    bases = paths.select(F.regexp_extract("path", "([^/]*)$", 1).alias("_path")).distinct()
    parts = F.split("path", "/")
    folders = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_path")).distinct()
    lost = rows.where(slash).join(folders, "_path", "left_anti").unionByName(rows.where(~slash).join(bases, "_path", "left_anti"))
    return lost.select(name, "token")


def unresolved_references(found: DataFrame, paths: DataFrame) -> DataFrame:
    """References that are neither a listed path nor a folder of one.

    Every path also stands for its parent folders, so the folder rule is an equi join too.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    known = paths.select(F.explode(folders).alias("_known")).where(F.col("_known") != "").distinct()
    clean = F.regexp_replace("token", "/+$", "")
    return found.withColumn("_known", clean).join(known, "_known", "left_anti").select("doc_id", "token")
