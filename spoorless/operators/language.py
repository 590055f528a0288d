"""Languages of a user's texts: the catalogue that fits, and translation by lookup and by ordered pattern rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A part of a rule's rendering: it is left out if the group that it needs (0: none) is empty; {1} to {9} are groups.
RULES = "locale string, priority int, pattern string, parts array<struct<needs: int, text: string>>"


def matched(requests: DataFrame, codes: DataFrame, prefixes: DataFrame, default: str = "en") -> DataFrame:
    """``requests (id, stored, wanted)`` with the ``code`` that serves each.

    The stored code if ``codes (code)`` has it as it is written; else the code of the longest of ``prefixes
    (prefix, code)`` that the wanted tag begins with, case aside; else the tag's first part, if that is a code; else
    the default. Prefixes are found by an equi-join with the wanted tag's own beginnings, so no pair that
    doesn't match is looked at; a null tag has none. Rows with equal ids are told apart by what they ask for.
    """
    longest = prefixes.agg(F.coalesce(F.max(F.length("prefix")), F.lit(0))).first()[0]
    tag = F.lower(F.coalesce("wanted", F.lit("")))
    rows = requests.withColumn("_tag", tag)
    starts = rows.select("_tag").distinct().select("_tag", F.explode(F.sequence(F.lit(0), F.least(F.length("_tag"), F.lit(longest)))).alias("_n"))
    starts = starts.select("_tag", F.substring("_tag", F.lit(1), F.col("_n")).alias("prefix"))
    by_prefix = starts.join(prefixes.select(F.lower("prefix").alias("prefix"), "code"), "prefix").groupBy("_tag").agg(F.max_by("code", F.struct(F.length("prefix"), "code")).alias("_by_prefix"))
    known = codes.select("code").distinct()
    rows = rows.withColumn("_first", F.split("_tag", "-")[0])
    rows = rows.join(by_prefix, "_tag", "left").join(known.select(F.col("code").alias("stored"), F.col("code").alias("_stored")), "stored", "left")
    rows = rows.join(known.select(F.col("code").alias("_first"), F.col("code").alias("_language")), "_first", "left")
    return rows.select(*[F.col(f"`{c}`") for c in requests.columns], F.coalesce("_stored", "_by_prefix", "_language", F.lit(default)).alias("code"))


def _rendered(text: Column, pattern: Column, parts: Column) -> Column:
    """The parts of a rule with the groups of its match put in; a group that takes no part in the match is empty."""
    groups = [F.call_function("regexp_extract", text, F.concat(pattern, F.lit("()" * 9)), F.lit(k)) for k in range(10)]  # so that each number has a group
    found = F.array(*groups)

    def one(part: Column) -> Column:
        # what is between the marks, one after the other: braces in a group's text aren't looked at again
        pieces = F.split(part["text"], r"(?=\{[1-9]\})|(?<=\{[1-9]\})")
        put = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\{[1-9]\}$"), F.get(found, F.substring(p, 2, 1).try_cast("int"))).otherwise(p)), "")
        return F.when((part["needs"] == 0) | (F.get(found, part["needs"]) != ""), put).otherwise("")

    return F.array_join(F.transform(parts, one), "")


def translated(texts: DataFrame, exact: DataFrame, rules: DataFrame) -> DataFrame:
    """``texts (..., locale, text)`` with their ``shown``: an exact entry, else the first rule that matches, else the text.

    ``exact (locale, text, shown)`` is joined by both; an empty entry counts for none. ``rules`` (:data:`RULES`) of a locale become one
    row, in the order of their priority, and are tried on texts without an entry; a rule is a pattern of Java's.
    Two entries for a text give the least.
    """
    entries = exact.filter("shown <> ''").groupBy("locale", "text").agg(F.min("shown").alias("_exact"))
    listed = rules.groupBy("locale").agg(F.sort_array(F.collect_list(F.struct("priority", "pattern", "parts"))).alias("_rules"))
    rows = texts.join(entries, ["locale", "text"], "left").join(listed, "locale", "left")
    first = F.get(F.filter("_rules", lambda r: F.regexp(F.col("text"), r["pattern"])), F.lit(0))
    # exploded from an array of one, so that rules are tried once and not for each use of the first
    rows = rows.withColumn("_rule", F.explode(F.array(F.when(F.col("_exact").isNull() & F.col("_rules").isNotNull(), first))))
    by_rule = F.when(F.col("_rule").isNotNull(), _rendered(F.col("text"), F.col("_rule.pattern"), F.col("_rule.parts")))
    return rows.select(*[F.col(f"`{c}`") for c in texts.columns], F.coalesce("_exact", by_rule, "text").alias("shown"))
