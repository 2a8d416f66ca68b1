"""Search texts for credential candidates."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from secretsift.functions.masking import fingerprint, mask
from secretsift.functions.text import all_matches, once
from secretsift.operators.rules import RULES, Rule

_EMPTY = "array<struct<rule:string,category:string,value:string>>"


def _hits(text: str, lowered: str, rule: Rule) -> Column:
    """Candidates of one rule; the keyword test spares most texts the regex."""
    searched = lowered if rule.any_case else text
    gate = reduce(or_, [F.contains(F.col(searched), F.lit(k)) for k in rule.keywords])
    found = F.transform(
        all_matches(F.col(text), rule.regex, rule.group),
        lambda v: F.struct(
            F.lit(rule.name).alias("rule"), F.lit(rule.category).alias("category"), v.alias("value")
        ),
    )
    return F.when(gate, found).otherwise(F.array().cast(_EMPTY))


def _lowered(texts: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Add the text in lower case, if any rule looks at it."""
    if any(r.any_case for r in rules):
        return texts.withColumn("_lowered", F.lower(text))
    return texts


def _all_hits(text: str, rules: tuple[Rule, ...]) -> Column:
    """Candidates of all rules, in one pass over the text."""
    return F.concat(*[_hits(text, "_lowered", r) for r in rules])


def find_credentials(
    texts: DataFrame, text: str, rules: tuple[Rule, ...] = RULES, raw: bool = False
) -> DataFrame:
    """One row per candidate in column ``text``, which the result leaves out.

    Adds ``rule``, ``category``, ``masked`` and ``fingerprint``; the found value
    itself only if ``raw`` is asked for.
    """
    keep = [F.col(f"`{c}`") for c in texts.columns if c != text]
    # The list goes into the generator as an expression: for a column of it, a
    # filter on its size would be inferred and search every text again.
    found = _lowered(texts, text, rules).select(*keep, F.inline(_all_hits(text, rules)))
    value = F.col("value")
    shown = [mask(value).alias("masked"), fingerprint(value).alias("fingerprint")]
    return found.select(*keep, "rule", "category", *shown, *([value] if raw else []))


def candidates_per_text(
    texts: DataFrame, text: str, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per text that has candidates: their number and sorted fingerprints.

    All candidates of a resource come from its one body, so the list is built
    inside the row and nothing is grouped or shuffled.
    """
    keep = [F.col(f"`{c}`") for c in texts.columns if c != text]
    prints = F.array_sort(F.array_distinct(
        F.transform(_all_hits(text, rules), lambda h: fingerprint(h["value"]))
    ))
    found = once(_lowered(texts, text, rules), candidates=prints)
    listed = found.select(*keep, "candidates").where(F.size("candidates") > 0)
    return listed.withColumn("n_candidates", F.size("candidates"))


def one_row_per_candidate(listed: DataFrame, others: list[str]) -> DataFrame:
    """Long form of the lists above."""
    return listed.select(*others, F.explode("candidates").alias("fingerprint"))


def fingerprint_counts(findings: DataFrame) -> DataFrame:
    """How often each candidate was found, and in how many places at least once."""
    return findings.groupBy("rule", "category", "fingerprint", "masked").agg(
        F.count(F.lit(1)).alias("n_findings")
    )
