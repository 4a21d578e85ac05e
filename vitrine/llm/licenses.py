"""License scans: keyword prefilter, ordered signature rules, suppression of contained detections."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import ascii_lower, whole_text
from vitrine.llm.license_rules import BASE, RULES, Rule, words

#: Characters between words: ASCII without letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DETECTION = "array<struct<start:bigint,stop:bigint,rule:int,label:string,certainty:double>>"


def spaced(parts: Column) -> Column:
    """The words of a split text, each between two blanks of its own."""
    return F.concat(F.lit(" "), F.array_join(F.filter(parts, lambda w: w != ""), "  "), F.lit(" "))


def n_words(parts: Column) -> Column:
    """A split text has an empty part before a leading and after a trailing separator."""
    last = (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    return F.size(parts).cast("long") - (F.element_at(parts, 1) == "").cast("int") - last.cast("int")


def _count(spaced: str) -> str:
    return f"cast((length({spaced}) - length(replace({spaced}, ' ', ''))) div 2 as bigint)"


def matches(spaced: str, rule: str) -> str:
    """SQL: word intervals of a rule's matches. One pass of the pattern marks them, words are counted between marks."""
    marked = rf"split(regexp_replace({spaced}, concat('(', {rule}.pattern, ')'), '\u0001$1\u0002'), '\u0001')"
    return f"""aggregate({marked}, struct(cast(NULL AS bigint) AS at, cast(array() AS {DETECTION}) AS found),
        (s, part) -> CASE WHEN s.at IS NULL THEN struct({_count("part")} AS at, s.found AS found)
            ELSE struct(s.at + {_count("part")} AS at, array_append(s.found, struct(
                s.at AS start, s.at + {_count("split_part(part, chr(2), 1)")} AS stop, {rule}.rule AS rule, {rule}.label AS label, {rule}.certainty AS certainty)) AS found) END,
        s -> s.found)"""


def outermost(found: str) -> str:
    """SQL: detections that no earlier one contains, in order of start, longest first, highest rule first.

    Of equal intervals the rule with priority stays; of nested ones the outer. Overlaps in part both stay.
    """
    ordered = f"""array_sort({found}, (x, y) -> CASE
        WHEN x.start < y.start OR (x.start = y.start AND (x.stop > y.stop OR (x.stop = y.stop AND x.rule < y.rule))) THEN -1
        WHEN x.start = y.start AND x.stop = y.stop AND x.rule = y.rule THEN 0 ELSE 1 END)"""
    return f"""aggregate({ordered}, struct(cast(-1 AS bigint) AS reach, cast(array() AS {DETECTION}) AS kept),
        (s, d) -> CASE WHEN d.stop <= s.reach THEN s ELSE struct(d.stop AS reach, array_append(s.kept, d) AS kept) END, s -> s.kept)"""


RULE = "rule int, label string, keyword string, literal string, pattern string, certainty double"


def rule_table(rows: list[tuple]) -> Column:
    """A constant array of rules. It is written as JSON, which is one literal instead of thousands."""
    names = [part.split()[0] for part in RULE.split(", ")]
    return F.from_json(F.lit(json.dumps([dict(zip(names, row)) for row in rows])), f"array<struct<{RULE.replace(' ', ':').replace(',:', ',')}>>")


def signature_table(rules: Sequence[Rule]) -> Column:
    return rule_table([(n, r.label, r.keyword, r.literal, r.pattern, r.certainty) for n, r in enumerate(rules)])


def base_table() -> Column:
    """A base phrase is gated by its own words."""
    return rule_table([(n, label, phrase.split()[0], words(phrase), words(phrase), 0.75) for n, (phrase, label) in enumerate(BASE.items())])


def scan_licenses(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections``.

    Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z. ``n_base`` counts the
    places of the base phrases, first_word and last_word are their smallest and largest start (null without any).
    ``labels`` joins the base labels with those of the detections left by the rules; ``detections`` has their word
    intervals. ``score`` is the highest certainty of a detection or base phrase, 0 without any. A null or empty text has
    no words, empty labels and score 0. Repeated rows are scanned each; a null id stays null. Only doc_id and text are read.

    A rule's pattern runs only on texts that hold its keyword as a word and its literal words, once over the whole text.
    """
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in rules} | {phrase.split()[0] for phrase in BASE})])
    split = docs.select("doc_id", F.explode(F.array(F.split(ascii_lower(whole_text()), BETWEEN))).alias("parts"))
    gated = split.select("doc_id", "parts", n_words(F.col("parts")).alias("n_words"), F.array_intersect("parts", keywords).alias("held"))
    some = F.size("held") > 0

    def held(rule: Column) -> Column:
        return F.array_contains(F.col("held"), rule["keyword"]) & F.contains(F.col("spaced"), rule["literal"])

    chosen = gated.select("doc_id", "n_words", F.explode(F.array(F.struct("held", F.when(some, spaced(F.col("parts"))).alias("spaced")))).alias("g"))
    chosen = chosen.select("doc_id", "n_words", "g.held", "g.spaced").select(
        "doc_id", "n_words", "spaced",
        F.when(some, F.filter(signature_table(rules), held)).alias("rules"),
        F.when(some, F.filter(base_table(), held)).alias("base"))
    none = f"cast(array() AS {DETECTION})"
    found = chosen.select(
        "doc_id", "n_words",
        F.expr(f"coalesce(flatten(transform(base, r -> {matches('spaced', 'r')})), {none})").alias("base"),
        F.expr(f"coalesce({outermost('flatten(transform(rules, r -> ' + matches('spaced', 'r') + '))')}, {none})").alias("detections"))
    found = found.select("doc_id", "n_words", F.explode(F.array(F.struct("base", "detections"))).alias("f")).select("doc_id", "n_words", "f.base", "f.detections")
    both = F.concat(F.col("base"), F.col("detections"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.start")).alias("first_word"), F.array_max(F.col("base.start")).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(both["label"])), ",").alias("labels"),
        F.coalesce(F.array_max(both["certainty"]), F.lit(0.0)).alias("score"), "detections")
