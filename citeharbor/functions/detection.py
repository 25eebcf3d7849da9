"""Sentence-level evidence and its roll-up, as column expressions.

No shuffle and no Python worker: a document is split into an array of sentences,
each sentence into an array of signals, and the arrays are folded into a result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeharbor.functions.core import as_column, let, strip, unicode_regex
from citeharbor.functions.patterns import ARCHIVE, PatternSet, SignalRule
from citeharbor.functions.text import as_text, sentences
from citeharbor.schemas import SIGNALS, TEXT_RESULT

EVIDENCE_TYPE = T.ArrayType(T.StructType(SIGNALS.fields[3:7]))
SIGNAL_TYPE = T.ArrayType(T.StructType(SIGNALS.fields[1:]))
RESULT_FIELDS = tuple(TEXT_RESULT.names)


def negative_context(sentence: Column | str, patterns: PatternSet = ARCHIVE) -> Column:
    """True when the sentence mentions the archive only as an example."""
    if patterns.negative_regex is None:
        return F.lit(False)
    return as_column(sentence).rlike(patterns.negative_regex)


def _evidence(rule: SignalRule, found: Column | None = None) -> Column:
    def filled(name: str) -> Column:
        return found if found is not None and rule.fills == name else F.lit(None).cast("string")

    return F.struct(
        F.lit(rule.signal_type).alias("signal_type"),
        filled("doi").alias("doi"),
        filled("study_number").alias("study_number"),
        F.lit(rule.weight).alias("score"))


def _rule_evidence(rule: SignalRule, pattern: str, sentence: Column) -> Column:
    regex = unicode_regex(pattern)
    if rule.every_match:
        return F.transform(
            F.regexp_extract_all(sentence, F.lit(regex), F.lit(rule.group)),
            lambda found: _evidence(rule, found))
    return F.when(sentence.rlike(regex), F.array(_evidence(rule))).otherwise(F.array())


def sentence_evidence(sentence: Column | str, patterns: PatternSet = ARCHIVE) -> Column:
    """Signals of one sentence in rule, pattern and match order."""
    sentence = as_column(sentence)
    nothing = F.array().cast(EVIDENCE_TYPE)
    per_pattern = [
        _rule_evidence(rule, pattern, sentence).cast(EVIDENCE_TYPE)
        for rule in patterns.rules for pattern in rule.patterns
    ]
    strong = F.concat(*per_pattern) if per_pattern else nothing
    if patterns.keyword is not None:
        weak_rule = SignalRule(patterns.keyword_type, (), patterns.keyword_weight)
        weak = F.when(
            F.lower(sentence).contains(patterns.keyword.lower()),
            F.array(_evidence(weak_rule)).cast(EVIDENCE_TYPE)).otherwise(nothing)
        strong = let(strong, lambda s: F.when(F.size(s) > 0, s).otherwise(weak))
    if patterns.negative_regex is not None:
        strong = F.when(negative_context(sentence, patterns), nothing).otherwise(strong)
    return strong


def document_signals(text: Column | str, patterns: PatternSet = ARCHIVE) -> Column:
    """All signals of a document in reading order (see ``SIGNAL_TYPE``), never NULL.

    ``sentence_no`` counts all sentences from 0, ``signal_no`` the signals of
    the document from 0. The gate is tested on the whole text first, so text
    without it is neither split nor scanned further, and then per sentence.
    """
    text = as_text(text)
    gate = patterns.gate_regex

    numbered = F.transform(
        sentences(text), lambda s, i: F.struct(i.alias("no"), s.alias("sentence")))
    if gate is not None:
        numbered = F.filter(numbered, lambda x: x["sentence"].rlike(gate))
    nested = F.transform(numbered, lambda x: F.transform(
        sentence_evidence(x["sentence"], patterns),
        lambda e: F.struct(
            x["no"].alias("sentence_no"), e["signal_type"].alias("signal_type"),
            e["doi"].alias("doi"), e["study_number"].alias("study_number"),
            e["score"].alias("score"), strip(x["sentence"]).alias("snippet"))))
    signals = F.transform(F.flatten(nested), lambda s, i: F.struct(
        s["sentence_no"].alias("sentence_no"), i.alias("signal_no"),
        s["signal_type"].alias("signal_type"), s["doi"].alias("doi"),
        s["study_number"].alias("study_number"), s["score"].alias("score"),
        s["snippet"].alias("snippet"))).cast(SIGNAL_TYPE)
    if gate is None:
        return signals
    return F.when(text.rlike(gate), signals).otherwise(F.array().cast(SIGNAL_TYPE))


def roll_up(signals: Column | str, patterns: PatternSet = ARCHIVE) -> Column:
    """Document result as a struct of :data:`RESULT_FIELDS`.

    Below the threshold only ``has_icpsr = false`` is set, the rest is NULL.
    """
    def first_filled(items: Column, name: str) -> Column:
        return F.get(F.filter(items, lambda s: s[name].isNotNull() & (s[name] != "")),
                     F.lit(0))[name]

    def result(items: Column) -> Column:
        total = F.aggregate(items, F.lit(0), lambda acc, s: acc + s["score"])
        top_score = F.array_max(F.transform(items, lambda s: s["score"]))
        top = let(top_score, lambda m: F.get(
            F.filter(items, lambda s: s["score"] == m), F.lit(0)))
        hit = F.struct(
            F.lit(True).alias("has_icpsr"),
            first_filled(items, "doi").alias("icpsr_doi"),
            first_filled(items, "study_number").alias("icpsr_study_number"),
            total.alias("detection_score"),
            top_score.alias("max_signal_score"),
            top["signal_type"].alias("signal_type"),
            top["snippet"].alias("snippet"))
        return F.when((F.size(items) > 0) & (total >= patterns.threshold), hit)

    hit = let(as_column(signals), result)
    miss = F.struct(
        F.lit(False).alias("has_icpsr"),
        F.lit(None).cast("string").alias("icpsr_doi"),
        F.lit(None).cast("string").alias("icpsr_study_number"),
        F.lit(None).cast("int").alias("detection_score"),
        F.lit(None).cast("int").alias("max_signal_score"),
        F.lit(None).cast("string").alias("signal_type"),
        F.lit(None).cast("string").alias("snippet"))
    return F.coalesce(hit, miss)


def detect(text: Column | str, patterns: PatternSet = ARCHIVE) -> Column:
    """Detection result of a document."""
    return roll_up(document_signals(text, patterns), patterns)
