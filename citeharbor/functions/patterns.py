"""Pattern sets: what the detector looks for, as data.

A :class:`PatternSet` is an ordered list of :class:`SignalRule` plus the
contexts that disqualify a sentence, the weak keyword and the score threshold.
The detector itself knows nothing about any archive.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from citeharbor.functions.core import quote_literal, unicode_regex


@dataclass(frozen=True)
class SignalRule:
    """One class of evidence.

    ``every_match``: one signal for each match; otherwise at most one signal per
    pattern and sentence. ``fills`` names the field ("doi" or "study_number")
    that receives regex group ``group`` of the match.
    """

    signal_type: str
    patterns: tuple[str, ...]
    weight: int
    every_match: bool = True
    fills: str | None = None
    group: int = 0


@dataclass(frozen=True)
class PatternSet:
    rules: tuple[SignalRule, ...]
    negatives: tuple[str, ...] = ()
    keyword: str | None = None
    keyword_type: str = "keyword_only"
    keyword_weight: int = 1
    threshold: int = 3
    # Regex that every sentence with a signal must match; skips all other text.
    # None when the rules share no such text.
    gate: str | None = field(default=None)

    @property
    def negative_regex(self) -> str | None:
        """All disqualifying contexts as one alternation."""
        if not self.negatives:
            return None
        return unicode_regex("(?:" + "|".join(self.negatives) + ")")

    @property
    def gate_regex(self) -> str | None:
        return None if self.gate is None else unicode_regex(self.gate)


# Identifiers, phrases, weights and threshold of the archive.
ARCHIVE_KEYWORD = "icpsr"

DOI_PATTERNS = (
    r"10\.3886/ICPSR\d+\.v\d+",
    r"10\.3886/ICPSR\d+",
)

# Fixed value: project-style identifiers, used for classification only.
PROJECT_DOI_PATTERN = r"10\.3886/E\d+"

STUDY_PATTERNS = (
    r"ICPSR\s*Study\s*No\.?\s*(\d+)",
    r"ICPSR\s*#\s*(\d+)",
    r"ICPSR\s*(\d{4,6})",
)

VERB_CONTEXT_PATTERNS = (
    r"data\s+used\s+from\s+the\s+ICPSR",
    r"data\s+retrieved\s+from\s+the\s+ICPSR",
    r"data\s+analyzed\s+using\s+ICPSR",
    r"data\s+downloaded\s+from\s+ICPSR",
    r"data\s+accessed\s+via\s+ICPSR",
    r"datasets?\s+provided\s+by\s+ICPSR",
    r"data\s+obtained\s+from\s+ICPSR",
    r"data\s+were\s+drawn\s+from\s+ICPSR",
)

NEGATIVE_PATTERNS = (
    r"repositories\s+such\s+as\s+ICPSR",
    r"repositories\s+like\s+ICPSR",
    r"such\s+as\s+ICPSR\s+or\s+Dataverse",
    r"for\s+example,\s+ICPSR",
)

WEIGHTS = {"doi": 3, "verb_context": 3, "study": 3, "keyword_only": 1}

MIN_SCORE = 3


def archive_patterns(with_project_dois: bool = False) -> PatternSet:
    """The archive's pattern set; project DOIs can be counted as signals on request."""
    dois = DOI_PATTERNS + ((PROJECT_DOI_PATTERN,) if with_project_dois else ())
    gate = quote_literal(ARCHIVE_KEYWORD)
    if with_project_dois:
        gate = f"(?:{gate}|{PROJECT_DOI_PATTERN})"
    return PatternSet(
        rules=(
            SignalRule("doi_pattern", dois, WEIGHTS["doi"], fills="doi"),
            SignalRule("study_pattern", STUDY_PATTERNS, WEIGHTS["study"],
                       fills="study_number", group=1),
            SignalRule("verb_context", VERB_CONTEXT_PATTERNS, WEIGHTS["verb_context"],
                       every_match=False),
        ),
        negatives=NEGATIVE_PATTERNS,
        keyword=ARCHIVE_KEYWORD,
        keyword_weight=WEIGHTS["keyword_only"],
        threshold=MIN_SCORE,
        gate=gate,
    )


ARCHIVE = archive_patterns()
