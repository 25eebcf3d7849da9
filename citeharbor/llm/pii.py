"""Personal data by weak supervision: patterns, word lists and context vote on candidate spans.

All of it is built-in functions. Candidates are found with broad patterns, one scan of the text for
each kind. Four labelers vote on each: the strict pattern of its kind, a word list (domain endings,
issuer digits, dialling codes), the words before it, and its shape. Expectation maximisation over the
counts of vote patterns estimates how reliable each labeler is; its posteriors then train the final
classifier of spans, a naive Bayes model over the votes and the look of the span, which decides.
Spans that the strict patterns find are always kept.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeharbor.sources.stages import cut

# The strict patterns. They are written so that no repeated group can exhaust the
# stack and no run of characters is read twice; what they match, leftmost first and without
# overlap, is the same as with the short forms in the comments.
MAIL_CHARS, HOST_CHARS = r"A-Za-z0-9._%+-", r"A-Za-z0-9-"
STRICT = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:\G|(?<![{MAIL_CHARS}]))[{MAIL_CHARS}]++@(?=[{HOST_CHARS}]++\.[{HOST_CHARS}])"
             rf"[{HOST_CHARS}.]*?(?<!\.)(?!\.?[{HOST_CHARS}])",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ with 12 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(STRICT)
# Further candidates of the same kinds and of secrets; broad on purpose, the votes decide.
BROAD = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[\[(] ?at ?[\])] ?)[A-Za-z0-9-]{1,63}"
             r"(?: ?[\[(] ?dot ?[\])] ?|\.)[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\x20-]?[0-9])",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z_]{2,24}\x20?[=:]\x20?[\x22']?[0-9a-fA-F]{12,128}(?![0-9A-Za-z])",
}
# A cheap test that a text can hold the pattern at all.
GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
BROAD_GATES = {
    "email": lambda t: t.rlike(r"[\[(] ?at ?[\])]"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
    "card": lambda t: t.rlike(r"[0-9]{4}[\x20-][0-9]{4}[\x20-]"),
    "secret": lambda t: t.rlike(r"[=:]\x20?[\x22']?[0-9a-fA-F]{12}"),
}
# Word lists. Domain endings, first digits of card issuers, dialling codes, names of secrets.
ENDINGS = "com org net edu gov int info biz io de fr es it nl uk ch at eu us ca au jp cn in br ru"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
CODES = r"^\+?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
SECRETS = r"(?i)^(?:token|password|passwd|pwd|secret|api_?key|auth|key)"
# Words that announce a kind of span, in the languages of the texts.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|kontakt|correo|courriel|write|reach)\W*\w*\W*$",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|login|from)\W*\w*\W*$",
    "card": r"(?i)\b(?:card|karte|carte|tarjeta|visa|credit|payment|number)\W*\w*\W*$",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|telefon|telefono|téléphone|number)\W*\w*\W*$",
    "secret": r"(?i)\b(?:set|use|login|config|env|export)\W*\w*\W*$",
}
NEAR = 40  # code points before a span that count as its context
VOTES = ("pattern", "words", "context", "shape")
ROUNDS = 25
PRIOR = {"email": 0.5, "ip": 0.5, "card": 0.5, "phone": 0.5, "secret": 0.5}
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,value:string,before:string>>"


def _placed(text: Column, pattern: str) -> Column:
    """Matches with their bounds in code points, from the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(found, between, lambda value, gap: F.struct(value.alias("value"), F.length(gap).alias("gap")))
    steps = F.filter(steps, lambda x: x["value"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans"))

    def add(state, step):
        begin = state["at"] + step["gap"]
        end = begin + F.length(step["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), step["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(state["spans"], span).alias("spans"))

    return F.aggregate(steps, start, add, lambda state: state["spans"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str, gate, base: bool) -> Column:
    found = _placed(text, pattern)
    if base:
        found = F.filter(found, lambda s: _passes(kind, s["value"]))
    full = F.transform(found, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"),
        s["value"].alias("value"),
        F.substring(text, F.greatest(s["start"] - NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR))).alias("before")))
    return F.when(gate(text), full).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``: strict matches, and broad ones that overlap none of their kind."""
    text = F.col("text")
    narrow = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = narrow.select(
        "doc_id", F.concat(*[_spans(text, k, p, GATES[k], True) for k, p in STRICT.items()]).alias("strict"),
        F.concat(*[_spans(text, k, p, BROAD_GATES[k], False) for k, p in BROAD.items()]).alias("broad"))
    apart = F.filter("broad", lambda b: ~F.exists("strict", lambda s: (
        (s["kind"] == b["kind"]) & (s["start"] < b["end"]) & (b["start"] < s["end"]))))
    return found.select("doc_id", F.when(F.size("broad") > 0, F.concat("strict", apart)).otherwise(
        F.col("strict")).alias("spans"))


def _by_kind(span: Column, of: dict[str, Column]) -> Column:
    return reduce(lambda rest, kv: F.when(span["kind"] == kv[0], kv[1]).otherwise(rest), of.items(), F.lit(0))


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for, -1 against, 0 abstains; without ``no`` the labeler abstains where it is not for."""
    return F.when(yes, 1).when(no, -1).otherwise(0) if no is not None else F.when(yes, 1).otherwise(0)


def votes(span: Column) -> Column:
    """The labelers' votes on a span, in the order of ``VOTES``."""
    value, before = span["value"], span["before"]
    number = digits(value)
    ending = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1))
    known = ending.isin(*ENDINGS.split())
    words = _by_kind(span, {
        "email": _vote(known, ~known),
        "ip": _vote(~value.rlike(r"^(?:0|127|255)\."), value.rlike(r"^(?:0|127|255)\.")),
        "card": _vote(number.rlike(ISSUERS), ~number.rlike(ISSUERS)),
        "phone": _vote(value.rlike(CODES), ~value.rlike(CODES) & value.rlike(r"^\+")),
        "secret": _vote(value.rlike(SECRETS), ~value.rlike(SECRETS))})
    context = F.element_at(F.array(*[_vote(before.rlike(CONTEXT[k])) for k in CONTEXT]),
                           _by_kind(span, {k: F.lit(i + 1) for i, k in enumerate(CONTEXT)}))
    shape = _by_kind(span, {
        "email": _vote(F.length(value).between(6, 80), F.length(value) > 200),
        "ip": _vote(~before.rlike(r"(?i)(?:v|version|section|§)\s*$"), before.rlike(r"(?i)(?:v|version|section|§)\s*$")),
        "card": _vote(luhn(number), ~luhn(number)),
        "phone": _vote(F.length(number).between(10, 13), F.length(number) < 10),
        "secret": _vote(F.length(F.regexp_extract(value, r"([0-9a-fA-F]+)$", 1)) >= 14, F.lit(False))})
    return F.array(_vote(span["base"]), words, context, shape)


def look(span: Column) -> Column:
    """Discrete looks of a span: length, share of digits, what precedes and how it begins."""
    value, size = span["value"], F.length(span["value"])
    return F.array(
        F.least(F.length(F.bin(size)), F.lit(8)),
        (4 * F.length(digits(value)) / F.greatest(size, F.lit(1))).cast("int"),
        F.when(span["before"] == "", 0).when(span["before"].rlike(r"\s$"), 1).otherwise(2),
        F.when(value.rlike("^[0-9]"), 0).when(value.rlike("^[A-Za-z]"), 1).otherwise(2))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], prior: float, rounds: int = ROUNDS):
    """Expectation maximisation over vote patterns and their counts.

    Labelers that vote are right or wrong independently given the truth; an abstention tells nothing.
    Starts from labelers that are right four times in five. Returns the share of true spans and, by
    truth and labeler, the probabilities of a vote for and against.
    """
    width = len(patterns[0][0]) if patterns else 0
    good = {1: [{1: 0.8, -1: 0.2}] * width, 0: [{1: 0.2, -1: 0.8}] * width}
    share = prior
    for _ in range(rounds):
        mass = {1: 1.0, 0: 1.0}
        told = {1: [{1: 4.0, -1: 1.0} for _ in range(width)], 0: [{1: 1.0, -1: 4.0} for _ in range(width)]}
        for pattern, n in patterns:
            p = posterior(pattern, share, good)
            for y, w in ((1, p * n), (0, (1 - p) * n)):
                mass[y] += w
                for k, vote in enumerate(pattern):
                    if vote:
                        told[y][k][vote] += w
        share = min(max(mass[1] / (mass[1] + mass[0]), 0.02), 0.98)
        good = {y: [{v: c / sum(t.values()) for v, c in t.items()} for t in told[y]] for y in (1, 0)}
    return share, good


def posterior(pattern, share, good) -> float:
    logs = {y: math.log(s) + sum(math.log(good[y][k][v]) for k, v in enumerate(pattern) if v)
            for y, s in ((1, share), (0, 1 - share))}
    return 1 / (1 + math.exp(min(logs[0] - logs[1], 700)))


class SpanModel:
    """The final classifier: log odds of each kind, plus those of each vote and look."""

    def __init__(self, counted: list):
        """``counted``: (kind, votes, look, n) for every combination that occurs."""
        self.odds: dict[str, float] = {}
        self.tables: dict[str, list[dict[int, float]]] = {}
        for kind in sorted({r[0] for r in counted}):
            rows = [(tuple(v), tuple(x), n) for k, v, x, n in counted if k == kind]
            merged: dict[tuple, int] = {}
            for vote, _, n in rows:
                merged[vote] = merged.get(vote, 0) + n
            share, good = reliabilities(sorted(merged.items()), PRIOR[kind])
            width = len(rows[0][0]) + len(rows[0][1])
            mass = [1.0, 1.0]
            seen: list[dict[int, list[float]]] = [{} for _ in range(width)]
            for vote, seems, n in rows:
                p = posterior(vote, share, good)
                for k, value in enumerate((*vote, *seems)):
                    cell = seen[k].setdefault(value, [1.0, 1.0])
                    cell[0] += n * (1 - p)
                    cell[1] += n * p
                mass[0] += n * (1 - p)
                mass[1] += n * p
            self.odds[kind] = math.log(mass[1] / mass[0])
            self.tables[kind] = [
                {v: math.log(c[1] / (mass[1] + len(t))) - math.log(c[0] / (mass[0] + len(t))) for v, c in t.items()}
                for t in seen]

    def accepts(self, span: Column, features: Column) -> Column:
        """Whether the log odds of a span are positive; kinds that never occurred are refused."""
        total = F.lit(-1.0)
        for kind, tables in self.tables.items():
            score = F.lit(self.odds[kind])
            for k, table in enumerate(tables):
                cell = reduce(lambda rest, kv: F.when(features[k] == kv[0], F.lit(kv[1])).otherwise(rest),
                              table.items(), F.lit(0.0))
                score = score + cell
            total = F.when(span["kind"] == kind, score).otherwise(total)
        return total > 0


def _features(span: Column) -> Column:
    return F.concat(votes(span), look(span))


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` for each row of ``docs`` (doc_id, text).

    Both are arrays of (start, rank of the kind, kind, end), in order; ``base`` holds the spans of the
    strict patterns, ``spans`` these and what the classifier adds. Bounds are code points, ends
    exclusive. A NULL text is empty and has none. Rows are judged one by one, so repeated ids or texts
    do not matter; other columns are ignored. Reliabilities come from the candidates of all rows.
    """
    found = cut(candidates(docs).select("doc_id", F.transform("spans", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"),
        _features(s).alias("features"))).alias("spans")))
    # As many rows as combinations of kind, votes and looks: at most 5 * 3^4 * 9 * 5 * 3 * 3.
    combos = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.features").agg(
        F.count(F.lit(1)).alias("n")).collect()
    width = len(VOTES)
    model = SpanModel([(r["kind"], r["features"][:width], r["features"][width:], r["n"]) for r in combos])
    kept = F.filter("spans", lambda s: s["base"] | model.accepts(s, s["features"]))
    order = {k: i for i, k in enumerate((*KINDS, "secret"))}

    def listed(spans):
        return F.array_sort(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), _by_kind(s, {k: F.lit(i) for k, i in order.items()}).alias("rank"),
            s["kind"].alias("kind"), s["end"].alias("end"))))

    return found.select("doc_id", listed(F.filter("spans", lambda s: s["base"])).alias("base"),
                        listed(kept).alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end, by start and then kind, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the strict spans by kind, their digest, and all spans as text."""
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
