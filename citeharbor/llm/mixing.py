"""Mixing to target weights with soft domains, in DataFrame operations only.

A classifier learned from a labelled table gives each document a posterior over domains: naive
Bayes over a few discrete properties of the text, among them how much its words speak for each domain
(log ratios of hashed words, learned from the same table in two halves, so that no labelled document is
judged by its own words). Rates (how often each document is used) are then
fitted by least squares, so that the expected tokens of each domain, rate times tokens times posterior
summed over all documents, meet the targets: projected gradient steps move the rates themselves and
set negative ones to zero, until the projected gradient vanishes. Documents with the same properties
have the same posterior and the same rate; the steps therefore run over one row for each combination
of properties, with the tokens of all its documents. Each property has a fixed number of values, so
the classifier and the steps are small arrays. A rate follows from the list of steps and the posterior
of its row, without a join.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeharbor.sources.stages import cut

STEPS = 500  # more is an error; ten to fifty are usual
SETTLED = 1e-6  # length of the projected gradient at which the fit ends
DAMPING = (1e-9, 1e-4, 1e-2, 1e-1)  # share of plain gradient in the directions of a step
LENGTHS = (4.0, 2.0, 1.0, 0.5, 2.0 ** -4, 2.0 ** -9)  # step lengths tried in each direction
MAX_DOMAINS = 256
DRAW = 1 << 20
BUCKETS = 1 << 13  # of hashed words
LEVELS = 16  # of what the words say for a domain
#: Properties of a text and how many values each has.
PROPERTIES = {"lang": 256, "size": 32, "wide": 12, "marks": 12, "digits": 12, "shouts": 12, "lines": 9}


def _level(part: Column, whole: Column) -> Column:
    """0 for none, else one more than the number of binary digits of parts per thousand."""
    share = (F.lit(1000) * part / F.greatest(whole, F.lit(1))).cast("long")
    return F.when(part == 0, F.lit(0)).otherwise(F.length(F.bin(share)) + 1)


def properties(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_tokens`` (words), ``draw`` (0 to 1, by hash), ``cells``, its properties, and
    ``buckets``, the hashes of its lower-case words, each once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    length = F.length(text)
    listed = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    words = F.size(listed)
    buckets = F.array_distinct(F.transform(
        listed, lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(BUCKETS)).cast("int")))
    values = {
        "lang": F.pmod(F.hash(F.col("lang").cast("string")), F.lit(PROPERTIES["lang"])),
        "size": F.length(F.bin(words)),
        "wide": _level(F.octet_length(text) - length, length),
        "marks": _level(F.regexp_count(text, F.lit(r"[#*$%&|<>{}=]")), length),
        "digits": _level(F.regexp_count(text, F.lit("[0-9]")), length),
        "shouts": _level(F.regexp_count(text, F.lit("[A-Z]{4}|!!")), length),
        "lines": F.length(F.bin(F.size(F.split(text, "\n")))),
    }
    cells = F.array(*[F.least(v.cast("int"), F.lit(PROPERTIES[k] - 1)) for k, v in values.items()])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), text), F.lit(DRAW)) / float(DRAW)
    return docs.withColumns({"n_tokens": words.cast("long"), "draw": draw, "cells": cells, "buckets": buckets})


def constant(values: list) -> Column:
    """A list of numbers, or of such lists, as a literal that is folded once; a literal for each number
    takes long to plan."""
    if isinstance(values[0], list):
        return F.array(*[constant(x) for x in values])
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


class Words:
    """Log ratios of hashed words for each domain against the others, from both halves of the labelled rows.

    ``marked`` has ``buckets``, ``domain`` and ``half`` (0 or 1). At most as many counts as buckets,
    domains and halves come back. Counts are smoothed by one.
    """

    def __init__(self, marked: DataFrame, domains: list):
        at = {d: k for k, d in enumerate(domains)}
        sizes, counts = np.zeros((2, len(domains))), np.zeros((2, len(domains), BUCKETS))
        for r in marked.groupBy("domain", "half").agg(F.count(F.lit(1)).alias("n")).collect():
            sizes[r["half"], at[r["domain"]]] = r["n"]
        each = marked.select("domain", "half", F.explode("buckets").alias("bucket")).groupBy(
            "domain", "half", "bucket").agg(F.count(F.lit(1)).alias("n"))
        listed = F.array_join(F.collect_list(F.concat_ws(" ", "bucket", "n")), " ")
        for r in each.groupBy("domain", "half").agg(listed.alias("pairs")).collect():
            pairs = np.array(r["pairs"].split(), dtype=np.int64)
            counts[r["half"], at[r["domain"]], pairs[::2]] = pairs[1::2]
        self.whole = self._ratios(sizes.sum(axis=0), counts.sum(axis=0))
        self.other = [self._ratios(sizes[1 - h], counts[1 - h]) for h in (0, 1)]

    @staticmethod
    def _ratios(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        rest, seen = sizes.sum() - sizes, counts.sum(axis=0) - counts
        return np.log((counts + 1) / (sizes[:, None] + 2)) - np.log((seen + 1) / (rest[:, None] + 2))

    @staticmethod
    def _levels(ratios: np.ndarray) -> Column:
        levels = []
        for table in map(constant, np.round(ratios, 2).tolist()):
            score = F.aggregate("buckets", F.lit(0.0), lambda acc, b: acc + F.get(table, b))
            size = F.least(F.floor(F.log2(F.lit(1.0) + F.abs(score))), F.lit(LEVELS // 2 - 1))
            levels.append((F.lit(LEVELS // 2) + F.signum(score) * size).cast("int"))
        return F.array(*levels)

    def cells(self) -> Column:
        """``cells`` with a level for each domain behind, from ``cells`` and ``buckets``."""
        return F.concat("cells", self._levels(self.whole))

    def cells_of_halves(self) -> Column:
        """The same for labelled rows, each by what the other half has learned."""
        one, two = (self._levels(r) for r in self.other)
        return F.concat("cells", F.when(F.col("half") == 0, one).otherwise(two))


class Classifier:
    """Log priors and, for each property and value, log likelihoods of the domains."""

    def __init__(self, marked: DataFrame, sizes: dict):
        """``marked`` has ``cells`` and ``domain``; ``sizes`` its rows by domain. Counts are smoothed by one."""
        self.domains, n = list(sizes), list(sizes.values())
        at = {d: k for k, d in enumerate(self.domains)}
        self.priors = [math.log(m / sum(n)) for m in n]
        widths = [*PROPERTIES.values(), *[LEVELS] * len(n)]
        self.logs = [[[math.log(1 / (m + w)) for m in n] for _ in range(w)] for w in widths]
        # At most as many rows as the properties have values, for each domain.
        counts = marked.select("domain", F.posexplode("cells").alias("property", "value")).groupBy(
            "domain", "property", "value").agg(F.count(F.lit(1)).alias("n")).collect()
        for r in counts:
            k = at[r["domain"]]
            self.logs[r["property"]][r["value"]][k] = math.log((r["n"] + 1) / (n[k] + widths[r["property"]]))

    def scores(self) -> Column:
        """Log probabilities of the domains but for a constant, from the column ``cells``."""
        parts = [F.lit(self.priors)]
        for k, table in enumerate(self.logs):
            parts.append(F.element_at(constant(table), F.col("cells")[k] + 1))
        logs = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)
        return logs


def softmax(logs: str) -> Column:
    raw = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    whole = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / whole)


def _dot(a: Column, b: Column, k: int) -> Column:
    return reduce(lambda x, y: x + y, [F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(k)])


def _moved(rate: Column, slope: Column, move: Column, floor: float) -> Column:
    """A rate after a step: it stays at ``floor`` where the gradient presses it there."""
    low = F.lit(float(floor))
    return F.when((rate <= low) & (slope > 0), low).otherwise(F.greatest(low, rate + move))


class Rates:
    """Rates as the projected steps taken so far, all from rate 1 (or the floor, if that is higher).

    A step is a pair of vectors over the domains: with the posterior of a row they give the gradient
    of its rate and how far the rate moves.
    """

    def __init__(self, floor: float, steps=()):
        self.floor, self.steps = float(floor), list(steps)

    def column(self) -> Column:
        start = F.lit(max(1.0, self.floor))
        if not self.steps:
            return start
        slopes, moves = (constant([x.tolist() for x in part]) for part in zip(*self.steps))
        taken = F.zip_with(slopes, moves, lambda g, v: F.struct(g.alias("slope"), v.alias("move")))
        k = len(self.steps[0][0])
        return F.aggregate(taken, start, lambda r, x: _moved(
            r, _dot(F.col("posterior"), x["slope"], k), _dot(F.col("posterior"), x["move"], k), self.floor))


def _totals(soft: DataFrame, rate: Column, k: int) -> list[float]:
    use = soft.select((rate * F.col("tokens")).alias("use"), "posterior")
    row = use.agg(*[F.sum(F.col("use") * F.col("posterior")[i]) for i in range(k)]).first()
    return [float(x or 0.0) for x in row]


def _state(soft: DataFrame, rates: Rates, slope: np.ndarray) -> tuple[float, np.ndarray]:
    """Squared length of the projected gradient over tokens, and the products of the posteriors of
    the rows whose rate can move, summed over their tokens."""
    k, low = len(slope), F.lit(rates.floor)
    row = soft.select(F.col("tokens").cast("double").alias("n"), "posterior", rates.column().alias("r"),
                      _dot(F.col("posterior"), constant(slope.tolist()), k).alias("g"))
    far = F.col("r") - F.greatest(low, F.col("r") - F.col("g"))
    free = F.when((F.col("r") <= low) & (F.col("g") > 0), F.lit(0.0)).otherwise(F.col("n"))
    parts = F.concat(F.array(F.col("n") * far * far), F.flatten(F.transform("posterior", lambda a: F.transform(
        "posterior", lambda b: a * b * free))))
    sums = row.select(F.posexplode(parts).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(1 + k * k)
    for r in sums:
        out[r["at"]] = r["x"] or 0.0
    return float(out[0]), out[1:].reshape(k, k)


def _tried(soft: DataFrame, rates: Rates, slope: np.ndarray, moves: list[np.ndarray]) -> np.ndarray:
    """Totals of the domains after each of some steps, all in one pass."""
    k = len(slope)
    row = soft.select(F.col("tokens").cast("double").alias("n"), "posterior", rates.column().alias("r"),
                      _dot(F.col("posterior"), constant(slope.tolist()), k).alias("g"))
    each = row.select("n", "posterior", "r", "g", F.posexplode(constant([m.tolist() for m in moves])).alias(
        "at", "move"))
    use = F.col("n") * _moved(F.col("r"), F.col("g"), _dot(F.col("posterior"), F.col("move"), k), rates.floor)
    sums = each.select("at", use.alias("use"), "posterior").groupBy("at").agg(
        *[F.sum(F.col("use") * F.col("posterior")[i]) for i in range(k)]).collect()
    out = np.zeros((len(moves), k))
    for r in sums:
        out[r["at"]] = r[1:]
    return out


def fit_rates(soft: DataFrame, targets: list[float], floor: float = 0.0, steps: int = STEPS) -> Column:
    """Rate expression over ``soft`` (``posterior``, ``tokens``) whose domain totals meet ``targets``.

    Least squares over rates of at least ``floor``, each domain's residual weighed by its tokens at
    rate 1. Every step goes along the gradient, conditioned by the products of the posteriors of the
    rows that can move, and is projected; rates that the gradient presses to the floor stay there.
    Several dampings and lengths are tried in one pass and the lowest point is taken, so the squares
    always fall. Raises RuntimeError if the projected gradient does not vanish.
    """
    k = len(targets)
    whole = max(float(soft.agg(F.sum("tokens")).first()[0] or 0.0), 1.0)
    base = np.array(_totals(soft, F.lit(1.0), k)) / whole
    live = base > 1e-12
    rates = Rates(floor)
    if not live.any():
        return rates.column()
    want, root = np.array(targets, dtype=float)[live] / whole, np.sqrt(base[live])

    def spread(x: np.ndarray) -> np.ndarray:
        out = np.zeros(k)
        out[live] = x / root
        return out

    apart = (np.array(_totals(soft, rates.column(), k))[live] / whole - want) / root
    for _ in range(steps):
        slope = spread(apart)
        far, products = _state(soft, rates, slope)
        if math.sqrt(far / whole) <= SETTLED:
            return rates.column()
        bend = products[np.ix_(live, live)] / whole / np.outer(root, root)
        size = max(float(np.trace(bend)), 1e-300) / len(root)
        ways = [-np.linalg.solve(bend + d * size * np.eye(len(root)), apart) for d in DAMPING]
        moves = [spread(a * w) for w in ways for a in LENGTHS]
        found = (_tried(soft, rates, slope, moves)[:, live] / whole - want) / root
        squares = (found ** 2).sum(axis=1)
        best = int(np.argmin(squares))
        if not squares[best] < (apart ** 2).sum():
            raise RuntimeError("the rates did not settle: no step goes down")
        rates.steps.append((slope, moves[best]))
        apart = found[best]
    raise RuntimeError(f"the rates did not settle in {steps} steps")


def effective_share(rows: DataFrame) -> float:
    """How evenly the tokens (``n_tokens``) are used (``rate``): 1 if all are used alike, 1/n if one of n is."""
    row = rows.agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("rate")),
                   F.sum(F.col("n_tokens") * F.col("rate") * F.col("rate"))).first()
    return float(row[1] ** 2 / (row[0] * row[2])) if row[0] and row[2] else 0.0


def _with_posterior(rows: DataFrame, model: Classifier) -> DataFrame:
    scored = rows.withColumn("scores", model.scores())
    return scored.withColumn("posterior", softmax("scores")).drop("scores")


class Mix:
    """A fitted mix: give it documents and it adds their rates. See :func:`fit`."""

    def __init__(self, words: Words | None = None, model: Classifier | None = None):
        self.words, self.model, self.rate = words, model, F.lit(1.0)

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows of :func:`properties` with all cells and without ``buckets``."""
        if self.words is None:
            return rows.drop("buckets")
        return rows.withColumn("cells", self.words.cells()).drop("buckets")

    def apply(self, rows: DataFrame) -> DataFrame:
        """Rows of :meth:`placed`, plus ``posterior`` (map by domain), ``rate``, ``copies``."""
        if self.model is None:
            return rows.withColumns({
                "posterior": F.create_map().cast("map<string,double>"), "rate": F.lit(1.0), "copies": F.lit(1)})
        named = F.map_from_arrays(F.lit(self.model.domains), F.col("posterior"))
        rated = _with_posterior(rows, self.model).withColumn("rate", self.rate).withColumn("posterior", named)
        whole = F.floor("rate")
        return rated.withColumn("copies", (whole + (F.col("draw") < F.col("rate") - whole).cast("int")).cast("int"))


def learn(rows: DataFrame, labelled: DataFrame) -> Mix:
    """The classifier from those ``rows`` of :func:`properties` that ``labelled`` gives a domain; no rates yet."""
    known = labelled.select("doc_id", F.col("domain").cast("string").alias("domain")).dropna().distinct()
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(2)).cast("int")
    # Merged whatever the labels' size: they grow with the documents and are no broadcast.
    marked = cut(rows.select("doc_id", "cells", "buckets").join(known.hint("merge"), "doc_id").select(
        "cells", "buckets", "domain", half.alias("half")))
    sizes = {r["domain"]: r["n"] for r in marked.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(
        "domain").limit(MAX_DOMAINS + 1).collect()}
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    if not sizes:
        return Mix()
    words = Words(marked, list(sizes))
    return Mix(words, Classifier(marked.select(words.cells_of_halves().alias("cells"), "domain"), sizes))


def fit(mix: Mix, narrow: DataFrame, weights: dict[str, float], keep_all: bool = False) -> Mix:
    """``mix`` with the rates of documents (``n_tokens, cells`` of :meth:`Mix.placed`) that meet ``weights``.

    ``weights`` are relative; domains without one get zero. The targets keep the number of tokens;
    with ``keep_all`` no rate falls below 1 and the targets are the least totals in these proportions
    that need no document dropped. Without any labelled document all rates are 1.
    """
    if mix.model is None:
        return mix
    share = [max(float(weights.get(d, 0.0)), 0.0) for d in mix.model.domains]
    if not sum(share):
        raise ValueError("no weight for any labelled domain")
    soft = cut(_with_posterior(narrow.groupBy("cells").agg(F.sum("n_tokens").alias("tokens")), mix.model).select(
        "posterior", "tokens"))
    base = _totals(soft, F.lit(1.0), len(share))
    total = sum(base)
    if keep_all:
        total = max((b * sum(share) / s for b, s in zip(base, share) if s > 0), default=total)
    mix.rate = fit_rates(soft, [total * s / sum(share) for s in share], 1.0 if keep_all else 0.0)
    return mix


def _seen(docs: DataFrame) -> DataFrame:
    """Properties of the texts without the texts, which are read once for them."""
    return cut(properties(docs.select("doc_id", "text", "lang")).drop("text", "lang"))


def judged(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], keep_all: bool = False) -> DataFrame:
    """``doc_id, n_tokens, posterior, rate, copies`` for each row of ``docs`` (doc_id, text, lang).

    ``labelled`` has doc_id and domain (ids with several domains count for each; NULLs count for
    none). ``copies`` is the rate rounded up or down by a hash of doc_id and text, so that its
    expectation is the rate. A NULL or empty text has no tokens. Repeated rows are judged alike.
    Other columns are ignored. See :func:`fit` for the rest.
    """
    rows = _seen(docs)
    mix = learn(rows, labelled)
    narrow = cut(mix.placed(rows))
    return fit(mix, narrow, weights, keep_all).apply(narrow).select(
        "doc_id", "n_tokens", "posterior", "rate", "copies")


def repeated(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], keep_all: bool = True) -> DataFrame:
    """The rows of ``docs``, each as often as its copies, columns unchanged; no text is shuffled."""
    rows = _seen(docs)
    mix = learn(rows, labelled)
    fit(mix, mix.placed(rows), weights, keep_all)
    row = docs.select(F.struct("*").alias("__row"), "doc_id", "text", "lang")
    # Through one-row generators: what follows would else be merged with what they hold, and scan the text
    # or add up its words again for each of its uses.
    found = F.struct("n_tokens", "draw", "cells", "buckets")
    placed = mix.placed(properties(row).select("__row", F.inline(F.array(found))))
    bound = placed.select("__row", F.inline(F.array(F.struct("n_tokens", "draw", "cells"))))
    return mix.apply(bound).filter("copies > 0").select(
        "__row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("__row.*")
