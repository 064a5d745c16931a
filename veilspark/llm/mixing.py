"""Mixing sources to target weights, by soft membership. DataFrame functions only.

A naive Bayes classifier over the whole vocabulary, fitted on a labelled table,
gives every document a posterior over domains. Words are hashed to ``BUCKETS``
features, a bound at any vocabulary. A word's weight is the logarithm of how
much more often a domain's documents have it than all documents, shrunk by how
sure that is (``CHANCE`` times what chance would give counts for nothing). The
sums over a document's distinct words, over its style and its length go through
a logistic regression for each domain, fitted by Newton steps (one distributed
aggregate each) on the labelled documents, each scored without its own counts,
so that the posteriors fit labels that were left out.

Then nonnegative rates (expected copies of a document) are fitted so that the
expected tokens of each domain, ``A_k = sum(rate * tokens * P(k))``, come closest
to the targets in scaled least squares: projected gradient steps
``rate <- max(0, rate - step * sum_k P(k) (A_k - T_k) / S_k)``, with S_k the
domain's tokens at rate 1. There are far more documents than domains, so that
many rates meet the targets; the steps start from 1 copy of each document, and
so end at rates near that. Each step is one distributed aggregate. Documents
with equal posteriors have equal rates through all steps, so the aggregate runs
over tokens summed per posterior (rounded to 1/1000: a number of rows that does
not grow with the corpus). The rate of a document is the same fold over the
steps' residuals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import Scratch

MAX_DOCS = 20_000
#: Features; the weights of all, which go to the workers, are at most that many rows of a few numbers.
BUCKETS = 1 << 18
#: Documents of a domain that have a word as often as all documents do, added to those seen.
PSEUDO_DOCS = 4.0
#: Squared deviations from chance, in variances, that a weight has to exceed.
CHANCE = 8.0
#: Bound of the sums of weights, Newton steps, and penalty of the regression.
MOST, NEWTON, PENALTY = 12.0, 8, 1.0
STEPS, STEP = 40, 1.5


def _words(text: Column) -> Column:
    """Words of letters, lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), "")


def _styles(words: Column, text: Column) -> Column:
    """Pseudo-words for the share of noise, and of distinct words by length."""
    n = F.size(words) + 1
    noise = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[A-Z][A-Z]|[!#$%&*|]"))
    dirt = F.least(F.floor(F.lit(4) * noise / n), F.lit(4)).cast("string")
    rich = F.floor(F.lit(5) * F.size(F.array_distinct(words)) / n).cast("string")
    long_ = F.least(F.floor(F.log2(n)), F.lit(8)).cast("string")
    return F.array(F.concat(F.lit("#noise"), dirt), F.concat(F.lit("#rich"), rich, F.lit("/"), long_))


def _features(df: DataFrame, keep: list[Column]) -> DataFrame:
    """One row for each distinct word or style of a text ``__x``, as ``__b``, with the columns ``keep``."""
    full = df.withColumn("__w", _words(F.col("__x")))
    words = F.explode(F.array_distinct(F.concat("__w", _styles(F.col("__w"), F.col("__x"))))).alias("__word")
    rows = full.select(*keep, F.size("__w").cast("long").alias("__tokens"), words)
    return rows.withColumns({"__b": F.pmod(F.xxhash64("__word"), F.lit(BUCKETS)).cast("int"), "__style": F.col("__word").startswith("#")}).drop("__word")


def _weight(n_word_domain: Column, n_word: Column, n_domain: Column, n_all: Column) -> Column:
    """Shrunk log of a word's share in a domain over its share in all documents."""
    share = n_word / n_all
    lift = F.log((n_word_domain + F.lit(PSEUDO_DOCS) * share) / (n_domain + PSEUDO_DOCS) / share)
    expected = share * n_domain
    deviation = (n_word_domain - expected) * (n_word_domain - expected) / (expected * (1 - n_domain / n_all) + 0.5)
    return F.when((n_word > 0) & (deviation > CHANCE), lift * (1 - F.lit(CHANCE) / deviation)).otherwise(0.0)


def _sums(weights: list[Column]) -> list[Column]:
    """Aggregates of a document's weights by domain, of words and of styles."""
    part = lambda w, style: F.sum(F.when(F.col("__style") == style, w).otherwise(0.0))
    return [part(w, style).alias(f"{name}{j}") for name, style in (("word", False), ("style", True)) for j, w in enumerate(weights)]


def _inputs(k: int) -> list[Column]:
    """What the regressions see of a document: 1, its length, and its bounded sums against the first domain's."""
    bounded = lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c))
    against = [bounded(F.col(f"{name}{j}") - F.col(f"{name}0")) for name in ("word", "style") for j in range(1, k)]
    return [F.lit(1.0), F.log2(F.col("__tokens") + 1.0) / 10, *against]


def _likely(inputs: Column, factors: list[float]) -> Column:
    """Logistic function of the product of an array of inputs and the factors, which stay one literal in every step's plan."""
    products = F.zip_with(inputs, F.array(*[F.lit(float(f)) for f in factors]), lambda x, f: x * f)
    return 1 / (1 + F.exp(-F.aggregate(products, F.lit(0.0), lambda total, x: total + x)))


@dataclass
class DomainModel:
    domains: list[str]
    weights: DataFrame | None  # __b, w0, w1, ...: words with a weight
    factors: list[list[float]]  # of the regression of each domain

    def posteriors(self, df: DataFrame) -> DataFrame:
        """(__i, __tokens, __p) for each row (__i, __x); __p is the array of P(domain) rounded to 1/1000."""
        k = len(self.domains)
        if self.weights is None:
            return df.select("__i", F.size(_words(F.col("__x"))).cast("long").alias("__tokens"), F.array(*[F.lit(round(1 / k, 3))] * k).cast("array<double>").alias("__p"))
        rows = _features(df.withColumn("__row", F.monotonically_increasing_id()), [F.col("__row"), F.col("__i")])
        found = rows.join(F.broadcast(self.weights), "__b", "left")
        scored = found.groupBy("__row", "__i", "__tokens").agg(*_sums([F.coalesce(f"w{j}", F.lit(0.0)) for j in range(k)]))
        seen = scored.select("__i", "__tokens", F.array(*_inputs(k)).alias("__x"))
        odds = seen.select("__i", "__tokens", *[_likely(F.col("__x"), f).alias(f"__o{j}") for j, f in enumerate(self.factors)])
        total = sum((F.col(f"__o{j}") for j in range(k)), F.lit(1e-12))
        return odds.select("__i", "__tokens", F.array(*[F.round(F.col(f"__o{j}") / total, 3) for j in range(k)]).alias("__p"))


def _regressions(seen: DataFrame, domains: list[str]) -> list[list[float]]:
    """Factors of each domain's penalised logistic regression on ``seen`` (__k and the array of inputs __x), by Newton steps."""
    n = 2 * len(domains)
    pairs = [(a, b) for a in range(n) for b in range(a + 1)]
    factors = np.zeros((len(domains), n))
    penalty = np.diag([1e-3] + [PENALTY] * (n - 1))
    rows = seen.select(*[(F.col("__k") == k).cast("double").alias(f"y{j}") for j, k in enumerate(domains)], "__x", *[F.col("__x")[a].alias(f"x{a}") for a in range(n)])
    for _ in range(NEWTON):
        likely = rows.withColumns({f"p{j}": _likely(F.col("__x"), list(factors[j])) for j in range(len(domains))})
        aggregates = []
        for j in range(len(domains)):
            aggregates += [F.sum(F.expr(f"(y{j} - p{j}) * x{a}")) for a in range(n)] + [F.sum(F.expr(f"p{j} * (1 - p{j}) * x{a} * x{b}")) for a, b in pairs]
        values = np.array(likely.agg(*[c.alias(f"v{i}") for i, c in enumerate(aggregates)]).first(), float).reshape(len(domains), -1)
        moved = 0.0
        for j in range(len(domains)):
            hessian = np.zeros((n, n))
            for (a, b), v in zip(pairs, values[j, n:], strict=True):
                hessian[a, b] = hessian[b, a] = v
            step = np.linalg.solve(hessian + penalty, values[j, :n] - penalty @ factors[j])
            step *= min(1.0, 4.0 / max(float(np.abs(step).max()), 1e-9))
            factors[j] += step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-4:
            break
    return factors.tolist()


def fit_domains(
    docs: DataFrame, labelled: DataFrame, domain_col: str, names: list[str], scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", *, max_docs: int = MAX_DOCS
) -> DomainModel:
    """Classifier from at most ``max_docs`` labelled documents, those with the smallest hash of the id.

    ``labelled`` has the id and a domain name; rows with a null in either are
    ignored, and of several labels the smallest name holds. Without any the
    domains are ``names``, all equally likely for every document.
    """
    sample = labelled.where(F.col(id_col).isNotNull() & F.col(domain_col).isNotNull()).groupBy(F.col(id_col).alias("__i")).agg(F.min(domain_col).alias("__k"))
    sample = sample.orderBy(F.xxhash64("__i"), "__i").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("__i"), F.col(text_col).cast("string").alias("__x"))
    chosen = texts.join(F.broadcast(sample), "__i").withColumn("__row", F.monotonically_increasing_id())
    rows = scratch.save(_features(chosen, [F.col("__row"), F.col("__k")]), "sample")
    totals = {r["__k"]: r["n"] for r in rows.groupBy("__k").agg(F.count_distinct("__row").alias("n")).collect()}
    domains = sorted(totals)
    if not domains:
        return DomainModel(list(names), None, [])
    n_all = F.lit(float(sum(totals.values())))
    counts = rows.groupBy("__b").agg(F.count("*").cast("double").alias("n"), *[F.sum((F.col("__k") == k).cast("double")).alias(f"n{j}") for j, k in enumerate(domains)])
    counts = scratch.save(counts.coalesce(8), "counts")
    weights = counts.select("__b", *[_weight(F.col(f"n{j}"), F.col("n"), F.lit(float(totals[k])), n_all).alias(f"w{j}") for j, k in enumerate(domains)])
    weights = weights.where(" OR ".join(f"w{j} <> 0" for j in range(len(domains))))
    # each labelled document without its own counts
    own = [(F.col("__k") == k).cast("double") for k in domains]
    left_out = [_weight(F.col(f"n{j}") - own[j], F.col("n") - 1, F.lit(float(totals[k])) - own[j], n_all - 1) for j, k in enumerate(domains)]
    scored = rows.join(counts, "__b").groupBy("__row", "__k", "__tokens").agg(*_sums(left_out))
    seen = scratch.save(scored.select("__k", F.array(*_inputs(len(domains))).alias("__x")).coalesce(4), "left-out")
    return DomainModel(domains, weights, _regressions(seen, domains))


def _rate(posterior: str, residuals: list[list[float]]) -> Column:
    """Rate of a document after the steps with these scaled residuals."""
    if not residuals:
        return F.lit(1.0)
    history = ", ".join(f"array({', '.join(f'{x!r}D' for x in e)})" for e in residuals)
    push = " + ".join(f"{posterior}[{k}] * e[{k}]" for k in range(len(residuals[0])))
    return F.expr(f"aggregate(array({history}), 1.0D, (rate, e) -> greatest(0.0D, rate - {STEP}D * ({push})))")


@dataclass
class Mixture:
    domains: list[str]
    targets: list[float]  # tokens
    achieved: list[float]
    residuals: list[list[float]]


def fit_rates(scored: DataFrame, domains: list[str], weights: dict[str, float], *, steps: int = STEPS) -> Mixture:
    """Residual history of the projected gradient for ``scored`` (__tokens, __p).

    ``weights`` are the shares of the mixture; domains without one get 0. The
    mixture is as large as the domain with the largest weight can fill at rate 1.
    """
    sums = lambda rate: [F.sum(F.col("__tokens") * rate * F.col("__p")[k]).alias(f"a{k}") for k in range(len(domains))]
    base = [float(x or 0) for x in scored.agg(*sums(F.lit(1.0))).first()]
    total_weight = sum(weights.get(k, 0.0) for k in domains)
    if not total_weight or not sum(base):
        return Mixture(domains, base, base, [])
    share = [weights.get(k, 0.0) / total_weight for k in domains]
    lead = max(range(len(domains)), key=lambda k: share[k])
    targets = [s / share[lead] * base[lead] for s in share]
    residuals, achieved, before = [], base, math.inf
    for _ in range(steps):
        gaps = [(a - t) / max(b, 1e-9) for a, t, b in zip(achieved, targets, base, strict=True)]
        loss = sum(e * e * b for e, b in zip(gaps, base, strict=True)) / sum(base)
        if loss < 1e-8 or before - loss < 1e-4 * loss:
            break
        before = loss
        residuals.append(gaps)
        rate = _rate("__p", residuals)
        achieved = [float(x or 0) for x in scored.agg(*sums(rate)).first()]
    return Mixture(domains, targets, achieved, residuals)


def mix_with_report(
    docs: DataFrame, labelled: DataFrame, domain_col: str, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", *, max_docs: int = MAX_DOCS
) -> tuple[DataFrame, Mixture]:
    """As ``mix``, with the target and the expected achieved tokens of each domain."""
    scratch = Scratch(docs.sparkSession, "mixing")
    model = fit_domains(docs, labelled, domain_col, sorted(weights), scratch, id_col, text_col, max_docs=max_docs)
    base = docs.select(F.col(id_col).alias("__i"), F.col(text_col).cast("string").alias("__x"))
    scored = scratch.save(model.posteriors(base), "posteriors")
    cells = scratch.save(scored.groupBy("__p").agg(F.sum("__tokens").cast("double").alias("__tokens")).coalesce(8), "cells")
    # without labels nothing is known that rates could change
    mixture = fit_rates(cells, model.domains, weights, steps=STEPS if model.weights is not None else 0)
    luck = F.pmod(F.xxhash64("__i", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = scored.withColumn("__rate", _rate("__p", mixture.residuals)).select(
        F.col("__i").alias(id_col),
        F.col("__tokens").alias("n_tokens"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in model.domains]).cast("array<string>"), "__p").alias("posterior"),
        F.col("__rate").alias("rate"),
        F.floor(F.col("__rate") + luck).alias("copies"),
    )
    return out, mixture


def mix(
    docs: DataFrame, labelled: DataFrame, domain_col: str, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", *, max_docs: int = MAX_DOCS
) -> DataFrame:
    """Rows (id, n_tokens, posterior, rate, copies) for every row of ``docs``.

    posterior maps domains to P(domain); copies is the rate rounded up or down
    by a hash of the id, so that its mean is the rate. Null and empty texts have
    0 tokens and get the rate of their posterior. Repeated rows are rows of
    their own; other columns are ignored, whatever their names. Without labels
    every document has equal posteriors and the rate 1; an empty table of
    documents gives an empty result.
    """
    return mix_with_report(docs, labelled, domain_col, weights, id_col, text_col, max_docs=max_docs)[0]
