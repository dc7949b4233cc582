"""Mixing sources to target weights by soft membership, in DataFrame operations only.

A naive Bayes classifier, fitted on a labelled table, gives each text a posterior over
domains. What it counts are the characters and pairs of characters that tell most about the
domains of that table, found on a bounded sample of its rows. Every document then gets a nonnegative rate so that the domains'
expected token totals (tokens x rate x posterior, summed) come as close as they can to the
target weights: least squares by projected gradient. A step only needs one sum a domain,
so each iteration is one aggregation, and a document's rate is a fixed expression of its
own posterior and the steps so far; nothing is joined and no row meets another.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cluster

#: Characters and pairs that are counted, and how many characters of each domain are sampled to choose them.
FEATURES, SAMPLE_CHARS = 20, 300_000
#: Of the sample's characters, the share that a counted one makes up at least.
LEAST_SHARE = 2e-4
ROUNDS = 40
TOLERANCE = 1e-4
#: Labelled rows, drawn at random, on which the evidence is chosen.
CALIBRATED_ROWS = 100_000
#: A text's bytes count for its posterior as if it had at most so many: whichever of these
#: gives the labelled rows' own domains the greatest probability, so that posteriors are as soft as they should be.
EVIDENCE = (6.0, 12.0, 25.0, 50.0, 100.0, 200.0, 400.0)


@dataclass
class Mixer:
    marks: list[str]
    domains: list[str]
    prior: list[float]
    weight: list[list[float]]  # by mark (and all other bytes last), by domain: log share
    target: list[float]
    evidence: float = EVIDENCE[-1]
    steps: list[list[float]] = field(default_factory=list)
    totals: list[list[float]] = field(default_factory=list)


def without(text: Column, part: str) -> Column:
    """Bytes of ``text`` that ``part`` takes up; two scans of it, and no array of its letters."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part)))


def choose_marks(labelled: DataFrame, domain: str, n: int = FEATURES) -> list[str]:
    """The ``n`` characters or pairs whose counts say most about ``domain`` (by mutual information), from a sample of about SAMPLE_CHARS a domain.

    One that mostly stands within one that is chosen already adds little and is passed over.
    """
    rows = labelled.where(F.col(domain).isNotNull() & (F.octet_length("text") > 0)).select(F.col(domain).cast("string").alias("d"), "text")
    sizes = {r["d"]: r["n"] for r in rows.groupBy("d").agg(F.sum(F.length("text")).alias("n")).collect()}
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, SAMPLE_CHARS / v))])
    letters = rows.where(F.rand(5) < F.try_element_at(share, F.col("d"))).select("d", F.split("text", "").alias("c"))
    both = letters.select("d", F.explode(F.flatten(F.transform("c", lambda c, i: F.array(c, F.concat(c, F.coalesce(F.get("c", i + 1), F.lit(""))))))).alias("g"))
    names = sorted(sizes)
    counted = both.groupBy("g").agg(*[F.count_if(F.col("d") == d).alias(f"n{i}") for i, d in enumerate(names)], F.count("*").alias("n"))
    totals = letters.groupBy("d").agg(F.sum(F.size("c")).alias("n")).collect()
    per = np.array([next((r["n"] for r in totals if r["d"] == d), 0) for d in names], float) + 1
    found = counted.where((F.col("n") >= LEAST_SHARE * per.sum()) & (F.trim("g") == F.col("g")) & (F.length("g") > 0)).orderBy("g").collect()
    if not found:
        return []
    p = (np.array([[r[f"n{i}"] for i in range(len(names))] for r in found], float) + 0.5) / per
    mean = p.mean(1, keepdims=True)
    gain = (p * np.log(p / mean)).mean(1)
    chosen: list[int] = []
    for k in np.argsort(-gain, kind="stable").tolist():
        a = found[k]["g"]
        if not any((a in found[c]["g"] or found[c]["g"] in a) and 2 * min(found[k]["n"], found[c]["n"]) > max(found[k]["n"], found[c]["n"]) for c in chosen):
            chosen.append(k)
        if len(chosen) == n:
            break
    return [found[k]["g"] for k in chosen]


def mark_counts(text: Column, marks: list[str]) -> list[Column]:
    return [(without(text, c) / F.lit(len(c.encode()))).cast("int").alias(f"_c{i}") for i, c in enumerate(marks)]


def tokens(text: Column) -> Column:
    """Size of a text in tokens: its spaces and line ends plus one, or 0 for an empty or null text."""
    return F.when(F.octet_length(text) > 0, 1 + without(text, " ") + without(text, "\n")).otherwise(0).cast("long")


def drawn_by(docs: DataFrame) -> Column:
    """What a row's chance depends on: its id and its text."""
    return F.xxhash64(F.col("doc_id").cast("string") if "doc_id" in docs.columns else F.lit(None).cast("string"), "text")


def features(docs: DataFrame, marks: list[str], keep: list[str]) -> DataFrame:
    base = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    text = F.col("_text")
    return base.select(*keep, tokens(text).alias("_tokens"), F.octet_length(text).cast("long").alias("_n"), *mark_counts(text, marks))


def columns(marks: list[str]) -> list[str]:
    return [f"_c{i}" for i in range(len(marks))]


def others(marks: list[str]) -> Column:
    """Bytes that no mark takes up, as marks may overlap 0 at least."""
    return F.greatest(F.col("_n") - reduce(lambda a, b: a + b, [F.col(c) * F.lit(len(m.encode())) for c, m in zip(columns(marks), marks, strict=True)], F.lit(0)), F.lit(0))


def fit_classifier(feats: DataFrame, marks: list[str], domain: str, targets: dict[str, float] | None = None) -> Mixer | None:
    """Naive Bayes from all rows of ``feats`` whose ``domain`` isn't null. targets: weight by domain; equal ones by default."""
    cols = columns(marks)
    rows = feats.where(F.col(domain).isNotNull()).groupBy(F.col(domain).cast("string").alias("d")).agg(F.count("*").alias("rows"), F.sum("_n").alias("n"), F.sum(others(marks)).alias("_rest"), *[F.sum(c).alias(c) for c in cols]).orderBy("d").collect()
    rows = [r for r in rows if r["n"]]
    if not rows:
        return None
    domains = [r["d"] for r in rows]
    counts = np.array([[*[r[c] for c in cols], r["_rest"]] for r in rows], float) + 1.0
    share = np.log(counts / counts.sum(1, keepdims=True))
    prior = np.array([r["rows"] for r in rows], float)
    want = np.array([float((targets or {}).get(d, 0 if targets else 1)) for d in domains])
    if want.sum() <= 0:
        want = np.ones(len(domains))
    return Mixer(marks, domains, np.log(prior / prior.sum()).tolist(), share.T.tolist(), (want / want.sum()).tolist())


def with_posterior(feats: DataFrame, mixer: Mixer, keep: list[str]) -> DataFrame:
    """``keep`` and _post, the array of domain probabilities from the counts; an empty text has the prior.

    Logits, their maximum and their exponentials are columns in turn, so that each is
    computed once a row and not once a use.
    """
    cols = [F.col(c).cast("double") for c in columns(mixer.marks)]
    other = others(mixer.marks).cast("double")
    scale = F.least(F.lit(1.0), F.lit(mixer.evidence) / F.greatest(F.col("_n"), F.lit(1)))
    k = range(len(mixer.domains))
    logits = [(F.lit(mixer.prior[d]) + scale * reduce(lambda a, b: a + b, [c * F.lit(w[d]) for c, w in zip([*cols, other], mixer.weight, strict=True)])).alias(f"_l{d}") for d in k]
    out = feats.select(*keep, *logits)
    each = [F.col(f"_l{d}") for d in k]
    out = out.withColumn("_top", F.greatest(*each) if len(each) > 1 else each[0])
    out = out.select(*keep, *[F.exp(x - F.col("_top")).alias(f"_e{d}") for d, x in zip(k, each, strict=True)])
    out = out.withColumn("_sum", reduce(lambda a, b: a + b, [F.col(f"_e{d}") for d in k]))
    return out.select(*keep, F.array(*[F.col(f"_e{d}") / F.col("_sum") for d in k]).alias("_post"))


def soften(feats: DataFrame, domain: str, mixer: Mixer) -> Mixer:
    """Chooses the evidence by the mean log probability of the labelled rows' own domains."""
    own = F.array_position(F.array(*[F.lit(d) for d in mixer.domains]), F.col(domain)).cast("int")
    rows = feats.where(F.col(domain).isin(*mixer.domains))
    n = rows.count()
    if n > CALIBRATED_ROWS:
        rows = cluster.materialise(rows.where(F.rand(6) < CALIBRATED_ROWS / n))
    losses = {}
    for e in EVIDENCE:
        mixer.evidence = e
        losses[e] = with_posterior(rows, mixer, [domain]).agg(F.avg(-F.log(F.greatest(F.element_at("_post", own), F.lit(1e-12))))).first()[0]
    mixer.evidence = min(losses, key=losses.get)
    return mixer


def rate(mixer: Mixer, post: Column) -> Column:
    """A document's rate after the steps so far: from 1, each step down the gradient, cut off below 0."""
    out = F.lit(1.0)
    for step in mixer.steps:
        move = reduce(lambda a, b: a + b, [post[d] * F.lit(x) for d, x in enumerate(step)])
        out = F.greatest(out - move, F.lit(0.0))
    return out


def fit_rates(docs: DataFrame, mixer: Mixer, rounds: int = ROUNDS) -> Mixer:
    """Projected gradient for least squares between expected totals and targets x all tokens.

    ``docs`` has _tokens and _post and is read once a round. In the metric weighted by
    tokens, a document's gradient is its posterior times the domains' residuals, and the
    curvature is the posteriors' second moment, whose trace bounds the step.
    """
    k = len(mixer.domains)
    w = F.col("_tokens").cast("double")
    post = F.col("_post")
    first = docs.agg(F.sum(w).alias("n"), *[F.sum(w * post[i] * post[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    if not first["n"]:
        return mixer
    n = first["n"]
    moment = np.array([[first[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / n
    # preconditioned: the domains' mixing is undone where the posteriors allow it
    precond = np.linalg.inv(moment + 0.02 * np.trace(moment) / k * np.eye(k))
    want = np.array(mixer.target)
    for _ in range(rounds):
        r = rate(mixer, post)
        got = docs.agg(*[F.sum(w * r * post[d]).alias(f"t{d}") for d in range(k)]).first()
        have = np.array([got[f"t{d}"] for d in range(k)]) / n
        mixer.totals.append(have.tolist())
        miss = have - want
        if np.abs(miss).max() < TOLERANCE:
            break
        mixer.steps.append((precond @ miss).tolist())
    else:
        unmet = {d: (round(float(h), 4), round(t, 4)) for d, h, t, m in zip(mixer.domains, have, mixer.target, miss, strict=True) if abs(m) >= TOLERANCE} if rounds else {}
        warnings.warn(f"after {rounds} rounds some domains' shares of the tokens miss their targets (share, target): {unmet}", stacklevel=2)
    return mixer


def fit(docs: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None, labelled: DataFrame | None = None, keep: list[str] | None = None) -> tuple[Mixer | None, DataFrame]:
    """Classifier and rates for ``docs``, and the written table they come from: ``keep``, _draw, _tokens, _post.

    labelled: a table with text and ``domain``; by default ``docs`` itself where ``domain``
    isn't null. Null texts count as empty: no tokens, and the prior. Long texts are counted
    whole. Without labelled rows there is no mixer.
    """
    keep = keep or []
    known = (docs if labelled is None else labelled).withColumn("_domain", F.col(domain).cast("string"))
    marks = choose_marks(known, "_domain")
    rows = docs.withColumn("_draw", drawn_by(docs))
    rows = rows.withColumn("_domain", F.col(domain).cast("string")) if labelled is None else rows.withColumn("_domain", F.lit(None).cast("string"))
    feats = cluster.materialise(features(rows, marks, [*keep, "_draw", "_domain"]))
    taught = feats if labelled is None else cluster.materialise(features(known, marks, ["_domain"]))
    mixer = fit_classifier(taught, marks, "_domain", targets)
    if mixer is None:
        return None, feats.select(*keep, "_draw", "_tokens", F.array().cast("array<double>").alias("_post"))
    soften(taught, "_domain", mixer)
    table = cluster.materialise(with_posterior(feats, mixer, [*keep, "_draw", "_tokens"]))
    return fit_rates(table, mixer), table


def copies(rate_: str, draw: Column) -> Column:
    """How many times a row is taken: its rate's whole part, and once more by a hash of ``draw`` with the rest as chance."""
    whole = F.floor(rate_)
    return (whole + F.when(cluster.chance(draw) < F.col(rate_) - whole, 1).otherwise(0)).cast("int")


def apply(docs: DataFrame, mixer: Mixer | None) -> DataFrame:
    """``docs`` with each row taken as often as its rate says; the columns stay.

    The draw goes by id and text: rows without an id are drawn each by its text, and
    repeated rows are taken alike.
    """
    names = docs.columns
    if mixer is None:
        return docs
    text = F.coalesce("text", F.lit(""))
    # the row travels as one column, so that none of its names can clash with those made here
    feats = docs.select(F.struct("*").alias("_row"), drawn_by(docs).alias("_draw"), F.octet_length(text).cast("long").alias("_n"), *mark_counts(text, mixer.marks))
    rated = with_posterior(feats, mixer, ["_row", "_draw"]).withColumn("_rate", rate(mixer, F.col("_post")))
    taken = rated.select("_row", F.explode(F.array_repeat(F.lit(1), copies("_rate", F.col("_draw")))).alias("_copy"))
    return taken.select(*[F.col("_row")[c].alias(c) for c in names])


#: The query's targets: shares of the tokens by language.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixer, table = fit(cluster.table(spark, sf_dir, "documents"), "lang", TARGETS, keep=["doc_id"])
    out = table.select("doc_id", F.col("_tokens").alias("n_tokens"), F.col("_post").alias("posterior"), "_draw")
    out = out.withColumn("rate", rate(mixer, F.col("posterior")) if mixer else F.lit(1.0))
    return out.withColumn("copies", copies("rate", F.col("_draw"))).drop("_draw")
