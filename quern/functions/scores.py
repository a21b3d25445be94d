"""Column formulas: decay, confidence, risk and search scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import HOTFIX_WORDS, REFACTOR_WORDS, has_any


def decayed_confidence(confidence: Column, days: Column, half_life: float = 60.0) -> Column:
    return confidence * F.exp(-math.log(2) * F.greatest(days, F.lit(0)) / half_life)


def tag_strength(weight: Column, seconds: Column, tau: float = 900.0) -> Column:
    return weight * F.exp(-F.greatest(seconds, F.lit(0)) / tau)


def extinction(clean_runs: Column, slope: float = 0.8, middle: float = 3.0) -> Column:
    """Share of a learned threat that clean runs have undone."""
    return 1 / (1 + F.exp(-slope * (clean_runs - middle)))


def effective_threat(threat: Column, clean_runs: Column) -> Column:
    return threat * (1 - F.when(clean_runs > 0, extinction(clean_runs)).otherwise(0.0))


def threat_verdict(threat: Column) -> Column:
    return F.when(threat >= 0.75, "veto").when(threat >= 0.40, "caution").otherwise("clear")


def scar(count: Column, base: float = 0.40, gain: float = 0.15) -> Column:
    """Threat that grows with incidents, to 1 at most."""
    return F.least(F.lit(1.0), F.round(base + gain * count, 2))


def hotspot(churn: Column, commits: Column, fixes: Column) -> Column:
    return churn * commits * (1 + 0.5 * fixes)


def hotspot_risk(score: Column, fixes: Column) -> Column:
    return F.when((score > 1000) | (fixes >= 5), "CRITICAL").when((score > 250) | (fixes >= 2), "HIGH").when(score > 50, "MEDIUM").otherwise("LOW")


def synapse_delta(dt: Column) -> Column:
    """Spike-timing rule: following soon strengthens, preceding weakens."""
    return F.when(dt > 0, F.exp(-dt / 600.0)).otherwise(-0.5 * F.exp(dt / 300.0))


def beta_mean(successes: Column, failures: Column) -> Column:
    return (1 + successes) / (2 + successes + failures)


def uct(value: Column, visits: Column, parent_visits: Column, c: float | Column = math.sqrt(2)) -> Column:
    return value + c * F.sqrt(F.ln(F.greatest(parent_visits, F.lit(1)).cast("double")) / F.greatest(visits, F.lit(1)))


def puct(value: Column, prior: Column, visits: Column, parent_visits: Column, c: float = 1.25) -> Column:
    return value + c * prior * F.sqrt(parent_visits.cast("double")) / (1 + visits)


def expected_free_energy(compiler: Column, pragmatic: Column, epistemic: Column, curiosity: float = 0.25) -> Column:
    """With a compiler verdict: 0.40 and 0.35 of verdict and goal, the rest for curiosity."""
    return 0.40 * compiler + 0.35 * pragmatic + curiosity * epistemic


def expected_free_energy_plain(pragmatic: Column, epistemic: Column) -> Column:
    return pragmatic + 0.35 * epistemic


def search_budget(blast: Column, threat: Column, base: float = 1.0) -> Column:
    return base * (1 + F.ln(1 + 10 * blast)) * (1 + threat)


def change_risk(blast: Column, churn: Column, coverage: Column, divergence: Column, critical: Column) -> Column:
    """Probability that a change is safe: a logistic score of its reach, churn and tests."""
    logit = 2.4 - 0.35 * F.least(F.lit(15), blast) - 0.002 * F.least(F.lit(1500), churn) + 1.8 * coverage - 0.8 * F.least(F.lit(3.0), divergence) - 1.1 * critical
    return 1 / (1 + F.exp(-F.least(F.lit(6.0), F.greatest(F.lit(-6.0), logit))))


def risk_interval(p: Column, trials: int = 10) -> Column:
    return 1.96 * F.sqrt(p * (1 - p) / trials)


def risk_tier(p: Column) -> Column:
    return F.when(p >= 0.80, "safe").when(p >= 0.55, "moderate").when(p >= 0.35, "risky").otherwise("critical")


def surprise(p: Column, uncertainty: Column) -> Column:
    return -F.ln(p) + 0.25 * F.least(F.lit(4.0), uncertainty)


def exploration_gain(c: Column, arousal: Column, surprised: Column) -> Column:
    """Exploration constant: raised by tanh of arousal in the tonic state, else as given."""
    return F.when((arousal >= 0.55) | (surprised >= 1.80), c * (1 + F.tanh(1.5 * arousal))).otherwise(c)


def drift_rewards(blast: Column) -> dict[str, Column]:
    """Reward of each way to mend a broken contract, by how many callers it reaches."""
    return {
        "dual_contract": 0.95 - 0.02 * F.least(F.lit(5), blast),
        "adapter": F.when(blast > 3, 0.88).otherwise(0.75),
        "caller_sync": F.when(blast <= 2, 0.92).otherwise(F.greatest(F.lit(0.40), 0.90 - 0.08 * blast)),
    }


def attention(text: Column) -> Column:
    """Weights of lexical, threat and graph evidence: for repairs, for redesigns, else balanced."""
    hotfix, refactor = has_any(text, HOTFIX_WORDS), has_any(text, REFACTOR_WORDS)

    def weights(a: float, b: float, c: float) -> Column:
        return F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(c).alias("gamma"))

    return F.when(hotfix & ~refactor, weights(0.30, 0.60, 0.10)).when(refactor & ~hotfix, weights(0.30, 0.10, 0.60)).otherwise(weights(0.40, 0.30, 0.30))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return 1.0 / (k + rank)
