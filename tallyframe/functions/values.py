"""Columns for labels, scores, weights and bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
STATUS_SCORES = {"affirmed": 0.90, "uncertain": 0.60, "not_mentioned": 0.35, "negated": 0.05}
AFFIRMED_IN_IMPRESSION = 0.95
MIN_WEIGHT, MAX_WEIGHT, GOLD_WEIGHT = 0.25, 1.0, 3.0


def number(c: Column) -> Column:
    """A column as double; what isn't a number, NaN included, is null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def binarise(c: Column, threshold: float = 0.5) -> Column:
    """1 at or over the threshold, else 0; null is 0."""
    return F.coalesce(number(c) >= threshold, F.lit(False)).cast("int")


def unit(c: Column, missing: float | None = 0.5) -> Column:
    """A number clipped to 0..1, `missing` in place of null (None leaves it null)."""
    d = number(c) if missing is None else F.coalesce(number(c), F.lit(missing))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), d))


def confidence_weight(values: list[Column], low: float = MIN_WEIGHT, high: float = MAX_WEIGHT) -> Column:
    """Row weight from the mean distance of its known soft labels from 0.5: `low` where all are 0.5, `high` at 0 and 1."""
    known = F.filter(F.array(*[number(v) for v in values]), lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + F.abs(v - 0.5) * 2)
    mean = F.coalesce(F.try_divide(total, F.size(known)), F.lit(0.0))
    return F.lit(low) + (high - low) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean))


def status_score(status: Column, in_impression: Column) -> Column:
    """Score of a status; an affirmed one counts more in the impression."""
    score = reduce(lambda w, s: w.when(status == s[0], s[1]), STATUS_SCORES.items(), F.when((status == "affirmed") & in_impression, AFFIRMED_IN_IMPRESSION))
    return score


def noise_weight(auc: Column, best: Column) -> Column:
    """Weight of a label source: its AUC over chance, relative to the best one's, rounded to 3 places, at least 0."""
    return F.round(F.greatest(F.lit(0.0), F.try_divide(auc - 0.5, best - 0.5)), 3)


def prevalence_band(prevalence: Column, auc: Column) -> tuple[Column, Column]:
    """Bounds of a label's share of positives: 2 % of it at an AUC of 0.65 up to 20 % at 1."""
    rel = 0.02 + 0.18 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (auc - 0.65) / 0.35))
    return prevalence * (1 - rel), prevalence * (1 + rel)


def joint_band(rate: Column, relative: float = 0.20) -> tuple[Column, Column]:
    """Bounds of a pair's joint rate."""
    return rate * (1 - relative), rate * (1 + relative)


def flipped(current: Column, accepted: Column) -> Column:
    """The opposite hard label where a correction is accepted, else the label as it is."""
    return F.when(accepted, F.when(current >= 0.5, 0.0).otherwise(1.0)).otherwise(current)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bce(logit: Column, y: Column) -> Column:
    """Binary cross entropy of a logit, without overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))


def hash_fold(key: Column, folds: int, seed: int | str) -> Column:
    """Fold of a key: the first 32 bits of SHA-256 of seed|key, modulo the number of folds."""
    if folds < 2:
        raise ValueError("folds must be at least 2")
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), key), 256), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(folds)).cast("int")


def group_key(study: Column, patient: Column, site: Column | None = None, language: Column | None = None) -> Column:
    """patient|site|language; a blank patient counts as the study, a missing column as unknown."""
    own = F.when(F.coalesce(patient, F.lit("")) == "", study).otherwise(patient)
    rest = [F.lit("unknown") if c is None else F.coalesce(c, F.lit("")) for c in (site, language)]
    return F.concat_ws("|", own, *rest)


def token_cost(n: Column, mean_chars: Column, usd_in: float, usd_out: float, discount: float = 0.5) -> Column:
    """Estimated price of n texts of mean_chars characters at prices per million tokens: 3.2 characters a token, 900
    tokens of instructions and 260 of answer for each text."""
    return (n * (mean_chars / 3.2 + 900) / 1e6 * usd_in + n * 260 / 1e6 * usd_out) * discount
