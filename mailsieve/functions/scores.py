"""Score algebra: how channel scores become one risk, label and confidence. Channels are nullable ints 0..100; null is absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channel weights, the calibration curves and their cap, bands.
WEIGHTS = {"url": 0.35, "header": 0.30, "nlp": 0.25, "attachment": 0.10}
CAP = 0.999
FINAL = ([7.9792, 11.455, 35.7434, 41.4669, 57.1623, 62.6143, 87.2549, 98.1583, 98.5046, 99.9015, 99.9999], [0.008464, 0.052632, 0.255102, 0.255102, 0.3125, 0.6, 0.863636, 0.980296, 0.983607, 1.0, 1.0])
CURVES = {
    "nlp": ([0.0, 1.0, 2.0, 3.0, 4.0, 16.0, 17.0, 36.0, 37.0, 43.0, 46.0, 57.0, 58.0, 89.0, 90.0, 99.0, 100.0], [0.015443, 0.052632, 0.052632, 0.3125, 0.373737, 0.373737, 0.541667, 0.541667, 0.6, 0.6, 0.863636, 0.863636, 0.980296, 0.980296, 0.984, 0.984, 1.0]),
    "header": ([10.0, 25.0, 60.0, 80.0], [0.065358, 0.065358, 1.0, 1.0]),
    "url": ([0.0, 100.0], [0.0, 0.0]),
    "attachment": ([0.0, 100.0], [0.0, 1.0]),
}
BANDS = {"benign": (0, 25), "suspicious": (26, 50), "phishing": (51, 75), "malware": (76, 100)}


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """x within the bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def weighted_average(channels: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Mean over present channels by weight; 0 if none is present."""
    total = sum(F.when(c.isNotNull(), weights[k] * c).otherwise(0.0) for k, c in channels.items())
    weight = sum(F.when(c.isNotNull(), weights[k]).otherwise(0.0) for k, c in channels.items())
    return F.when(weight > 0, clamp(total / weight)).otherwise(0.0)


def noisy_or(channels: dict[str, Column], reliability: dict[str, float] | None = None) -> Column:
    """100 (1 - product of (1 - r s / 100)) over present channels."""
    r = reliability or dict.fromkeys(channels, 1.0)
    p = F.lit(1.0)
    for k, c in channels.items():
        p = p * F.when(c.isNull(), 1.0).otherwise(1 - r[k] * clamp(c.cast("double")) / 100)
    return clamp((1 - p) * 100)


def piecewise(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear between the points, flat outside."""
    out = F.when(x <= xs[0], F.lit(ys[0]))
    for (x0, x1), (y0, y1) in zip(zip(xs, xs[1:], strict=False), zip(ys, ys[1:], strict=False), strict=True):
        out = out.when(x <= x1, y0 + (x - x0) * (y1 - y0) / (x1 - x0))
    return out.otherwise(F.lit(ys[-1]))


def calibrated_or(channels: dict[str, Column], curves: dict = CURVES, final: tuple = FINAL, cap: float = CAP) -> Column:
    """Every present channel by its curve to a probability, combined by noisy-or, then by the final curve."""
    p, any_of = F.lit(1.0), F.lit(False)
    for k, c in channels.items():
        q = F.greatest(F.lit(0.0), F.least(F.lit(cap), piecewise(c.cast("double"), *curves[k])))
        p, any_of = p * F.when(c.isNull(), 1.0).otherwise(1 - q), any_of | c.isNotNull()
    # the raw score is bound once: written out in every branch of the curve, its expression would grow with the curve
    risk = F.get(F.transform(F.array((1 - p) * 100), lambda raw: clamp(piecewise(raw, *final) * 100)), 0)
    return F.when(any_of, risk).otherwise(0.0)


def alpha(count: Column, tau: float = 5.0, most: float = 0.30) -> Column:
    return F.when(count > 0, F.least(count / (count + tau), F.lit(most))).otherwise(0.0)


def nudge(score: Column, count: Column, mean: Column, tau: float = 5.0, most: float = 0.30) -> Column:
    """The score drawn to its campaign's mean by min(n / (n + tau), most); unchanged without a history."""
    a = alpha(F.coalesce(count, F.lit(0)), tau, most)
    return clamp(F.when(mean.isNull() | (a == 0), score).otherwise((1 - a) * score + a * mean))


def label(score: Column) -> Column:
    return F.when(score <= 25, "benign").when(score <= 50, "suspicious").when(score <= 75, "phishing").otherwise("malware")


def reconciled(score: Column, attachment: Column) -> Column:
    """Malware only if the attachment itself scores so high; else phishing."""
    natural = label(score)
    return F.when((natural == "malware") & ~F.coalesce(attachment >= 76, F.lit(False)), "phishing").otherwise(natural)


def confidence(score: Column, partial: Column, source: Column) -> Column:
    """Distance to the band's nearer edge over 25, less for partial analyses and rule verdicts."""
    edge = F.lit(None).cast("int")
    for low, high in BANDS.values():
        edge = F.when((score >= low) & (score <= high), F.least(score - low, high - score)).otherwise(edge)
    return clamp(F.coalesce(edge, F.lit(0)) / 25.0 * F.when(partial, 0.7).otherwise(1.0) * F.when(source == "rule", 0.5).otherwise(1.0), 0.0, 1.0)


def source(url: Column, header: Column, nlp: Column) -> Column:
    return F.when(F.coalesce(url, header, nlp).isNotNull(), "model").otherwise("rule")


def url_label(ml: Column, ti_match: Column, ti_risk: Column, routed: Column, verdict: Column, degraded: Column) -> Column:
    return (
        F.when(ti_match & (ti_risk >= 80), "phishing").when(verdict == "phishing", "phishing").when((verdict == "benign") & ~degraded, "legitimate")
        .when(routed, "suspicious").when(ml >= 70, "phishing").when(ml >= 40, "suspicious").otherwise("legitimate")
    )


def envelope_score(lab: Column, score: Column, verdict: Column, degraded: Column, deploy_p: Column) -> Column:
    l2 = (deploy_p * 100).cast("int")
    return F.when(lab == "phishing", 100).when((verdict == "benign") & ~degraded & (l2 < score), l2).otherwise(score)


def url_fusion(url_p: Column, op_p: Column, shortener: Column) -> Column:
    """Blend of URL and operational probabilities in three zones, and for shorteners."""
    zone = F.when((op_p > 0.60) & (url_p >= 0.05), 0.25 * url_p + 0.75 * op_p).when(op_p < 0.01, 0.65 * url_p + 0.35 * op_p).otherwise(0.60 * url_p + 0.40 * op_p)
    return F.when(op_p.isNull(), url_p).when(shortener & (url_p <= 0.95), 0.1 * url_p + 0.9 * op_p).otherwise(zone)


def header_score(auth: Column, reputation: Column, structural: Column, blend: str = "max", weights: tuple = (1.0, 1.0, 1.0)) -> Column:
    if blend == "average":
        return clamp(F.floor((auth + reputation + structural) / 3), 0, 100).cast("int")
    if blend == "weighted":
        w = weights if sum(weights) > 0 else (1.0, 1.0, 1.0)
        return clamp(F.floor((auth * w[0] + reputation * w[1] + structural * w[2]) / sum(w) + 0.5), 0, 100).cast("int")
    return clamp(F.greatest(auth, reputation, structural), 0, 100).cast("int")


def attachment_score(malicious: Column, entropy: Column, mismatch: Column, dangerous: Column, macros: Column, double: Column) -> Column:
    one = lambda c, n: F.when(c, n).otherwise(0)
    return clamp(F.when(malicious, 90).otherwise(one(entropy > 7.5, 20) + one(mismatch, 30) + one(dangerous, 25) + one(macros, 20) + one(double, 35)), 0, 100).cast("int")


def prior_adjusted(p: Column, train_prior: float, new_prior: float) -> Column:
    a, b = p * new_prior / train_prior, (1 - p) * (1 - new_prior) / (1 - train_prior)
    return a / (a + b)


def spam_suppressed(score: Column, spam: Column, alpha: float = 1.0) -> Column:
    """A risk less its share of spam probability; none known takes nothing."""
    return score * (1 - alpha * F.coalesce(spam, F.lit(0.0)))


def class_gated(score: Column, label: Column, k: float = 0.3) -> Column:
    """A risk cut to k of itself for what the text model calls spam."""
    return score * F.when(label == "spam", k).otherwise(1.0)
