"""Query classification and the retrieval strategy that follows from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes and their patterns in order of precedence.
PATTERNS = [
    ("temporal", r"\b(when|date|year|in \d{4}|\d{4}-\d{4}|last|ago|recent|when did)\b"),
    ("comparative", r"\b(compare|vs\b|versus|which is better|is .* better)\b"),
    ("factual", r"^(what is|who is|define|where is|how many|how much)\b"),
    ("conceptual", r"\b(what does .* mean|why|how (does|do))\b"),
    ("exploratory", r"\b(explain|tell me about|overview|summary|describe)\b"),
]
# The other classifier's words, in its order.
ALTERNATIVE = [
    ("factual", r"\b(what is|who is|when did|how many|define|list)\b"),
    ("temporal", r"\b(recent|latest|last|20\d{2}|this year)\b"),
    ("comparative", r"\b(compare|versus|vs|difference between|better than)\b"),
    ("conceptual", r"\b(explain|why|how does|relationship|impact)\b"),
]
#: Weights and candidates of each class: sparse weight, dense weight, reranker, share of the base number of candidates.
STRATEGIES = {"factual": (0.6, 0.4, False, 0.6), "conceptual": (0.2, 0.8, True, 0.8), "comparative": (0.3, 0.7, True, 0.5), "temporal": (0.4, 0.6, False, 0.75), "exploratory": (0.3, 0.7, False, 1.0)}
BASE_CANDIDATES = 500


def classify(query: Column) -> Column:
    """Struct (label, confidence): 0.9 if the pattern stands at the start, else 0.7; 0.5 if none is found."""
    q = F.trim(query)
    out = F.struct(F.lit("exploratory").alias("label"), F.lit(0.5).alias("confidence"))
    for label, p in reversed(PATTERNS):
        at_start = q.rlike("(?i)^(?:" + p.lstrip("^") + ")")
        hit = F.struct(F.lit(label).alias("label"), F.when(at_start, 0.9).otherwise(0.7).alias("confidence"))
        out = F.when(q.rlike("(?i)" + p), hit).otherwise(out)
    return out


def classify_alternative(query: Column) -> Column:
    q, out = F.lower(query), F.lit("exploratory")
    for label, p in reversed(ALTERNATIVE):
        out = F.when(q.rlike(p), label).otherwise(out)
    return F.coalesce(out, F.lit("exploratory"))


def strategy(label: Column, candidates: int = BASE_CANDIDATES) -> Column:
    """Struct (sparse_weight, dense_weight, use_reranker, candidates) of a class."""

    def of(s) -> Column:
        sw, dw, rr, share = s
        return F.struct(F.lit(sw).alias("sparse_weight"), F.lit(dw).alias("dense_weight"), F.lit(rr).alias("use_reranker"), F.lit(int(candidates * share)).alias("candidates"))

    out = of(STRATEGIES["exploratory"])
    for k, s in STRATEGIES.items():
        out = F.when(label == k, of(s)).otherwise(out)
    return out


def temporal_range(query: Column, now: Column) -> Column:
    """Struct (start, end) of dates: a range of years, a year, or the last N days, months (30 days) or years (365)."""
    two, one, last = r"(\d{4})\s*[-–]\s*(\d{4})", r"(?:^|[^\w])(\d{4})(?:[^\w]|$)", r"(?i)last\s+(\d+)\s+(day|month|year)"
    date = lambda y, md: F.to_date(F.concat(y, F.lit(md)))
    n = F.regexp_extract(query, last, 1).cast("int")
    days = F.when(F.lower(F.regexp_extract(query, last, 2)) == "day", n).when(F.lower(F.regexp_extract(query, last, 2)) == "month", n * 30).otherwise(n * 365)
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    y1, y2, y = F.regexp_extract(query, two, 1), F.regexp_extract(query, two, 2), F.regexp_extract(query, one, 1)
    return (
        F.when(query.rlike(two), span(date(y1, "-01-01"), date(y2, "-12-31")))
        .when(query.rlike(one), span(date(y, "-01-01"), date(y, "-12-31")))
        .when(query.rlike(last), span(F.date_sub(now, days), F.to_date(now)))
    )


def degraded_weights(sparse_weight: Column, dense_weight: Column, degradation: Column, sensitivity: float = 1.0) -> Column:
    """Struct (sparse_weight, dense_weight): the dense weight less its loss by quantisation, both summing to 1."""
    d = dense_weight * F.greatest(F.lit(0.0), 1.0 - sensitivity * degradation)
    total = sparse_weight + d
    return F.struct(F.when(total > 0, sparse_weight / total).otherwise(sparse_weight).alias("sparse_weight"), F.when(total > 0, d / total).otherwise(d).alias("dense_weight"))


def adaptive_alpha(alpha: Column, quantised: Column, drop: Column, beta: Column, unknown: float = 0.15) -> Column:
    """Dense share of a corpus: less beta times its measured drop, or less a fixed part where nothing was measured."""
    known = F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha - F.coalesce(beta, F.lit(1.75)) * drop))
    return F.when(~quantised, alpha).when(drop.isNull(), F.greatest(F.lit(0.0), alpha - unknown)).otherwise(known)
