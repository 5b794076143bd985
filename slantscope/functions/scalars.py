"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

_EXACT = T.DecimalType(38, 0)


def day(col: str | Column) -> Column:
    """Calendar day of a timestamp."""
    return F.to_date(col)


def day_text(col: str | Column) -> Column:
    """Day as ``YYYY-MM-DD`` text."""
    return F.date_format(col, "yyyy-MM-dd")


def rate_pct(biased: str | Column, total: str | Column) -> Column:
    """``round(biased / total * 100, 2)`` with exact half-even rounding,
    0 when ``total`` is 0 (A8, X3, X4).

    Computed in integers: q = floor(10000*b / t) and the remainder decide the
    last digit, so no intermediate rounding can move a value onto a half.
    """
    b = (biased if isinstance(biased, Column) else F.col(biased)).cast(_EXACT)
    t = (total if isinstance(total, Column) else F.col(total)).cast(_EXACT)
    n = b * F.lit(10000).cast(_EXACT)
    rem = n % t
    q = ((n - rem) / t).cast("long")
    twice = rem * F.lit(2).cast(_EXACT)
    rounded = (F.when(twice > t, q + 1)
               .when((twice == t) & (q % 2 == 1), q + 1)
               .otherwise(q))
    return F.when(t > 0, rounded / F.lit(100.0)).otherwise(F.lit(0.0))


def flag(cond: Column) -> Column:
    """``CASE WHEN cond THEN 1 ELSE 0 END``; NULL counts as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def is_biased(label: str | Column = "bias_type") -> Column:
    """A label other than ``false`` is a bias."""
    c = label if isinstance(label, Column) else F.col(label)
    return c != F.lit(S.NO_BIAS)


def fixed_confidence(biased: str | Column = "is_biased") -> Column:
    """0.8 for a bias, 0.2 otherwise."""
    c = biased if isinstance(biased, Column) else F.col(biased)
    return F.when(c, F.lit(S.BIASED_CONFIDENCE)).otherwise(F.lit(S.UNBIASED_CONFIDENCE))


def topic_onehot(topic: str | Column, slots: dict[str, int] | None = None,
                 width: int = S.TOPIC_WIDTH) -> Column:
    """Width-5 one-hot of a topic name; all zeros for an unknown topic."""
    slots = slots or S.TOPIC_SLOT
    c = topic if isinstance(topic, Column) else F.col(topic)
    slot = F.lit(None).cast("int")
    for name, k in slots.items():
        slot = F.when(c == F.lit(name), F.lit(k)).otherwise(slot)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                       lambda j: F.when(j == slot, F.lit(1.0)).otherwise(F.lit(0.0)))


def dot(vec: str | Column, weight_of_index) -> Column:
    """Sum of ``x[i] * w(i)`` in index order, in double (X11).

    ``weight_of_index`` maps the (0-based) index Column to a weight Column,
    so a rule-defined weight vector never has to be materialised.
    """
    v = vec if isinstance(vec, Column) else F.col(vec)
    terms = F.transform(v, lambda x, i: x.cast("double") * weight_of_index(i))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def sigmoid(x: Column) -> Column:
    """Softmax probability of class 1 from the logit difference."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def argmax2(l0: Column, l1: Column) -> Column:
    """Index of the larger of two logits; ties go to 0."""
    return F.when(l1 > l0, F.lit(1)).otherwise(F.lit(0))


def head_input(vec: str | Column, topic: str | Column) -> Column:
    """Text vector followed by the topic one-hot, as the head sees it."""
    v = vec if isinstance(vec, Column) else F.col(vec)
    return F.concat(F.transform(v, lambda x: x.cast("double")), topic_onehot(topic))
