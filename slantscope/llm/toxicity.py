"""Toxicity scores from a counterfactual-regularised classifier.

A logistic classifier over the words of a text and their beginnings (so that inflected forms count) is fitted on labelled rows.  Each labelled text that mentions a group is
also read with its identity terms swapped for those of another group, and the squared difference of the two scores is
part of the loss, so that a group's mention by itself neither raises nor lowers a score.

Fitting uses a bounded sample of the labelled rows (``sample`` of them, chosen by a hash of the id); every word
or beginning with enough rows and chi-square against the label is kept, so the sample alone bounds the model that is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out, text_parts, whole_text

SAMPLE = 20_000  # labelled rows to fit on
STEMS = (3, 4, 5, 6)  # lengths of word beginnings
MIN_CHI2, MIN_DOCS = 30.0, 4
L2, SWAP_PENALTY = 1e-4, 1.0
BALANCE = 10.0  # weight of a labelled row against a clean one, at most
CUT = 0.7
COUNTED = 200_000  # different words that a task counts before it hands the counts on
SLICE = 256  # texts whose word numbers are handed on together

# Terms that name a group of people; a swap stays within a line.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("mother", "father"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "chinese"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("immigrant", "citizen"), ("immigrants", "citizens"),
    ("old", "young"), ("disabled", "abled"), ("blind", "deaf"),
    ("frauen", "männer"), ("frau", "mann"), ("christen", "muslime", "juden"), ("ausländer", "deutsche"),
    ("femmes", "hommes"), ("femme", "homme"), ("chrétiens", "musulmans", "juifs"), ("noirs", "blancs"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("cristianos", "musulmanes", "judíos"), ("negros", "blancos"),
)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """Distinct words (runs of letters, lower case) of a whole text."""
    out: set[str] = set()
    for part in text_parts(text or ""):
        out.update(_WORD.findall(part.lower()))
    return out


def features_of(words: set[str]) -> set[str]:
    """Words, and the beginnings of longer ones, marked with ``^``."""
    out = set(words)
    for k in STEMS:
        out.update({"^" + w[:k] for w in words if len(w) > k})
    return out


def swap_table(terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> dict[str, str]:
    """Each identity term and the next one of its line."""
    return {t: line[(i + 1) % len(line)] for line in terms for i, t in enumerate(line)}


def swapped(words: set[str], swaps: dict[str, str]) -> set[str]:
    """The words of the same text about another group."""
    return {swaps.get(w, w) for w in words}


class Model:
    """Word weights; ``score`` is the probability of the label."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known = frozenset(weights)

    def score(self, text: str | None) -> float:
        z = self.bias + sum(sorted(self.weights[w] for w in features_of(words_of(text)) & self.known))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _solve(times, right: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """The solution of a positive definite system, by conjugate gradients; ``times`` multiplies its matrix."""
    x, rest = np.zeros_like(right), right.copy()
    z = rest / diagonal
    way, old = z.copy(), rest @ z
    for _ in range(2 * len(right) + 100):
        if np.linalg.norm(rest) <= 1e-9 * np.linalg.norm(right):
            break
        moved = times(way)
        a = old / (way @ moved)
        x, rest = x + a * way, rest - a * moved
        z = rest / diagonal
        new = rest @ z
        way, old = z + new / old * way, new
    return x


def fit(rows: list[tuple[int, list[int], list[int]]], words: list[str], l2: float = L2,
        swap_penalty: float = SWAP_PENALTY, steps: int = 50, balance: float = BALANCE) -> Model:
    """Weights for ``rows`` of (label, word numbers, word numbers after the swap), by Newton's method with sparse products.

    Loss: weighted mean log loss + l2/2 |w|^2 + swap_penalty * mean squared change of the logit under the swap.  Rows of label 1
    weigh up to ``balance`` times the others, where they are that much fewer.  Without rows, every score is 0.5.
    """
    n, m = len(rows), len(words)
    if not n:
        return Model({}, 0.0)
    y = np.array([r[0] for r in rows], dtype=float)
    # rows and columns of the ones of a sparse matrix; the last column is the bias
    at = np.repeat(np.arange(n), [len(r[1]) + 1 for r in rows])
    col = np.array([i for r in rows for i in (*r[1], m)], dtype=np.int64)
    # rows, columns and values of the changes under the swap
    swaps = [(k, i, v) for k, r in enumerate(rows) if r[1] != r[2] for v, side in ((1.0, r[1]), (-1.0, r[2])) for i in side]
    s_at, s_col, s_val = (np.array([x[k] for x in swaps], dtype=d) for k, d in enumerate((np.int64, np.int64, float)))
    ridge = np.full(m + 1, l2)
    ridge[m] = 0
    share = np.where(y == 1, np.clip((n - y.sum()) / max(y.sum(), 1), 1, balance), 1.0)
    share /= share.sum()  # of each row in the mean
    rate = (share @ y * n + 0.5) / (n + 1)
    w = np.zeros(m + 1)
    w[m] = np.log(rate / (1 - rate))

    def logits(v):
        return np.bincount(at, weights=v[col], minlength=n)

    def back(v):
        return np.bincount(col, weights=v[at], minlength=m + 1)

    def pull(v):
        moved = np.bincount(s_at, weights=s_val * v[s_col], minlength=n)
        return 2 * swap_penalty / n * np.bincount(s_col, weights=s_val * moved[s_at], minlength=m + 1)

    def loss(w):
        z = logits(w)
        return float(share @ (np.logaddexp(0, z) - y * z) + 0.5 * ridge @ (w * w) + 0.5 * w @ pull(w))

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(logits(w), -40, 40)))
        grad = back(share * (p - y)) + ridge * w + pull(w)
        weight = share * p * (1 - p)
        diagonal = back(weight) + ridge + 1e-9 + 2 * swap_penalty / n * np.bincount(s_col, weights=s_val * s_val, minlength=m + 1)
        step, size = _solve(lambda v: back(weight * logits(v)) + (ridge + 1e-9) * v + pull(v), grad, diagonal), 1.0
        while size > 1e-6 and (new := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - new < 1e-10:
            break
        w, now = w - size * step, new
    return Model(dict(zip(words, w[:m].tolist())), float(w[m]))


def labelled_sample(docs: DataFrame, labels: DataFrame, t: Scratch, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """``id, label, text`` of a bounded share of the labelled rows that may be learned from.

    Rows are chosen by a hash of the id: all of them, or the share that gives about ``sample``.  A null id or label is
    no label; an id with several labels has the largest.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        "id is not null and label is not null").where(~held_out("id"))
    n = known.agg(F.count(F.lit(1))).first()[0]
    share = min(1.0, sample / max(n, 1))
    chosen = (known.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))
              .groupBy("id").agg(F.max("label").alias("label")))
    text = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return t.put(text.join(F.broadcast(chosen), "id").select("id", "label", "text"))  # about `sample` rows


def _counted(seen: dict[str, list[int]]) -> pa.RecordBatch:
    """Words with the rows that hold them and the labels of those rows, summed."""
    rows, labels = zip(*seen.values())
    return pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(rows, pa.int64()), pa.array(labels, pa.int64())],
                                      names=["word", "c", "a"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = SAMPLE, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, **options) -> Model:
    """A model of ``label_col``, learned from the rows that :func:`held_out` leaves to learn from."""
    t = Scratch(docs.sparkSession, "toxicity")
    rows = labelled_sample(docs, labels, t, id_col, text_col, label_col, sample)
    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # counted one text at a time; what a task holds is bounded by COUNTED words, not by its batches
        seen: dict[str, list[int]] = {}
        for b in batches:
            for y, x in zip(b.column("label").to_pylist(), b.column("text")):
                for w in features_of(words_of(x.as_py())):
                    c = seen.setdefault(w, [0, 0])
                    c[0] += 1
                    c[1] += y
                if len(seen) >= COUNTED:
                    yield _counted(seen)
                    seen = {}
        if seen:
            yield _counted(seen)

    seen = rows.select("label", "text").mapInArrow(spread, "word string, c long, a long").groupBy("word").agg(
        F.sum("c").cast("double").alias("c"), F.sum("a").cast("double").alias("a"))
    # chi-square of the 2 x 2 table of word and label
    a, c = F.col("a"), F.col("c")
    gap = a * float(n) - c * float(n1)
    chi2 = F.lit(float(n)) * gap * gap / (c * (F.lit(float(n)) - c) * float(max(n1 * (n - n1), 1)))
    swaps = swap_table(terms)
    best = seen.where((c >= MIN_DOCS) & (c < n)).withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2)
    words = sorted({r["word"] for r in best.select("word").collect()} | set(swaps))
    number = {w: i for i, w in enumerate(words)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                own, other = [], []
                for x in b.column("text"):
                    words = words_of(x.as_py())
                    for into, of in ((own, words), (other, swapped(words, swaps))):
                        into.append(sorted(number[w] for w in features_of(of) if w in number))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(own, pa.list_(pa.int32())),
                                                  pa.array(other, pa.list_(pa.int32()))], names=["id", "label", "own", "other"])

    kind = rows.schema["id"].dataType.simpleString()
    # about `sample` rows; the order makes reruns agree
    found = rows.mapInArrow(encode, f"id {kind}, label int, own array<int>, other array<int>").toArrow().to_pylist()
    found.sort(key=lambda r: (str(r["id"]), r["label"], r["own"]))
    t.drop(rows)
    return fit([(r["label"], r["own"], r["other"]) for r in found], words, **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``id, held_out, score, predicted`` per row of ``docs``; only the text is an input of the score.

    Null and empty texts get the score of a text without words.  Repeated rows get the same score; null ids stay null.
    An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shared.value.score(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(s, pa.float64())],
                                             names=["id", "held_out", "score"])

    src = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), whole_text(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, held_out boolean, score double").select(
        F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(text: pd.Series) -> pd.Series:
        return text.map(shared.value.score)

    return docs.where(toxic(whole_text(text_col)) < cut)
