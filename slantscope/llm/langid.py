"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased; every run of other characters than letters is one blank.  Character n-grams of the highest
order are counted per language over all documents that may be learned from (a Spark aggregation); the counts of the lower orders
are Kneser-Ney continuation counts, and discounts and context totals are aggregations, too.  Every n-gram is kept.  A language's
model is, per order, a list of 64-bit n-gram hashes with the discounted probabilities, and one of context hashes with the
interpolation weights; a stored table holds them for all languages.  A text gets the language
with the lowest cross-entropy per character.  Rejection: a text whose cross-entropy is above what all but a share
of a language's calibration documents reach is marked.

Scoring: a table of up to ``SMALL`` rows is broadcast as sorted arrays.  A larger one stays where it is: texts are scored in
batches of neighbouring rows, the distinct n-grams of a batch are joined with the table, and each batch meets the part of the
table that it asks for.  Both ways give the same values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, held_out, text_parts, whole_text

ORDER = 5
SMALL = 2_000_000  # rows of a model table that is broadcast; larger ones are joined
BATCH = 1 << 23  # bytes of text that share the joined part of a larger table
CALIBRATION = 0.1  # share of a language's documents to calibrate on; they are not counted
FLOOR = 20  # documents of a language to calibrate on at least, if it has twice as many
REJECT_SHARE = 0.01
EVIDENCE = 20  # characters that a score's confidence counts at most
CHUNK = 1 << 21  # characters scored at a time
MULT = np.uint64(0x9E3779B97F4A7C15)
BLANK = 32


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    """Code points of a normalised text: letters, single blanks between, ``ORDER - 1`` blanks before, one behind.

    Empty if the text has no letter.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.zeros(0, np.uint32)
    c = np.where(letter, c, np.uint32(BLANK))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = c[keep]
    if c[-1] != BLANK:
        c = np.append(c, np.uint32(BLANK))
    return np.concatenate([np.full(ORDER - 1, BLANK, np.uint32), c])


def _hash(cols: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(cols[0]) if cols else 1, len(cols) + 1, dtype=np.uint64)
    for c in cols:
        h = (h ^ c.astype(np.uint64)) * MULT
        h ^= h >> np.uint64(29)
    return h


def _windows(c: np.ndarray) -> list[np.ndarray]:
    return [c[i:len(c) - ORDER + 1 + i] for i in range(ORDER)]


def _chunks(texts: Iterator[tuple[int, str]]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(number, codes) of texts, in lists of bounded size; long texts come in parts."""
    held, size = [], 0
    for i, text in texts:
        for part in text_parts(text, CHUNK):
            c = codes(part)
            if len(c):
                held.append((i, c))
                size += len(c)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _distinct(parts: list[tuple[int, np.ndarray]]):
    """N-grams of the parts: distinct ones as columns of code points, each position's n-gram number, positions per part."""
    all_c = np.concatenate([c for _, c in parts])
    sizes = np.array([len(c) for _, c in parts])
    ends = np.cumsum(sizes)
    inside = np.ones(len(all_c) - ORDER + 1, dtype=bool)
    for k in range(1, ORDER):  # windows that run into the next part
        inside[(ends[:-1] - k)[ends[:-1] - k < len(inside)]] = False
    w = _windows(all_c)
    keys = _hash(w)[inside]
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    at = np.flatnonzero(inside)[first]
    return [x[at] for x in w], number, sizes - ORDER + 1


class LanguageModel:
    """Interpolated Kneser-Ney model of one language from its highest-order n-gram counts."""

    def __init__(self, grams: list[str], counts: np.ndarray, alphabet: int):
        cols = [np.array([ord(g[i]) for g in grams], dtype=np.uint32) for i in range(ORDER)]
        self.floor = 1.0 / (alphabet + 1)
        self.orders: list[tuple[np.ndarray, ...]] = []
        c = counts.astype(float)
        for n in range(ORDER, 0, -1):
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
            g, h = _hash(cols), _hash(cols[:-1])
            if n == 1:
                h = np.repeat(h, len(g))
            ctx, where = np.unique(h, return_inverse=True)
            total = np.bincount(where, weights=c)
            kinds = np.bincount(where)
            order = np.argsort(g)
            self.orders.append((g[order], (np.maximum(c - discount, 0) / total[where])[order], ctx, discount * kinds / total))
            # continuation counts: distinct characters seen before the shorter n-gram
            if n > 1:
                _, first, c = np.unique(_hash(cols[1:]), return_index=True, return_counts=True)
                cols, c = [x[first] for x in cols[1:]], c.astype(float)
        self.orders.reverse()

    @classmethod
    def of(cls, orders: list[tuple[np.ndarray, ...]], floor: float) -> LanguageModel:
        """A model from its arrays, or from those parts of them that some texts ask for."""
        m = cls.__new__(cls)
        m.orders, m.floor = orders, floor
        return m

    def log_prob(self, cols: list[np.ndarray]) -> np.ndarray:
        """Log probability of the last character of each n-gram after the others."""
        p = np.full(len(cols[0]), self.floor)
        for n, (grams, prob, ctx, weight) in enumerate(self.orders, 1):
            own = cols[ORDER - n:]
            h = _hash(own[:-1]) if n > 1 else np.repeat(_hash([]), len(p))
            if not len(ctx):
                continue
            i = np.minimum(np.searchsorted(ctx, h), len(ctx) - 1)
            known = ctx[i] == h
            seen = 0.0
            if len(grams):
                g = _hash(own)
                j = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
                seen = np.where(grams[j] == g, prob[j], 0.0)
            p = np.where(known, seen + weight[i] * p, p)
        return np.log(p)


class Identifier:
    """The models of all learned languages, with rejection limits."""

    def __init__(self, models: dict[str, LanguageModel]):
        self.names, self.models, self.limits = sorted(models), models, {}

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character of each text under each language (nats); NaN for texts without letters."""
        total = np.zeros((len(texts), len(self.names)))
        n = np.zeros(len(texts))
        for parts in _chunks(enumerate(texts)):
            cols, number, sizes = _distinct(parts)
            doc = np.array([i for i, _ in parts])
            np.add.at(n, doc, sizes)
            starts = np.cumsum(sizes) - sizes
            for k, name in enumerate(self.names):
                np.add.at(total[:, k], doc, np.add.reduceat(self.models[name].log_prob(cols)[number], starts))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n[:, None] > 0, -total / n[:, None], np.nan), n

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float], list[bool]]:
        """Language (``und`` without letters), confidence, cross-entropy, whether it is rejected."""
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)
        h, n = self.entropies(texts)
        out: tuple[list, ...] = ([], [], [], [])
        for row, size in zip(h, n):
            if not size:
                for x, v in zip(out, ("und", 0.0, None, True)):
                    x.append(v)
                continue
            best = int(row.argmin())
            name = self.names[best]
            share = np.exp(-(row - row[best]) * min(size, EVIDENCE))
            for x, v in zip(out, (name, float(1 / share.sum()), float(row[best]), bool(row[best] > self.limits.get(name, np.inf)))):
                x.append(v)
        return out


def set_apart(known: DataFrame, t: Scratch) -> DataFrame:
    """``known(id, text, lang)`` with ``apart``: true for the documents to calibrate on, chosen by a hash.

    A share of each language; of a language too small for ``FLOOR`` in it, ``FLOOR`` different ones or half of them, whichever is less.
    """
    place = F.pmod(F.xxhash64("text", "id"), F.lit(1 << 30))
    sizes = t.put(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    small = sizes.where(F.col("n") * CALIBRATION < FLOOR).select("lang")
    below = F.lit(int(CALIBRATION * (1 << 30)))
    if small.isEmpty():
        return known.withColumn("apart", place < below)
    firsts = known.join(F.broadcast(small), "lang").groupBy("lang").agg(F.sort_array(F.collect_set(place)).alias("p"))
    own = firsts.select("lang", F.element_at("p", F.least(F.lit(FLOOR), F.floor(F.size("p") / 2)).cast("int") + 1).alias("own"))
    cuts = t.put(sizes.join(own, "lang", "left").select("lang", F.coalesce("own", below).alias("below")))
    return known.join(F.broadcast(cuts), "lang").withColumn("apart", place < F.col("below")).drop("below")


def gram_counts(texts: DataFrame) -> DataFrame:
    """``texts(lang, text)`` -> ``lang, gram, n`` for the n-grams of the highest order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang").to_pylist()
            col = b.column("text")
            for lang in sorted(set(langs)):
                for parts in _chunks((0, col[i].as_py()) for i, x in enumerate(langs) if x == lang):
                    cols, number, _ = _distinct(parts)
                    flat = np.stack(cols, axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                    grams = [flat[i:i + ORDER] for i in range(0, len(flat), ORDER)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()),
                                                      pa.array(np.bincount(number), pa.int64())], names=["lang", "gram", "n"])

    return texts.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The n-grams of each language with the highest counts, at most ``most`` of them.

    The least count that stays is read off the number of n-grams per count; those of equal count are told apart by a
    hash, so nothing but these numbers is ranked.  :func:`train` keeps all n-grams and does not use this.
    """
    mark = [F.col("n"), F.pmod(F.xxhash64("gram"), F.lit(4096))]
    marked = counts.withColumn("mark", F.struct(mark[0].alias("n"), mark[1].alias("h")))
    per = marked.groupBy("lang", "mark").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy("lang").orderBy(F.col("mark").desc()))
    least = per.withColumn("upto", upto).where(F.col("upto") <= most).groupBy("lang").agg(F.min("mark").alias("least"))
    return marked.join(F.broadcast(least), "lang").where(F.col("mark") >= F.col("least")).select("lang", "gram", "n")


def model_table(counts: DataFrame, t: Scratch) -> tuple[DataFrame, float]:
    """``lang, gram, n`` -> the stored table ``lang, kind, key, value`` of all languages' models, and the share of an unseen character.

    ``kind`` is 2 k for n-grams of order k (``value``: discounted probability) and 2 k + 1 for its contexts
    (interpolation weight); ``key`` is the hash.
    """
    levels = [counts.select("lang", "gram", "n")]
    for k in range(ORDER, 1, -1):  # continuation counts: distinct characters seen before the shorter n-gram
        levels.append(t.put(levels[-1].groupBy("lang", F.substring("gram", 2, k - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))))
    letters = levels[-1].select("gram").distinct().count()
    rows = None
    for k, level in zip(range(ORDER, 0, -1), levels):
        one = level.select(F.lit(k).alias("k"), "lang", "gram", F.substring("gram", 1, k - 1).alias("ctx"), "n")
        rows = one if rows is None else rows.unionByName(one)
    ones, twos = F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))
    discount = F.when(ones + twos > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.1), ones / (ones + 2 * twos)))).otherwise(0.5)
    steps = rows.groupBy("k", "lang").agg(discount.alias("d"))
    own = Window.partitionBy("k", "lang", "ctx")
    placed = rows.select("k", "lang", "gram", "n", F.sum("n").over(own).alias("total"), F.count(F.lit(1)).over(own).alias("kinds"),
                         (F.row_number().over(own.orderBy("gram")) == 1).alias("first"))
    valued = placed.join(F.broadcast(steps), ["k", "lang"]).select(
        "k", "lang", "gram", "first", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("prob"),
        (F.col("d") * F.col("kinds") / F.col("total")).alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            orders = b.column("k").to_numpy()
            for k in np.unique(orders):
                part = b.filter(pa.array(orders == k))
                flat = np.frombuffer("".join(part.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
                cols = list(flat.reshape(-1, k).T)
                heads = part.column("first").to_numpy(zero_copy_only=False)
                ctx = np.broadcast_to(_hash(cols[:-1]), len(heads))
                key = np.concatenate([_hash(cols), ctx[heads]]).view(np.int64)
                kind = np.repeat([2 * k, 2 * k + 1], [len(heads), heads.sum()]).astype(np.int32)
                value = np.concatenate([part.column("prob").to_numpy(), part.column("weight").to_numpy()[heads]])
                lang = pa.concat_arrays([part.column("lang"), part.column("lang").filter(pa.array(heads))])
                yield pa.RecordBatch.from_arrays([lang, pa.array(kind), pa.array(key), pa.array(value)], names=["lang", "kind", "key", "value"])

    table = t.put(valued.mapInArrow(run, "lang string, kind int, key long, value double"))
    t.drop(*levels[1:])
    return table, 1.0 / (letters + 1)


def assemble(names: list[str], floor: float, lang: np.ndarray, kind: np.ndarray, key: np.ndarray, value: np.ndarray) -> Identifier:
    """The models of ``names`` from rows of a model table; ``lang`` holds places in ``names``."""
    code = lang.astype(np.int64) * (2 * ORDER + 2) + kind
    key = key.view(np.uint64)
    order = np.lexsort((key, code))
    code, key, value = code[order], key[order], value[order]
    ends = np.searchsorted(code, np.arange(len(names) * (2 * ORDER + 2) + 1))

    def part(i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(*ends[i * (2 * ORDER + 2) + k:][:2])
        return key[at], value[at]

    return Identifier({name: LanguageModel.of([(*part(i, 2 * n), *part(i, 2 * n + 1)) for n in range(1, ORDER + 1)], floor)
                       for i, name in enumerate(names)})


class StoredModels:
    """The models of all learned languages as a stored table, with rejection limits."""

    def __init__(self, names: list[str], floor: float, table: DataFrame):
        self.names, self.floor, self.table, self.limits = sorted(names), floor, table, {}

    def whole(self) -> Identifier:
        """All of the table in memory."""
        rows = self.table.toArrow()
        place = {name: i for i, name in enumerate(self.names)}
        lang = np.array([place[x] for x in rows.column("lang").to_pylist()], dtype=np.int64)
        return assemble(self.names, self.floor, lang, *(rows.column(c).to_numpy() for c in ("kind", "key", "value")))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Identifier | StoredModels:
    """Models of the languages in ``lang_col``, learned from the rows that :func:`held_out` leaves to learn from.

    Rows with a null text or language are not learned from.  Without any, every prediction is ``und``.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text is not null and lang is not null").where(~held_out("id"))
    t = Scratch(docs.sparkSession, "langid")
    known = set_apart(known, t)
    counts = t.put(gram_counts(known.where("not apart")))
    table, floor = model_table(counts, t)
    t.drop(counts)
    held = {r["lang"]: r["count"] for r in table.groupBy("lang").count().collect()}
    if not held:
        return Identifier({})
    found = StoredModels(list(held), floor, table)
    if sum(held.values()) <= SMALL:
        found = found.whole()
        t.drop(table)
    shares = predict(known.where("apart"), found, "id", "text", ["lang"]).where("lang = lang_pred").groupBy("lang").agg(
        F.percentile_approx("entropy", 1 - REJECT_SHARE, 10_000).alias("most"))
    found.limits = {r["lang"]: r["most"] for r in shares.collect()}
    return found


def _scored(found: Identifier, cols: list[pa.Array], names: list[str], texts: pa.Array) -> pa.RecordBatch:
    lang, score, entropy, rejected = found.predict(texts.to_pylist())
    return pa.RecordBatch.from_arrays(
        [*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()),
         pa.array(rejected, pa.bool_())], names=[*names, "lang_pred", "score", "entropy", "rejected"])


def predict(docs: DataFrame, model: Identifier | StoredModels, id_col: str = "doc_id", text_col: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """``lang_pred, score, entropy, rejected`` per row of ``docs``; only the text is an input.

    A null text, or one without a letter, gets ``und``, score 0 and null entropy, and is rejected.  ``lang_pred`` names the best
    language also where ``rejected`` says that no learned language fits well.  Repeated rows get the same
    values; null ids stay null; an empty table gives an empty result.  With :class:`StoredModels`, ``docs`` is read
    twice and must be a read of stored files.
    """
    names = [id_col, *(keep or [])]
    src = docs.select(*[F.col(f"`{c}`") for c in names], whole_text(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    out = f"{schema}, lang_pred string, score double, entropy double, rejected boolean"
    if isinstance(model, StoredModels):
        return _predict_joined(src, model, names, schema, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _scored(shared.value, b.columns[:-1], names, b.column(len(names)))

    return src.mapInArrow(run, out)


def _numbered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with its rows' batch numbers: neighbouring rows of a partition share one up to ``size`` bytes of text."""
    before = 0
    for b in batches:
        ends = before + np.cumsum(pc.binary_length(b.column("_text")).to_numpy().astype(np.int64) + 1)
        if len(ends):
            starts = np.concatenate([[before], ends[:-1]])
            before = int(ends[-1])
            yield b, (b.column("_part").to_numpy().astype(np.int64) << 40) + starts // size


def _runs(*cols: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends of stretches of equal values."""
    cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(cols[0])])


def _asked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """``_batch, kind, key`` of the rows of a model table that each batch's texts look up."""
    for b, number in _numbered(batches, size):
        for lo, hi in _runs(number):
            for parts in _chunks((0, b.column("_text")[i].as_py()) for i in range(lo, hi)):
                cols, _, _ = _distinct(parts)
                for n in range(1, ORDER + 1):
                    own = cols[ORDER - n:]
                    for kind, key in ((2 * n, np.unique(_hash(own))), (2 * n + 1, np.unique(_hash(own[:-1])))):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), number[lo])), pa.array(np.full(len(key), kind, np.int32)),
                                                          pa.array(key.view(np.int64))], names=["_batch", "kind", "key"])


def _predict_joined(src: DataFrame, model: StoredModels, names: list[str], schema: str, out: str) -> DataFrame:
    """:func:`predict` by joining each batch's n-grams and contexts with the stored table."""
    size = BATCH
    src = src.withColumn("_part", F.spark_partition_id())
    shared = src.sparkSession.sparkContext.broadcast((model.names, model.floor, model.limits))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in _numbered(batches, size):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(at)], names=[*names, "_text", "_batch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, floor, limits = shared.value
        place = {name: i for i, name in enumerate(known)}
        now, rows, found = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            at, is_text = b.column("_batch").to_numpy(), b.column("_is_text").to_numpy(zero_copy_only=False)
            for lo, hi in _runs(at, is_text):
                part = b.slice(lo, hi - lo)
                if at[lo] != now:
                    now, rows, found = at[lo], [], None
                if not is_text[lo]:
                    lang = np.array([place[x] for x in part.column("_lang").to_pylist()], dtype=np.int64)
                    rows.append((lang, *(part.column(c).to_numpy() for c in ("_kind", "_key", "_value"))))
                    continue
                if found is None:
                    empty = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
                    found = assemble(known, floor, *(np.concatenate(c) for c in zip(empty, *rows)))
                    found.limits, rows = limits, []
                yield _scored(found, [part.column(c) for c in names], names, part.column("_text"))

    # a batch asks for a row once; hashing by the row's key serves both steps
    asked = src.mapInArrow(lambda batches: _asked(batches, size), "_batch long, kind int, key long").repartition("kind", "key").distinct()
    given = asked.join(model.table, ["kind", "key"]).select(
        "_batch", F.lit(False).alias("_is_text"), F.col("lang").alias("_lang"), F.col("kind").alias("_kind"), F.col("key").alias("_key"),
        F.col("value").alias("_value"))
    texts = src.mapInArrow(number, f"{schema}, _text string, _batch long").withColumn("_is_text", F.lit(True))
    both = texts.unionByName(given, allowMissingColumns=True)
    return both.repartition("_batch").sortWithinPartitions("_batch", "_is_text").mapInArrow(run, out)
