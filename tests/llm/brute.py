"""Brute-force versions of the operators, and documents with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re

import xxhash

BLANKS = b" \t\n\r\x0b\x0c"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeats(units_by_row: list, length: int) -> list[bytearray]:
    """Per row, which units a string of ``length`` units covers that starts anywhere else, too."""
    seen: dict = {}
    for u in units_by_row:
        for i in range(len(u) - length + 1):
            w = tuple(u[i:i + length]) if isinstance(u, list) else u[i:i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for u in units_by_row:
        cover = bytearray(len(u))
        for i in range(len(u) - length + 1):
            w = tuple(u[i:i + length]) if isinstance(u, list) else u[i:i + length]
            if seen[w] > 1:
                cover[i:i + length] = b"\1" * length
        out.append(cover)
    return out


def simhash(text: str | None, k: int = 3) -> int:
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles)) if shingles else 0


def components(n: int, edges) -> list[int]:
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def awkward_docs(spark, path, seed: int = 3):
    """Documents with nulls, empty, short, repeated and long texts, shared passages and clashing extra columns; read from files."""
    r = random.Random(seed)
    vocab = ["the", "of", "Große", "étude", "niño", "zu", "a", "IDIOT", "x1", "42", "café", "naïve", "--", "l'eau", "中文", "😀"] + [
        "w%d" % i for i in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, line = say(90), say(12)
    long = " ".join(say(40) + "\n" + line for _ in range(60))
    texts = [None, "", " \t\n ", "a", "a b", "The Of", "the of", say(30), say(200), passage, say(50) + " " + passage + " " + say(50),
             say(20) + "\t" + passage + "\r\n" + say(7), long, long, long + " tail", "la " * 400, "ab" * 900, "ab" * 900 + "c",
             "x" * 3000, say(60), "no-break space   and \x1c control", "don't  stop!!\n\n 12 'tis"]
    texts += [say(r.randint(1, 120)) for _ in range(25)]
    near = say(150).split()
    for k in range(6):
        one = list(near)
        one[10 + k] = "changed%d" % k
        texts.append(" ".join(one))
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "ß", None])) for i, t in enumerate(texts)]
    rows += [(8, texts[8], "en", "s1"), (8, texts[8], "en", "s1"), (None, texts[9], None, None), (None, None, "en", "s2"),
             (1000, texts[9], "de", "s1"), (1001, texts[9], "de", "s1"), (-5, texts[7], "en", "s9")]
    schema = "doc_id long, text string, lang string, source string"
    clash = "rid long, _rid long, id long, size long, key string, fp long, name long, rank int, copies long, ids binary, bytes binary, score double, found string"
    full = [(*row, *([k] * 4), "k", k, k, k, k, b"i", b"b", 0.5, None) for k, row in enumerate(rows)]
    spark.createDataFrame(full, f"{schema}, n_chars long, {clash}".replace("n_chars long, ", "")).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def empty_like(spark, docs, path):
    docs.limit(0).write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)
