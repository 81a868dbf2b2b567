"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded by a small network from its words and
word pairs (hashed, with learned embeddings) and its form (letter case, symbols, repetition, word lengths); gated
attention, learned from document labels only, weighs the passages; the weighted mean of the encodings gives the
document's score.  Training runs on the driver over a bounded sample of labelled documents, of which it reads every
passage; scoring runs over whole texts in Arrow batches, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored
from .words import SPACED_LOWER, U64, Words, find_words, pieces

PASSAGE = 48
WORD = r"[^\x20\x09-\x0D]+"
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:'-?()",
    "shout": b"!",
    "bar": b"|<>{}[]\\/_=",
    "junk": b"*#$%&@^~+`\"",
    "newline": b"\n",
}
N_FEATURES = len(_CLASSES) + 8
#: Hash buckets of words, and as many of pairs of words.
BUCKETS = 1024


@dataclass
class Bags:
    """The passages of some documents.  ``bag[i]:bag[i + 1]`` are those of document i, ``first[j]:first[j + 1]`` the
    buckets of the words and pairs of passage j."""

    form: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    bag: np.ndarray

    def some(self, docs: np.ndarray) -> Bags:
        """Those of a few documents."""
        sizes = np.diff(self.bag)[docs]
        rows = np.repeat(self.bag[docs] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        n = np.diff(self.first)[rows]
        at = np.repeat(self.first[rows] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return Bags(self.form[rows], self.grams[at], np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(sizes))))


def _grams(words: Words, own: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of words and of pairs within a passage, ordered by passage; where each passage begins)."""
    single = (words.hashes >> U64(54)).astype(np.int64)
    at, hashes = words.windows(2)
    inside = own[at] == own[np.minimum(at + 1, len(own) - 1)] if len(own) else np.zeros(0, bool)
    pair = (hashes[inside] >> U64(54)).astype(np.int64) + BUCKETS
    passage = np.concatenate([own, own[at[inside]]]) if len(own) else np.zeros(0, np.int64)
    order = np.argsort(passage, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(passage, minlength=total))))
    return np.concatenate([single, pair])[order].astype(np.int32), first


def passages(col: pa.Array) -> Bags:
    """A row without words has one empty passage."""
    words = find_words(col, SPACED_LOWER)
    n_rows = len(words.first) - 1
    per_row = np.maximum(1, -(-words.counts // PASSAGE))
    bag = np.concatenate(([0], np.cumsum(per_row)))
    total = int(bag[-1])
    row = np.repeat(np.arange(n_rows), per_row)
    number = np.arange(total) - bag[row]
    a = words.first[row] + number * PASSAGE
    b = np.minimum(a + PASSAGE, words.first[row + 1])
    size = (b - a).astype(float)
    out = np.zeros((total, N_FEATURES))
    own = np.repeat(np.arange(total), b - a)  # words lie in passage order
    if len(words.hashes):
        from_byte = np.append(words.start, len(words.data))[a]
        to_byte = np.where(size > 0, words.end[np.maximum(b - 1, 0)], from_byte)
        from_byte = np.minimum(from_byte, to_byte)
        n_bytes = np.maximum(to_byte - from_byte, 1)
        counts = np.zeros(len(words.data) + 1, np.int32)
        for j, chars in enumerate(_CLASSES.values()):
            table = np.zeros(256, np.int32)
            table[np.frombuffer(chars, np.uint8)] = 1
            np.cumsum(table[words.data], out=counts[1:])
            out[:, j] = (counts[to_byte] - counts[from_byte]) / n_bytes
        n = np.maximum(size, 1)
        length = (words.end - words.start).astype(float)
        mean = np.bincount(own, length, total) / n
        again = np.zeros(len(own))
        again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (own[1:] == own[:-1])
        keys = np.sort((own.astype(U64) << U64(40)) | (words.hashes >> U64(24)))
        fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
        distinct = np.bincount((keys[fresh] >> U64(40)).astype(np.int64), minlength=total)
        first_byte, last_byte = words.data[words.start], words.data[words.end - 1]
        out[:, -8] = mean / 10
        out[:, -7] = np.sqrt(np.maximum(np.bincount(own, length**2, total) / n - mean**2, 0)) / 10
        out[:, -6] = np.bincount(own, again, total) / n
        out[:, -5] = distinct / n
        out[:, -4] = np.bincount(own, (first_byte >= 65) & (first_byte <= 90), total) / n
        out[:, -3] = np.bincount(own, ~((last_byte >= 97) & (last_byte <= 122)) & (last_byte < 128), total) / n
        out[:, -2] = np.bincount(own, length == 1, total) / n
        out[:, -1] = np.log1p(size) / 4
    return Bags(out, *_grams(words, own, total), bag)


@dataclass
class QualityModel:
    weights: dict[str, np.ndarray]

    @classmethod
    def constant(cls, score: float) -> QualityModel:
        """For labels of one class, or none."""
        return cls({"constant": np.array([score])})

    def score(self, x: Bags) -> np.ndarray:
        if "constant" in self.weights:
            return np.full(len(x.bag) - 1, self.weights["constant"][0])
        return _forward(self.weights, x, _embedded(self.weights["E"], x))[0]


def _embedded(table: np.ndarray, x: Bags, step: int = 1 << 17) -> np.ndarray:
    """Mean embedding of each passage; about ``step`` words and pairs at a time, so a long text takes little memory."""
    small = table.astype(np.float32)
    n = np.diff(x.first)
    out = np.zeros((len(n), table.shape[1]))
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(x.first, x.first[a] + step, side="right")) - 1)
        some = n[a:b] > 0
        if some.any():
            sums = np.add.reduceat(small[x.grams[x.first[a] : x.first[b]]], (x.first[a:b] - x.first[a])[some], axis=0)
            out[a:b][some] = sums / n[a:b][some, None]
        a = b
    return out


def _shares(x: Bags) -> np.ndarray:
    """Share of each bucket in each passage."""
    n = np.diff(x.first)
    cell = np.repeat(np.arange(len(n)), n) * (2 * BUCKETS) + x.grams
    return np.bincount(cell, minlength=len(n) * 2 * BUCKETS).reshape(len(n), -1) / np.maximum(n, 1)[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _forward(w: dict[str, np.ndarray], bags: Bags, embedded: np.ndarray) -> tuple:
    x = np.clip((bags.form - w["mean"]) / w["spread"], -6, 6)
    h = np.tanh(x @ w["W"] + embedded + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["a"]
    bag = bags.bag
    size = np.diff(bag)
    top = np.repeat(np.maximum.reduceat(e, bag[:-1]), size)
    p = np.exp(e - top)
    p /= np.repeat(np.add.reduceat(p, bag[:-1]), size)
    z = np.add.reduceat(p[:, None] * h, bag[:-1], axis=0)
    return _sigmoid(z @ w["c"] + w["d"][0]), x, h, t, g, p, z


def fit(bags: Bags, labels: np.ndarray, hidden: int = 16, epochs: int = 25, batch: int = 64, rate: float = 0.01, decay: float = 1e-4) -> QualityModel:
    """Cross-entropy by Adam, in batches of whole documents; the same input gives the same model."""
    if len(labels) == 0 or labels.min() == labels.max():
        return QualityModel.constant((float(labels.sum()) + 1) / (len(labels) + 2))
    rng = np.random.default_rng(7)
    spread = bags.form.std(axis=0)
    w = {"mean": bags.form.mean(axis=0), "spread": np.where(spread > 1e-9, spread, 1.0)}
    d = N_FEATURES
    w |= {"W": rng.normal(0, d**-0.5, (d, hidden)), "E": np.zeros((2 * BUCKETS, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, hidden)), "U": rng.normal(0, hidden**-0.5, (hidden, hidden))}
    w |= {"a": rng.normal(0, hidden**-0.5, hidden), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(1)}
    names = ["W", "E", "b", "V", "U", "a", "c", "d"]
    m, v = {k: np.zeros_like(w[k]) for k in names}, {k: np.zeros_like(w[k]) for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for begin in range(0, len(order), batch):
            docs = order[begin : begin + batch]
            part, own, step = bags.some(docs), labels[docs], step + 1
            shares = _shares(part)
            y, x, h, t, g, p, z = _forward(w, part, shares @ w["E"])
            size = np.diff(part.bag)
            dy = (y - own) / len(docs)
            dz = np.repeat(dy[:, None] * w["c"], size, axis=0)
            dp = (dz * h).sum(axis=1)
            de = p * (dp - np.repeat(np.add.reduceat(p * dp, part.bag[:-1]), size))
            dt, dg = de[:, None] * w["a"] * g * (1 - t**2), de[:, None] * w["a"] * t * g * (1 - g)
            dh = (p[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
            grads = {"W": x.T @ dh, "E": shares.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ dy, "d": np.array([dy.sum()])}
            for k in names:
                grad = grads[k] + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(w)


def is_held_out(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def train_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 2000, max_words: int = 2_000_000
) -> QualityModel:
    """Fit on at most ``max_docs`` labelled rows that aren't held out, with at most ``max_words`` words in all.

    Rows are taken whole, by hash of the id, each that still fits.  Rows with a null id or label are no examples; rows
    with equal id, label and text count once.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held_out(id_col))
    sample = usable.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label")).distinct().orderBy(F.xxhash64("id"), "id", "label").limit(max_docs)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # max_docs rows at most
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    texts = stored(texts.select("*", F.xxhash64("text").alias("key"), n.alias("n")), "labelled")
    rows = texts.select("id", "label", "key", "n").distinct().orderBy(F.xxhash64("id"), "id", "label", "key").limit(max_docs).collect()
    left, taken = max_words, []
    for r in rows:
        if r["n"] <= left:
            left -= r["n"]
            taken.append((r["id"], r["label"], r["key"]))
    if not taken:
        return QualityModel.constant(0.5)
    chosen = docs.sparkSession.createDataFrame(taken, "id long, label double, key long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                x = passages(piece.column("text"))
                cuts = list(zip(x.bag[:-1].tolist(), x.bag[1:].tolist(), strict=True))
                form = [x.form[a:b].astype(np.float32).tobytes() for a, b in cuts]
                grams = [x.grams[x.first[a] : x.first[b]].astype(np.int16).tobytes() for a, b in cuts]
                sizes = [np.diff(x.first[a : b + 1]).astype(np.int32).tobytes() for a, b in cuts]
                columns = [pa.array(c, pa.binary()) for c in (form, grams, sizes)]
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("label"), piece.column("key"), *columns], ["id", "label", "key", "form", "grams", "sizes"])

    found = texts.join(F.broadcast(chosen), ["id", "label", "key"]).dropDuplicates(["id", "label", "key"]).select("id", "label", "key", "text")
    rows = found.mapInArrow(run, "id long, label double, key long, form binary, grams binary, sizes binary").collect()  # max_words at most
    rows.sort(key=lambda r: (r["id"], r["label"], r["key"]))
    form = np.concatenate([np.frombuffer(r["form"], np.float32).reshape(-1, N_FEATURES) for r in rows]).astype(float)
    grams = np.concatenate([np.frombuffer(r["grams"], np.int16) for r in rows]).astype(np.int32)
    sizes = [np.frombuffer(r["sizes"], np.int32) for r in rows]
    bags = Bags(form, grams, np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), np.concatenate(([0], np.cumsum([len(x) for x in sizes]))))
    return fit(bags, np.array([r["label"] for r in rows]))


def score_quality(df: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of df plus ``score_col`` (0 to 1, higher is better), which replaces a column of that name.

    Every passage of the text counts.  A null or empty text is one empty passage and gets a score too.
    """
    df = df.drop(*[c for c in df.columns if c.lower() == score_col.lower()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_col, 1 << 20):
                score = model.score(passages(piece.column(text_col)))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(score)], [*piece.schema.names, score_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType())]))
