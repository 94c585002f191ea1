"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character n-grams of whole texts hashed to a fixed number of buckets: the relative
frequency of a bucket in the text times its inverse document frequency over all training documents.
Weights are trained with follow-the-regularised-leader and elastic-net penalties on a bounded sample
per language, and a temperature fitted on rows of the sample that were held out makes the scores
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .common import stage, mix64, slices

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """`per_language` bounds the training rows of a language and `max_rows` those of all together.

    Every language is learned. `cells` bounds the weights (buckets x languages) in memory: with very many
    languages n-grams share fewer buckets.
    """

    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 17
    per_language: int = 2_000
    max_rows: int = 200_000
    cells: int = 1 << 25
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    calibration_tenths: int = 2

    def for_languages(self, n: int) -> Settings:
        """The settings with a power of two of buckets, so that the weights of `n` languages fit."""
        return replace(self, buckets=min(self.buckets, 1 << max(1, (self.cells // n).bit_length() - 1)))


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Lower-case code point of every letter, a space (32) for everything else."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(texts: list[str | None], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all n-grams, the text each belongs to, letters per text) of some whole texts.

    Runs of characters that are no letters count as one space; every text has a space at both ends.
    """
    parts = [np.frombuffer((" " + (t or "") + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    code = _alphabet()[np.concatenate(parts)] if parts else np.zeros(0, np.uint32)
    blank = code == 32
    again = np.zeros(len(code), bool)
    again[1:] = blank[1:] & blank[:-1] & (owner[1:] == owner[:-1])
    code, owner = code[~again].astype(np.uint64), owner[~again]
    letters = np.bincount(owner[code != 32], minlength=len(parts))
    places, owners = [], []
    for n in s.orders:
        if len(code) < n:
            continue
        acc = np.full(len(code) - n + 1, n, np.uint64)
        for j in range(n):
            acc = acc * np.uint64(0x1F0001) + code[j : len(code) - n + 1 + j]
        inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
        places.append((mix64(acc[inside]) & np.uint64(s.buckets - 1)).astype(np.int32))
        owners.append(owner[: len(owner) - n + 1][inside])
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *places]), np.concatenate([none, *owners]), letters


def _document_frequencies(docs: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """Documents with each bucket, over all of `docs` (column text), and the number of documents."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(s.buckets + 1, np.int64), 0
        mark = np.zeros(s.buckets, bool)
        for b in batches:
            for _, texts in slices((t.as_py() for t in b.column("text")), 500_000):
                place, owner, _ = grams(texts, s)
                order = np.argsort(owner, kind="stable")
                place, ends = place[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))
                for i in range(len(texts)):
                    mark[place[ends[i] : ends[i + 1]]] = True
                    found = np.flatnonzero(mark)
                    seen[found] += 1
                    mark[found] = False
            rows += b.num_rows
        seen[s.buckets] = rows
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(seen[found])], schema=schema)

    counts = docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # at most buckets + 1 rows
    out = np.zeros(s.buckets + 1, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _train(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, s: Settings) -> np.ndarray:
    """Follow the regularised leader, per coordinate, over (buckets, values, class) rows."""
    z, n = np.zeros((s.buckets, n_langs)), np.zeros((s.buckets, n_langs))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        za = z[at]
        return np.where(np.abs(za) <= s.l1, 0.0, -(za - np.sign(za) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    rng = np.random.default_rng(7)
    for _ in range(s.epochs):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            w = weights(at)
            error = _softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(y)), y]).mean())

    lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass
class Model:
    """Classes, the sparse weights (IDF included) of the buckets that have any, and the temperature."""

    settings: Settings
    langs: list[str]
    used: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        dense = np.zeros((self.settings.buckets, len(self.langs)))
        dense[self.used] = self.weights
        return self._predict(texts, dense)

    def _predict(self, texts: list[str | None], dense: np.ndarray) -> tuple[list[str], np.ndarray]:
        langs, scores = [], []
        for _, part in slices(texts, 500_000):
            place, owner, letters = grams(part, self.settings)
            total = np.bincount(owner, minlength=len(part)).clip(1)
            logits = np.stack(
                [np.bincount(owner, dense[place, k], minlength=len(part)) / total for k in range(len(self.langs))], axis=1
            ) if self.langs else np.zeros((len(part), 1))
            p = _softmax(logits / self.temperature)
            best = p.argmax(axis=1)
            known = (letters > 0) & bool(self.langs)
            langs += [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
            scores.append(np.where(known, p[np.arange(len(part)), best], 0.0))
        return langs, np.concatenate([np.zeros(0), *scores])


def fit(docs: DataFrame, chosen: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        settings: Settings = Settings()) -> Model:
    """Learn from rows of `docs` for which `chosen` holds and the language is not null.

    Document frequencies cover all of them; weights are fitted on at most about `per_language` rows
    of each language and `max_rows` together, chosen by a hash of the id, in one task. All languages
    are learned. Null texts count as empty. Without
    rows the model knows no language; with one language it always says that.
    """
    s = settings
    rows = docs.where(F.coalesce(chosen, F.lit(False)) & F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    )
    many = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one number a language
    langs = sorted(many)
    if not langs:
        return Model(s, [], np.zeros(0, np.int64), np.zeros((0, 0)), 1.0)
    s = s.for_languages(len(langs))
    df, total = _document_frequencies(rows, s)
    idf = np.log((1 + total) / (1 + df)) + 1
    spot = F.pmod(F.xxhash64(F.lit("sample"), "id", "text"), F.lit(1_000_000))
    each = min(s.per_language, max(1, s.max_rows // len(langs)))
    spark = docs.sparkSession
    share = spark.createDataFrame([(lang, int(1_000_000 * min(1.0, each / n)) + 1) for lang, n in many.items()], "lang string, share int")
    share = stage(share, scratch(spark, "languages"))  # a file of known size: Spark need not shuffle the texts to meet it
    sample = rows.join(share, "lang").where(spot < F.col("share")).withColumn(
        "held", F.pmod(F.xxhash64(F.lit("held"), "id", "text"), F.lit(10)) < s.calibration_tenths
    )
    schema = pa.schema([("bucket", pa.int32()), ("weights", pa.list_(pa.float64())), ("temperature", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_of, train, held = {x: k for k, x in enumerate(langs)}, [], []
        for b in batches:
            marks = list(zip(b.column("lang").to_pylist(), b.column("held").to_pylist(), strict=True))
            for start, texts in slices(b.column("text").to_pylist(), 500_000):
                place, owner, _ = grams(texts, s)
                order = np.argsort(owner, kind="stable")
                place, ends = place[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))
                for i in range(len(texts)):
                    own = place[ends[i] : ends[i + 1]]
                    at, count = np.unique(own, return_counts=True)
                    lang, apart = marks[start + i]
                    row = at, count / max(1, len(own)) * shared.value[at], place_of[lang]
                    (held if apart else train).append(row)
        if not train and not held:
            return
        # Rows in an order that does not depend on how they arrived.
        train.sort(key=lambda r: (r[2], len(r[0]), float(r[1].sum())))
        w = _train(train, len(langs), s)
        logits = np.array([x @ w[at] for at, x, _ in held]).reshape(len(held), len(langs))
        t = _temperature(logits, np.array([y for _, _, y in held], np.int64))
        used = np.flatnonzero(w.any(axis=1))
        at = np.append(used, -1)
        values = [*w[used], np.zeros(len(langs))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(values, schema[1].type), pa.array(np.full(len(at), t))], schema=schema)

    got = sample.select("text", "lang", "held").repartition(1).mapInArrow(
        run, "bucket int, weights array<double>, temperature double").toArrow()
    if not got.num_rows:
        return Model(s, langs, np.zeros(0, np.int64), np.zeros((0, len(langs))), 1.0)
    at = got.column("bucket").to_numpy()
    w = np.array(got.column("weights").to_pylist()).reshape(len(at), len(langs))
    keep = at >= 0
    return Model(s, langs, at[keep], w[keep] * idf[at[keep]][:, None], float(got.column("temperature")[0].as_py()))


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns `keep` of `docs` with lang_pred and score (probability of that language) added.

    Only the text is looked at. A null text, or one without a letter, is `und` with score 0, and so is
    every text if the model knows no language. Rows that repeat get the same answer; an empty table
    stays empty. The model that travels is bounded by buckets x languages.
    """
    names = [c for c in keep if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).alias("_text"))
    from pyspark.sql import types as T

    fields = [docs.schema[c] for c in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        dense = np.zeros((model.settings.buckets, len(model.langs)))
        dense[model.used] = model.weights
        for b in batches:
            langs, scores = model._predict([t.as_py() for t in b.column("_text")], dense)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(run, T.StructType(fields))
