"""Operator 6, language ID: sparse logistic regression on TF-IDF of character n-grams.

Document frequencies come from all training documents. The model is fitted on a sample of them
of documented size (``PER_LANGUAGE`` documents of each language, chosen by a hash of the id, and
fewer with more than ``MAX_LANGUAGES``; no language is left out), with
follow-the-regularised-leader updates and elastic-net penalties, so most weights are exactly
zero. A part of the sample that the fit does not see sets the temperature of the probabilities.
Every document is then scored in one scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgraph.llm.repeats import stored
from newsgraph.llm.textkit import SLICE_BYTES, small, text_column

#: Lengths of the n-grams and number of hashed features.
GRAMS, FEATURES = (1, 2, 3), 1 << 16
#: Bound of the labelled sample: documents of each language, fewer of each with more languages than these.
PER_LANGUAGE, MAX_LANGUAGES = 600, 200
#: Step size and penalties of the fit.
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 2e-3, 1e-4, 3
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_CODES = np.uint64(0x9E3779B97F4A7C15)


def gram_features(text: str) -> np.ndarray:
    """Feature number of every n-gram of the lower-cased text, with repeats."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    out, run = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(codes) < n:
            break
        run = run[: len(codes) - n + 1] * _CODES + codes[n - 1:] + np.uint64(1)
        if n in GRAMS:
            h = run ^ np.uint64(n << 56)
            out.append((h * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(48))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def _texts(column: pa.Array) -> Iterator[str | None]:
    for t in column.to_pylist():
        yield None if t is None else t.decode("utf-8", "replace")


def _chunks(text: str) -> Iterator[str]:
    """Parts of a text that overlap by what an n-gram needs; most texts are one part."""
    step = SLICE_BYTES // 4
    for low in range(0, max(len(text), 1), step):
        yield text[low:low + step + max(GRAMS) - 1]


def has_letters(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def document_frequencies(docs: DataFrame) -> DataFrame:
    """Columns feature, docs, over all texts with letters; one row per task and feature is shuffled."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(FEATURES, np.int64)
        seen = np.zeros(FEATURES, bool)
        for batch in small(batches):
            for text in _texts(batch.column(0)):
                if has_letters(text):
                    for part in _chunks(text):
                        seen[gram_features(part)] = True
                    own = np.flatnonzero(seen)
                    counts[own] += 1
                    seen[own] = False
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["feature", "docs"])

    return (docs.select(text_column(docs)).mapInArrow(kernel, "feature long, docs long")
            .groupBy("feature").agg(F.sum("docs").alias("docs")))


def _sparse(docs: DataFrame) -> DataFrame:
    """Columns lang, cal, features, shares: each text as distinct features and their shares."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            langs, cal = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, held, text in zip(langs, cal, _texts(batch.column(2))):
                if not has_letters(text):
                    continue
                counts = np.zeros(FEATURES, np.int64)
                for part in _chunks(text):
                    counts += np.bincount(gram_features(part), minlength=FEATURES)
                used = np.flatnonzero(counts)
                shares = (counts[used] / counts.sum()).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([held]), pa.array([used.astype(np.int32).tobytes()], pa.binary()),
                     pa.array([shares.tobytes()], pa.binary())], names=["lang", "cal", "features", "shares"])

    return docs.select("lang", "cal", text_column(docs)).mapInArrow(
        kernel, "lang string, cal boolean, features binary, shares binary")


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (features x classes) of a multinomial logistic model, by FTRL-proximal updates."""
    z = np.zeros((FEATURES, classes))
    n = np.zeros((FEATURES, classes))
    order = np.arange(len(rows))
    shuffle = np.random.default_rng(7)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        shuffle.shuffle(order)
        for k in order.tolist():
            at, x, y = rows[k]
            w = weights(z[at], n[at])
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(z, n)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that makes the labels most likely, by golden-section search."""
    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), labels]).mean())

    low, high, ratio = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    languages: list[str]
    #: idf x weight / temperature, features x languages
    table: np.ndarray

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letters(text):
            return UNKNOWN, 0.0
        total, count = np.zeros(len(self.languages)), 0
        for part in _chunks(text):
            used = gram_features(part)
            total += np.bincount(used, minlength=FEATURES) @ self.table if len(used) > FEATURES // 4 \
                else self.table[used].sum(0)
            count += len(used)
        p = total / max(count, 1)
        p = np.exp(p - p.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def held_out() -> "F.Column":
    """Documents that are never learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from text and lang of the rows with a language that are not held out.

    Every language is learnt. The weights are FEATURES x languages numbers on the driver.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()
                        & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    total = np.zeros(FEATURES, np.int64)
    for row in document_frequencies(known).collect():  # at most FEATURES rows
        total[row.feature] = row.docs
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())
    place = {lang: k for k, lang in enumerate(languages)}
    if len(languages) > MAX_LANGUAGES:
        per_language = max(1, per_language * MAX_LANGUAGES // len(languages))
    ranked = known.selectExpr("lang", "doc_id",
                              "row_number() over (partition by lang order by xxhash64(doc_id), doc_id) as rank")
    picked = ranked.filter(F.col("rank") <= per_language).groupBy(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id")).agg(
        (F.min("rank") % 5 == 0).alias("cal"))
    # ids of the sample: PER_LANGUAGE times MAX_LANGUAGES, or one a language, so the texts need no shuffle
    chosen = known.join(F.broadcast(picked), (F.col("lang") == F.col("_lang")) & (F.col("doc_id") == F.col("_id")))
    # an id may come with many rows
    sample = stored(_sparse(chosen), "sample").selectExpr(
        "*", "row_number() over (partition by lang order by features, shares) as rank").filter(F.col("rank") <= per_language)
    size = np.log((1 + total.max(initial=0)) / (1 + total)) + 1.0
    fit, check = [], []
    for r in sample.orderBy("lang", "features", "shares").toLocalIterator():
        at = np.frombuffer(r.features, np.int32)
        x = np.frombuffer(r.shares, np.float32) * size[at]
        (check if r.cal else fit).append((at, x / max(np.linalg.norm(x), 1e-12), place[r.lang], np.linalg.norm(x)))
    if not fit:
        return LanguageModel([], np.zeros((FEATURES, 0)))
    # texts are scored by plain sums, so the length of the vectors is taken as their mean
    scale = 1.0 / np.mean([r[3] for r in fit])
    rows = [(at, x * norm * scale, y) for at, x, y, norm in fit]
    weights = ftrl(rows, len(languages))
    judged = [(x * norm * scale) @ weights[at] for at, x, _, norm in check or fit]
    t = temperature(np.array(judged), np.array([r[2] for r in check or fit]))
    return LanguageModel(languages, size[:, None] * weights * scale / t)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score; text alone decides.

    A null text, or one without letters, is ``und`` with score 0, as is every text where nothing
    could be learnt. Columns of these names are replaced; all rows stay.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages numbers
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    names = schema.fieldNames()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in small(batches):
            column = batch.column(batch.schema.get_field_index("text"))
            out = [judge(t) for t in _texts(column.cast(pa.binary()))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                names=names)

    return docs.mapInArrow(kernel, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
