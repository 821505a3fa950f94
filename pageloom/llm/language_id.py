"""Language ID by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pageloom.llm.features import code_points, grams
from pageloom.llm.shared import released

SIZES, BITS = (1, 2, 3), 13
#: The classifiers learn from about so many rows in all, in equal parts by language, chosen by a hash of the id.
TRAIN_ROWS = 4000
SCALE, L2, ROUNDS = 8.0, 1e-5, 60
#: A prediction is ambiguous if the nearest codeword's loss is more than this part of the second's.
AMBIGUOUS = 0.25
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1, all different: every split of the languages in two if there are few, else random splits.

    With n languages up to five there are 2**(n-1)-1 splits, and any two rows differ in 2**(n-2) places. Above,
    the best of some seeded random codes of about 10 log2(n) bits is taken.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = [[1 if i == 0 or not (s >> (i - 1)) & 1 else -1 for i in range(n)] for s in range(1, 1 << (n - 1))]
        return np.array(splits, float).T
    rng, length, best, far = np.random.default_rng(7), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, length))
        d = (length - code @ code.T) / 2 + length * np.eye(n)
        if d.min() > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, d.min()
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest language, score, ambiguous) of each feature row, by the logistic loss against each codeword.

        The score is the second codeword's part of the two smallest losses: 1/2 where both are equally near, 1 where
        only one fits. Both losses grow with the margins alike, so a text in two languages scores low however long it is.
        """
        margin = x @ self.weight + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]).sum(2)
        best = loss.argmin(1)
        if len(self.languages) < 2:
            return best, np.ones(len(x)), np.zeros(len(x), bool)
        least, second = np.partition(loss, 1, axis=1)[:, :2].T
        return best, second / np.maximum(least + second, 1e-300), least > AMBIGUOUS * second


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """The square roots of the n-grams' shares: a unit vector of the whole text, times SCALE."""
    points = code_points(text)
    count = np.zeros(1 << BITS)
    for g in grams(points, SIZES, BITS):
        count += np.bincount(g, minlength=1 << BITS)
    return (SCALE * np.sqrt(count / max(count.sum(), 1))).astype(np.float32)


def training_rows(docs: DataFrame, learn: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, lang): about rows / number of languages of each language."""
    known = docs.where(F.col("lang").isNotNull() & learn)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows / len(counts) / n))).otherwise(share)
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return known.where(u < share).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, f) of each row with a letter: a byte a feature, its root on a scale of 255."""
    for batch in batches:
        lang, found = [], []
        for text, value in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if has_letter(text):
                lang.append(value)
                found.append(np.rint(255 * np.sqrt(features(text) / SCALE)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(found, pa.binary())], ["lang", "f"])


def learned(lang: list[str], found: list[bytes]) -> Model:
    """One logistic regression for each bit of the codewords, all on the same rows; languages weigh alike."""
    languages = tuple(sorted(set(lang)))
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((1 << BITS, 1), np.float32), np.full(1, 30.0, np.float32))
    x = np.frombuffer(b"".join(found), np.uint8).reshape(len(found), -1)
    index = np.searchsorted(languages, lang)
    y = code[index].astype(np.float32)
    weigh = (1 / np.bincount(index)[index] / len(languages))[:, None].astype(np.float32)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for step in range(1, ROUNDS + 1):
        gw, gb = L2 * w, np.zeros_like(b)
        for at in range(0, len(x), 512):
            part, own = x[at : at + 512].astype(np.float32), y[at : at + 512]
            part *= part * np.float32(SCALE / 255**2)
            err = -own / (1 + np.exp(np.clip(own * (part @ w + b), -60, 60))) * weigh[at : at + 512]
            gw += part.T @ err
            gb += err.sum(0)
        for i, (p, g) in enumerate(((w, gw), (b, gb))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p -= 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
    return Model(languages, code, w, b)


def fit(rows: DataFrame, limit: int = TRAIN_ROWS + 1000) -> Model:
    """The model of the bounded sample `rows`, learned in one task; only its weights come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang: list[str] = []
        found: list[bytes] = []
        for batch in batches:
            lang += batch.column("lang").to_pylist()
            found += batch.column("f").to_pylist()
        model = learned(lang, found)
        del found
        released()
        parts = [model.weight.astype("<f4").tobytes(), model.bias.astype("<f4").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([list(model.languages)], pa.list_(pa.string())), *(pa.array([p], pa.binary()) for p in parts)], ["languages", "weight", "bias"])

    sample = rows.mapInArrow(_sampled, "lang string, f binary").limit(limit).repartition(1).sortWithinPartitions("lang", "f")  # the same model whatever the order of arrival
    got = sample.mapInArrow(run, "languages array<string>, weight binary, bias binary").collect()
    if not got:
        return learned([], [])
    languages, (weight, bias) = tuple(got[0]["languages"]), (np.frombuffer(got[0][c], "<f4") for c in ("weight", "bias"))
    return Model(languages, codewords(len(languages)), weight.reshape(1 << BITS, -1), bias)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and ambiguous of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8,192 weights a bit, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                lang, score, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
                rows = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
                if rows:
                    best, top, close = model.decode(np.stack([features(texts[i]) for i in rows]))
                    for i, k, s, c in zip(rows, best.tolist(), top.tolist(), close.tolist(), strict=True):
                        lang[i], score[i], unsure[i] = model.languages[k], s, c
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                    [*part.schema.names, "lang_pred", "score", "ambiguous"],
                )

    results = StructType().add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    kept = docs.drop(*results.names).withColumn("text", F.col("text").cast("string"))
    return kept.mapInArrow(run, StructType([*kept.schema.fields, *results.fields]))


def language_id(docs: DataFrame, learn: Column, target: DataFrame | None = None) -> DataFrame:
    """target (docs itself if not given) with lang_pred, score and ambiguous.

    Learns from text and lang of the rows of docs that `learn` admits; predicts from the text alone. A null
    text or one without a letter is `und` with score 0; so is everything if nothing could be learned. A text whose
    two nearest codewords are about equally near is ambiguous; of equal losses the first language counts.
    Repeated rows are predicted each; an empty table gives an empty result; columns of target that have the
    names of results are replaced.
    """
    return predict(docs if target is None else target, fit(training_rows(docs, learn)))
