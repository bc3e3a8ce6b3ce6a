"""Operator 3: language identification by string kernels.

A text is the set of its byte n-grams of 1 to 3 bytes, lower-cased (a blended spectrum, by presence).  The
kernel of two texts is the number of n-grams they share over the geometric mean of their set sizes.
Landmark texts (Nyström) turn it into a feature map, on which one-versus-rest kernel ridge regression is
solved in closed form.  A batch of texts is scored by two matrix products: presence of the landmarks'
n-grams by landmark, and kernel values by language.

The model is fitted on a bounded sample of labelled rows: at most ``SAMPLE`` rows, ``PER_CLASS`` of each
language, those with the least hashes of their ids.  Prediction covers every row and its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

SAMPLE, PER_CLASS, LANDMARKS = 4000, 500, 160
CELL_BITS = 12
RIDGE = 1e-3
UNKNOWN = "und"


def grams(text: str) -> np.ndarray:
    """Sorted distinct codes of the 1-, 2- and 3-byte n-grams of a text's lower case, white space runs as one space."""
    b = np.frombuffer(" ".join(["", *text.lower().split(), ""]).encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int32)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    # longer grams stand above shorter ones
    return np.concatenate([np.unique(b), np.unique(two) + 256, np.unique(three) + 65792])


@dataclass
class Model:
    """Languages, the landmarks' grams and their presence, and weights from kernel values to languages."""

    languages: list[str]
    vocabulary: np.ndarray  # sorted codes
    landmarks: np.ndarray  # grams x landmarks, float32; divided by the root of the landmark's size
    weights: np.ndarray  # landmarks x languages
    offset: np.ndarray

    def places(self) -> np.ndarray:
        """For each code its row among the landmarks' grams; -1 if none has it."""
        table = np.full(65792 + (1 << 24), -1, dtype=np.int32)
        table[self.vocabulary] = np.arange(len(self.vocabulary), dtype=np.int32)
        return table

    @cached_property
    def table(self) -> np.ndarray:
        """``places``, made once in each Python worker."""
        return self.places()

    def kernel(self, sets: list[np.ndarray], places: np.ndarray) -> np.ndarray:
        present = np.zeros((len(sets), len(self.vocabulary)), dtype=np.float32)
        for i, s in enumerate(sets):
            at = places[s]
            present[i, at[at >= 0]] = 1
        sizes = np.array([max(1, len(s)) for s in sets], dtype=np.float32)
        return present @ self.landmarks / np.sqrt(sizes)[:, None]

    def scores(self, sets: list[np.ndarray], places: np.ndarray) -> np.ndarray:
        return self.kernel(sets, places).astype(np.float64) @ self.weights + self.offset


def fit(sets: list[np.ndarray], languages: list[str]) -> Model:
    """Fit on gram sets and their languages; classes in alphabetical order."""
    classes = sorted(set(languages))
    label = np.array([classes.index(x) for x in languages])
    # landmarks: every class in turn, in the order given
    order = np.argsort(np.concatenate([np.arange((label == k).sum()) for k in range(len(classes))]), kind="stable")
    chosen = np.concatenate([np.flatnonzero(label == k) for k in range(len(classes))])[order][:LANDMARKS]
    vocabulary = np.unique(np.concatenate([sets[i] for i in chosen]))
    landmarks = np.zeros((len(vocabulary), len(chosen)), dtype=np.float32)
    for j, i in enumerate(chosen.tolist()):
        landmarks[np.searchsorted(vocabulary, sets[i]), j] = 1 / np.sqrt(len(sets[i]))
    model = Model(classes, vocabulary, landmarks, np.zeros((len(chosen), len(classes))), np.zeros(len(classes)))
    places = model.places()
    values = np.concatenate([model.kernel(sets[i : i + 256], places) for i in range(0, len(sets), 256)]).astype(np.float64)
    # Nyström: the landmarks' own kernel matrix to the power -1/2
    power, basis = np.linalg.eigh(values[chosen])
    held = power > 1e-6 * power[-1]
    root = basis[:, held] / np.sqrt(power[held])
    features = values @ root
    mean = features.mean(axis=0)
    target = np.where(label[:, None] == np.arange(len(classes)), 1.0, -1.0)
    # classes weigh the same however many rows they have
    weight = (len(label) / (len(classes) * np.bincount(label, minlength=len(classes))))[label][:, None]
    centred = features - mean
    gram = centred.T @ (weight * centred) + RIDGE * len(label) * np.eye(features.shape[1])
    bias = (weight * target).sum(axis=0) / weight.sum()
    beta = np.linalg.solve(gram, centred.T @ (weight * (target - bias)))
    model.weights, model.offset = root @ beta, bias - mean @ beta
    return model


def train(labelled: DataFrame, sample: int = SAMPLE, per_class: int = PER_CLASS) -> Model | None:
    """Fit on at most ``sample`` rows of ``doc_id, text, lang`` (null languages and texts left out); None without rows.

    Only sets of n-grams reach the driver: at most ``sample`` of them.
    """
    usable = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").withColumn("__th", F.xxhash64("text"))
    h = F.xxhash64("doc_id", "__th")
    # by counts of the hashes' leading bits, the rows that can be among the least of their language: so a common one is no single group
    cell = F.shiftright(h, 64 - CELL_BITS)
    cells = usable.groupBy("lang", cell.alias("__cell")).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy("lang").orderBy("__cell"))  # at most 2 ** CELL_BITS rows a language
    last = cells.withColumn("__upto", upto).where(F.col("__upto") - F.col("__n") < per_class).groupBy("lang").agg(F.max("__cell").alias("__last"))
    least = usable.select("doc_id", "lang", "__th").join(F.broadcast(last), "lang").where(cell <= F.col("__last"))  # a row a language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id"))
    ids = least.select("doc_id", "lang", "__th").withColumn("__rank", rank).where(F.col("__rank") <= per_class).orderBy("__rank", h, "doc_id", "lang").limit(sample)
    ids = ids.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), F.col("__th").alias("__h")).distinct()
    chosen = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("lang") == F.col("__lang")) & (F.col("__th") == F.col("__h"))
    rows = usable.join(F.broadcast(ids), chosen).select("doc_id", "lang", "text").distinct()  # repeated rows of one document once

    def work(_, texts):
        return {"grams": [grams(t) for t in texts]}

    got = map_texts(rows, work, [T.StructField("grams", T.ArrayType(T.IntegerType()))], keep=("doc_id", "lang")).toArrow()
    found = sorted(zip(got["lang"].to_pylist(), got["doc_id"].to_pylist(), (np.asarray(g.values) for g in got["grams"]), strict=True), key=lambda x: (x[0], str(x[1])))
    return fit([g for _, _, g in found], [x for x, _, _ in found]) if found else None


def held_out() -> Column:
    """Whether a row is held out of training: crc32 of its id's text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row: the best language and its score, 0 to 1.

    A null text, a text without a letter, and every text where there was nothing to learn from, is ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LANDMARKS x their grams

    def work(_, texts):
        m, out, score = shared.value, [UNKNOWN] * len(texts), [0.0] * len(texts)
        if m is None:
            return {"lang_pred": out, "score": score}
        places = m.table
        with_letters = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
        for start in range(0, len(with_letters), 256):
            part = with_letters[start : start + 256]
            values = m.scores([grams(texts[i]) for i in part], places)
            best = values.argmax(axis=1)
            sure = np.clip((values[np.arange(len(part)), best] + 1) / 2, 0, 1)
            for i, b, s in zip(part, best.tolist(), sure.tolist(), strict=True):
                out[i], score[i] = m.languages[b], s
        return {"lang_pred": out, "score": score}

    return map_texts(docs, work, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``; learns from rows that are not held out.

    A null ``doc_id`` is not held out.  Repeated rows give repeated rows; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", "lang")
    model = train(rows.where(~held_out()))
    return predict(rows, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
