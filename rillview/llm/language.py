"""Language identification by hierarchical discrimination.

A text's hashed byte trigrams (letters lower-cased) are counted and scaled to length one. A linear support vector
machine for each language family picks the family; within it, one-versus-one linear support vector machines vote for the
language. All machines are fitted on the driver from a bounded sample (`sample_per_lang` distinct texts a language, those of
the least hashes over all training rows); everything else reads all rows.

Defined cases: a text that is null, empty or without a letter gives `und` with score 0; rows whose language is null are
not learned from; without any training row every text gives `und`; with one language every text with a letter gives that
language; repeated rows and null ids are scored like others; texts of any length are read whole; extra input columns
of any name are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillview.llm.common import chunks, fold

DIM = 4096
UND = "und"
#: Letters, and numbers such as fractions, which has_letter() tells apart.
LETTER = re.compile(r"[^\W\d_]")
# Families of languages by ISO 639-1 code; a language that is not listed forms a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "be", "mk"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ne", "ur", "sa"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "semitic": ("ar", "he", "am", "mt"),
    "sinitic": ("zh", "yue", "wuu"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def trigram_slots(text: str) -> np.ndarray:
    """The slot of each byte trigram of the text, a space added at both ends."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(20)).astype(np.int64)


def features(text: str) -> np.ndarray:
    """Square roots of the trigrams' shares: a vector of length one."""
    counts = np.bincount(trigram_slots(text), minlength=DIM).astype(np.float32)
    return np.sqrt(counts / max(counts.sum(), 1.0))


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 150) -> np.ndarray:
    """Weights (the last is the bias) of the machine with squared hinge loss, y of -1 and 1, both classes weighing alike."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    y = y.astype(x.dtype)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost
    weight = weight.astype(x.dtype)
    w = np.zeros(x.shape[1], x.dtype)
    ahead, t = w.copy(), 1.0
    step = np.float32(1.0 / (1e-3 + 2 * cost * float((x**2).sum(1).max())))
    for _ in range(rounds):  # accelerated gradient steps
        slack = np.maximum(0, 1 - y * (x @ ahead))
        gradient = np.float32(1e-3) * ahead - 2 * ((weight * slack * y) @ x)
        new, t_new = ahead - step * gradient, (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, float(t_new)
    return w


class Model:
    """families: name -> languages; family_w: a row for each family; pairs: (language, language) -> weights."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        y = np.array(langs, dtype=object)
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
        of = np.array([FAMILY_OF.get(lang, lang) for lang in langs], dtype=object)
        self.names = list(self.families)
        self.family_w = np.array([linear_svm(x, np.where(of == f, 1.0, -1.0)) for f in self.names]) if len(self.names) > 1 else None
        self.pairs = {}
        for own in self.families.values():
            for a, b in combinations(own, 2):
                both = (y == a) | (y == b)
                self.pairs[a, b] = linear_svm(x[both], np.where(y[both] == a, 1.0, -1.0))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not has_letter(text):
            return UND, 0.0
        x = np.append(features(text), 1.0)
        sure, family = 1.0, self.names[0]
        if self.family_w is not None:
            margins = self.family_w @ x
            best = int(margins.argmax())
            family, sure = self.names[best], _sigmoid(margins[best] - np.delete(margins, best).max())
        own = self.families[family]
        votes, least = dict.fromkeys(own, 0), dict.fromkeys(own, 1.0)
        for a, b in combinations(own, 2):
            p = _sigmoid(2 * float(self.pairs[a, b] @ x))
            votes[a if p >= 0.5 else b] += 1
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        lang = max(own, key=lambda k: (votes[k], least[k], k))
        return lang, float(sure * least[lang])


def _sigmoid(v: float) -> float:
    return float(1 / (1 + np.exp(-2 * np.clip(v, -20, 20))))


def fit(rows: DataFrame, sample_per_lang: int = 300) -> Model:
    """rows: text, lang. The bound is `sample_per_lang` distinct texts of each language, those with the least hashes."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    hashed = rows.withColumn("h", F.xxhash64("text"))
    # the least hashes of each language's distinct texts, in steps so that no task has more than a 256th of a language or 16 samples of it
    chosen = hashed.select("lang", "h", F.pmod(F.hash("h"), F.lit(256)).alias("salt")).withColumn("few", F.pmod("salt", F.lit(16))).distinct()
    for keys in (["lang", "salt"], ["lang", "few"], ["lang"]):
        chosen = chosen.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(F.col("nth") <= sample_per_lang).drop("nth")
    drawn = hashed.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 0):
            text, lang = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array([features(t).astype(np.float16).tobytes() for t in text], pa.binary()), pa.array(lang, pa.string())], names=["x", "lang"])

    got = drawn.mapInArrow(make, "x binary, lang string").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float16) for r in got], np.float32).reshape(-1, DIM)
    return Model(x, [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to the columns `keep` (default: all); one row for each row."""
    keep = docs.columns if keep is None else keep
    frame = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("the_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in chunks(batches, n):
            found = [own.predict(t) for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([a for a, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*[f"k{i}" for i in range(n)], "p0", "p1"])

    schema = ", ".join([*[f"k{i} {frame.schema[i].dataType.simpleString()}" for i in range(n)], "p0 string, p1 double"])
    out = frame.mapInArrow(run, schema)
    return out.toDF(*keep, "lang_pred", "score")


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs in which the model finds a language, with the columns of docs, whatever they are called; if it has none, the rows with a letter."""
    if not model.names:
        model = Model(np.zeros((1, DIM), np.float32), ["any"])
    names = [f"d{i}" for i in range(len(docs.columns))]
    named = docs.select(*[F.col(f"`{c}`").alias(d) for c, d in zip(docs.columns, names, strict=True)], "text")
    return identify(named, model, names).filter(F.col("lang_pred") != UND).select(*names).toDF(*docs.columns)


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 4) == 2


def detect_languages(docs: DataFrame, sample_per_lang: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs; learns from the rows that are not held out."""
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))), sample_per_lang)
    return identify(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
