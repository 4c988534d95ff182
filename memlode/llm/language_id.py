"""Language identification with a blended-spectrum presence kernel.

A text is the set of its character 1- to 3-grams (letters lower-cased, everything else one space),
hashed into ``DIM`` slots.  The kernel of two texts is the number of slots they share over the root of
the product of their numbers of slots.  Nystroem landmarks approximate it; a ridge regression for each
language against the rest is solved on the landmark features.  Because the kernel is an inner product
of the slot vectors, landmarks and weights multiply out to one DIM x languages matrix, and a batch of
documents is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from memlode.llm.common import crc_bucket, documents

DIM_BITS = 14
DIM = 1 << DIM_BITS
GRAMS = 3
#: Bounds of the fit: documents for each language, documents in all, landmarks.
PER_LANGUAGE, SAMPLE, LANDMARKS = 600, 4_000, 256
RIDGE = 1e-3
SHARPNESS = 4.0
_BATCH = 256
_PIECE = 1 << 20
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def slots(text: str | None) -> np.ndarray | None:
    """Which slots a whole text fills (bool, DIM long); None without a letter.

    Long texts go in pieces that carry the last codes over, so the grams at the seams are those of the whole.
    """
    if not text:
        return None
    out, letters, any_letter = np.zeros(DIM, bool), _letter_table(), False
    low, carry = text.lower(), np.full(1, 32, np.uint64)
    for at in range(0, len(low), _PIECE):
        codes = np.frombuffer(low[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = letters[codes]
        any_letter = any_letter or bool(is_letter.any())
        end = [np.uint64(32)] if at + _PIECE >= len(low) else []
        c = np.r_[carry, np.where(is_letter, codes, 32).astype(np.uint64), end].astype(np.uint64)
        gap = c == 32
        c = c[~(gap & np.r_[False, gap[:-1]])]
        carry = c[1 - GRAMS :]
        h = np.zeros(len(c), np.uint64)
        for n in range(GRAMS):
            if len(c) <= n:
                break
            h = h[: len(c) - n] + (c[n:] + np.uint64(n + 1)) * _MULT[n]
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[(mixed >> np.uint64(64 - DIM_BITS)).astype(np.int64)] = True
    return out if any_letter else None


@dataclass
class KernelModel:
    """languages, and the matrix (DIM x languages) into which landmarks and weights multiply out."""

    languages: list[str]
    matrix: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """One-versus-rest scores of a batch of slot vectors."""
        norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return (x @ self.matrix) / norm

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, conf = ["und"] * len(texts), [0.0] * len(texts)
        for at in range(0, len(texts), _BATCH):
            own = [(i, s) for i, t in enumerate(texts[at : at + _BATCH], at) if (s := slots(t)) is not None]
            if not own or not self.languages:
                continue
            z = self.scores(np.stack([s for _, s in own]).astype(np.float32))
            p = np.exp(SHARPNESS * (z - z.max(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            for (i, _), row in zip(own, p):
                j = int(row.argmax())
                lang[i], conf[i] = self.languages[j], float(min(1.0, row[j]))
        return lang, conf


def fit(x: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """Kernel ridge regression on Nystroem features; rows of ``x`` are slot vectors, in a seeded order."""
    names = sorted(set(langs))
    if not names:
        return KernelModel([], np.zeros((DIM, 0), np.float32))

    def unit(part: np.ndarray) -> np.ndarray:
        return part.astype(np.float32) / np.sqrt(np.maximum(part.sum(axis=1, keepdims=True, dtype=np.int64), 1)).astype(np.float32)

    marks = unit(x[:: max(1, len(x) // landmarks)][:landmarks])
    val, vec = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = val > 1e-6 * val.max()
    root = vec[:, good] / np.sqrt(val[good])  # K_mm^(-1/2)
    phi = np.concatenate([unit(x[at : at + _BATCH]) @ marks.T for at in range(0, len(x), _BATCH)]).astype(np.float64) @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + ridge * len(phi) * np.eye(phi.shape[1]), phi.T @ y)
    return KernelModel(names, (marks.T.astype(np.float64) @ (root @ w)).astype(np.float32))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> KernelModel:
    """Learns from documents outside the held-out quarter (crc32(doc_id) mod 4 = 2) with lang and text.

    Each language gives at most ``per_language`` documents and all together ``sample``, chosen by a
    hash of the id; copies count once.  Only their packed slots reach the driver.
    """
    own = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket(F.col("doc_id"), 4) != 2))
    counts = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()
    want = max(1, min(per_language, sample // max(1, len(counts))))
    span = 1 << 30
    share = [(r.lang, int(span * min(1.0, (1.3 * want + 30) / r["count"]))) for r in counts]
    plan = docs.sparkSession.createDataFrame(share, "l_name string, l_upto long")
    turn = F.xxhash64(F.lit("language"), "doc_id")
    packed = F.pandas_udf(_pack, BinaryType())
    picked = own.join(F.broadcast(plan), F.col("lang") == F.col("l_name")).where(F.pmod(turn, F.lit(span)) < F.col("l_upto"))
    rows = picked.select("lang", turn.alias("turn"), packed("text").alias("bits")).where("bits is not null").groupBy("lang", "bits").agg(F.min("turn").alias("turn"))
    got = rows.orderBy("turn", "lang", "bits").collect()
    taken: dict[str, int] = {}
    rows = [r for r in got if (taken.__setitem__(r.lang, taken.get(r.lang, 0) + 1) or taken[r.lang]) <= want]
    x = np.stack([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in rows]) if rows else np.zeros((0, DIM), np.uint8)
    return fit(x, [r.lang for r in rows])


def _pack(texts: pd.Series) -> pd.Series:
    return pd.Series([None if (s := slots(t)) is None else np.packbits(s).tobytes() for t in texts])


def predict(docs: DataFrame, model: KernelModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; ``und`` with score 0 for null text or text without letters
    (and for all if nothing was learned).  Ties go to the first language by name."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = {f.name: f.dataType for f in docs.schema}["doc_id"]
    schema = StructType([StructField("doc_id", kind), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            lang, conf = sent.value.predict(f["text"].tolist())
            yield pd.DataFrame({"doc_id": f["doc_id"], "lang_pred": lang, "score": conf})

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def op7_language_id(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs, train(docs))
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
