"""Language identification by string kernels.

The kernel of two texts is the number of n-grams of bytes (all orders of the spectrum
together) that occur in both, whatever how often, divided by the root of the product of their
own numbers.  Nyström landmarks turn it into features, on which one ridge regression per
language is fitted against the rest.  As the kernel is a product of presence vectors, landmarks
and regressions fold into one matrix, so texts are scored by batched matrix products.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import text_parts

SLOTS = 1 << 16
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
_U = np.uint64
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LETTER = regex.compile(r"\p{L}")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def presence(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text a row that tells which n-grams it holds, n-grams being hashed to ``SLOTS``."""
    n = len(off) - 1
    found = np.zeros((n + 1, SLOTS), np.uint8)  # the last row takes what crosses documents
    flat = found.reshape(-1)
    low = _LOWER[buf[: off[-1]]].astype(_U)
    doc = np.repeat(np.arange(n), np.diff(off))
    code = np.zeros(len(low), _U)
    for order in range(1, max(ORDERS) + 1):
        size = len(low) - order + 1
        if size <= 0:
            break
        code = (code[:size] << _U(8)) | low[order - 1 :]
        if order not in ORDERS:
            continue
        slot = (((code + _U(order << 40)) * _U(0x9E3779B97F4A7C15)) >> _U(48)).astype(np.int64)
        row = np.where(doc[:size] == doc[order - 1 :], doc[:size], n)
        flat[row * SLOTS + slot] = 1
    return found[:n]


def has_letter(text: bytes) -> bool:
    return _ASCII_LETTER.search(text) is not None or not text.isascii() and _LETTER.search(text.decode()) is not None


@dataclass(frozen=True)
class Model:
    """Languages and, per n-gram slot, the weight for each."""

    langs: list[str]
    weights: np.ndarray

    def scores(self, found: np.ndarray) -> np.ndarray:
        size = np.maximum(found.sum(1, dtype=np.int64), 1)
        return (found.astype(np.float32) @ self.weights) / np.sqrt(size)[:, None]


def fit(rows: list[tuple[str, bytes]], landmarks: int, ridge: float) -> Model:
    """Nyström features and one-versus-rest kernel ridge regression on packed presence rows."""
    langs = sorted({r[0] for r in rows})
    if not rows:
        return Model([], np.zeros((SLOTS, 0), np.float32))
    # Landmarks take turns between the languages.
    by = {x: [i for i, r in enumerate(rows) if r[0] == x] for x in langs}
    turns = [i for t in range(max(map(len, by.values()))) for x in langs for i in by[x][t : t + 1]][:landmarks]

    def unpacked(at: list[int]) -> np.ndarray:
        z = np.unpackbits(np.frombuffer(b"".join(rows[i][1] for i in at), np.uint8).reshape(len(at), -1), axis=1).astype(np.float32)
        return z / np.sqrt(np.maximum(z.sum(1), 1))[:, None]

    marks = unpacked(turns)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    gram, target = np.zeros((len(turns), len(turns))), np.zeros((len(turns), len(langs)))
    for a in range(0, len(rows), 128):
        at = list(range(a, min(a + 128, len(rows))))
        phi = (unpacked(at) @ marks.T).astype(np.float64) @ root
        y = np.array([[float(rows[i][0] == x) for x in langs] for i in at])
        gram += phi.T @ phi
        target += phi.T @ y
    w = np.linalg.solve(gram + ridge * np.eye(len(turns)), target)
    return Model(langs, (marks.T @ (root @ w).astype(np.float32)).astype(np.float32))


def remainder(doc_id: str, divisor: int):
    """crc32 of doc_id as text, modulo ``divisor``; of a null doc_id that of the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor


def train(docs: DataFrame, per_lang: int = 500, landmarks: int = 192, ridge: float = 1e-3, most_rows: int = 16384) -> Model:
    """Fit on a bounded sample of labelled documents: ``per_lang`` for each language.

    The sample is those of smallest hash of doc_id, about 1.25 times ``per_lang`` of each language and at most
    twice ``per_lang`` times the number of languages in all; of more languages fewer documents each, so that
    all are about ``most_rows`` (8 KB each).  Their whole texts count.  Rows without a text or a lang are not learned from.
    """
    ok = docs.where("lang is not null and text is not null and length(text) > 0").select(F.col("lang").cast("string"), F.col("text").cast("string"), (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("h"))
    counts = {r["lang"]: r["n"] for r in ok.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], landmarks, ridge)
    per_lang = max(1, min(per_lang, most_rows // (2 * len(counts))))
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.25 * per_lang / n))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 32):
                part = batch.slice(a, 32)
                bits = np.packbits(presence(*text_parts(part.column(1))), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([x.tobytes() for x in bits], pa.binary())], names=["lang", "h", "bits"])

    picked = ok.where(F.col("h") < F.element_at(share, F.col("lang"))).mapInArrow(run, "lang string, h double, bits binary")
    got = picked.orderBy("h", "lang", "bits").limit(2 * per_lang * len(counts)).collect()
    return fit([(r["lang"], bytes(r["bits"])) for r in got], landmarks, ridge)


def predict(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """The language of each whole text, how sure that is (``score``, 0 to 1), and by how much it leads (``margin``).

    A null text, or one without a letter, is ``und`` with score and margin 0; so is every text if the
    model has learned no language.  Rows are judged one by one and nothing is shuffled: repeated
    rows give repeated results, a null doc_id stays null.  With ``keep`` all columns of ``docs``
    stay (of one named lang_pred, score or margin the result takes the place), else doc_id alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS times the number of languages
    cols = [c for c in docs.columns if c not in ("lang_pred", "score", "margin")] if keep else ["doc_id"]
    schema = docs.select(*(F.col(f"`{c}`") for c in cols)).schema if keep else docs.select(F.col("doc_id").cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            buf, off = text_parts(batch.column(batch.num_columns - 1))
            raw = memoryview(np.ascontiguousarray(buf))
            langs: list[str] = []
            scores: list[float] = []
            margins: list[float] = []
            a = 0
            while a < batch.num_rows:
                b = min(a + 48, max(a + 1, int(np.searchsorted(off, off[a] + (1 << 20), "right")) - 1))
                letters = [has_letter(bytes(raw[off[i] : off[i + 1]])) for i in range(a, b)]
                s = m.scores(presence(buf[off[a] : off[b]], off[a : b + 1] - off[a])) if m.langs and any(letters) else np.zeros((b - a, 1))
                top = s.argmax(1)
                lead = s.max(1) - (np.partition(s, -2, 1)[:, -2] if s.shape[1] > 1 else 0)
                for i, ok in enumerate(letters):
                    known = ok and bool(m.langs)
                    langs.append(m.langs[top[i]] if known else UNKNOWN)
                    scores.append(float(min(1.0, max(0.0, s[i, top[i]]))) if known else 0.0)
                    margins.append(float(lead[i]) if known else 0.0)
                a = b
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], names=[*cols, "lang_pred", "score", "margin"])

    given = [F.col(f"`{c}`") if keep else F.col(c).cast("long") for c in cols]
    return docs.select(*given, F.col("text").cast("string").alias("text to judge")).mapInArrow(run, schema.add("lang_pred", "string").add("score", "double").add("margin", "double"))
