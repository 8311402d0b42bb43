"""Language identification by error-correcting output codes.

Every language gets a codeword. For each bit a logistic classifier over the shares of hashed letter n-grams predicts that bit; a text's language is the codeword
whose loss is smallest, each bit's loss weighted by how well that bit is told on the training sample. A small gap between the two nearest codewords is flagged.

Learnt from a bounded sample of labelled rows: SAMPLE rows of each language, fewer where that would be over ROWS in all, those with the smallest hash of their ids; whole texts. Prediction reads
nothing but the text. Null texts, and texts without a letter, are 'und' with score 0; so is every text where no language can be learnt. Rows that repeat
keep a row each; an empty table gives an empty result; of docs only the id, the text and, to learn, the language are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod

SAMPLE = 400  # rows a language, at most
ROWS = 2400  # rows of all languages together, at most, and one a language at least: the bound of what is learnt from
SLACK = 2
SLOTS = 1 << 14
EPOCHS = 300
AMBIGUOUS = 0.2  # gap of losses under which a prediction is flagged
UND = "und"

_LETTER = regex.compile(r"\p{L}")


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: every split of the languages for up to five, else random columns that part every pair."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        cols = [[1 if i == 0 or i in s else -1 for i in range(k)] for r in range(k - 1) for s in combinations(range(1, k), r)]
        return np.array(cols, float).T
    rng = np.random.default_rng(7)
    n = 10 + 4 * int(np.ceil(np.log2(k)))
    best, far = None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (k, n))
        d = int(((n - m @ m.T) / 2 + n * np.eye(k)).min())
        if d > far and (abs(m.sum(axis=0)) < k).all():
            best, far = m, d
    return best


def slots(text: str) -> np.ndarray:
    """Hashed 1-, 2- and 3-grams of the text's bytes, lower-cased, digits and marks read as blanks."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)
    b = _FOLD[b].astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:]
    mix = lambda x, c: (x * np.uint32(c)) >> np.uint32(18)  # noqa: E731  14 bits
    return np.concatenate([mix(b + np.uint32(1), 2654435761), mix(two + np.uint32(77), 2246822519), mix(three + np.uint32(991), 3266489917)])


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32


def features(text: str) -> np.ndarray:
    """Square roots of the n-grams' shares, a vector of length one."""
    return np.sqrt(np.bincount(slots(text), minlength=SLOTS) / max(1, 3 * len(text)))


def train(texts: list[str], langs: list[str]) -> dict:
    names = sorted(set(langs))
    code = codewords(len(names))
    if len(names) < 2:
        return {"names": names, "code": code, "w": np.zeros((SLOTS, 1), np.float32), "bias": np.ones(1), "weight": np.ones(1)}
    x = np.array([features(t) for t in texts], np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    at = np.array([names.index(a) for a in langs])
    y = code[at].astype(np.float32)
    share = 1 / np.bincount(at)[at]
    share = (share / share.sum()).astype(np.float32)[:, None]
    w, bias = np.zeros((SLOTS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    v, vb = np.zeros_like(w), np.zeros_like(bias)
    for _ in range(EPOCHS):  # logistic loss, momentum
        g = -y * share / (1 + np.exp(np.clip(y * (x @ w + bias), -30, 30)))
        v, vb = 0.9 * v + x.T @ g, 0.9 * vb + g.sum(axis=0)
        w, bias = w - 4.0 * (v + 1e-4 * w), bias - 4.0 * vb
    loss = (share * np.log1p(np.exp(np.clip(-y * (x @ w + bias), -30, 30)))).sum(axis=0)
    weight = 1 / (0.05 + loss)
    return {"names": names, "code": code, "w": w, "bias": bias, "weight": weight / weight.sum()}


def losses(model: dict, text: str) -> np.ndarray:
    """The weighted loss of each language's codeword."""
    f = features(text)
    f /= max(np.linalg.norm(f), 1e-9)
    at = np.flatnonzero(f)
    margin = f[at] @ model["w"][at] + model["bias"]
    return (np.log1p(np.exp(np.clip(-model["code"] * margin, -30, 30))) * model["weight"]).sum(axis=1)


def predict(model: dict, text: str | None) -> tuple[str, float, bool]:
    if not model["names"] or not text or not _LETTER.search(text):
        return UND, 0.0, False
    loss = losses(model, text)
    p = np.exp(4 * (loss.min() - loss))
    order = np.argsort(loss, kind="stable")
    close = len(loss) > 1 and bool(loss[order[1]] - loss[order[0]] < AMBIGUOUS)
    return model["names"][order[0]], float(p[order[0]] / p.sum()), close


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> dict:
    """A model from the rows that aren't held out."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ((crc_mod(F.col(id_col), 4) != 2) | F.col(id_col).isNull()))
    rows = rows.select(F.col(lang_col).cast("string").alias("l_"), F.col(text_col).cast("string").alias("t_"), F.xxhash64(id_col).alias("h_"))
    held = {r[0]: r[1] for r in rows.groupBy("l_").agg(F.count(F.lit(1))).collect()}  # a row a language
    if not held:
        return train([], [])
    each = max(1, min(SAMPLE, ROWS // len(held)))
    # Only rows under a cut of the hash leave their task: about SLACK times as many as are kept, however many tasks there are.
    share = {a: min(1.0, SLACK * each / n) for a, n in held.items()}
    got, lacking = [], set(held)
    while lacking:
        under = [(F.col("l_") == a) & (F.col("h_") <= min(2**63 - 1, int(share[a] * 2**64) - 2**63)) for a in sorted(lacking)]
        first = Window.partitionBy("l_").orderBy("h_", "t_")
        best = rows.where(reduce(or_, under)).withColumn("k_", F.row_number().over(first)).where(F.col("k_") <= each).collect()
        n = Counter(r["l_"] for r in best)
        short = {a for a in lacking if n[a] < min(each, held[a])}  # where many rows share an id
        got += [r for r in best if r["l_"] not in short]
        share.update((a, min(1.0, 8 * share[a])) for a in short)
        lacking = short
    got = [r for r in sorted(got, key=lambda r: (r["l_"], r["k_"])) if _LETTER.search(r["t_"])]
    return train([r["t_"] for r in got], [r["l_"] for r in got])


def identify(docs: DataFrame, model: dict, id_col="doc_id", text_col="text") -> DataFrame:
    """A row for each row of docs: doc_id, held_out, lang_pred, score, ambiguous."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS floats a bit of the code, whatever the corpus

    def run(batches):
        m = held.value
        for b in batches:
            got = [predict(m, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc_mod(F.col(id_col), 4) == 2, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
