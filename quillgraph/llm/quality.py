"""Quality classification by a linear machine over n-gram indicators scaled with their log-count ratios.

r(f) = log((alpha + p(f)) / |p|) - log((alpha + q(f)) / |q|), p and q the counts of feature f over rows of label 1 and 0. A text is the set of its features, each with value r(f);
a hinge-loss machine is fitted to those by dual coordinate descent, class weights balanced, and a logistic curve turns its margin into a share.

Features: words, pairs of words, the shapes of words and their pairs, so that text of words never seen has features too, and how varied the words are. All of them count; each is told by its hash, in one of SLOTS slots, which
bounds the model whatever the sample holds. Learnt from a bounded sample of labelled rows (SAMPLE of either label, those
with the smallest hash of their ids, whole texts). Scoring reads nothing but the text. Null texts count as empty; an empty text gets the score of its bias. With no labels, or one label only, every score is that label's share (0.5 without
labels). Rows that repeat keep a row each; labels that repeat count once; an empty table gives an empty result. Columns keep their names, whatever they are.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, plain

SAMPLE = 1500  # rows of either label; the bound of what is learnt from
ALPHA = 1.0
MIN_DF = 3  # rows of the sample that a ratio is estimated from, at least; features seen in fewer have no weight
COST = 0.1
EPOCHS = 30
THRESHOLD = 0.3
BITS = 21
SLOTS = 1 << BITS  # weights of the model
SEEN = 600_000  # words whose hashes a worker keeps

_RUN = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"[0-9]")
_PAIR, _SHAPE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def shape(w: str) -> str:
    """A word's case and the marks around its letters: Xx, XX, x, and 'x,' for a word with a comma."""
    return _RUN.sub(lambda m: "XX" if m[0].isupper() and len(m[0]) > 1 else "Xx" if m[0][0].isupper() else "x", _DIGIT.sub("9", w))


class _Numbers(dict):
    """A number for each word met, and by it the hashes of the word and of its shape; a bounded number of words is kept."""

    def __init__(self):
        self.words, self.shapes, self.known = array("Q"), array("Q"), {}

    def __missing__(self, w: str) -> int:
        core, mark = (w[:-1], w[-1]) if w[-1] in ",." else (w, "")
        s = ("XX" if core.isupper() and len(core) > 1 else "Xx" if core[0].isupper() else "x") + mark if core.isalpha() else shape(w)
        h = self.known.get(s)
        if h is None:
            h = self.known[s] = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"), 1)
        self.words.append(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))
        self.shapes.append(h)
        n = self[w] = len(self)
        return n


class Grams:
    """The slots of texts' features, distinct and ascending."""

    def __init__(self):
        self.seen = _Numbers()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        n = len(words)
        if len(self.seen) > SEEN:
            self.seen = _Numbers()
        at = np.fromiter(map(self.seen.__getitem__, words), np.int64, n)
        w, s = (np.frombuffer(x, np.uint64)[at] if n else np.empty(0, np.uint64) for x in (self.seen.words, self.seen.shapes))
        with np.errstate(over="ignore"):
            s *= _SHAPE
            rest = [f"n {n.bit_length()}"]
            if n:
                rest += [f"distinct {8 * len(set(words)) // n}", f"length {sum(map(len, words)) // n}"]
            own = np.array([xxhash.xxh3_64_intdigest(x, 2) for x in rest], np.uint64)
            f = np.concatenate([w, s, w[:-1] * _PAIR + w[1:], s[:-1] * _PAIR + s[1:], own])
            f ^= f >> np.uint64(31)
            f *= _MIX
        return np.unique((f >> np.uint64(64 - BITS)).astype(np.int32))


def train(texts: list[str], labels: list[int]) -> dict:
    y = np.where(np.array(labels) == 1, 1, -1)
    if len(set(labels)) < 2:
        return {"w": None, "bias": 0.0, "a": 0.0, "b": float(20 * (labels[0] == 1) - 10) if labels else 0.0}
    grams = Grams()
    rows = [grams(t) for t in texts]
    pos, neg = (np.bincount(np.concatenate([f for f, s in zip(rows, y) if s == side]), minlength=SLOTS) for side in (1, -1))
    at = np.flatnonzero(pos + neg >= MIN_DF)  # features with a place each in the arrays below
    place = np.full(SLOTS, -1)
    place[at] = np.arange(at.size)
    p, q = pos[at] + ALPHA, neg[at] + ALPHA
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    xs = [i[i >= 0] for i in (place[f] for f in rows)]
    del rows, pos, neg, place
    norm = [1 / np.sqrt(max(1, len(i))) for i in xs]  # long texts have as much say as short ones
    cost = COST * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w, bias, alpha = np.zeros(at.size), 0.0, np.zeros(len(y))
    diag = np.array([(r[i] ** 2).sum() * k * k + 1 for i, k in zip(xs, norm)])
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        moved = 0.0
        for j in rng.permutation(len(y)):
            i = xs[j]
            g = y[j] * ((w[i] * r[i]).sum() * norm[j] + bias) - 1
            new = min(max(alpha[j] - g / diag[j], 0.0), cost[j])
            if d := (new - alpha[j]) * y[j]:
                w[i] += d * norm[j] * r[i]
                bias += d
                alpha[j] = new
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    margin = np.array([(w[i] * r[i]).sum() * k + bias for i, k in zip(xs, norm)])
    a, b = 1.0, 0.0  # logistic curve of the margin, smoothed targets, the classes as they come in the sample weighed evenly
    hit = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2))
    share = cost / cost.sum()
    for _ in range(300):
        e = share * (1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30))) - hit)
        s = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        h = share * s * (1 - s)
        m = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(m, [(e * margin).sum(), e.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-6:
            break
    v = np.zeros(SLOTS, np.float32)
    v[at] = w * r
    return {"w": v, "bias": bias, "a": float(a), "b": float(b)}


def score(model: dict, grams: Grams, text: str | None) -> float:
    m = 0.0
    if model["w"] is not None:
        known = model["w"][grams(text)]
        known = known[known != 0].astype(np.float64)
        m = known.sum() / max(1, known.size) ** 0.5 + model["bias"]
    return float(1 / (1 + np.exp(-np.clip(model["a"] * m + model["b"], -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> dict:
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q_")).withColumnRenamed("doc_id", "k_")
    marks = marks.where(crc_mod(F.col("k_"), 5) != 0)
    ids = []
    for q in (0, 1):
        ids.append(marks.where(F.col("q_") == q).orderBy(F.xxhash64("k_"), "k_").limit(SAMPLE))
    picked = F.broadcast(ids[0].unionAll(ids[1]))  # 2 * SAMPLE rows at most
    got = docs.select(F.col(id_col).alias("i_"), F.col(text_col).alias("t_")).join(picked, F.col("i_") == F.col("k_")).groupBy("i_", "q_").agg(F.min(F.coalesce("t_", F.lit(""))).alias("t_")).collect()
    got.sort(key=lambda r: r[0])
    return train([r[2] for r in got], [r[1] for r in got])


def classify(docs: DataFrame, model: dict, id_col="doc_id", text_col="text", rid_col: str | None = None) -> DataFrame:
    """A row for each row of docs: rid (rid_col, else 0), doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights

    def run(batches):
        m, grams = held.value, Grams()
        for b in batches:
            s = [score(m, grams, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], ["rid", "doc_id", "held_out", "score", "predicted"])

    rid = (F.col(rid_col) if rid_col else F.lit(0)).cast("long").alias("rid")
    src = docs.select(rid, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc_mod(F.col(id_col), 5) == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "rid long, doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """Docs that the model doesn't reject, in one pass; every column stays, whatever its name."""
    rows, at = plain(docs)
    held, text = docs.sparkSession.sparkContext.broadcast(model), at("text")

    def run(batches):
        m, grams = held.value, Grams()
        for b in batches:
            yield b.filter(pa.array([score(m, grams, t) >= THRESHOLD for t in b.column(text).to_pylist()], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("rid")
