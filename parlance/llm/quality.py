"""Quality classifier: Bradley-Terry scores of documents from preference pairs.

Every document has a vector of features of its text alone. A labelled good document is
preferred to a labelled bad one; weights are fitted to such pairs by the logistic loss of the
difference of the two vectors (Bradley and Terry's model, with a linear strength). A strength
becomes a score by the quantiles of the training strengths: the cut is the strength at the
quantile that separates the classes best, and the score of the cut is ``CUT``.

At most ``MAX_LABELLED`` labelled documents, those with the smallest md5 of their id, are
used to fit; each is paired with ``PAIRS`` of the other class. All documents are scored.

Edge cases: a null or empty text has the features of an empty text and a score of its own; a
null id is in no fold's held-out part; an id that is labelled more than once counts
once if its labels agree and not at all otherwise, and of several texts of an id the one with the
smallest features is learnt from; ties of strengths have one score; a very long text has the
features of the whole; without labels of both classes every score is 1; an empty table gives an
empty result; other columns are kept, but one named score is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import documents, fold, release

MAX_LABELLED, PAIRS, CUT = 20_000, 8, 0.7
FOLDS, HELD_OUT = 4, 2

_CLASSES = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".", b",", b"!?", b"|", b"#$%&*@~^+=<>\\/_{}[]", b"'\"()-:;`"), 1):
    _CLASSES[list(_chars)] = _i
_CLASSES[128:] = 11
N_CLASSES = 12
N_FEATURES = N_CLASSES + 11


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes, shapes of words and lines, and how much repeats."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES)
    if not data:
        out[-1] = 1
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_CLASSES, weights=counts, minlength=N_CLASSES)
    out[:N_CLASSES] = kinds / len(data)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n = max(1, len(words))
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    out[N_CLASSES:] = (
        np.log1p(len(words)) / 10,
        distinct / n,
        pairs / max(1, len(words) - 1),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))) / 5,
        len(data) / n / 10,
        max(map(len, words), default=0) ** 0.5 / 10,
        np.log1p(counts[33:127].max() / n),
        (kinds[7] + kinds[8] + kinds[9]) / n,
        kinds[1] / n,
        0,
    )
    return out


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, rounds: int = 40) -> dict:
    """Weights by Newton's method on pairs, and the cut between the classes."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - centre) / scale, -8, 8)
    ups, downs = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(ups) or not len(downs):
        return {"centre": centre, "scale": scale, "w": np.zeros(x.shape[1]), "cut": 0.0, "slope": 0.0}
    steps = np.arange(pairs)
    many, few = (ups, downs) if len(ups) >= len(downs) else (downs, ups)
    partner = few[(np.arange(len(many))[:, None] * pairs + steps * 7919) % len(few)].ravel()
    first = np.repeat(many, pairs)
    d = z[first] - z[partner] if many is ups else z[partner] - z[first]
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = d.T @ p / len(d) - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1, 3 / (np.linalg.norm(step) + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    wrong = np.concatenate([[0], np.cumsum(np.where(good[order], 1, 0))]) + np.concatenate([np.cumsum(np.where(good[order], 0, 1)[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    quantile = best[len(best) // 2] / len(s)
    cut = float(np.quantile(s, quantile, method="hazen"))
    return {"centre": centre, "scale": scale, "w": w, "cut": cut, "slope": 2 / (s.std() + 1e-9)}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    # a sum for each row, so that a text's score doesn't depend on the rows beside it
    s = (np.clip((x - model["centre"]) / model["scale"], -8, 8) * model["w"]).sum(1)
    if not model["slope"]:
        return np.ones(len(x))
    at = np.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip((s - model["cut"]) * model["slope"] + at, -30, 30)))


def _vectors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            x = [features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.array(x, pa.list_(pa.float64()))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> dict:
    """The model from at most ``most`` labelled documents that aren't held out."""
    known = labels.where(F.col("quality").isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT))
    known = known.groupBy(F.col("doc_id").cast("long")).agg(F.min("quality").alias("low"), F.max("quality").alias("quality")).where("low = quality")
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most).select("doc_id", "quality")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    one = _vectors(texts).groupBy("doc_id").agg(F.min("x").alias("x"))  # of the rows of an id
    rows = one.join(chosen, "doc_id").collect()  # at most ``most`` short vectors
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(-1, N_FEATURES)
    if not len(x):
        x = np.zeros((1, N_FEATURES))
        return fit(x, np.array([True]))
    return fit(x, np.array([r["quality"] == 1 for r in rows]))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with a score; its other columns are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            yield batch.append_column("score", pa.array(score(model, x)))

    docs = docs.drop("score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, and whether it is at least ``CUT``."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
