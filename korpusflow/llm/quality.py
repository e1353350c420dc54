"""Quality rules: exact base counts and a calibrated logistic regression over hashed word and character n-grams.

The model is trained on at most `max_rows` labelled rows of `max_chars` code points together (the first by a hash of
doc_id, so the sample is the same at every size), a fifth of which only calibrates it, and scores every whole text in Arrow batches against a fixed threshold.

Cases: a null text counts as empty; texts without words fail the base rule; a null doc_id is scored like any other; rows
that repeat are scored alike; labels that are null, repeated or contradict (the smallest counts, and of texts with one id the least) or whose document is
missing don't matter; without labels of both classes the model keeps all (or none) that it saw; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpusflow.llm.common import coded, hashes, materialize, mix, words
from korpusflow.llm.ngrams import Grams, calibrate, fit

MAX_TRAIN_ROWS, MAX_TRAIN_CHARS = 2000, 6_000_000
KEEP_AT = 0.5
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
GAPS = b" \t\n\x0b\x0c\r"
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def sampled(labels: DataFrame, label: str, max_rows: int, where: str = "true") -> DataFrame:
    """doc_id, label of at most max_rows labelled documents: those whose hash is least."""
    clean = labels.filter(f"{label} in (0, 1) and doc_id is not null").filter(where).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    return clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS, max_chars: int = MAX_TRAIN_CHARS) -> dict:
    """The model: hashed weights, bias, and the calibration's slope and offset."""
    chosen = sampled(labels, label, max_rows)

    def run(batches):
        for batch in batches:
            rows = Grams(batch.column(2)).sparse()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))],
                ["doc_id", "label", "at", "value"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    # Rows that repeat an id are trained on once, so that max_rows bounds them.
    rows = materialize(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "quality-sample")
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over max_rows lengths
    few = rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).withColumn("sum", F.sum("n").over(upto)).filter(F.col("sum") <= max_chars)
    rows = rows.join(F.broadcast(few.select("doc_id")), "doc_id", "left_semi")
    got = rows.mapInArrow(run, "doc_id long, label int, at array<int>, value array<float>").toArrow().sort_by("doc_id")
    y = np.asarray(got["label"]).astype(float) if got.num_rows else np.zeros(0)
    x = [(np.asarray(a.values).copy(), np.asarray(v.values).copy()) for a, v in zip(got["at"], got["value"])]
    del got
    held = np.array([i % 5 == 0 for i in range(len(y))], bool)
    w, bias = fit([r for r, h in zip(x, held) if not h], y[~held])
    margins = np.array([(w[a] * v).sum() + bias for (a, v), h in zip(x, held) if h])
    slope, offset = calibrate(margins, y[held]) if len(margins) else (1.0, 0.0)
    return {"weights": w.astype(np.float32), "bias": bias, "slope": slope, "offset": offset}


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    flat, ends = words(texts, lower=False)
    codes, distinct = coded(flat)
    h = hashes(distinct)[codes] if distinct else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(h) - WINDOW + 1), np.uint64)
        for k in range(WINDOW):
            rolled = mix(rolled + h[k : k + len(rolled)])
    n = len(ends) - 1
    out = {k: np.zeros(n, np.int64) for k in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"n_words": np.diff(ends)}
    for i, text in enumerate(texts.to_pylist()):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        out["word_chars"][i] = len(text) - (len(raw) - len(raw.translate(None, GAPS)))
        out["n_symbols"][i] = len(raw) - len(raw.translate(None, SYMBOLS))
        seen, again = set(), 0
        for line in raw.split(b"\n"):
            if line in seen:
                again += 1
            elif line.strip(GAPS):
                seen.add(line)
        out["n_dup_lines"][i] = again
        a, b = ends[i], ends[i + 1]
        if b - a > WINDOW:
            mine = rolled[a : b - WINDOW + 1]
            order = np.argsort(mine, kind="stable")
            same = mine[order[1:]] == mine[order[:-1]]
            if same.any():
                twice = np.zeros(len(mine), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                depth = np.zeros(b - a + 1, np.int64)
                depth[: len(mine)] += twice
                depth[WINDOW : WINDOW + len(mine)] -= twice
                out["n_repeat_words"][i] = int((np.cumsum(depth[:-1]) > 0).sum())
    return out


def score(docs: DataFrame, model: dict, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the base counts, base_failed, quality (calibrated probability of label 1) and kept, for every row."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            base = base_counts(texts)
            margin = Grams(texts).scores(model["weights"]) + model["bias"]
            good = 1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["offset"], -30, 30)))
            failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
            cols = [base[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, cols), pa.array(failed), pa.array(~failed & (good >= keep_at)), pa.array(good)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, BASE + ", base_failed boolean, kept boolean, quality double")
