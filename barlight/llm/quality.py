"""Quality by co-training of two views.

The text view sees word shapes, repetition and word lengths; the metadata view sees language, source, length and line layout. Each view is a linear
classifier fitted to a bounded sample of labelled rows. Over some rounds each view labels the rows of a bounded unlabelled pool that it is
surest of, and hands them to the other view. Both are then calibrated and combined on labelled rows that neither was fitted to, and score
every document in one map over whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from barlight.llm.common import slices
from barlight.llm.logistic import fit_dense, sigmoid

MAX_LABELLED = 20_000
MAX_POOL = 20_000
ROUNDS = 4
PER_ROUND = 400
CONFIDENCE = 0.97
PENALTY = 1e-3
SHAPES = 64
LANGS, SOURCES = 8, 32
LEFT_OUT = 5
"""One labelled row in so many is kept for calibration."""


class WordShapes:
    """Shape of a word: runs of lower case, upper case and digits by one sign, other characters as they are."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            signs = "".join("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
            shape = re.sub(r"(.)\1+", r"\1", signs)[:24]
            found = self.known[word] = zlib.crc32(shape.encode()) % SHAPES
        return found


def text_view(texts: pa.Array, shapes: WordShapes) -> np.ndarray:
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    distinct, index = coded.dictionary, coded.indices.to_numpy()
    borders = split.offsets.to_numpy() - split.offsets[0].as_py()
    n = np.diff(borders)
    rows = len(n)
    doc = np.repeat(np.arange(rows), n)
    share = 1 / np.maximum(n, 1)
    shape = np.array([shapes.bucket(w) for w in distinct.to_pylist()] or [0])
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(1)
    out = np.zeros((rows, SHAPES + 4))
    if len(index):
        out[:, :SHAPES] = np.bincount(doc * SHAPES + shape[index], minlength=rows * SHAPES).reshape(rows, SHAPES) * share[:, None]
        again = (index[1:] == index[:-1]) & (doc[1:] == doc[:-1])
        out[:, SHAPES] = np.bincount(doc[1:][again], minlength=rows) * share
        pairs = np.unique(doc * len(distinct) + index)
        out[:, SHAPES + 1] = np.bincount(pairs // len(distinct), minlength=rows) * share
        out[:, SHAPES + 2] = np.bincount(doc, length[index], rows) * share
    out[:, SHAPES + 3] = np.log1p(n)
    return out


def metadata_view(part: pa.RecordBatch) -> np.ndarray:
    rows = part.num_rows
    out = np.zeros((rows, LANGS + SOURCES + 5))
    for name, first, size in (("lang", 0, LANGS), ("source", LANGS, SOURCES)):
        for row, value in enumerate(part.column(name).to_pylist()):
            if value is not None:
                out[row, first + zlib.crc32(value.encode()) % size] = 1
    chars = pc.cast(part.column("n_chars"), pa.float64())
    out[:, -5] = np.log1p(np.maximum(pc.fill_null(chars, 0.0).to_numpy(zero_copy_only=False), 0))
    out[:, -4] = pc.is_null(part.column("n_chars")).to_numpy(zero_copy_only=False)
    texts = pc.fill_null(part.column("text"), "")
    lines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False) + 1
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    out[:, -3], out[:, -2], out[:, -1] = np.log(lines), np.log1p(size / lines), np.log1p(size)
    return out


class View:
    """Standardised linear classifier of one view."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> View:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        balance = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        self.weights, self.intercept = fit_dense(self._standard(x), y, balance, PENALTY)
        return self

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._standard(x) @ self.weights + self.intercept


class CoTrained:
    """Two views that taught each other, and their calibrated combination."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], calibrate: np.ndarray):
        taught = [(x[~calibrate], y[~calibrate]) for x in views]
        free = np.arange(len(pool[0]))
        share = float(np.clip(y.mean(), 0.05, 0.95))
        for _ in range(ROUNDS):
            self.views = [View().fit(*t) for t in taught]
            sure = [sigmoid(v.logit(x[free])) if len(free) else np.zeros(0) for v, x in zip(self.views, pool)]
            used = np.zeros(len(free), bool)
            for giver, taker in ((0, 1), (1, 0)):
                p = sure[giver]
                for label, confidence, most in ((1.0, p, int(PER_ROUND * share)), (0.0, 1 - p, int(PER_ROUND * (1 - share)))):
                    chosen = np.argsort(-confidence, kind="stable")[:most]
                    chosen = chosen[confidence[chosen] >= CONFIDENCE]
                    used[chosen] = True
                    x, t = taught[taker]
                    taught[taker] = np.concatenate([x, pool[taker][free[chosen]]]), np.concatenate([t, np.full(len(chosen), label)])
            if not used.any():
                break
            free = free[~used]
        self.views = [View().fit(*t) for t in taught]
        held = y[calibrate] if calibrate.any() and 0 < y[calibrate].mean() < 1 else y
        rows = calibrate if held is not y else np.ones(len(y), bool)
        logits = [v.logit(x[rows]) for v, x in zip(self.views, views)]
        even = np.ones(len(held))
        self.curves = []
        for z in logits:
            slope, shift = fit_dense(z[:, None], held, even, 1e-4)
            self.curves.append((max(float(slope[0]), 0.0), shift))
        joint = np.stack([a * z + b for (a, b), z in zip(self.curves, logits)], axis=1)
        self.mix, self.shift = fit_dense(joint, held, even, 1e-4)
        self.mix = np.maximum(self.mix, 0)

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of text view, metadata view and both."""
        each = [a * v.logit(x) + b for (a, b), v, x in zip(self.curves, self.views, views)]
        return sigmoid(each[0]), sigmoid(each[1]), sigmoid(np.stack(each, axis=1) @ self.mix + self.shift)


def views_of(part: pa.RecordBatch, shapes: WordShapes) -> list[np.ndarray]:
    return [text_view(part.column("text"), shapes), metadata_view(part)]


def train(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    """The model, or None where the labels don't hold both classes."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    labelled = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    others = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).join(known, "doc_id", "left_anti").distinct()
    pool = others.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_POOL).withColumn("y", F.lit(None).cast("double"))
    sample = F.broadcast(labelled.unionByName(pool))  # at most MAX_LABELLED + MAX_POOL rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = WordShapes()
        for part in slices(batches, "text"):
            x = [v.astype("<f4") for v in views_of(part, shapes)]
            columns = [part.column("key"), part.column("y"), *(pa.array([r.tobytes() for r in v], pa.binary()) for v in x)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "y", "text_view", "metadata_view"])

    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").join(sample, "doc_id").withColumn("key", F.xxhash64("doc_id"))
    table = rows.mapInArrow(run, "key long, y double, text_view binary, metadata_view binary").toArrow().sort_by("key")
    y = table.column("y").to_numpy()
    views = [np.array([np.frombuffer(v, "<f4") for v in table.column(c).to_pylist()], float) for c in ("text_view", "metadata_view")]
    seen = ~np.isnan(y) if len(y) else np.zeros(0, bool)
    if not seen.any() or not 0 < y[seen].mean() < 1:
        return None
    calibrate = table.column("key").to_numpy()[seen] % LEFT_OUT == 0
    if not 0 < y[seen][~calibrate].mean() < 1:
        calibrate = np.zeros(len(calibrate), bool)
    return CoTrained([v[seen] for v in views], y[seen], [v[~seen] for v in views], calibrate)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every document (doc_id, text, lang, source, n_chars), learned from *labels* (doc_id, quality).

    Returns one row per input row: doc_id, p_text, p_metadata, score (0 to 1, higher: better) and accepted (score >= 0.5). Null and empty texts are
    scored as texts without words, null metadata as missing; labels without id or value are ignored, and of several labels of an id the smallest
    counts; null ids are scored but never learned from; repeated rows give repeated rows; an empty table gives an empty one. Where labels don't hold
    both classes, every score is 1 and all are accepted. Other columns are ignored.
    """
    source = docs.select("doc_id", "text", "lang", "source", "n_chars")
    model = train(source, labels)
    names = ["doc_id", "p_text", "p_metadata", "score", "accepted"]
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, p_text double, p_metadata double, score double, accepted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = WordShapes()
        for part in slices(batches, "text"):
            scores = model.score(views_of(part, shapes)) if model else [np.ones(part.num_rows)] * 3
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, scores), pa.array(scores[2] >= 0.5)], names)

    return source.mapInArrow(run, schema)


def keep_accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The accepted documents, with all their columns.

    What the views read goes to Python and verdicts come back: the rows themselves stay in the JVM.
    """
    model = train(docs.select("doc_id", "text", "lang", "source", "n_chars"), labels)
    if model is None:
        return docs

    @F.arrow_udf("boolean")
    def accepts(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        shapes = WordShapes()
        for read in columns:
            batch = pa.record_batch(list(read), ["text", "lang", "source", "n_chars"])
            yield pa.array(np.concatenate([model.score(views_of(part, shapes))[2] >= 0.5 for part in slices(iter([batch]), "text")] or [np.zeros(0, bool)]))

    return docs.filter(accepts("text", "lang", "source", "n_chars"))
