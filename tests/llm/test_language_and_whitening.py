"""Language identification against a plain parser and by held-out accuracy; whitening against a dense eigensolver."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from barlight.llm import language, whitening
from barlight.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


# ---- language -----------------------------------------------------------------------------------------------------
def plain_phrases(sample: str, text: str) -> int:
    """Greedy phrases by substring search, block by block."""
    count = 0
    for first in range(0, len(text), language.BLOCK):
        block, at = text[first : first + language.BLOCK], 0
        while at < len(block):
            size = 1
            while at + size < len(block) and block[at : at + size + 1] in sample:
                size += 1
            at += size
            count += 1
    return count


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", min_size=1, max_size=60), st.lists(st.text("abcd ", max_size=80), min_size=1, max_size=5))
def test_phrases_equal_substring_search(sample, texts):
    automaton = language.Automaton(np.array([ord(c) for c in sample], np.uint32))
    texts = sorted(texts, key=len, reverse=True)
    signs = np.array([ord(c) for t in texts for c in t], np.uint32)
    size = np.array([len(t) for t in texts])
    got = automaton.phrases(signs, np.cumsum(size) - size, size)
    assert got.tolist() == [plain_phrases(sample, t) for t in texts]


def test_costs_and_blocks_equal_plain_version():
    samples = {"x": "the cat sat on the mat and the dog lay down", "y": "el gato y el perro estaban en la casa"}
    known = language.Languages({k: np.array([ord(c) for c in v], np.uint32).tobytes() for k, v in samples.items()})
    texts = ["The CAT, the dog!", "el perro 99 casa", None, "", "12 %% 34", "la " * 700 + "the mat", "ж", "the"]
    names, scores = known.predict(texts)
    for text, name, score in zip(texts, names, scores):
        folded = language.Folding().fold([text])[0]
        letters = "".join(map(chr, folded))
        if not text or not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0)
            continue
        cost = {k: plain_phrases(v, letters) * math.log2(len(v) + 1) / len(letters) for k, v in samples.items()}
        assert name == min(cost, key=lambda k: (round(cost[k], 12), k))
        assert score == pytest.approx(1 / sum(2.0 ** -((c - min(cost.values())) * math.sqrt(len(letters))) for c in cost.values()))


def test_folding():
    signs, sizes, letters = language.Folding().fold(["  Ä-b\n\nC ", None, "", "́x", "77", "  "])
    assert "".join(map(chr, signs)) == "ä b c ́x" and sizes.tolist() == [6, 0, 0, 2, 0, 0] and letters.tolist() == [True, False, False, True, False, False]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op11_language_id"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = {r.doc_id: r for r in got.collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert rows.keys() == truth.keys() and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [r for r in rows.values() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    swapped = docs.withColumn("lang", language.F.when(language.is_held_out("doc_id"), "zz").otherwise(language.F.col("lang")))
    assert {(r.doc_id, r.lang_pred) for r in language.identify(swapped).collect()} == {(i, r.lang_pred) for i, r in rows.items()}


def test_language_of_odd_rows(spark):
    rows = [(i, f"the cat {i} and the dog", "en") for i in range(40)] + [(100 + i, f"el gato {i} y el perro", "es") for i in range(40)]
    rows += [(None, "xyz xyz", "q"), (200, None, "r"), (201, "el gato", None), (202, "", "en"), (203, "123", "en"), (204, "el " * 60_000, None), (1, "the cat 1 and the dog", "en")]
    rows += [(300, "the dog", "en")] * 500
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, lang string, score int, h string").repartition(4)
    got = sorted((tuple(r) for r in language.identify(frame).collect()), key=str)
    assert len(got) == len(rows)
    of = {r[0]: r for r in got}
    assert of[None][1] is False and of[200][2:] == ("und", 0.0) and of[202][2:] == of[203][2:] == ("und", 0.0) and of[201][2] == of[204][2] == "es" and of[300][2] == "en"
    assert language.identify(frame.limit(0)).collect() == []
    nothing = language.identify(frame.withColumn("lang", language.F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


# ---- whitening ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["even", "falling", "rank", "equal", "two", "close", "pairs", "zero", "one"])
def test_contour_solver_equals_dense_solver(name):
    rng = np.random.default_rng(3)
    turn, _ = np.linalg.qr(rng.normal(size=(48, 48)))
    matrix = {
        "even": lambda: np.cov(rng.normal(size=(900, 48)).T), "falling": lambda: np.cov((rng.normal(size=(900, 48)) * np.logspace(0, -4, 48)).T),
        "rank": lambda: np.cov((rng.normal(size=(300, 7)) @ rng.normal(size=(7, 48))).T), "equal": lambda: np.eye(48), "two": lambda: np.diag([5.0] * 40 + [1.0] * 8),
        "close": lambda: (turn * (1 + 1e-10 * np.arange(48))) @ turn.T, "pairs": lambda: (turn * np.repeat(np.arange(1, 25), 2)) @ turn.T, "zero": lambda: np.zeros((4, 4)), "one": lambda: np.array([[2.0]]),
    }[name]()
    values, vectors = whitening.leading_eigenpairs(matrix, 32)
    truth = np.sort(np.linalg.eigvalsh(matrix))[::-1][:32]
    truth = truth[truth > 1e-10 * max(truth.max(), 1e-300)]
    assert len(values) == len(truth) == {"rank": 7, "zero": 0, "one": 1}.get(name, 32)
    assert np.allclose(values, truth, rtol=1e-9, atol=1e-13 * matrix.max())
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12) and np.allclose(matrix @ vectors, vectors * values, atol=1e-12 * max(matrix.max(), 1))


def test_inertia_counts():
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(30, 30))
    matrix += matrix.T
    truth = np.linalg.eigvalsh(matrix)
    assert [whitening.count_above(matrix, s) for s in np.linspace(-14, 14, 41)] == [(truth > s).sum() for s in np.linspace(-14, 14, 41)]


def plain_whitened(rows, components=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(rows), x.sum(axis=0)
    centred = n * x - sums
    deviation = (centred**2).sum(axis=1)
    y = centred.astype(float) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, deviation, values / np.trace(y.T @ y / n), np.abs(y @ axes / np.sqrt(values))


def test_whitening_equals_dense_solver(spark):
    source = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in source.select("vec_id", "embedding").collect()]
    n, deviation, shares, whitened = plain_whitened(rows)
    got = QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.1")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    of = {(r.vec_id, r.component): r for r in got.collect()}
    assert len(of) == 32 * n and {r.n for r in of.values()} == {n} and {r.identity_error for r in of.values()}.pop() < 1e-9
    for at, (i, _) in enumerate(rows):
        line = [of[i, k] for k in range(1, 33)]
        assert {r.deviation for r in line} == {deviation[at]}
        assert np.allclose(np.abs([r.whitened for r in line]), whitened[at], atol=1e-7) and np.allclose([r.explained for r in line], shares, rtol=1e-9)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(60)] + [(None, [0.1, 0.2, 0.3, 0.4, 0.5]), (7, [1.0] * 5), (7, [1.0] * 5)]
    bad = [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 1.0, 1.0, 1.0]), (904, [1.0, float("nan"), 1.0, 1.0, 1.0]), (905, [float("inf")] * 5), (906, [1e300] * 5)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in good + bad], "vec_id long, embedding array<double>, n int, v int").repartition(3)
    got = whitening.whiten(frame).collect()
    n, deviation, shares, whitened = plain_whitened(good)
    assert len(got) == 5 * len(good) and {r.n for r in got} == {len(good)} and {r.vec_id for r in got} == {i for i, _ in good}
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    assert np.allclose(sorted(abs(r.whitened) for r in got), sorted(whitened.ravel()), atol=1e-9)
    assert whitening.whiten(frame.limit(0)).collect() == []
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(9)], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).collect() == []  # no direction in which they differ
