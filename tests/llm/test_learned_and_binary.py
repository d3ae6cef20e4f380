"""Search and archives against brute force, fitted scorers by held-out accuracy, the pipeline end to end."""

from __future__ import annotations

import collections
import hashlib
import struct

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from barlight.llm import components, quality, topk, toxicity, warc
from barlight.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


# ---- search -------------------------------------------------------------------------------------------------------
def brute_top(rows, k, every):
    usable = [(i, np.floor(64 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max([len(v) for _, v in usable], default=0)
    usable = [(i, np.pad(v, (0, dims - len(v)))) for i, v in usable]
    out = set()
    for q in {i for i, _ in usable if i % every == 0}:
        query = next(v for i, v in usable if i == q)
        scores = sorted((-int(query @ v), i) for i, v in usable if i != q)[:k]
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)}
    return out


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=12)]) for i in range(700)]
    rows += [(700 + i, [0.5] * 12) for i in range(200)]  # ties
    rows += [(5000, None), (5001, [float("nan")] * 12), (5002, [1.0, None]), (5003, []), (5004, [1.0, 2.0]), (None, [1.0] * 12), (5020, [float("inf")] * 12)]
    frame = spark.createDataFrame([(i, v, 3, 1) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    got = topk.top_k(frame).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 20, 20) and len(got) == len(set(got))


def test_top_k_over_chunks_lanes_and_tiles(spark, monkeypatch):
    for name, value in {"TILE": 64, "RANGE": 2, "CHUNK": 30, "WORK": 2000, "SEEDS": 40}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    rows = [(int(i) % 1000, [float(x) for x in rng.normal(size=9) * wide]) for i, wide in enumerate(rng.choice([0.1, 1, 100, 1e5], 1100))]  # ids repeat
    rows += [(2000 + i, [-0.0, 0.25, 1.0]) for i in range(150)]  # ties
    rows = [r for n, r in enumerate(rows) if r[0] % 20 or r[0] not in {x for x, _ in rows[:n]}]
    assert min(topk.layout(1200, 60, 9, 20)) > 1
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 20, 20) and len(got) == len(set(got))


def test_top_k_takes_the_smallest_of_query_rows_with_an_id(spark):
    rows = [(20, [1.0, 2.0]), (20, [2.0, 1.0]), (20, [-0.0, 3.0]), (21, [1.0, 0.0]), (22, [0.0, 1.0])]
    least = min((np.floor(64 * np.array(v)).astype("<f8").tobytes(), v) for i, v in rows if i == 20)[1]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert {tuple(r) for r in got} == brute_top([(20, least), *rows[3:]], 20, 20)


def test_top_k_ships_no_vectors_once_per_thousand_queries(spark):
    frame = spark.range(400).selectExpr("id as vec_id", "transform(sequence(1, 8), i -> cast(sin(id * i) as float)) as embedding")
    plan = topk.top_k(frame)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Broadcast" not in plan  # copies of all queries, one for each lane, met the blocks in a join that may broadcast them
    for total in (720_000, 2_160_000, 22_000_000):  # bytes dealt stay below four times the input of four bytes a value
        chunks, lanes = topk.layout(total, total // 20, 64, 20)
        assert chunks * total * 72 + lanes * (total // 20) * (72 + 16 + 20 * 24) < 4 * total * 280
    assert max(topk.layout(50_000, 2_500, 64, 20)) == 1


def test_top_k_skips_blocks_of_other_clusters():
    rng = np.random.default_rng(4)
    vectors = np.floor(64 * (rng.normal(size=(50, 32))[:, None] + rng.normal(size=(50, 80, 32)) * 0.02)).reshape(-1, 32)
    vectors = vectors[np.argsort(topk.cells(vectors), kind="stable")]
    ids = rng.permutation(len(vectors))
    search = topk.Search(ids[::20], vectors[::20], 5)
    for start in range(0, len(ids), 400):
        search.meet(ids[start : start + 400], vectors[start : start + 400])
    row, key, score = search.result()
    want = {(q, i, -s) for q, at in enumerate(range(0, len(ids), 20)) for s, i in sorted((-int(s), int(i)) for s, i in zip(vectors @ vectors[at], ids) if i != ids[at])[:5]}
    assert set(zip(row.tolist(), key.tolist(), score.tolist())) == want and search.visited < 0.5 * search.blocks


def test_top_k_of_few_and_of_none(spark):
    frame = spark.createDataFrame([(20, [1.0]), (21, [2.0]), (22, [-1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(frame).orderBy("rank").collect()] == [(20, 1, 21, 8192), (20, 2, 22, -4096)]
    assert topk.top_k(frame.limit(0)).count() == 0


# ---- archives -----------------------------------------------------------------------------------------------------
def test_archives_round_trip(spark, tmp_path):
    big, small = "<p>" + "same payload é " * 200, "<p>tiny</p>"
    rows = [(1, "u1", big), (2, None, big), (3, "u3", big), (4, "u4", small), (5, "u5", small), (6, "u6", None), (7, "u7", ""), (None, "n", big), (8, "a\r\nb", "x" * 300_000), (3, "u3", big)]
    rows += [(100 + i, f"http://host/{i}", f"<html>{'lorem ipsum ' * 20}{i}</html>") for i in range(60)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/archives"
    warc.write_archives(pages, path, archive_bytes=100_000)
    got = warc.read_archives(spark, path).collect()
    data = lambda h: (h or "").encode()
    want = collections.Counter()
    for key, _, html in rows:
        revisit = html == big and key != 3
        want[key, len(data(html)), hashlib.sha1(data(html)).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")
    for file in (tmp_path / "archives").glob("part-*"):
        archive = file.read_bytes()
        magic, size = struct.unpack_from("<II", archive)
        assert magic == warc.DICTIONARY_MAGIC
        first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size])).decompressobj()
        start = 8 + size + len(warc.SEPARATOR)
        assert first.decompress(archive[start:]).startswith(b"WARC/1.1\r\n") and first.unused_data  # each record is a frame of its own
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


# ---- components ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("local", [10**6, 4])
def test_components_equal_search(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_LINKS", local)
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(12)]
    label = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in links:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} == set(label.items())


# ---- fitted scorers -----------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]


def odd_rows(spark):
    return spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", None, -5), (900002, "idiot " * 40_000, "xx", "s", 7), (900002, "x", None, "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    got = toxicity.score_documents(docs.unionByName(odd_rows(spark)), labels).toPandas()
    assert len(got) == docs.count() + 4 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    joined = got.merge(labels.toPandas(), on="doc_id")
    flagged, held = joined[joined.predicted == 1], joined[joined.held_out]
    assert flagged.toxic.mean() > 0.9 and held[held.toxic == 1].predicted.mean() > 0.5
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    assert toxicity.score_documents(docs, labels.limit(0)).filter("score != 0").count() == 0


def test_label_model_finds_accuracies_and_dependence():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    flip = lambda p: np.where(rng.random(len(y)) < p, ~y, y)
    said = [flip(0.1), flip(0.15), flip(0.2), flip(0.5)]
    said.append(np.where(rng.random(len(y)) < 0.03, ~said[0], said[0]))  # nearly repeats the first
    patterns, counts = np.unique(np.where(np.array(said).T, 1, -1), axis=0, return_counts=True)
    model = toxicity.LabelModel(patterns, counts.astype(float))
    assert any({0, 4} <= set(c) for c in model.cliques) and abs(model.share - 0.2) < 0.06
    right = (model.posterior(np.where(np.array(said).T, 1, -1)) > 0.5) == y
    assert right.mean() > 0.9


def test_quality_scores(spark, tables):
    docs, labels = tables
    got = quality.score_documents(docs.unionByName(odd_rows(spark)), labels).toPandas()
    joined = got.merge(labels.toPandas(), on="doc_id")
    assert len(got) == docs.count() + 4 and ((joined.quality == 1) == joined.accepted).mean() > 0.95
    kept = quality.keep_accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality.score_documents(docs, labels).filter("accepted").count()
    assert quality.score_documents(docs, labels.filter("quality = 1")).filter("not accepted").count() == 0
    assert quality.score_documents(docs.limit(0), labels).count() == 0


# ---- registry and pipeline ----------------------------------------------------------------------------------------
def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline_stages_keep_columns_and_shrink(spark, tables):
    docs = tables[0]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.durable(out)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[2] == sizes[3] and sizes[-1] > 0.6 * sizes[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()
