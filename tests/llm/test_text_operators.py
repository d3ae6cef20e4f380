"""Operators on texts against brute force and the tokenizers library, odd rows included."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from barlight.llm import bpe, licenses, line_templates, ngram_join, packing, rules

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, split int"
LIBRARY = Tokenizer.from_file(VOCABULARY)

PASSAGE = " ".join(f"word{i % 37}x{i}" for i in range(80))
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, PASSAGE), (6, PASSAGE + " more"), (7, PASSAGE), (7, PASSAGE), (None, "null id text here now"),
    (8, "A" * 9000), (9, ("long " * 50_000)), (10, "Ünï ΣΑΣ 中文 ２ \x1c x\x85y <|endoftext|> don't 's"), (11, "x\r\ny\r\nx"), (12, "# # # | | <a> $ %"),
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "clash", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- BPE ----------------------------------------------------------------------------------------------------------
def test_codec_equals_library(spark, odd, corpus):
    for frame in (odd, corpus):
        texts = collections.Counter((r["doc_id"], r["text"]) for r in frame.collect())
        want = collections.Counter()
        for (key, text), n in texts.items():
            ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
            decoded = LIBRARY.decode(ids, skip_special_tokens=False)
            want[key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded] += n
        got = bpe.encode(frame, VOCABULARY).collect()
        assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["decoded"]) for r in got) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), max_size=8))
def test_any_text_encodes_as_in_the_library(texts):
    ids, borders = bpe.encoder(VOCABULARY).encode(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, borders[:-1], borders[1:]):
        assert ids[a:b].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_segments_join_to_the_text():
    text = "word " * 500_000
    assert "".join(bpe.segments(text)) == text and len(list(bpe.segments(text))) > 1


# ---- packing ------------------------------------------------------------------------------------------------------
def check_packing(rows, texts):
    ids = {}
    for key, text in texts:
        ids.setdefault(key, []).append(np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    sequences = collections.defaultdict(list)
    lengths = collections.Counter()
    for r in rows:
        tokens = ids[r["doc_id"]][0]
        assert r["doc_tokens"] == len(tokens) and zlib.crc32(tokens[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {k: sum(map(len, v)) for k, v in ids.items()}
    used = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
        used.append(at)
    return sum(packing.CAPACITY - u for u in used) / (packing.CAPACITY * len(used))


def test_packing_is_exact_and_tight(spark, odd, corpus):
    rows = packing.pack(corpus, VOCABULARY).collect()
    starts = collections.Counter((r["doc_id"], r["start"]) for r in rows)
    assert max(starts.values()) == 1
    assert check_packing(rows, [(r["doc_id"], r["text"]) for r in corpus.collect()]) < 0.05
    check_packing(packing.pack(odd, VOCABULARY).collect(), ODD)
    assert packing.pack(odd.limit(0), VOCABULARY).count() == 0


def test_patterns_hold_the_demand():
    rng = np.random.default_rng(3)
    demand = {int(s): int(n) for s, n in zip(*np.unique(np.minimum(64, rng.geometric(0.08, 900)), return_counts=True))}
    plan = packing.cutting_patterns(demand, 64)
    held = collections.Counter()
    for pattern, copies in plan:
        assert copies > 0 and sum(s * n for s, n in pattern.items()) <= 64
        for s, n in pattern.items():
            held[s] += n * copies
    assert held == demand
    assert sum(c for _, c in plan) <= 1.03 * sum(s * n for s, n in demand.items()) / 64 + 2
    assert packing.cutting_patterns({}, 64) == []


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        weights = np.unique(rng.integers(1, 12, 4))
        values = rng.uniform(-0.2, 1, len(weights))
        best = np.zeros(21)
        for room in range(1, 21):
            best[room] = max([best[room - 1], *(best[room - w] + v for w, v in zip(weights, values) if w <= room)])
        value, counts = packing.knapsack(values, weights, 20)
        assert value == pytest.approx(best[20]) and counts @ values == pytest.approx(value) and counts @ weights <= 20


# ---- quality rules ------------------------------------------------------------------------------------------------
def brute_counts(text):
    data = (text or "").encode()
    words = data.split()
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in data.split(b"\n") if line.split()]
    return len(words), sum(len(w.decode()) for w in words), sum(data.count(bytes([b])) for b in b"#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_equal_brute_force(odd, corpus):
    for frame in (odd, corpus):
        want = collections.Counter()
        for r in frame.collect():
            n = brute_counts(r["text"])
            want[(r["doc_id"], *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
        got = rules.judge(frame).collect()
        assert collections.Counter(tuple(r)[:-1] for r in got) == want
        assert not any(r["kept"] and r["base_failed"] for r in got)


def test_order_of_rules_changes_no_verdict(corpus):
    texts = rules.Texts(pa.array([r["text"].encode() for r in corpus.collect()], pa.binary()))
    want = rules.cascade(texts, rules.RULES)
    for seed in range(5):
        assert np.array_equal(rules.cascade(rules.Texts(pa.array(texts.raw, pa.binary())), tuple(random.Random(seed).sample(rules.RULES, len(rules.RULES)))), want)
    assert {r.name for r in rules.plan_cascade(corpus)} == {r.name for r in rules.RULES}


def test_costly_statistics_are_counted_for_survivors_alone(corpus):
    order = tuple(sorted(rules.RULES, key=lambda r: r.name not in ("too_few_words", "many_symbols", "word_length")))  # the cheap ones first
    texts = rules.Texts(pa.array([r["text"].encode() for r in corpus.collect()], pa.binary()))
    everyone = np.arange(texts.n)
    cheap = np.logical_or.reduce([r.rejects(rules.Texts(pa.array(texts.raw, pa.binary())), everyone) for r in order[:3]])
    rules.cascade(texts, order)
    assert texts.evaluated["n_words"] == texts.n and 0 < texts.evaluated["n_repeat_words"] == (~cheap).sum() < texts.n
    assert texts.evaluated["n_shouted_words"] <= texts.evaluated["n_letter_words"] <= texts.evaluated["n_repeat_words"]


def test_rules_keep_whole_rows(odd):
    kept = rules.keep(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rules.judge(odd).filter("kept").collect()}
    assert rules.judge(odd.limit(0)).count() == 0


# ---- n-gram join --------------------------------------------------------------------------------------------------
def brute_components(rows, width, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[root(i)].append(key)
    named = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    return collections.Counter((key, len(sets[i]), named[root(i)]) for i, (key, _) in enumerate(rows))


def near_copies(seed=2, groups=6, size=12):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 300]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 25))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(400)}"
            rows.append((len(rows) + 100, " ".join(words)))
    shared = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, f"{shared} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(40)]
    return rows


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, width, percent):
    rows = [*ODD, *near_copies()]
    got = ngram_join.join_components(docs(spark, rows), width, percent).collect()
    assert collections.Counter(map(tuple, got)) == brute_components(rows, width, percent)


def test_one_of_each_group_stays(spark):
    rows = [*ODD, *near_copies()]
    kept = ngram_join.first_of_each(docs(spark, rows)).collect()
    groups = ngram_join.join_components(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({r["component_id"] for r in groups if r["component_id"] is not None})
    assert ngram_join.join_components(docs(spark, rows).limit(0)).count() == 0


def test_rows_with_null_or_repeated_ids_stay(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(30))
    rows = [(None, text(k)) for k in range(5)] + [(None, text(0)), (None, text(0) + " end"), (4, text(5)), (4, text(6)), (4, text(6)), (2, text(7)), (None, text(7) + " end"), (9, text(7))]
    rows += [(5, None), (5, ""), (None, None), (None, " ")]
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.first_of_each(docs(spark, rows)).collect()]
    rest = collections.Counter(kept)
    assert rest[None, text(0)] + rest[None, text(0) + " end"] == 1
    want = [(None, text(k)) for k in range(1, 5)] + [(4, text(5)), (4, text(6)), (2, text(7)), (5, None), (5, ""), (None, None), (None, " ")]
    assert collections.Counter(r for r in kept if r[1] not in (text(0), text(0) + " end")) == collections.Counter(want)


def test_large_tiles_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 4)
    rows = near_copies(seed=7, groups=3, size=30)
    got = ngram_join.join_components(docs(spark, rows), 4, 85).collect()
    assert collections.Counter(map(tuple, got)) == brute_components(rows, 4, 85)


# ---- lines --------------------------------------------------------------------------------------------------------
def test_recurring_templates_go_and_the_rest_stays(spark):
    own = lambda i, k: f"own line {k} of text {'abcdefghij'[i]} {'klmnopqrst'[i]} says {'uvwxyzabcd'[i]}"
    rows = [(i, f"{own(i, 1)}\nPage {i} of 20 was printed by server{i}\n{own(i, 2)}\nSubscribe to our letter today please") for i in range(10)]
    rows += [(20 + i, "a copied text\nthat is the same\nin all its copies") for i in range(6)]
    rows += [(30, None), (31, ""), (32, "\n\n"), (33, "Subscribe to our letter today please"), (None, "Page 7 of 9 was printed by server3\nand one more")]
    got = line_templates.drop_recurring_lines(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {r["doc_id"]: r["text"] for r in got}
    for i in range(10):
        assert text[i] == f"{own(i, 1)}\n{own(i, 2)}"
    assert all(text[20 + i] == rows[10 + i][1] for i in range(6))
    assert text[30] is None and text[31] == "" and text[32] == "\n\n" and text[33] == "" and text[None] == "and one more"
    assert line_templates.drop_recurring_lines(docs(spark, rows).limit(0)).count() == 0


def test_similar_lines_share_a_leaf_template(spark):
    names = ["Ann", "Bob", "Cid", "Dan", "Eve", "Fay"]
    rows = [(i, f"only here {n} q{i}a\nDear reader of this page you were greeted by {n} our editor this very morning\nand {n} only z{i}b") for i, n in enumerate(names)]
    got = line_templates.drop_recurring_lines(docs(spark, rows)).collect()
    assert all(r["n_dropped"] >= 1 and "Dear reader" not in r["text"] for r in got)


def unlike(i, k):
    return " ".join(f"{'abcdefghij'[(i * 7 + k * 3 + j) % 10]}{chr(97 + i % 26)}{chr(97 + k)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(12))


def test_whole_blocks_go_whatever_surrounds_them(spark):
    block = ["Follow us on all the networks", "Read our terms of use here", "All the rest is reserved"]
    rows = [(i, "\n".join([unlike(i, 0), unlike(i, 1), *block])) for i in range(12)]  # the block's last line ends the text
    rows += [(20 + i, f"{unlike(20 + i, 0)}\n\nA paragraph set off by blank lines\n\n{unlike(20 + i, 1)}") for i in range(12)]
    base = [unlike(40, k) for k in range(6)]
    rows += [(40 + i, "\n".join(line.replace(line.split()[i % 12], f"edit{'abcdefghij'[i]}") if i and k in (i % 6, (i + 2) % 6) else line for k, line in enumerate(base))) for i in range(10)]
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(docs(spark, rows)).collect()}
    assert all(got[i] == f"{unlike(i, 0)}\n{unlike(i, 1)}" for i in range(12))
    assert all("paragraph" not in got[20 + i] and unlike(20 + i, 0) in got[20 + i] and unlike(20 + i, 1) in got[20 + i] for i in range(12))
    assert all(got[40 + i] == dict(rows)[40 + i] for i in range(10))  # near copies of whole documents keep their lines


def test_near_copies_do_not_shield_a_passage(spark):
    passage = "A passage that many texts of all kinds hold in them"
    base = [unlike(50, k) for k in range(4)]
    rows = [(100 + i, "\n".join([base[0], base[1].replace(base[1].split()[3], f"edit{chr(97 + i % 26)}{chr(97 + i // 26)}"), base[2], passage, base[3]])) for i in range(60)]
    rows += [(i, f"{unlike(i, 0)}\n{passage}\n{unlike(i, 1)}") for i in range(8)]
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(docs(spark, rows)).collect()}
    assert all(got[i] == f"{unlike(i, 0)}\n{unlike(i, 1)}" for i in range(8))
    assert all(passage not in got[100 + i] and base[0] in got[100 + i] and base[3] in got[100 + i] for i in range(60))


def test_a_collecting_text_does_not_shield_a_passage(spark):
    passage = "A passage that eight texts and a digest of them hold"
    texts = {i: f"{unlike(i, 0)}\n{passage}\n{unlike(i, 1)}" for i in range(8)}
    digest = "\n".join(texts.values())
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(docs(spark, [*texts.items(), (99, digest)])).collect()}
    assert all(got[i] == f"{unlike(i, 0)}\n{unlike(i, 1)}" for i in range(8))  # what only a text and the digest hold stays
    assert got[99] == "\n".join(f"{unlike(i, 0)}\n{unlike(i, 1)}" for i in range(8))
    long = f"{unlike(70, 0)} {unlike(71, 0)}"
    whole = {i: f"{unlike(i, 0)} {unlike(i, 2)}\n{long}\n{unlike(i, 1)}" for i in range(8)}
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(docs(spark, [*whole.items(), (99, "\n".join(whole.values()))])).collect()}
    assert all(got[i] == f"{unlike(i, 0)} {unlike(i, 2)}\n{unlike(i, 1)}" for i in range(8))  # a long line of a text and its digest stays, too


def test_columns_of_any_name_stay(spark):
    rows = [(i, f"{unlike(i, 0)}\nSubscribe to our letter today please", i, f"h{i}", -i, [i], None) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _size long, _h string, h long, _lines array<long>, n_lines long")
    got = line_templates.drop_recurring_lines(frame)
    assert got.columns == ["doc_id", "text", "_size", "_h", "h", "_lines", "n_lines", "n_dropped"]
    assert {(r["doc_id"], r["_size"], r["_h"], r["h"], r["_lines"][0]) for r in got.collect()} == {(i, i, f"h{i}", -i, i) for i in range(5)}
    assert all(r["text"] == unlike(r["doc_id"], 0) and r["n_lines"] == 2 and r["n_dropped"] == 1 for r in got.collect())


def test_long_passages_of_two_texts_go(spark):
    passage = f"{unlike(60, 0)} {unlike(61, 0)}"
    rows = [(i, f"{unlike(i, 0)}\n{passage}\nShort and in two texts\n{unlike(i, 1)}") for i in range(2)]
    rows += [(10 + i, "\n".join([unlike(62, 0), unlike(62, 1) + f" changed{'ab'[i]}", f"{unlike(63, 0)} {unlike(64, 0)}", unlike(62, 2)])) for i in range(2)]
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(docs(spark, rows)).collect()}
    assert all(got[i] == f"{unlike(i, 0)}\nShort and in two texts\n{unlike(i, 1)}" for i in range(2))
    assert all(got[10 + i] == dict(rows)[10 + i] for i in range(2))  # near copies


# ---- licenses -----------------------------------------------------------------------------------------------------
def test_license_scan_equals_containment(spark, corpus):
    filler = lambda n, s: " ".join(f"{s}{i}" for i in range(n))
    rows = [(100 + i, f"{filler(11 * i, 'a')} {text.upper()} {filler(90, 'b')}") for i, text in enumerate(licenses.NOTICES.values())]
    rows += [(300, licenses.NOTICES["MIT-text"].replace("hereby", "today").replace("merge", "join")), (301, "Permission is hereby granted to no one at all"), *ODD]
    found = licenses.scan(docs(spark, rows)).collect()
    templates = licenses.Templates(licenses.NOTICES, 5, 0.8, 1e-4)
    sets = dict(zip(templates.names, templates.sets))
    want = set()
    for key, text in rows:
        held = np.unique(licenses.rolled(licenses.word_hashes(licenses.words_of((text or "").encode())), 5))
        want |= {(key, name) for name, s in sets.items() if len(np.intersect1d(held, s)) >= 0.8 * len(s)}
    assert {(r["doc_id"], r["license"]) for r in found} == want and all(r["containment"] >= 0.8 for r in found)
    assert {r["doc_id"] for r in found} >= {100 + i for i in range(len(licenses.NOTICES))}
    lines = {r["doc_id"] for r in corpus.collect() if any(x in r["text"] for x in ("CC BY-NC 4.0.", "MIT License.", "Apache License, Version 2.0.", "Public License, version 3."))}
    assert {r["doc_id"] for r in licenses.scan(corpus).collect()} == lines
    assert licenses.scan(docs(spark, rows).limit(0)).count() == 0


def test_notices_shorter_than_a_shingle_are_found(spark, corpus):
    notices = {**licenses.ALL_NOTICES, "one": "Copyleft", "none": " . "}
    rows = [(1, "All rights reserved."), (2, f"{PASSAGE}\nall RIGHTS, reserved"), (3, "All rights"), (4, "reserved."), (5, "Not all rights were reserved."), (6, "MIT copyleft"), (7, "x " * 500 + "All rights reserved. Released under the MIT License."), (8, None)]
    found = collections.Counter((r["doc_id"], r["license"]) for r in licenses.scan(docs(spark, rows), notices).collect())
    assert found == collections.Counter([(1, "All-rights-reserved"), (2, "All-rights-reserved"), (6, "one"), (7, "All-rights-reserved"), (7, "MIT")])
    short = {r["doc_id"] for r in licenses.scan(corpus, licenses.ALL_NOTICES).filter("license = 'All-rights-reserved'").collect()}
    assert short == {r["doc_id"] for r in corpus.collect() if b"all rights reserved" in b" ".join(licenses.words_of(r["text"].encode()))}
