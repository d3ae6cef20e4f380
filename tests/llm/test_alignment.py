"""Cross-tokenizer alignment against a plain version."""

from __future__ import annotations

import collections
import hashlib
import json

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barlight.llm import alignment
from barlight.llm.queries import QUERIES

BYTE_LEVEL, RANKS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    """The same by sets of byte ends and nested loops."""
    library = Tokenizer.from_file(BYTE_LEVEL)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    signs = alignment.byte_signs()
    spelling = {i: bytes(signs[c] for c in t) for t, i in json.load(open(BYTE_LEVEL))["model"]["vocab"].items() if t != "<|endoftext|>"}
    grouped = []
    for _, text in rows:
        groups = []
        if text:
            a = [(i, spelling[i]) for i in library.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in pieces.encode(text):
                p = pieces.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()))
            want = (" " + text).encode()
            if b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
                ends = []
                for side in (a, b):
                    at, out = 0, []
                    for i, x in side:
                        at += len(x)
                        out.append((at, i))
                    ends.append(out)
                common = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
                low = 0
                for stop in common:
                    groups.append(tuple([i for e, i in side if low < e <= stop] for side in ends))
                    low = stop
        grouped.append(groups)
    count = collections.Counter()
    for groups in grouped:
        count.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (doc, _), groups in zip(rows, grouped):
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(out, key=str)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "   two   spaces  "), (5, "▁ a piece sign of its own"), (6, "<|endoftext|> and </s> <s> <unk> <0x41>"), (7, "日本語 naïve é é 🙂🙂‍"),
    (8, "a" * 3000), (9, "x" + "ab1" * 700), (10, "tab\tline\n\n end\r\n\x00\x01"), (11, "The same text."), (12, "The same text."), (None, "The same text."), (12, "The same text."),
    (13, "ﬁ ﬁ ＡＢＣ Å"), (14, "9" * 500), (15, " lead"), (16, " 　wide space"),
]


@pytest.mark.parametrize("head_pairs", [1 << 20, 40, 0])
def test_alignment_equals_plain_version(spark, head_pairs):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in ODD], "doc_id long, text string, row int, pairs string").repartition(3)
    got = alignment.align(docs, BYTE_LEVEL, PIECES, RANKS, head_pairs=head_pairs)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(ODD)


def test_alignment_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for head_pairs in (1 << 20, 500):
        got = alignment.align(docs, BYTE_LEVEL, PIECES, RANKS, head_pairs=head_pairs)
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
    slow = alignment.align(docs.limit(40), BYTE_LEVEL, PIECES)
    assert sorted((tuple(r) for r in slow.collect()), key=str) == plain([tuple(r) for r in docs.limit(40).collect()])
    assert QUERIES["op13_tokenizer_alignment"](spark, "/root/testdata/sf0.001").count() == len(rows)


def test_alignment_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, BYTE_LEVEL, PIECES, RANKS).collect() == []


def test_wide_groups_are_merged_before_they_are_paired(monkeypatch):
    pairs = {}
    for limit in (1, 10**9):
        monkeypatch.setattr(alignment, "WIDE_GROUP", limit)
        monkeypatch.setattr(alignment, "BLOCK_LINKS", 7)
        first, second = alignment.tokenizers_of(BYTE_LEVEL, RANKS, PIECES)
        sizes = [alignment.pc.binary_length(t.pieces).cast(alignment.pa.int64()) for t in (first, second)]
        a, b = alignment.tokenise(alignment.pa.array([t for _, t in ODD]), first, second)
        table = alignment.Groups(a, b, *sizes).pairs(32000).to_pydict()
        pairs[limit] = sorted(zip(table["doc"], table["pair"], table["times"]))
    assert pairs[1] == pairs[10**9] and pairs[1]
