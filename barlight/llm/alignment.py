"""Cross-tokenizer alignment: which tokens of one vocabulary cover the same bytes as which of another.

Both tokenizers cut the same bytes, a space and the text. Where a token of each ends at the same byte, a *group* ends, and every token of one
side of a group is linked with every token of its other side. All steps are columnar: token lists are flattened with their parent indices,
byte ends are cumulative sums within each document, an Acero hash join on (document, end) finds the common ends, and ``Table.group_by`` counts the
documents of each id pair within a task before Spark merges the counts.

Counts go back to the documents without shuffling every pair of every document. The most frequent pairs, at most HEAD_PAIRS, and the highest count
of each id, bounded by the vocabulary, are sent to all tasks; pairs below that are rare and meet their counts in a join.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from barlight.llm.common import slices
from barlight.session import durable

HEAD_PAIRS = 1 << 20
"""Id pairs, the most frequent ones, that are sent to all tasks with their counts: 12 MB at most."""
HELD_PAIRS = 1 << 21
"""Counted pairs that a task holds before it hands them over."""
LONG_TEXT = 200_000
"""Longer texts are left to the reference library: the rank encoder fails on very long runs of white space."""
WIDE_GROUP = 4096
"""Links of a group beyond which its repeated ids are merged before they are paired."""
BLOCK_LINKS = 1 << 22
"""Links written out at a time."""
LIBRARY_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""Fixed value: how the byte-level vocabulary's word splitter cuts a text."""


def byte_signs() -> dict[str, int]:
    """The byte behind each sign of a byte-level vocabulary: printable Latin-1 signs stand for themselves, other bytes for U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """The byte-level tokenizer of a tokenizers file; its *ranks* (a file of the same vocabulary) encode all but very long texts."""

    def __init__(self, path: str, ranks: str | None = None):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            description = json.load(file)
        vocabulary = dict(description["model"]["vocab"])
        signs = byte_signs()
        spelled = {i: bytes(signs[c] for c in token) for token, i in vocabulary.items() if all(c in signs for c in token)}
        spelled |= {t["id"]: t["content"].encode() for t in description["added_tokens"]}
        self.pieces = pa.array([spelled.get(i, b"") for i in range(max(spelled) + 1)], pa.binary())
        self.fast = None
        if ranks:
            with open(ranks, "rb") as file:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("ranks", pat_str=LIBRARY_PATTERN, mergeable_ranks=known, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return [self.fast.encode_ordinary(t) if len(t) <= LONG_TEXT else self.library.encode(t, add_special_tokens=False).ids for t in texts]


class Pieces:
    """A piece tokenizer with byte fallback, which puts a space before the text by itself."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = pa.array([self._spelled(i) for i in range(self.library.get_piece_size())], pa.binary())

    def _spelled(self, i: int) -> bytes:
        piece = self.library.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.library.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers_of(byte_level: str, ranks: str | None, pieces: str) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers, loaded once in each worker process."""
    return ByteLevel(byte_level, ranks), Pieces(pieces)


def lists(ids: list[list[int]]) -> pa.ListArray:
    return pa.array(ids, pa.list_(pa.int32()))


def emptied(ids: pa.ListArray, stays: np.ndarray) -> pa.ListArray:
    """*ids* with an empty list in each row that doesn't stay."""
    count = np.where(stays, pc.list_value_length(ids).to_numpy(zero_copy_only=False), 0)
    mask = pa.array(stays[pc.list_parent_indices(ids).to_numpy()], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pc.list_flatten(ids).filter(mask))


def spelled(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The joined bytes of each row's tokens."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pieces.take(ids.values)), b"")


def tokenise(texts: pa.Array, first: ByteLevel, second: Pieces) -> tuple[pa.ListArray, pa.ListArray]:
    """Token ids of both sides; none for null and empty texts and where either side's bytes differ from a space and the text."""
    plain = pc.fill_null(texts, "").to_pylist()
    full = np.array([bool(t) for t in plain], bool)
    held = [t for t in plain if t]
    a_held, b_held = iter(first.encode([" " + t for t in held])), iter(second.encode(held))
    a, b = lists([next(a_held) if f else [] for f in full]), lists([next(b_held) if f else [] for f in full])
    wanted = pa.array([b" " + t.encode() for t in plain], pa.binary())
    same = pc.and_(pc.equal(spelled(a, first.pieces), wanted), pc.equal(spelled(b, second.pieces), wanted)).to_numpy(zero_copy_only=False)
    return emptied(a, same & full), emptied(b, same & full)


def ends(ids: pa.ListArray, sizes: pa.Array) -> pa.Table:
    """(doc, end, at) of every token: its document's place, the byte of the document that it ends at, its own place."""
    parent, flat = pc.list_parent_indices(ids), pc.list_flatten(ids)
    running = pc.cumulative_sum(sizes.take(flat))
    start = ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()
    before = np.concatenate([[0], running.to_numpy(zero_copy_only=False)])[start]
    return pa.table({"doc": parent, "end": pc.subtract(running, pa.array(before, pa.int64()).take(parent)), "at": pa.array(np.arange(len(flat)), pa.int64())})


class Groups:
    """Groups of a slice of documents, numbered through in the order of the text."""

    def __init__(self, a: pa.ListArray, b: pa.ListArray, a_sizes: pa.Array, b_sizes: pa.Array):
        left, right = ends(a, a_sizes), ends(b, b_sizes).rename_columns(["doc", "end", "at_b"])
        both = left.join(right, ["doc", "end"], join_type="inner", use_threads=False)
        self.a_id, self.b_id = pc.list_flatten(a).to_numpy(), pc.list_flatten(b).to_numpy()
        self.a_stop, self.b_stop = (np.sort(both.column(c).to_numpy()) + 1 for c in ("at", "at_b"))
        self.a_count, self.b_count = np.diff(self.a_stop, prepend=0), np.diff(self.b_stop, prepend=0)
        last = np.cumsum(pc.list_value_length(a).to_numpy(zero_copy_only=False))
        self.doc_stop = np.searchsorted(self.a_stop, last, side="right")
        self.doc = np.repeat(np.arange(len(a)), np.diff(self.doc_stop, prepend=0))

    def per_document(self, values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], self.doc_stop])])

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups, written as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        side = lambda ids, stop: pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(ids).cast(pa.string())), ",")
        each = pc.binary_join_element_wise(side(self.a_id, self.a_stop), side(self.b_id, self.b_stop), "|")
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], self.doc_stop]), pa.int32()), each), ";")
        return [hashlib.sha256(text.encode()).hexdigest() if text else "" for text in whole.to_pylist()]

    def links(self, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair, times) of all links, in blocks; the pair of ids a and b is a * *width* + b."""
        count = self.a_count * self.b_count
        narrow = np.flatnonzero(count <= WIDE_GROUP)
        block = np.cumsum(count[narrow]) // BLOCK_LINKS
        for part in np.split(narrow, np.flatnonzero(np.diff(block)) + 1):
            n, m = self.a_count[part], self.b_count[part]
            group = np.repeat(np.arange(len(part)), n * m)
            step = np.arange(len(group)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            x = self.a_id[(self.a_stop[part] - n)[group] + step // m[group]]
            y = self.b_id[(self.b_stop[part] - m)[group] + step % m[group]]
            yield self.doc[part][group], x.astype(np.int64) * width + y, np.ones(len(group), np.int64)
        for g in np.flatnonzero(count > WIDE_GROUP):
            x, n = np.unique(self.a_id[self.a_stop[g] - self.a_count[g] : self.a_stop[g]], return_counts=True)
            y, m = np.unique(self.b_id[self.b_stop[g] - self.b_count[g] : self.b_stop[g]], return_counts=True)
            rows = max(1, BLOCK_LINKS // len(y))
            for at in range(0, len(x), rows):
                pair = (x[at : at + rows, None].astype(np.int64) * width + y).ravel()
                yield np.full(len(pair), self.doc[g]), pair, (n[at : at + rows, None] * m).ravel()

    def pairs(self, width: int) -> pa.Table:
        """(doc, pair, times): the distinct pairs of each document and how many links hold them."""
        total = pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
        for doc, pair, times in self.links(width):
            block = pa.table({"doc": pa.array(doc, pa.int64()), "pair": pa.array(pair, pa.int64()), "times": pa.array(times, pa.int64())})
            total = pa.concat_tables([total, merged(block, ["doc", "pair"], "times")])
        return merged(total, ["doc", "pair"], "times")


def merged(table: pa.Table, keys: list[str], value: str) -> pa.Table:
    return table.group_by(keys, use_threads=False).aggregate([(value, "sum")]).rename_columns([*keys, value])


def packed(doc: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    """The values of each of *rows* documents as little-endian binary; *doc* ascends."""
    borders = np.searchsorted(doc, np.arange(rows + 1)) * values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(borders.astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Document and value of all values of a binary column."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
    return np.repeat(np.arange(len(column)), size), np.frombuffer(b"".join(column.to_pylist()), kind)


def align(docs: DataFrame, byte_level: str, pieces: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """Links between the tokens of the vocabularies *byte_level* and *pieces*, and how common they are in all documents.

    Returns one row per input row: the id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair has the highest count of its first id, ties
    included), count_sum (document counts of the pairs of all links) and groups_sha256. A pair's count is the number of rows that hold it
    linked, repeated rows included. Null and empty texts, and texts whose tokens don't spell a space and the text, have zeros and an empty digest; null
    and repeated ids are kept as they are; texts of any length are aligned whole; an empty table gives an empty one; other columns are ignored.
    *ranks*, a file of *byte_level*'s vocabulary as ranks, makes encoding faster and changes no id. *head_pairs* bounds the pairs sent to all tasks and changes no result.
    """
    first, second = tokenizers_of(byte_level, ranks, pieces)
    ids, width = len(first.pieces), len(second.pieces)
    kind = np.uint32 if ids * width < 1 << 32 else np.int64
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = ["n_a", "n_b", "n_groups", "n_links"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokenizers_of(byte_level, ranks, pieces)
        sizes = [pc.binary_length(t.pieces).cast(pa.int64()) for t in (first, second)]
        for part in slices(batches, "text"):
            a, b = tokenise(part.column("text"), first, second)
            groups = Groups(a, b, *sizes)
            numbers = [pc.list_value_length(a), pc.list_value_length(b), pa.array(np.diff(groups.doc_stop, prepend=0)), pa.array(groups.per_document(groups.a_count * groups.b_count))]
            pairs = groups.pairs(width).sort_by([("doc", "ascending"), ("pair", "ascending")])
            doc, pair, times = (pairs.column(c).to_numpy() for c in ("doc", "pair", "times"))
            blobs = [packed(doc, pair.astype(kind), part.num_rows), packed(doc, times.astype(np.uint32), part.num_rows)]
            columns = [part.column("row"), part.column("id"), *(x.cast(pa.int64()) for x in numbers), pa.array(groups.digests(), pa.string()), *blobs]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", *counted, "groups_sha256", "pairs", "times"])

    held = durable(source.mapInArrow(link, f"row long, id {id_type}, {', '.join(f'{c} long' for c in counted)}, groups_sha256 string, pairs binary, times binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting = None, []
        for part in slices(batches, "pairs"):
            pairs = pa.table({"pair": unpacked(part.column("pairs"), kind)[1].astype(np.int64)})
            waiting.append(pairs.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"]))
            if sum(t.num_rows for t in waiting) > HELD_PAIRS:
                total, waiting = merged(pa.concat_tables([*([total] if total is not None else []), *waiting]), ["pair"], "n"), []
                if total.num_rows > HELD_PAIRS:
                    yield from total.to_batches(max_chunksize=1 << 16)
                    total = None
        if total is not None or waiting:
            yield from merged(pa.concat_tables([*([total] if total is not None else []), *waiting]), ["pair"], "n").to_batches(max_chunksize=1 << 16)

    counts = durable(held.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))

    highest = np.zeros(ids, np.int64)  # one number for each id of the vocabulary
    best = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n").alias("highest"))
    found = best.toArrow()
    highest[found.column("a").to_numpy()] = found.column("highest").to_numpy()
    scale = F.floor(F.log2("n"))
    least, room = 0, head_pairs
    for row in counts.groupBy(scale.alias("scale")).count().orderBy(F.desc("scale")).collect():  # at most 63 rows
        room -= row["count"]
        if room < 0:
            least = row["scale"] + 1
            break
    head = counts.filter(scale >= least).toArrow().sort_by("pair")  # at most head_pairs rows
    sent = docs.sparkSession.sparkContext.broadcast((highest, head.column("pair").to_numpy().astype(kind), head.column("n").to_numpy()))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        highest, known, n = sent.value
        for part in slices(batches, "pairs"):
            doc, pair = unpacked(part.column("pairs"), kind)
            times = unpacked(part.column("times"), np.uint32)[1].astype(np.int64)
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            found = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            value = np.where(found, n[at], 0) if len(known) else np.zeros(len(pair), np.int64)
            start = np.searchsorted(doc, np.arange(part.num_rows + 1))
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[start])
            rest = np.flatnonzero(~found)
            tail = pa.StructArray.from_arrays([pa.array(pair[rest].astype(np.int64)), pa.array(times[rest])], ["pair", "times"])
            tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[rest], np.arange(part.num_rows + 1)), pa.int32()), tail)
            sums = [pa.array(total(np.where(found & (value == highest[pair // width]), times, 0))), pa.array(total(times * value))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "id", *counted)), *sums, part.column("groups_sha256"), tails], ["row", "id", *counted, "n_best", "count_sum", "groups_sha256", "tail"])

    outputs = ", ".join(f"{c} long" for c in (*counted, "n_best", "count_sum"))
    scored = held.mapInArrow(add_up, f"row long, id {id_type}, {outputs}, groups_sha256 string, tail array<struct<pair: long, times: long>>")
    if least:  # pairs too rare to be sent meet their counts in a join
        scored = durable(scored)
        rare = scored.select("row", F.explode("tail").alias("t")).select("row", "t.pair", "t.times").join(counts.filter(scale < least), "pair")
        rare = rare.withColumn("a", F.expr(f"pair div {width}")).join(F.broadcast(best), "a")  # one row for each id of the vocabulary at most
        is_best = F.when(F.col("n") == F.col("highest"), F.col("times")).otherwise(0)
        sums = rare.groupBy("row").agg(F.sum(is_best).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
        scored = scored.join(sums, "row", "left")
        for column, more in (("n_best", "more_best"), ("count_sum", "more_sum")):
            scored = scored.withColumn(column, F.col(column) + F.coalesce(more, F.lit(0)))
    return scored.select(F.col("id").alias(id_col), *counted, "n_best", "count_sum", "groups_sha256")
