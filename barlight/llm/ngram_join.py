"""N-gram Jaccard self-join: all links between documents whose sets of word shingles are alike, and their components.

1. Equal sets collapse: a *node* is a distinct set.
2. Two sets with Jaccard similarity t share one of the first n - ceil(t n) + 1 shingles of each, in any order of all shingles. The order here puts
   rare ones first (counts of all documents in a table of hashed shingles), so what many documents share is not looked up.
3. Nodes that share a minimum of one of three hashes are held against the smallest of them. Groups of near copies connect by these few links.
   Pairs whose signatures rule the similarity out are dropped unread.
4. Nodes that share a prefix shingle meet in a *tile* of one size band, if they are not connected yet. A tile of many nodes is cut into chunks,
   and pairs of chunks are tiles of their own. Bit counts of hashed signatures bound the overlap of a pair from above. Signatures have more bits a shingle for short
   sets; pairs of long ones are held against larger sketches before their sets are built. What passes is intersected exactly, as sorted arrays. First each tile gives out only as many pairs as would connect its nodes; the pairs that are
   then still unconnected and untried are all held against each other.

Shingles are 64-bit hashes. Sets are built again from their texts for those nodes alone that a pair asks for; texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barlight.llm.common import slices
from barlight.llm.components import components
from barlight.session import durable

SIGNATURE_BYTES = 128
"""Signature that the sets of a tile are compared by; shorter sets have finer ones, whose halves fold onto this size."""
FINE = ((256, 512), (512, 256))
"""(most shingles, bytes of the signature)."""
COUNT_BUCKETS = 1 << 21
COUNT_BLOCK = 1 << 16
TILE_ROWS = 2048
MINIMA = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (binary). Words are runs of anything but ASCII white space, A-Z in lower case."""
    words, sizes = [], []
    for text in texts.to_pylist():
        found = text.lower().split() if text else []
        words += found
        sizes.append(len(found))
    coded = pa.array(words, pa.binary()).dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = known[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for shift in range(width):
        rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[shift : shift + len(rolled)])
    out, start = [], 0
    for size in sizes:
        if size >= width:
            out.append(np.unique(rolled[start : start + size - width + 1]))
        elif size:
            whole = np.array([size], np.uint64)
            for h in hashes[start : start + size]:
                whole = mixed(whole * np.uint64(0xC2B2AE3D27D4EB4F) + h)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        start += size
    return out


def node_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def shingle_classes(docs: DataFrame, width: int) -> np.ndarray:
    """Bit length of each hash bucket's count of shingles over all documents: COUNT_BUCKETS bytes, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNT_BUCKETS, np.uint32)
        for part in slices(batches, "text"):
            found = [s for s in shingle_sets(part.column("text"), width) if len(s)]
            if found:
                at, n = np.unique(np.concatenate(found) & np.uint64(COUNT_BUCKETS - 1), return_counts=True)
                counts[at.astype(np.int64)] += n.astype(np.uint32)
        for block in range(0, COUNT_BUCKETS, COUNT_BLOCK):
            at = np.flatnonzero(counts[block : block + COUNT_BLOCK]).astype(np.uint16)
            if len(at):
                n = np.minimum(counts[block : block + COUNT_BLOCK][at], 65535).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([block // COUNT_BLOCK], pa.int32()), pa.array([at.tobytes()]), pa.array([n.tobytes()])], ["block", "at", "n"])

    def add(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(COUNT_BLOCK, np.uint64)
        for batch in groups:
            for key, at, n in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "n"))):
                block = key
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint16)
        classes = np.ceil(np.log2(total.astype(float) + 1)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([classes.tobytes()])], ["block", "classes"])

    parts = docs.mapInArrow(count, "block int, at binary, n binary").groupBy("block").applyInArrow(add, "block int, classes binary")
    out = np.zeros(COUNT_BUCKETS, np.uint8)
    for row in parts.collect():
        out[row["block"] * COUNT_BLOCK : (row["block"] + 1) * COUNT_BLOCK] = np.frombuffer(row["classes"], np.uint8)
    return out


def signature(shingles: np.ndarray, size: int) -> bytes:
    """Parity of the shingles that fall on each bit of *size* bytes: two signatures differ in at most as many bits as their sets in shingles."""
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & 8 * size - 1, minlength=8 * size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def tile_bytes(n: int) -> int:
    return next((size for most, size in FINE if n <= most), SIGNATURE_BYTES)


def pair_bytes(n: int) -> int:
    """Bytes of the sketch that a single pair is held against: two to four bits a shingle, an eighth to a quarter of a byte each."""
    return max(tile_bytes(n), 1 << max(0, n // 4).bit_length())


def folded(signatures: list[bytes], size: int) -> np.ndarray:
    """Signatures of *size* bytes or more as rows of that size. Halving XORs the halves, which is the parity on half as many bits."""
    out = np.zeros((len(signatures), size // 8), np.uint64)
    lengths = np.array([len(x) for x in signatures])
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        held = np.frombuffer(b"".join(signatures[row] for row in rows), np.uint64).reshape(len(rows), -1)
        while held.shape[1] > size // 8:
            held = held[:, : held.shape[1] // 2] ^ held[:, held.shape[1] // 2 :]
        out[rows] = held
    return out


def possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of *n* and *m* shingles with signatures *x* and *y* can be alike: bits that differ bound the overlap from above."""
    bound = np.minimum((n + m - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)) // 2, np.minimum(n, m))
    return 100 * bound >= percent * (n + m - bound)


def node_table(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n, node, signature, sketch, minima, keys) of every document; keys are the prefix shingles."""
    classes = docs.sparkSession.sparkContext.broadcast(shingle_classes(docs, width))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), width)
            nodes, bits, sketches, minima, keys = [], [], [], [], []
            for s in sets:
                n = len(s)
                if not n:
                    for column in (nodes, bits, sketches, minima, keys):
                        column.append(None)
                    continue
                nodes.append(node_of(s))
                bits.append(signature(s, tile_bytes(n)))
                sketches.append(signature(s, pair_bytes(n)) if pair_bytes(n) > tile_bytes(n) else None)
                minima.append([int((mixed(s * np.uint64(m))).min().astype(np.int64)) for m in MINIMA])
                first = n - -(-percent * n // 100) + 1
                rare = table[(s & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64)].astype(np.uint64)
                order = rare << np.uint64(56) | s >> np.uint64(8)  # ties in the upper 56 bits keep the order of s: the sort is stable
                keys.append(s[np.argsort(order, kind="stable")[:first]].astype(np.int64))
            columns = [part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(bits, pa.binary()), pa.array(sketches, pa.binary()), pa.array(minima, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "node", "signature", "sketch", "minima", "keys"])

    return docs.mapInArrow(run, f"doc_id {kind}, text_hash long, n long, node long, signature binary, sketch binary, minima array<long>, keys array<long>")


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity reaches *percent*."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                passed.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(passed, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def tile_pairs(tiles: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs of unconnected nodes in each tile whose signatures allow the similarity; *forest*: only as many as would connect them.

    Column long tells pairs whose sketches may rule out more than the signatures of a tile.
    """
    marks = ("key", "band", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            held = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            ids = np.stack([held.column(c).to_numpy() for c in marks], axis=1)
            cut = int(np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)]))[-1])  # the last tile may go on
            rest = held.slice(cut)
            yield from pairs_in(held.slice(0, cut), ids[:cut])
        if rest is not None and rest.num_rows:
            yield from pairs_in(rest, np.stack([rest.column(c).to_numpy() for c in marks], axis=1))

    def pairs_in(held: pa.Table, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if held.num_rows < 2:
            return
        n, node, label, home, chunk = (held.column(c).to_numpy() for c in ("n", "node", "label", "home", "chunk"))
        given = held.column("signature").to_pylist()
        size = np.array([len(x) for x in given])
        levels = []  # signatures at each size and the row of each node among them
        for level in sorted({SIGNATURE_BYTES, *(x for _, x in FINE)}):
            rows = np.flatnonzero(size >= level)
            levels.append((level, np.searchsorted(rows, np.arange(len(size))), folded([given[row] for row in rows], level)))
        tile = np.cumsum(np.concatenate([[0], (ids[1:] != ids[:-1]).any(axis=1)]))
        across = ids[:, 2] != ids[:, 3]
        _, label = np.unique(label, return_inverse=True)
        _, group = np.unique(tile * (int(label.max()) + 1) + label, return_inverse=True)
        root = np.arange(int(group.max()) + 1)  # groups of each tile that links, or pairs given out here, connect
        left, step = np.arange(len(n)), 0
        while len(left):
            step += 1
            left = left[left + step < len(n)]
            right = left + step
            near = (tile[left] == tile[right]) & (100 * n[left] >= percent * n[right])  # sizes ascend in a tile
            left, right = left[near], right[near]
            ask = (root[group[left]] != root[group[right]]) & (home[left] | home[right]) & (~across[left] | (chunk[left] != chunk[right]))
            i, j = left[ask], right[ask]
            for level, row, bits in levels:
                fine = np.flatnonzero((size[i] >= level) & (size[j] >= level))
                out = np.ones(len(i), bool)
                out[fine] = possible(bits[row[i[fine]]], bits[row[j[fine]]], n[i[fine]], n[j[fine]], percent)
                i, j = i[out], j[out]
            if forest and len(i):
                i, j = connecting(root, group, i, j)
            if len(i):
                a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.maximum(n[i], n[j]) > FINE[-1][0])], ["a", "b", "long"])

    return tiles.mapInArrow(run, "a long, b long, long boolean")


def connecting(root: np.ndarray, group: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) that join two groups; *root* is brought up to date."""
    joined: dict[int, int] = {}
    chosen = []

    def top(x: int) -> int:
        while x in joined:
            x = joined[x]
        return x

    for k, (x, y) in enumerate(zip(root[group[i]].tolist(), root[group[j]].tolist())):
        x, y = top(x), top(y)
        if x != y:
            joined[max(x, y)] = min(x, y)
            chosen.append(k)
    root[list(joined)] = [top(x) for x in joined]
    root[:] = root[root]
    return i[chosen], j[chosen]


def open_tiles(shared: DataFrame, nodes: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Rows of the tiles whose nodes are not all connected, sorted by tile and size within each partition."""
    labelled = shared.join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
    band = F.floor(F.log("n") / math.log(1 / (percent / 100 - 0.001)))
    rows = durable(labelled.join(open_keys, "key").join(nodes.select("node", "n"), "node").withColumn("own", band))
    rows = rows.withColumn("band", F.explode(F.array("own", F.col("own") - 1))).withColumn("home", F.col("own") == F.col("band"))
    crowds = rows.groupBy("key", "band").agg(F.ceil(F.count("*") / TILE_ROWS).alias("chunks"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("home").alias("lives"))
    crowds = crowds.filter("low != high and lives").select("key", "band", "chunks")
    cut = rows.join(crowds, ["key", "band"]).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
    cut = cut.join(nodes.select("node", "signature"), "node")
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    tiles = cut.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    order = ["key", "band", "low", "high"]
    return tiles.repartition(*order).sortWithinPartitions(*order, "n").select(*order, "n", "node", "label", "home", "chunk", "signature")


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow to be alike."""
    sketch = F.coalesce("sketch", "signature")
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), sketch.alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), sketch.alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            size = np.minimum([len(v) for v in x], [len(v) for v in y])
            passed = np.zeros(batch.num_rows, bool)
            for level in np.unique(size).tolist():
                rows = np.flatnonzero(size == level)
                passed[rows] = possible(folded([x[row] for row in rows], level), folded([y[row] for row in rows], level), n[rows], m[rows], percent)
            yield batch.select(["a", "b"]).filter(pa.array(passed))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(run, "a long, b long")


def sifted(found: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of tiles; those of long sets are held against their sketches first, before any set is built."""
    found = durable(found.distinct())
    long = plausible(found.filter("long").select("a", "b"), nodes.filter(F.col("n") > math.floor(FINE[-1][0] * percent / 100)), percent)  # a partner's size is at least that
    return durable(found.filter("not long").select("a", "b").union(long))


def sets_of(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes that *pairs* name, built from the text of one of their documents.

    A Bloom filter of those documents' ids (16 MB at most) tells each task which texts to look at; the nodes found are then matched exactly.
    """
    wanted = durable(nodes.select("node", "doc_id").join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node").withColumn("h", F.xxhash64("doc_id")))
    bits = 1 << int(min(27, max(16, math.ceil(math.log2(16 * wanted.count() + 1)))))
    at = F.pmod(F.col("h"), F.lit(bits))
    words = wanted.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("mask")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[words.column("word").to_numpy()] = words.column("mask").to_numpy().astype(np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            at = batch.column("h").to_numpy() % bits
            batch = batch.filter(pa.array((table[at // 32] >> (at % 32).astype(np.uint32) & 1).astype(bool)))
            for part in slices(iter([batch]), "text"):
                sets = shingle_sets(part.column("text"), width)
                held = [(h, node_of(s), s.tobytes()) for h, s in zip(part.column("h").to_pylist(), sets) if len(s)]
                columns = [pa.array([x[k] for x in held], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "node", "shingles"])

    found = docs.withColumn("h", F.xxhash64("doc_id")).mapInArrow(rebuild, "h long, node long, shingles binary")
    return durable(found.join(wanted.select("node", "h"), ["node", "h"]).select("node", "shingles").dropDuplicates(["node"]))


def links(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, text_hash, n, node) of every distinct set, and links (a, b) between nodes that connect all that are alike.

    Not every link inside a group is listed: nodes that are connected by links already are not compared again.
    """
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    table = durable(node_table(docs.withColumn("text_hash", F.xxhash64("text")), width, percent))
    members = table.select("doc_id", "text_hash", "n", "node")
    nodes = durable(table.filter("node is not null").dropDuplicates(["node"]))

    minima = nodes.select("node", F.posexplode("minima").alias("slot", "key"))
    leaders = minima.groupBy("slot", "key").agg(F.min("node").alias("a"), F.count("*").alias("m")).filter("m > 1").drop("m")
    near = minima.join(leaders, ["slot", "key"]).filter(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    near = durable(plausible(near, nodes, percent))
    first = durable(alike(near, sets_of(docs, near, nodes, width), percent))
    label = components(first)

    posted = nodes.select("node", F.explode("keys").alias("key"))
    shared = durable(posted.join(posted.groupBy("key").count().filter("count > 1").select("key"), "key").select("key", "node"))
    tried = sifted(tile_pairs(open_tiles(shared, nodes, label, percent), percent, forest=True), nodes, percent)
    second = durable(first.union(alike(tried, sets_of(docs, tried, nodes, width), percent)))
    left = sifted(tile_pairs(open_tiles(shared, nodes, components(second), percent), percent, forest=False), nodes, percent)
    left = durable(left.join(tried, ["a", "b"], "left_anti"))
    return members, durable(second.union(alike(left, sets_of(docs, left, nodes, width), percent)))


def join_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union of their sets of *width*-word shingles.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable). A document of fewer words than *width* has its
    whole sequence as one shingle; a null, empty or blank text has none, is linked with nothing and is its own component. Null ids take part, but a
    component is named by the smallest id that is not null, and stays null without one. Repeated rows give repeated rows; rows that share an id
    but not a text are told apart; an empty table gives an empty one; other columns are ignored.
    """
    members, found = links(docs, width, percent)
    label = components(found)
    named = members.join(label, "node", "left").withColumn("group", F.coalesce("component", "node"))
    smallest = named.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("smallest"))
    out = named.join(smallest, "group", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))


def first_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all columns of *docs*: the one with the smallest id (null is last), then the smallest text hash.

    Rows without words are their own components; of rows with the same id and text one stays. Rows with null or repeated ids but other texts are told apart.
    """
    members, found = links(docs, width, percent)
    named = members.filter("node is not null").join(components(found), "node", "left").withColumn("group", F.coalesce("component", "node"))
    best = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("best"))
    stay = best.select("best.doc_id", "best.text_hash").union(members.filter("node is null").select("doc_id", "text_hash")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_stays"))
    keyed = docs.withColumn("_hash", F.xxhash64(F.col("text").cast("binary")))
    return keyed.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_stays")), "left_semi").dropDuplicates(["doc_id", "_hash"]).drop("_hash")
