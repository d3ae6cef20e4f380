"""Packing of tokenized documents into fixed-length sequences by cutting-stock column generation.

1. Every document is cut into full sequences and one tail. Tails are counted in a histogram of *units* (8 tokens, 512 to a sequence).
2. A linear program over patterns (how many tails of each size share a sequence) is solved by column generation on that histogram: the
   dual prices of the sizes value the items of a knapsack, dynamic programming finds the pattern worth most, and it enters the basis while
   it is worth more than the sequence it takes. The program has at most 512 rows, however many documents there are.
3. Pattern counts are rounded down, what is left is packed largest first, and tails, ranked within their size, take the slots.
4. Sizes are rounded up, so sequences keep a little room. A share of the tails, drawn by a hash and as large as that room, is the *stock*:
   one stream of tokens that is cut freely to fill the room, and then whole sequences.

Only token counts, checksums and the ids of possible stock leave the tokenizing tasks. All ranks are sums of per-split counts, so a size that
a third of all documents share is spread over as many tasks as it has splits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from barlight.llm.bpe import encoded
from barlight.session import durable

CAPACITY = 4096
UNIT = 8
BUCKETS = 512
STOCK_BUCKETS = 64
"""At most this many of the hash buckets (an eighth of the tails) become stock."""
TOLERANCE = 1e-3
"""Column generation ends when no pattern is worth more than 1 + TOLERANCE sequences, which bounds the gap to the optimum by that share."""
SPAN = 1 << 14
"""Tokens to a bucket of the join of room and stock."""


def knapsack(values: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within *capacity*: its value and how often it takes each item."""
    by_weight = np.zeros(capacity + 1)
    by_weight[weights] = np.maximum(values, 0)
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        worth = best[room - 1 :: -1] + by_weight[1 : room + 1]  # items of weight 1, 2, ... room; weight without item: worth nothing
        taken[room] = k = int(worth.argmax())
        best[room] = worth[k]
    counts, room, at = np.zeros(len(weights), np.int64), capacity, {int(w): i for i, w in enumerate(weights)}
    while room > 0:
        weight = int(taken[room]) + 1
        if weight in at and by_weight[weight] > 0:
            counts[at[weight]] += 1
        room -= weight
    return float(best[capacity]), counts


def cutting_patterns(demand: dict[int, int], capacity: int, tolerance: float = TOLERANCE) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: how many}, copies) that hold exactly *demand* (size: count); nearly as few copies as any patterns could."""
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[s] for s in sizes.tolist()], float)
    columns = np.diag(capacity // sizes)  # one basic pattern for each row
    inverse = np.diag(1.0 / (capacity // sizes))
    amount = inverse @ need
    while True:
        prices = inverse.sum(axis=0)
        value, pattern = knapsack(prices, sizes, capacity)
        if value <= 1 + tolerance:
            break
        change = inverse @ pattern
        rows = np.flatnonzero(change > 1e-9)
        leaves = rows[np.argmin(amount[rows] / change[rows])]
        step = amount[leaves] / change[leaves]
        amount -= step * change
        amount[leaves] = step
        pivot = inverse[leaves] / change[leaves]
        inverse -= np.outer(change, pivot)
        inverse[leaves] = pivot
        columns[:, leaves] = pattern
    plan: list[tuple[dict[int, int], int]] = []
    left = need.astype(np.int64)
    for k in np.argsort(-amount, kind="stable").tolist():
        used = np.flatnonzero(columns[:, k])
        copies = max(0, min(int(amount[k] + 1e-9), *(left[used] // columns[used, k]).tolist()))
        if copies:
            left[used] -= copies * columns[used, k]
            plan.append(({int(sizes[i]): int(columns[i, k]) for i in used}, copies))
    while left.any():  # less than one copy of each pattern: largest first
        room, pattern = capacity, {}
        for i in range(len(sizes) - 1, -1, -1):
            if left[i] and (n := min(int(left[i]), room // int(sizes[i]))):
                pattern[int(sizes[i])] = n
                room -= n * int(sizes[i])
        copies = min(int(left[i]) // pattern[s] for i, s in enumerate(sizes.tolist()) if s in pattern)
        for i, s in enumerate(sizes.tolist()):
            left[i] -= copies * pattern.get(s, 0)
        plan.append((pattern, copies))
    return plan


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Full sequences and tails of every document; tails that may become stock carry their ids."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = ["doc_id", "split", "position", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"]
    schema = f"doc_id {kind}, split long, position long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids binary"
    stop = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, position = TaskContext.get().partitionId(), 0
        for part, ids in encoded(batches, vocabulary):
            rows = []
            for key, body in zip(part.column("id").to_pylist(), ids):
                tokens = np.concatenate([body, stop]).astype("<u4", copy=False)
                bucket = zlib.crc32(f"{key} {zlib.crc32(tokens.data)}".encode()) % BUCKETS
                for start in range(0, len(tokens), CAPACITY):
                    piece = tokens[start : start + CAPACITY]
                    spare = piece.tobytes() if bucket < STOCK_BUCKETS and len(piece) < CAPACITY else None
                    rows.append((key, split, position, start, len(piece), zlib.crc32(piece.data), len(tokens), bucket, spare))
                    position += 1
            columns = list(zip(*rows))
            types = [part.column("id").type, *[pa.int64()] * 6, pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return source.mapInArrow(run, schema)


def before(df: DataFrame, keys: list[str], amount: str, name: str) -> DataFrame:
    """Add the sum of *amount* over the rows of the same *keys* that come before, in order of (split, position)."""
    split_keys = [*keys, "split"]
    sums = df.groupBy(split_keys).agg(F.sum(amount).alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(keys).orderBy("split")) - F.col("_sum")).drop("_sum")
    inside = Window.partitionBy(split_keys).orderBy("position")
    return df.withColumn("_inside", F.sum(amount).over(inside) - F.col(amount)).join(sums, split_keys).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of at most 4096 tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is one piece that holds
    the end id; null and repeated ids and repeated rows are packed like any other; an empty table gives no pieces; other columns are ignored. Every
    id of a document lies in exactly one piece, offsets of a sequence run on from 0 without gaps. The histogram (at most 512 sizes by 65
    buckets) is all that the driver reads.
    """
    spark = docs.sparkSession
    pieces = durable(cut_documents(docs, vocabulary, end_id, id_col, text_col))
    size = F.ceil(F.col("length") / UNIT).cast("int")
    shape = (
        pieces.filter(F.col("length") < CAPACITY)
        .groupBy(size.alias("size"), F.least("bucket", F.lit(STOCK_BUCKETS)).alias("bucket"))
        .agg(F.count("*").alias("n"), F.sum("length").alias("tokens"))
        .collect()
    )
    tokens, room = sum(r["tokens"] for r in shape), sum(r["n"] * r["size"] * UNIT - r["tokens"] for r in shape)
    share = min(STOCK_BUCKETS, int(np.ceil(BUCKETS * (1.05 * room / tokens + TOLERANCE)))) if tokens else 0
    demand: dict[int, int] = {}
    for r in shape:
        if r["bucket"] >= share:
            demand[r["size"]] = demand.get(r["size"], 0) + r["n"]
    plan = cutting_patterns(demand, CAPACITY // UNIT)
    slots, taken, sequences = [], {}, 0
    for pattern, copies in plan:
        for s, n in pattern.items():
            first = taken.get(s, 0)
            slots.append((s, first, first + n * copies, sequences, copies))
            taken[s] = first + n * copies
        sequences += copies

    kind = F.when(F.col("length") == CAPACITY, 0).when(F.col("bucket") < share, -1).otherwise(size)
    amount = F.when((F.col("length") < CAPACITY) & (F.col("bucket") < share), F.col("length")).otherwise(F.lit(1).cast("long"))
    sorted_out = pieces.withColumns({"kind": kind, "amount": amount, "ids": F.when(kind == -1, F.col("ids"))})
    ranked = before(sorted_out, ["kind"], "amount", "rank")
    ranked = durable(ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "rank", "ids"))

    slot_table = spark.createDataFrame(slots, "kind int, first long, stop long, base long, copies long")
    tails = ranked.filter(F.col("kind") > 0).join(F.broadcast(slot_table), "kind").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop")))
    tails = tails.withColumn("sequence_id", F.col("base") + (F.col("rank") - F.col("first")) % F.col("copies"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank", "kind")
    tails = durable(tails.withColumn("offset", F.sum("length").over(order) - F.col("length")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))

    # Room that sequences have left, as stretches of one line of tokens, and the stock laid along that line.
    room_left = tails.groupBy("sequence_id").agg(F.sum("length").alias("offset")).filter(F.col("offset") < CAPACITY)
    room_left = room_left.withColumn("amount", CAPACITY - F.col("offset")).withColumn("split", F.floor(F.col("sequence_id") / (1 << 12))).withColumn("position", F.col("sequence_id"))
    room_left = before(room_left.withColumn("line", F.lit(0)), ["line"], "amount", "at").select("sequence_id", "offset", "amount", "at")
    stock = ranked.filter(F.col("kind") == -1)
    held, poured = (x.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] for x, c in ((room_left, "amount"), (stock, "length")))
    fresh = max(0, -(-(poured - held) // CAPACITY))
    more = spark.range(fresh).select((F.col("id") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(CAPACITY).cast("long").alias("amount"), (F.col("id") * CAPACITY + held).alias("at"))
    span = lambda at, n: F.explode(F.sequence(F.floor(at / SPAN), F.floor((at + n - 1) / SPAN)))
    stretches = room_left.union(more).withColumn("span", span(F.col("at"), F.col("amount")))
    poured_stock = stock.withColumn("span", span(F.col("rank"), F.col("length"))).withColumnRenamed("start", "tail")
    lo, hi = F.greatest("at", "rank"), F.least(F.col("at") + F.col("amount"), F.col("rank") + F.col("length"))
    cut = stretches.join(poured_stock, "span").withColumn("lo", lo).withColumn("hi", hi)
    cut = cut.filter((F.col("lo") < F.col("hi")) & (F.col("span") == F.floor(F.col("lo") / SPAN)))
    cut = cut.select(
        "doc_id",
        (F.col("tail") + F.col("lo") - F.col("rank")).alias("start"),
        (F.col("hi") - F.col("lo")).alias("length"),
        F.crc32(F.substring("ids", (4 * (F.col("lo") - F.col("rank")) + 1).cast("int"), (4 * (F.col("hi") - F.col("lo"))).cast("int"))).alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        (F.col("offset") + F.col("lo") - F.col("at")).alias("offset"),
    )
    full = ranked.filter(F.col("kind") == 0).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + sequences + fresh).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return tails.union(cut).union(full)
