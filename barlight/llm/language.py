"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text tells how far any text goes on as that language's sample has it. A text is parsed greedily into the
longest phrases that a sample holds; a language's cost is its number of phrases times the bits that name a place in its sample, per character. The
language of least cost wins.

Before that texts are folded: letters to lower case, combining marks as they are, and any run of other characters to one space. Folded texts are parsed
in blocks of BLOCK characters, at whose ends a phrase ends, too; all blocks of a slice of documents take a step at a time, so the automata are
walked by array operations. An automaton is a hash table of its transitions and is built once in each worker, from samples that are broadcast.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barlight.llm.common import slices

SAMPLE_TEXTS = 96
"""Labelled texts that a language is learned from, at most: those of the smallest hashes."""
SAMPLE_CHARS = 1024
"""Characters of each of them, at most, from a place that its hash names."""
SPARE = 4
"""Texts looked at for each text that is taken."""
BLOCK = 512
FOLDS, HELD_OUT = 3, 1
UNDETERMINED = "und"

SPACE, BORDER, UNSEEN = 32, 0x110000, 0x1FFFFF
MARK = 0x80000000
"""Flag of a folded letter."""
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Folding:
    """What each code point becomes: a letter its lower case, a combining mark itself, anything else a space."""

    def __init__(self):
        self.table = np.full(0x110000, UNSEEN, np.uint32)

    def fold(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Folded characters of all texts, each text's length among them, and whether it has a letter."""
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        points = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le"), np.uint32)
        folded = self.table[points]
        if (unseen := folded == UNSEEN).any():
            for point in np.unique(points[unseen]).tolist():
                sign = chr(point)
                kind = unicodedata.category(sign)[0]
                self.table[point] = ord(sign.lower()[0]) | MARK if kind == "L" else point if kind == "M" else SPACE
            folded = self.table[points]
        doc = np.repeat(np.arange(len(texts)), sizes)
        letters = np.bincount(doc[folded >= MARK], minlength=len(texts)) > 0
        folded = folded & (MARK - 1)
        space = folded == SPACE
        starts = np.cumsum(sizes) - sizes
        after_space = np.concatenate([[True], space[:-1]]) if len(space) else space
        after_space[starts[sizes > 0]] = True
        stays = ~(space & after_space)
        return folded[stays], np.bincount(doc[stays], minlength=len(texts)), letters


def suffix_automaton(signs: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the smallest automaton whose paths from state 0 are the substrings of *signs*."""
    moves: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for sign in signs:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at, last = last, new
        while at >= 0 and sign not in moves[at]:
            moves[at][sign] = new
            at = link[at]
        if at < 0:
            continue
        known = moves[at][sign]
        if length[known] == length[at] + 1:
            link[new] = known
            continue
        split = len(moves)  # the part of *known* that is reached by short suffixes alone
        moves.append(dict(moves[known]))
        length.append(length[at] + 1)
        link.append(link[known])
        while at >= 0 and moves[at].get(sign) == known:
            moves[at][sign] = split
            at = link[at]
        link[known] = link[new] = split
    return moves


class Automaton:
    """A suffix automaton as a hash table of its transitions, walked by many texts at once."""

    def __init__(self, signs: np.ndarray):
        moves = suffix_automaton(signs.tolist())
        keys = np.array([state << 21 | sign for state, out in enumerate(moves) for sign in out], np.uint64)
        targets = np.array([target for out in moves for target in out.values()], np.int64)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.targets = np.full(1 << bits, EMPTY), np.zeros(1 << bits, np.int32)
        slot, todo = (keys * SPREAD) >> self.shift, np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == EMPTY]
            self.keys[slot[free]] = keys[free]  # of several keys for a slot one gets it
            placed = self.keys[slot[todo]] == keys[todo]
            self.targets[slot[todo[placed]]] = targets[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.last

    def step(self, state: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """The states after *sign*, -1 where there is none."""
        key = state.astype(np.uint64) << np.uint64(21) | sign
        slot = (key * SPREAD) >> self.shift
        seen = self.keys[slot]
        out = np.where(seen == key, self.targets[slot], np.int32(-1))
        rest = np.flatnonzero((seen != key) & (seen != EMPTY))
        while len(rest):
            slot[rest] = (slot[rest] + np.uint64(1)) & self.last
            seen = self.keys[slot[rest]]
            found = seen == key[rest]
            out[rest[found]] = self.targets[slot[rest[found]]]
            rest = rest[~found & (seen != EMPTY)]
        return out

    def phrases(self, signs: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of each block, given longest first: the fewest pieces that are substrings of the sample or single unknown characters."""
        state, count = np.zeros(len(start), np.int32), np.zeros(len(start), np.int64)
        active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # blocks longer than each step
        for step, n in enumerate(active.tolist()):
            sign = signs[start[:n] + step].astype(np.uint64)
            following = self.step(state[:n], sign)
            stuck = np.flatnonzero(following < 0)
            if len(stuck):
                count[stuck] += state[stuck] > 0
                again = self.step(np.zeros(len(stuck), np.int32), sign[stuck])
                count[stuck] += again < 0
                following[stuck] = np.maximum(again, 0)
            state[:n] = following
        return count + (state > 0)


class Languages:
    """The languages' automata and the bits that name a place in their samples."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        signs = [np.frombuffer(samples[name], np.uint32) for name in self.names]
        self.automata = [Automaton(s) for s in signs]
        self.bits = np.array([np.log2(len(s) + 1) for s in signs])
        self.folding = Folding()

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        signs, sizes, letters = self.folding.fold(texts)
        if not self.names:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        stops = np.cumsum(sizes)
        blocks = -(-sizes // BLOCK)
        doc = np.repeat(np.arange(len(texts)), blocks)
        start = (stops - sizes)[doc] + BLOCK * (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        size = np.minimum(BLOCK, stops[doc] - start)
        order = np.argsort(-size, kind="stable")
        doc, start, size = doc[order], start[order], size[order]
        count = np.stack([np.bincount(doc, a.phrases(signs, start, size), len(texts)) for a in self.automata], axis=1)
        cost = count * self.bits / np.maximum(sizes, 1)[:, None]
        best = cost.argmin(axis=1)  # of equal costs the first name
        excess = (cost - cost[np.arange(len(texts)), best][:, None]) * np.sqrt(sizes)[:, None]
        score = np.where(letters, 1 / np.exp2(-np.minimum(excess, 1000)).sum(axis=1), 0.0)
        return [self.names[i] if ok else UNDETERMINED for i, ok in zip(best.tolist(), letters.tolist())], score


@lru_cache(maxsize=2)
def languages_of(samples: tuple[tuple[str, bytes], ...]) -> Languages:
    """The automata of *samples*, built once in each worker process."""
    return Languages(dict(samples))


def is_held_out(id_col: str) -> Column:
    """Documents that are never learned from; a null id isn't one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> tuple[tuple[str, bytes], ...]:
    """Folded sample of each language: at most *texts* different texts of rows that may be learned from, *chars* characters of each."""
    known = docs.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~is_held_out(id_col))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    distinct = {row["lang"]: row["n"] for row in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # a row a language
    if not distinct:
        return ()
    limits = F.create_map(*(F.lit(v) for name, n in distinct.items() for v in (name, int(min(1.0, SPARE * texts / max(n, 1)) * (1 << 40)))))
    few = known.filter(F.pmod("h", F.lit(1 << 40)) < limits[F.col("lang")])  # about SPARE * texts different ones a language, however many there are
    piece = F.substring("text", (F.pmod(F.shiftright("h", 40), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1).cast("int"), F.lit(chars))
    pieces = few.groupBy("lang", "h").agg(F.min(piece).alias("piece"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))).filter(F.col("rank") <= texts)
    folding, samples = Folding(), {name: [] for name in distinct}
    for row in ranked.orderBy("lang", "rank").collect():
        samples[row["lang"]] += [folding.fold([row["piece"]])[0], np.array([BORDER], np.uint32)]
    return tuple((name, np.concatenate(parts).astype(np.uint32).tobytes()) for name, parts in sorted(samples.items()) if parts)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """Language of every document's whole text, learned from *lang_col* of the rows whose crc32 of the id modulo 3 isn't 1.

    Returns one row per input row: the id, held_out (that remainder is 1), lang_pred (a learned value) and score (0 to 1, the share of the best language in
    the powers of two of all excess costs). Null, empty and letterless texts are `und` with score 0, and so is every text where nothing could be
    learned; rows with null id, null language or null text are never learned from, and a null id isn't held out; of equal costs the
    alphabetically first language wins; repeated rows give repeated rows, but a repeated text is learned once; an empty table gives an empty one; other columns are
    ignored. Time and memory grow with the number of languages: each has an automaton of at most *texts* times *chars* characters in every worker.
    """
    learned = learn(docs, id_col, text_col, lang_col, texts, chars)
    sent = docs.sparkSession.sparkContext.broadcast(learned)
    source = docs.select(F.col(id_col).alias("id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = languages_of(sent.value)
        for part in slices(batches, "text"):
            names, scores = languages.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], [id_col, "held_out", "lang_pred", "score"])

    return source.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
