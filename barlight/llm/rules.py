"""Quality rules as a short-circuit cascade.

Every rule rejects documents; a document is kept when none rejects it. The rules are timed on a small sample, with the statistics that they need, and
their rejections are counted there as well. They then run in order of rejections per second: each sees only the documents that are still alive, and
a statistic is counted when a rule first asks for it, for those documents alone. The order changes the work and never the verdict.

Texts are split, numbered and counted as arrays within bounded slices of a partition. There is no shuffle.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from barlight.llm.common import slices

SAMPLE_ROWS = 400
"""Rows that the driver times the rules on."""
MIN_WORDS = 50

SPACE_BYTES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


class Texts:
    """A slice of texts. Statistics are computed for the rows that are asked for, once for each row."""

    def __init__(self, texts: pa.Array):
        self.raw: list[bytes] = pc.fill_null(texts.cast(pa.binary()), b"").to_pylist()
        self.n = len(self.raw)
        self.evaluated = dict.fromkeys(STATISTICS, 0)
        self._values = {name: np.zeros(self.n, np.int64) for name in STATISTICS}
        self._known = {name: np.zeros(self.n, bool) for name in STATISTICS}
        self._split: tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray] | None = None

    def __getitem__(self, asked: tuple[str, np.ndarray]) -> np.ndarray:
        """Statistic *name* of *rows*."""
        name, rows = asked
        missing = rows[~self._known[name][rows]]
        if len(missing):
            for known, values in STATISTICS[name](self, missing).items():
                self._values[known][missing], self._known[known][missing] = values, True
                self.evaluated[known] += len(missing)
        return self._values[name][rows]

    def words(self, rows: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words, and for each word of *rows* its number among them and the place of its row in *rows*."""
        asked = np.zeros(self.n, bool)
        asked[rows] = True
        if self._split is None or (asked & ~self._split[0]).any():
            lists = [self.raw[row].split() for row in rows]
            coded = pa.array([w for words in lists for w in words], pa.binary()).dictionary_encode()
            self._split = asked, coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(rows, [len(x) for x in lists])
        _, distinct, word, row = self._split
        stays = asked[row]
        return distinct, word[stays], np.searchsorted(rows, row[stays])


def byte_counts(texts: Texts, rows: np.ndarray) -> dict[str, np.ndarray]:
    """Words, their code points and symbols."""
    raw = [texts.raw[row] for row in rows]
    flat = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([0, *map(len, raw)])
    space, symbol = np.zeros(256, bool), np.zeros(256, bool)
    space[list(SPACE_BYTES)] = symbol[list(SYMBOLS)] = True
    is_space = space[flat]
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[ends])
    opens = ~is_space & np.concatenate([[True], is_space[:-1]]) if len(flat) else np.zeros(0, bool)
    starts = ends[:-1][ends[:-1] < len(flat)]
    opens[starts] = ~is_space[starts]
    return {"n_words": sums(opens), "word_chars": sums(~is_space & (flat & 0xC0 != 0x80)), "n_symbols": sums(symbol[flat])}


def repeat_words(texts: Texts, rows: np.ndarray) -> dict[str, np.ndarray]:
    """Words that lie in a window of three words which the text holds twice or more."""
    distinct, word, doc = texts.words(rows)
    if len(word) < 3:
        return {"n_repeat_words": np.zeros(len(rows), np.int64)}
    vocabulary = len(distinct)
    _, pair = np.unique(word[:-1] * vocabulary + word[1:], return_inverse=True)
    _, triple = np.unique(pair[:-1] * vocabulary + word[2:], return_inverse=True)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    _, back, count = np.unique(doc[at] * (int(triple.max()) + 1) + triple[at], return_inverse=True, return_counts=True)
    again = at[count[back] > 1]
    covered = np.zeros(len(word), bool)
    for shift in range(3):
        covered[again + shift] = True
    return {"n_repeat_words": np.bincount(doc[covered], minlength=len(rows))}


def lines(texts: Texts, rows: np.ndarray) -> dict[str, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier one."""
    held = [[line for line in texts.raw[row].split(b"\n") if line.strip()] for row in rows]
    count = np.array([len(x) for x in held], np.int64)
    return {"n_lines": count, "n_dup_lines": count - np.array([len(set(x)) for x in held], np.int64)}


def words_like(name: str, pattern: str) -> Callable[[Texts, np.ndarray], dict[str, np.ndarray]]:
    """Counts words that match *pattern*; each distinct word is looked at once."""

    def count(texts: Texts, rows: np.ndarray) -> dict[str, np.ndarray]:
        distinct, word, doc = texts.words(rows)
        hit = pc.match_substring_regex(distinct.cast(pa.string()), pattern).to_numpy(zero_copy_only=False)
        return {name: np.bincount(doc[hit[word]], minlength=len(rows)) if len(word) else np.zeros(len(rows), np.int64)}

    return count


STATISTICS: dict[str, Callable[[Texts, np.ndarray], dict[str, np.ndarray]]] = {
    "n_words": byte_counts,
    "word_chars": byte_counts,
    "n_symbols": byte_counts,
    "n_repeat_words": repeat_words,
    "n_lines": lines,
    "n_dup_lines": lines,
    "n_letter_words": words_like("n_letter_words", r"\pL"),
    "n_shouted_words": words_like("n_shouted_words", "^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$"),
}


@dataclass(frozen=True)
class Rule:
    """A named test: which of *rows* it rejects. It asks the texts for the statistics it needs, of these rows alone."""

    name: str
    rejects: Callable[[Texts, np.ndarray], np.ndarray]


RULES = (
    Rule("too_few_words", lambda t, rows: t["n_words", rows] < MIN_WORDS),
    Rule("repeated_windows", lambda t, rows: 100 * t["n_repeat_words", rows] > 50 * t["n_words", rows]),
    Rule("many_symbols", lambda t, rows: 100 * t["n_symbols", rows] > 25 * t["n_words", rows]),
    Rule("repeated_lines", lambda t, rows: 100 * t["n_dup_lines", rows] > 40 * t["n_lines", rows]),
    Rule("word_length", lambda t, rows: (10 * t["word_chars", rows] < 25 * t["n_words", rows]) | (t["word_chars", rows] > 15 * t["n_words", rows])),
    Rule("words_without_letter", lambda t, rows: 100 * t["n_letter_words", rows] < 70 * t["n_words", rows]),
    Rule("shouted_words", lambda t, rows: 100 * t["n_shouted_words", rows] > 50 * t["n_words", rows]),
)


def cascade(texts: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """Mask of the documents that no rule rejects; each rule sees, and has counted, what its predecessors left."""
    alive = np.arange(texts.n)
    for rule in rules:
        if not len(alive):
            break
        alive = alive[~rule.rejects(texts, alive)]
    kept = np.zeros(texts.n, bool)
    kept[alive] = True
    return kept


def plan_cascade(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Order *rules* by rejections per second on about *rows* sampled rows; the time is that of a rule's statistics and its test."""
    share = min(1.0, rows / max(1, docs.count()))
    sample = docs.select(F.col(text_col).cast("binary").alias("text")).sample(share, seed=11).toArrow().column("text").combine_chunks()
    worth = []
    for rule in rules:
        texts = Texts(sample)  # nothing is counted yet
        began = time.perf_counter()
        rejected = int(rule.rejects(texts, np.arange(texts.n)).sum()) if texts.n else 0
        worth.append((rejected + 0.5) / (time.perf_counter() - began + 1e-7))
    return tuple(rules[i] for i in np.argsort([-w for w in worth], kind="stable"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdict of every document.

    Returns one row per input row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and kept (boolean). A
    null, empty or blank text has no words, fails the base rule and is not kept; null and repeated ids and repeated rows are judged like any
    other; an empty table gives an empty one; other columns are ignored. Words are runs of anything but ASCII white space.
    """
    order = plan_cascade(docs, text_col, rules)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"`{id_col}` {source.schema['id'].dataType.simpleString()}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = Texts(part.column("text"))
            everyone = np.arange(texts.n)
            counts = [pa.array(texts[n, everyone], pa.int64()) for n in names]
            failed = RULES[0].rejects(texts, everyone) | RULES[1].rejects(texts, everyone)
            yield pa.RecordBatch.from_arrays([part.column("id"), *counts, pa.array(failed), pa.array(cascade(texts, order) & ~failed)], [id_col, *names, "base_failed", "kept"])

    return source.mapInArrow(run, schema)


def keep(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns; texts without words go.

    Texts go to Python and verdicts come back: the rows themselves stay in the JVM.
    """
    order = plan_cascade(docs, text_col, rules)

    @F.arrow_udf("boolean")
    def passes(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(np.concatenate([cascade(Texts(part.column("text")), order) for part in slices(iter([pa.record_batch([column], ["text"])]), "text")] or [np.zeros(0, bool)]))

    return docs.filter(passes(F.col(text_col)))
