"""Toxicity by weak supervision.

1. A bounded sample of labelled rows gives terms (words and word stems of four to six letters) that toxic documents hold far more often than
   others. They fill the lexicons of the voters; further voters look at patterns (shouting, exclamation marks, direct address).
2. Each voter says toxic, clean or nothing about every document. A generative label model, fitted to the counts of all vote patterns
   without labels, estimates how often each voter is right for either class, and how voters depend on each other: pairs that still agree
   given the class share one joint table. There are at most 3**11 patterns, whatever the corpus.
3. A linear classifier on capped term counts is trained on the posterior labels of a bounded sample, and scores every document.

Whole texts are read once, in one map; what moves on are votes and a few term counts of each document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from barlight.llm.common import slices
from barlight.llm.logistic import fit_sparse, sigmoid
from barlight.session import durable

MAX_LABELLED = 20_000
MAX_TRAINING = 30_000
MAX_TERMS = 4_000
FOLDS = 5
STEMS = (4, 5, 6)
MIN_RATIO = 5.0
MIN_EVIDENCE = 16.0
"""Nats by which a term's toxic share must speak against chance: more than the logarithm of the number of terms."""
CAP = 3
PENALTY = 2e-4
VOTERS = ("words_0", "words_1", "words_2", "stem_4", "stem_5", "stem_6", "distinct", "density", "exclamation", "shouting", "address")
# Direct address in the corpus's languages.
ADDRESS = r"(?i)\b(you are an?|you're an?|shut up|tu es|vous êtes|du bist|ihr seid|eres un|eres una)\b"

WORDS = regex.compile(r"\p{L}+")


def terms_of(word: str) -> list[str]:
    """The terms of a lower-case word: itself, and its stems, which are marked."""
    return ["=" + word] + [word[:n] + "-" for n in STEMS if len(word) >= n]


def learned(doc_id, folds: int = FOLDS):
    """Rows that labels may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds != 0, F.lit(False))


def discover_terms(docs: DataFrame, labels: DataFrame) -> list[str]:
    """Terms of toxic documents in a bounded sample of labelled rows, most telling first."""
    known = labels.filter(F.col("toxic").isNotNull() & learned(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    texts = docs.join(F.broadcast(sample), "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            keys = list(found[0].keys() | found[1].keys())
            columns = [pa.array(keys, pa.string()), pa.array([found[1][k] for k in keys], pa.int64()), pa.array([found[0][k] for k in keys], pa.int64())]
            found[0].clear(), found[1].clear()
            return pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])

        docs_seen = [0, 0]
        for part in slices(batches, "text"):
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                docs_seen[toxic] += 1
                found[toxic].update({t for word in set(WORDS.findall((text or "").lower())) for t in terms_of(word)})
            if len(found[0]) + len(found[1]) > 300_000:
                yield flush()
        found[1][""], found[0][""] = docs_seen[1], docs_seen[0]
        yield flush()

    counts = durable(texts.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= 3))
    whole = counts.filter("term = ''").first()
    if whole is None:
        return []
    ratio = (F.col("toxic") + 0.5) / (whole["toxic"] + 1) / ((F.col("clean") + 0.5) / (whole["clean"] + 1))
    base = (whole["toxic"] + 1) / (whole["toxic"] + whole["clean"] + 2)
    held = F.col("toxic") + F.col("clean")
    evidence = F.col("toxic") * F.log(F.col("toxic") / held / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / held / (1 - base))).otherwise(0.0)
    strong = counts.filter("term != ''").filter((ratio >= MIN_RATIO) & (evidence >= MIN_EVIDENCE)).orderBy(F.desc(evidence), "term").limit(MAX_TERMS)
    return [r["term"] for r in strong.select("term").collect()]


class TermCounter:
    """Counts of known terms in texts; each distinct chunk of a slice is looked at once."""

    def __init__(self, terms: list[str]):
        self.index = {t: i for i, t in enumerate(terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def hits(self, chunk: str) -> tuple[int, ...]:
        found = self.known.get(chunk)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            index = self.index
            found = self.known[chunk] = tuple(index[t] for word in WORDS.findall(chunk.lower()) for t in terms_of(word) if t in index)
        return found

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, capped count) triples, and the number of words of each text."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        hits = [self.hits(c) for c in coded.dictionary.to_pylist()]
        some = np.array([bool(h) for h in hits] or [False])
        index = coded.indices.to_numpy()
        borders = split.offsets.to_numpy() - split.offsets[0].as_py()
        at = np.flatnonzero(some[index]) if len(index) else np.zeros(0, np.int64)
        doc = np.searchsorted(borders, at, side="right") - 1
        pairs = [(d, t) for d, i in zip(doc.tolist(), index[at].tolist()) for t in hits[i]]
        width = len(self.index) + 1
        key, n = np.unique(np.array([d * width + t for d, t in pairs], np.int64), return_counts=True)
        return key // width, key % width, np.minimum(n, CAP), np.diff(borders)


def votes(doc: np.ndarray, term: np.ndarray, n: np.ndarray, words: np.ndarray, texts: pa.Array, kinds: np.ndarray) -> np.ndarray:
    """A row of votes for each text: 1 toxic, -1 clean, 0 nothing. kinds: 0-2 word lexicons, 4-6 stem lexicons."""
    size = len(words)
    tally = lambda mask: np.bincount(doc[mask], n[mask], size)
    both = lambda hits: np.where(hits >= 2, 1, -1)  # noqa: E731  one hit may be chance
    columns = [np.where(tally(kinds[term] == k) >= 2, 1, 0) for k in range(3)]
    columns += [both(tally(kinds[term] == k)) for k in STEMS]
    whole = kinds[term] < 3
    columns.append(both(np.bincount(doc[whole], minlength=size)))
    hits = tally(kinds[term] == STEMS[0]) + tally(whole)
    columns.append(np.where(hits >= 2 + words / 400, 1, np.where(hits < 2, -1, 0)))
    texts = pc.fill_null(texts, "")
    rate = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) / np.maximum(words, 1)
    columns.append(np.where(rate("!") > 0.03, 1, 0))
    columns.append(np.where(rate(r"\b[A-Z][A-Z]+\b") > 0.3, 1, 0))
    columns.append(np.where(rate(ADDRESS) * words >= 1, 1, 0))
    return np.stack(columns, axis=1).astype(np.int8)


class LabelModel:
    """P(votes | class) as a product of tables, one for each voter or clique of dependent voters, and the share of toxic documents."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, dependence: float = 0.05, clique: int = 3):
        self.cliques = [(j,) for j in range(patterns.shape[1])]
        self._expectation_maximisation(patterns, counts, rounds)
        linked = sorted(((self._conditional_information(patterns, counts, i, j), i, j) for i in range(patterns.shape[1]) for j in range(i)), reverse=True)
        group = {j: (j,) for j in range(patterns.shape[1])}
        for strength, i, j in linked:
            merged = tuple(sorted({*group[i], *group[j]}))
            if strength > dependence and len(merged) <= clique:
                for member in merged:
                    group[member] = merged
        self.cliques = sorted(set(group.values()))
        self._expectation_maximisation(patterns, counts, rounds)

    def _codes(self, patterns: np.ndarray) -> list[np.ndarray]:
        return [sum((patterns[:, j].astype(int) + 1) * 3**p for p, j in enumerate(c)) for c in self.cliques]

    def _expectation_maximisation(self, patterns: np.ndarray, counts: np.ndarray, rounds: int) -> None:
        codes = self._codes(patterns)
        toxic = sigmoid(2.0 * patterns.sum(axis=1))
        for _ in range(rounds):
            mass = counts * toxic
            self.share = float(np.clip(mass.sum() / counts.sum(), 1e-4, 0.9))
            self.tables = []
            for code, c in zip(codes, self.cliques):
                cells = 3 ** len(c)
                both = np.stack([np.bincount(code, m, cells) + 1.0 / cells for m in (counts - mass, mass)])
                self.tables.append(np.log(both / both.sum(axis=1, keepdims=True)))
            new = self.posterior(patterns)
            if np.abs(new - toxic).max() < 1e-6:
                break
            toxic = new
        self.toxic = toxic

    def _conditional_information(self, patterns: np.ndarray, counts: np.ndarray, i: int, j: int) -> float:
        """Mutual information of two voters given the class, as the other voters see it: a pair that repeats itself would else pass for the class."""
        total, toxic = 0.0, self.posterior(patterns, (i, j))
        for mass in (counts * toxic, counts * (1 - toxic)):
            joint = np.bincount((patterns[:, i] + 1) * 3 + patterns[:, j] + 1, mass, 9).reshape(3, 3) + 1e-9
            joint /= joint.sum()
            total += mass.sum() / counts.sum() * (joint * np.log(joint / joint.sum(axis=1, keepdims=True) / joint.sum(axis=0))).sum()
        return total

    def posterior(self, patterns: np.ndarray, without: tuple[int, ...] = ()) -> np.ndarray:
        """Probability of toxic for each pattern, from all voters or all but some."""
        z = np.full(len(patterns), np.log(self.share / (1 - self.share)))
        for clique, code, table in zip(self.cliques, self._codes(patterns), self.tables):
            if not set(clique) & set(without):
                z += table[1][code] - table[0][code]
        return sigmoid(z)


def vote_table(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, votes, terms, counts) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(sent.value)
        kinds = np.array([hash_third(t) if t.startswith("=") else len(t) - 1 for t in sent.value] + [9])
        for part in slices(batches, "text"):
            doc, term, n, words = counter.count(part.column("text"))
            said = votes(doc, term, n, words, part.column("text"), kinds)
            offsets = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32())
            columns = [part.column("doc_id"), pa.array(["".join("-0+"[v + 1] for v in row) for row in said.tolist()], pa.string())]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, n)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "votes", "terms", "counts"])

    return docs.mapInArrow(run, f"doc_id {kind}, votes string, terms array<int>, counts array<int>")


def hash_third(term: str) -> int:
    return sum(term.encode()) % 3


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every whole text of *docs* (doc_id, text), learned from *labels* (doc_id, toxic).

    Returns one row per input row: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), and posterior, the label model's view. Labels are learned
    from rows alone whose crc32(doc_id as text) mod 5 is not 0. Null and empty texts are scored as texts without terms; a null id is never learned
    from and counts as not held out; labels without id or value are ignored, and of several labels of an id the largest counts; repeated rows give
    repeated rows; empty tables give an empty result, and without toxic labels no document is toxic (score 0). Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    terms = discover_terms(docs, labels)
    table = durable(vote_table(docs, terms))
    patterns = table.groupBy("votes").count().collect()
    held_out = ~learned(F.col("doc_id")) & F.col("doc_id").isNotNull()
    if not terms or not patterns:
        return table.select("doc_id", held_out.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("posterior"))
    as_row = lambda said: ["-0+".index(c) - 1 for c in said]
    model = LabelModel(np.array([as_row(r["votes"]) for r in patterns]), np.array([r["count"] for r in patterns], float))

    training = table.filter(learned(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING).select("votes", "terms", "counts").toArrow()
    size, lists = training.num_rows, training.column("terms").combine_chunks()
    row = np.repeat(np.arange(size), np.diff(lists.offsets.to_numpy()))
    target = model.posterior(np.array([as_row(v) for v in training.column("votes").to_pylist()]).reshape(size, len(VOTERS)))
    column, value = lists.flatten().to_numpy(), training.column("counts").combine_chunks().flatten().to_numpy().astype(float)
    weights, intercept = fit_sparse(row, column, value, len(terms), target, np.ones(size), PENALTY)
    share = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("terms")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            n = batch.column("counts").flatten().to_numpy()
            score = sigmoid(np.bincount(doc, n * weights[found.flatten().to_numpy()], batch.num_rows) + intercept)
            view = share.posterior(np.array([as_row(v) for v in batch.column("votes").to_pylist()]).reshape(batch.num_rows, len(VOTERS)))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(view)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "posterior"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return table.withColumn("held_out", held_out).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, posterior double")
