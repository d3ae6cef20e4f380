"""BPE encoding and decoding over the trie of distinct words.

A BPE encoding is a chain of tokens in which every neighbouring pair is *compatible*: merging the two texts again gives the same
two tokens. So the encoding of a prefix is settled by its last token alone: the one token that ends the prefix and is compatible with
the last token of what stands before it. The distinct words of a slice are put into a trie, last tokens are handed down from each node
to the nodes below it, and words that share a prefix share its encoding. All nodes of one depth are settled together, as arrays; the
rare nodes whose token is longer than eight bytes are settled one by one.

Texts never leave their task: words are made distinct within bounded slices of a partition and kept in a bounded cache, so there is
no shuffle at any size, and a lost executor costs its own partitions only.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from barlight.llm.common import slices

# Fixed values of the vocabulary's format: word pattern and word end.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

MARKED = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
RARE = re.compile("[^\\x00-\\u024f]")
"""Code points on whose class or case two Unicode versions may differ: they are left to the library's normalizer and splitter."""

CACHED = 150_000
"""Entries from which a cache starts a new generation; the one before is kept, so frequent words stay and memory is bounded."""
SLICE = 4_000_000
SEGMENT = 2_000_000
"""Characters of a very long text that are encoded at a time; cuts fall on white space, which no token crosses."""
WIDE = 40
PAIR_SLOTS = 1 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from code point 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class TokenTable:
    """Tokens by their bytes: arrays for those of up to eight bytes, a dictionary for the others."""

    def __init__(self, tokens: dict[bytes, int]):
        self.tokens = tokens
        self.long = sorted({len(w) for w in tokens if len(w) > 8})
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in range(1, 9):
            found = sorted((int.from_bytes(w, "big"), t) for w, t in tokens.items() if len(w) == width)
            keys = np.array([k for k, _ in found], np.uint64)
            self.by_width[width] = keys, np.array([t for _, t in found], np.int64)

    def find(self, width: int, packed: np.ndarray) -> np.ndarray:
        """Token of the last *width* bytes of each packed value, -1 where there is none."""
        keys, ids = self.by_width[width]
        if not len(keys):
            return np.full(len(packed), -1, np.int64)
        wanted = packed & np.uint64((1 << 8 * width) - 1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, ids[at], -1)


class Cache:
    """Two generations of a dictionary: what is asked for again moves on to the newer one."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys) -> list[str]:
        if len(self.new) > CACHED:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for key in keys:
            if key not in new:
                value = old.get(key)
                if value is None:
                    out.append(key)
                else:
                    new[key] = value
        return out


class TrieEncoder:
    """Encoder for a word-end BPE vocabulary file of the tokenizers library (NFC, lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.names = [""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for name, token in [*vocabulary.items(), *self.special.items()]:
            self.names[token] = name
        letters = byte_letters()
        spelled = {vocabulary[x]: (bytes([b]), False) for b, x in enumerate(letters)}
        spelled |= {vocabulary[x + WORD_END]: (bytes([b]), True) for b, x in enumerate(letters)}
        self.born, self.halves, self.rank = [-1] * len(self.names), {}, {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.rank[a << 32 | b] = rank
            if made not in self.halves:
                self.born[made], self.halves[made] = rank, (a, b)
                spelled[made] = spelled[a][0] + spelled[b][0], spelled[b][1]
        whole = {t: True for t in spelled if t not in self.halves}  # tokens that are the encoding of their own text
        for token in sorted(self.halves, key=self.born.__getitem__):
            a, b = self.halves[token]
            whole[token] = whole[a] and whole[b] and self._meet(a, b) == self.born[token]
        self.inner = TokenTable({w: t for t, (w, end) in spelled.items() if not end and whole[t]})
        self.final = TokenTable({w: t for t, (w, end) in spelled.items() if end and whole[t]})
        self.width = np.array([len(spelled[t][0]) if t in spelled else 0 for t in range(len(self.names))], np.int64)
        self.pair_keys = np.zeros(PAIR_SLOTS, np.uint64)  # open addressing; 0 is free, keys are stored plus one
        self.pair_fits = np.zeros(PAIR_SLOTS, bool)
        self.pairs_known = 0
        self.chunks, self.words = Cache(), Cache()
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, pre_tokenizers.Split(Regex(WORDS), "removed", invert=True)

    # -- compatible pairs

    def _meet(self, left: int, right: int) -> int | None:
        """Rank of the first merge across the border while both tokens are being built or stand complete; None: never."""
        never = len(self.born) + len(self.rank)
        edge_left, edge_right = [left], [right]
        while edge_left[-1] in self.halves:
            edge_left.append(self.halves[edge_left[-1]][1])
        while edge_right[-1] in self.halves:
            edge_right.append(self.halves[edge_right[-1]][0])
        while True:
            grow_left = self.born[edge_left[-2]] if len(edge_left) > 1 else never
            grow_right = self.born[edge_right[-2]] if len(edge_right) > 1 else never
            cross = self.rank.get(edge_left[-1] << 32 | edge_right[-1])
            if cross is not None and cross < grow_left and cross <= grow_right:  # equal ranks merge from the left
                return cross
            if grow_left == grow_right == never:
                return None
            (edge_left if grow_left <= grow_right else edge_right).pop()

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key: its own or the free one where it would go."""
        at = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.pair_keys[at[todo]]
            todo = todo[(held != 0) & (held != keys[todo])]
            at[todo] = at[todo] + 1 & PAIR_SLOTS - 1
        return at

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32 | right).astype(np.uint64) + np.uint64(1)
        at = self._slots(keys)
        new = self.pair_keys[at] == 0
        if new.any():
            fresh = np.unique(keys[new])
            if self.pairs_known + len(fresh) > PAIR_SLOTS // 2:
                self.pair_keys[:] = 0
                self.pairs_known, fresh = 0, np.unique(keys)
            for key in fresh.tolist():
                slot = self._slots(np.array([key], np.uint64))[0]
                self.pair_keys[slot] = key
                self.pair_fits[slot] = self._meet(key - 1 >> 32, key - 1 & 0xFFFFFFFF) is None
            self.pairs_known += len(fresh)
            at = self._slots(keys)
        return self.pair_fits[at]

    # -- the trie

    def _last_tokens(self, rows: np.ndarray, end: np.ndarray, words: list[bytes], packed: np.ndarray, last: np.ndarray, table: TokenTable) -> np.ndarray:
        """Last token of the prefix words[row][:end] of each row, given the last tokens of all shorter prefixes of it."""
        found = np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        for width in (3, 2, 4, 5, 1, 6, 7, 8):  # only one token can fit, so the likeliest widths come first
            at = todo[end[todo] >= width]
            if not len(at):
                continue
            token = table.find(width, packed[rows[at], end[at]])
            at, token = at[token >= 0], token[token >= 0]
            start = end[at] - width
            fits = start == 0
            if not fits.all():
                more = ~fits
                fits[more] = self._compatible(last[rows[at[more]], start[more]], token[more])
            found[at[fits]] = token[fits]
            todo = todo[found[todo] < 0]
        for i in todo.tolist():
            row, stop = int(rows[i]), int(end[i])
            for width in table.long:
                token = table.tokens.get(words[row][stop - width : stop]) if width <= stop else None
                if token is not None and (width == stop or self._compatible(last[row : row + 1, stop - width], np.array([token]))[0]):
                    found[i] = token
                    break
            else:
                raise ValueError(f"no token ends {words[row][:stop]!r}")
        return found

    def encode_words(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian uint32) of distinct pre-tokenized words."""
        raw = [t.encode() for t in texts]
        order = sorted(range(len(raw)), key=raw.__getitem__)
        out: list[bytes] = [b""] * len(raw)
        for wide in (False, True):
            chosen = [i for i in order if (len(raw[i]) > WIDE) == wide]
            step = 1 if wide else max(len(chosen), 1)
            for start in range(0, len(chosen), step):
                part = chosen[start : start + step]
                for i, ids in zip(part, self._encode_sorted([raw[i] for i in part])):
                    out[i] = ids
        return out

    def _encode_sorted(self, words: list[bytes]) -> list[bytes]:
        n, size = len(words), np.array([len(w) for w in words], np.int64)
        span = int(size.max())
        letters = np.zeros((n, span), np.uint8)
        letters[np.arange(span) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        packed = np.zeros((n, span + 1), np.uint64)
        for d in range(span):
            packed[:, d + 1] = packed[:, d] << np.uint64(8) | letters[:, d]
        same = (letters[1:] == letters[:-1]) & (np.arange(span) < np.minimum(size[1:], size[:-1])[:, None])
        shared = np.concatenate([[0], np.where(same.all(axis=1), span, np.argmin(same, axis=1))])
        last = np.full((n, span + 1), -1, np.int64)
        numbers = np.arange(n)
        for depth in range(1, span):
            inner = size > depth
            # The first word of a run that shares this prefix is its trie node; a shorter word between them has the prefix, too.
            opens = shared < depth
            node = np.maximum.accumulate(np.where(opens, numbers, 0))
            wanted = np.unique(node[inner])
            if not len(wanted):
                break
            long_enough = wanted[size[wanted] >= depth]
            tokens = np.full(n, -1, np.int64)
            tokens[long_enough] = self._last_tokens(long_enough, np.full(len(long_enough), depth), words, packed, last, self.inner)
            last[:, depth] = tokens[node]
        token, end = self._last_tokens(numbers, size, words, packed, last, self.final), size.copy()
        chain, active = [], numbers
        while len(active):
            column = np.full(n, -1, np.int64)
            column[active] = token[active]
            chain.append(column)
            end[active] -= self.width[token[active]]
            active = active[end[active] > 0]
            token[active] = last[active, end[active]]
        grid = np.stack(chain[::-1], axis=1)
        flat = grid[grid >= 0].astype("<u4").tobytes()
        stops = np.cumsum((grid >= 0).sum(axis=1)) * 4
        starts = np.concatenate([[0], stops[:-1]])
        return [flat[a:b] for a, b in zip(starts.tolist(), stops.tolist())]

    # -- texts

    def _split(self, chunks: list[str]) -> Iterator[list[str]]:
        """Words of each chunk; chunks hold no ASCII white space and no special token."""
        rare = {i for i, c in enumerate(chunks) if not c.isascii() and RARE.search(c)}
        joined = "\n".join([c for i, c in enumerate(chunks) if i not in rare] if rare else chunks)
        marked = MARKED.findall(unicodedata.normalize("NFC", joined).lower())
        start = 0
        for i, chunk in enumerate(chunks):
            if i in rare:
                yield [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]
                continue
            try:
                stop = marked.index("\n", start)
            except ValueError:
                stop = len(marked)
            yield marked[start:stop]
            start = stop + 1

    def _learn(self, chunks: list[str]) -> None:
        """Put the ids of *chunks* into the cache."""
        marked = [c for c in chunks if "<|" in c and self.special_pattern.search(c)]
        if marked:
            parts = {c: [p for p in self.special_pattern.split(c) if p] for c in marked}
            self._learn(sorted({p for found in parts.values() for p in found if p not in self.special}))
            known = self.chunks.new
            for chunk, found in parts.items():
                known[chunk] = b"".join(self.special[p].to_bytes(4, "little") if p in self.special else known[p] for p in found)
            chunks = [c for c in chunks if c not in parts]
        split = list(self._split(chunks))
        fresh = self.words.missing({w for words in split for w in words})
        known, made = self.words.new, self.chunks.new
        known.update(zip(fresh, self.encode_words(fresh)))
        for chunk, words in zip(chunks, split):
            made[chunk] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32) and where each text's ids begin (one more than texts); null counts as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = split.flatten().dictionary_encode()
        distinct, index = flat.dictionary.to_pylist(), flat.indices.to_numpy()
        borders = split.offsets.to_numpy() - split.offsets[0].as_py()
        self._learn(self.chunks.missing(distinct))
        ids = list(map(self.chunks.new.__getitem__, distinct))
        stock = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        starts = np.cumsum(sizes) - sizes
        each = sizes[index]
        stops = np.cumsum(each)
        total = int(stops[-1]) if len(stops) else 0
        at = np.repeat((starts[index] - (stops - each)).astype(np.int32), each)
        at += np.arange(total, dtype=np.int32)
        return stock[at], np.concatenate([[0], stops])[borders]

    def decode(self, ids: np.ndarray) -> str:
        """Names of the tokens with a space between them: the vocabulary names no decoder."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    """One encoder per vocabulary and worker process."""
    return TrieEncoder(path)


def segments(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > SEGMENT:
        cut = re.compile("[ \t-\r]").search(text, start + SEGMENT)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Bounded slices of Arrow batches and the ids (uint32) of each of their texts."""
    bpe = encoder(vocabulary)
    for part in slices(batches, column, SLICE):
        texts = part.column(column)
        if part.num_rows == 1 and texts[0].is_valid and len(text := texts[0].as_py()) > SEGMENT:
            yield part, [np.concatenate([bpe.encode(pa.array([s]))[0] for s in segments(text)])]
            continue
        ids, borders = bpe.encode(texts)
        yield part, [ids[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """Encode and decode every whole text.

    Returns one row per input row: the id column, n_tokens, ids_sha256, decoded_sha256, and on request ids (binary, little-endian uint32) and
    decoded. A null text counts as empty (no ids, hash of nothing); a null id stays null; repeated rows give repeated rows; an empty table gives
    an empty one; other columns are ignored, whatever their names. Very long texts are encoded in segments that end before white space.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = [(id_col, source.schema["id"].dataType.simpleString()), ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    kinds += [("ids", "binary")] * keep_ids + [("decoded", "string")] * keep_text
    schema = ", ".join(f"`{name}` {kind}" for name, kind in kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for part, ids in encoded(batches, vocabulary):
            texts, hashes = [], []
            for x in ids:
                text = bpe.decode(x)
                hashes.append(hashlib.sha256(text.encode()).hexdigest())
                if keep_text:
                    texts.append(text)
            out = [part.column("id"), pa.array([len(x) for x in ids], pa.int64())]
            out += [pa.array([hashlib.sha256(x.data).hexdigest() for x in ids], pa.string()), pa.array(hashes, pa.string())]
            out += [pa.array([x.tobytes() for x in ids], pa.binary())] * keep_ids + [pa.array(texts, pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays(out, [name for name, _ in kinds])

    return source.mapInArrow(run, schema)
