"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

All symbols of many words stand in one flat array. Each round looks up every neighbouring pair by binary search over the
sorted pair keys, takes the lowest rank of each word, and merges its occurrences from the left. Words without a mergeable
pair leave the array. Texts are cut into words by array operations too: a table gives the class of each code point, and the
pre-tokenizer's pattern becomes a rule on neighbouring classes.

Null and empty texts give no ids. Repeated rows are encoded each. Only the id and the text are read, so other columns may have
any names. A text of any length is one row; memory follows the longest text and ``CHUNK_CHARS``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters whose arrays are held at once, and words a worker remembers before it starts anew.
CHUNK_CHARS = 500_000
REMEMBERED_WORDS = 400_000

SPACE, WHITE, LETTER, NUMBER, OTHER, NONE, UNKNOWN = range(7)
NO_RANK = np.iinfo(np.int32).max
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> dict[str, int]:
    """The visible character that stands for each byte in byte-level vocabularies, by rule: printable Latin-1 characters
    stand for themselves, all others take the code points from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Index(dict):
    """Numbers words in the order they are first met, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


def ragged(offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of slices (offset, count), one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets - (ends - counts), counts)


class Codec:
    """One vocabulary; made from the JSON text of a byte-level BPE tokenizer."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        to_byte = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        words = {i: bytes(to_byte[c] for c in w) for w, i in vocab.items() if w not in self.special}
        words |= {i: w.encode() for w, i in self.special.items()}
        parts = [words.get(i, b"") for i in range(max(words) + 1)]
        self.byte_counts = np.array([len(p) for p in parts], dtype=np.int64)
        self.byte_offsets = np.cumsum(self.byte_counts) - self.byte_counts
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.first = np.zeros(256, dtype=np.int32)
        for c, b in to_byte.items():
            self.first[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.classes = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        self.index = Index()
        self.offsets = self.counts = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        n = len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(n), sizes)
        rank = np.full(len(symbols), NO_RANK, dtype=np.int32)  # of the pair that starts here
        makes = np.zeros(len(symbols), dtype=np.int32)  # and the symbol it merges to
        self._look_up(np.arange(len(symbols)), symbols, owner, rank, makes)
        done_symbols, done_owners = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(owner)])
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            ended = least == NO_RANK
            if ended.any():
                done_symbols.append(symbols[ended])
                done_owners.append(owner[ended])
            where = np.flatnonzero((rank == least) & ~ended)
            # Of neighbouring occurrences, as in "aaaa", every second one from the left is merged.
            new_run = np.r_[True, np.diff(where) != 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run_start) % 2 == 0]
            symbols[where] = makes[where]
            keep = ~ended
            keep[where + 1] = False
            merged = np.cumsum(keep)[where] - 1
            symbols, owner, rank, makes = symbols[keep], owner[keep], rank[keep], makes[keep]
            # Only the pairs around a merged symbol are new.
            self._look_up(np.r_[merged, merged[merged > 0] - 1], symbols, owner, rank, makes)
        if not done_symbols:
            return np.zeros(0, dtype=np.int32), np.zeros(n, dtype=np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owners)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=n)

    def _look_up(self, at: np.ndarray, symbols, owner, rank, makes) -> None:
        """Set rank and result of the pairs that start at the given places, by binary search over the sorted keys."""
        rank[at] = NO_RANK
        at = at[at < len(symbols) - 1]
        at = at[owner[at] == owner[at + 1]]
        key = (symbols[at].astype(np.int64) << 20) | symbols[at + 1]
        place = np.searchsorted(self.keys, key)
        place[place == len(self.keys)] = 0
        known = self.keys[place] == key
        rank[at[known]] = self.ranks[place[known]]
        makes[at[known]] = self.made[place[known]]

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokenized words of all texts as numbers in the index, and how many each text has."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        kinds = self._kinds(points)
        ends = np.cumsum(sizes)
        firsts = (ends - sizes)[sizes > 0]
        before = np.r_[np.uint8(NONE), kinds[:-1]]
        before[firsts] = NONE
        white, white_before = kinds <= WHITE, before <= WHITE
        begins = ~white & (kinds != before)  # a run of letters, numbers or other signs
        starts = (white & ~white_before) | (begins & (before != SPACE))
        # The last white space before a run stands alone, or leads the run if it is a space.
        starts[np.flatnonzero(begins & white_before) - 1] = True
        self._contractions(points, kinds, starts, before)
        where = np.flatnonzero(starts)
        per_text = np.searchsorted(where, ends) - np.searchsorted(where, ends - sizes)
        stops = np.r_[where[1:], len(points)]
        codes, firsts = distinct_words(points, where, stops)
        words = [joined[a:b] for a, b in zip(where[firsts].tolist(), stops[firsts].tolist())]
        known = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        return known[codes], per_text

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        kinds = self.classes[points]
        unknown = kinds == UNKNOWN
        if unknown.any():
            classify(np.unique(points[unknown]), self.classes)
            kinds = self.classes[points]
        return kinds

    def _contractions(self, points, kinds, starts, before) -> None:
        """A word that starts at an apostrophe ends after s, t, re, ve, m, ll or d, whatever letters follow."""
        at = np.flatnonzero(starts & (points == 0x27))
        if not len(at):
            return
        padded = np.r_[points, 0, 0, 0]
        inside = np.r_[before, NONE, NONE, NONE] != NONE  # False where another text starts
        a, b = padded[at + 1], padded[at + 2]
        one = inside[at + 1] & np.isin(a, [ord(c) for c in "stmd"])
        two = inside[at + 1] & inside[at + 2] & np.logical_or.reduce([(a == ord(x)) & (b == ord(y)) for x, y in ("re", "ve", "ll")])
        for hit, size in ((one, 2), (two, 3)):
            found = at[hit]
            starts[found + 1] = False
            after = found + size
            after = after[after < len(points)]
            starts[after[(kinds[after] == LETTER) & (before[after] != NONE)]] = True

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        pieces, owners = texts, None
        if any(s in t for s in self.special for t in texts):
            pieces, owners = self._cut_at_special(texts)
        plain = [p for p in pieces if isinstance(p, str)]
        if len(self.index) > REMEMBERED_WORDS:
            self.forget()
        index = self.index
        numbers, per_piece = self.numbers(plain)
        if index.fresh:
            flat, counts = self.merge([w.encode() for w in index.fresh])
            index.fresh.clear()
            self.offsets = np.r_[self.offsets, len(self.flat) + np.cumsum(counts) - counts]
            self.counts = np.r_[self.counts, counts]
            self.flat = np.r_[self.flat, flat]
        counts = self.counts[numbers]
        ids = self.flat[ragged(self.offsets[numbers], counts)]
        totals = np.r_[0, np.cumsum(counts)]
        ends = np.cumsum(per_piece)
        sizes = totals[ends] - totals[ends - per_piece]
        if owners is None:
            return ids, sizes
        return self._with_special(pieces, owners, ids, sizes, len(texts))

    def _cut_at_special(self, texts: list[str]) -> tuple[list, np.ndarray]:
        import re

        pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pieces, owners = [], []
        for n, text in enumerate(texts):
            for k, part in enumerate(pattern.split(text)):
                pieces.append(self.special[part] if k % 2 else part)
                owners.append(n)
        return pieces, np.array(owners)

    def _with_special(self, pieces, owners, ids, sizes, n):
        parts, counts, begun = [], np.zeros(n, dtype=np.int64), 0
        sizes = iter(sizes.tolist())
        for piece, owner in zip(pieces, owners.tolist()):
            size = next(sizes) if isinstance(piece, str) else 1
            parts.append(ids[begun:begun + size] if isinstance(piece, str) else np.array([piece], dtype=np.int32))
            begun += size if isinstance(piece, str) else 0
            counts[owner] += size
        return np.concatenate(parts), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of slices of one id array; bytes that are no UTF-8 become replacement characters."""
        sizes = self.byte_counts[ids]
        data = self.bytes[ragged(self.byte_offsets[ids], sizes)].tobytes()
        totals = np.r_[0, np.cumsum(sizes)]
        ends = np.cumsum(counts)
        return [
            data[a:b].decode("utf-8", "replace")
            for a, b in zip(totals[ends - counts].tolist(), totals[ends].tolist())
        ]


def classify(points: np.ndarray, table: np.ndarray) -> None:
    """Note the class of code points, as the pre-tokenizer's pattern tells them apart."""
    import regex

    patterns = [(regex.compile(p), kind) for p, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", WHITE))]
    for c in points.tolist():
        table[c] = SPACE if c == 0x20 else next((kind for p, kind in patterns if p.match(chr(c))), OTHER)


def distinct_words(points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each word, equal for equal words, and the first word of each code.

    Words meet by a 64-bit hash and are then compared in full; should two differ, all are compared as strings.
    """
    sizes = stops - starts
    place = np.arange(len(points)) - np.repeat(starts, sizes)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(sizes.max()), MULTIPLIER, dtype=np.uint64)])
    hashes = np.add.reduceat((points + np.uint64(1)) * powers[place], starts) * MULTIPLIER + sizes.astype(np.uint64)
    codes, _ = pd.factorize(hashes)
    firsts = np.zeros(codes.max() + 1, dtype=np.int64)
    firsts[codes[::-1]] = np.arange(len(codes))[::-1]
    like = firsts[codes]
    same = np.array_equal(sizes, sizes[like]) and np.array_equal(points, points[ragged(starts[like], sizes)])
    if not same:
        words = [points[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist())]
        codes, _ = pd.factorize(np.array(words, dtype=object))
        firsts = np.unique(codes, return_index=True)[1]
    return codes, firsts


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most ``limit`` characters; a longer text is a range of its own."""
    start = size = 0
    for n, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, n
            start, size = n, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def read_vocabulary(path: str) -> str:
    """JSON text of the tokenizer file, a few MB by its fixed vocabulary; it travels to the workers with the function."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def slices(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Ids as little-endian 32-bit bytes, one binary value per text."""
    offsets = np.r_[0, np.cumsum(counts)] * 4
    data = np.ascontiguousarray(values, dtype="<u4")
    if offsets[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    raw = data.tobytes()
    return pa.array([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())


def encode(docs: DataFrame, path: str, key: list[str], text: str = "text", decoded: bool = False) -> DataFrame:
    """The key columns, ``n_tokens``, ``ids`` (little-endian 32-bit integers) and, if asked for, the text decoded from them."""
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(source.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            rest = batch.select(key)
            for a, b in chunks(texts):
                ids, counts = codec.encode(texts[a:b])
                columns = [*rest.slice(a, b - a).columns, pa.array(counts), slices(ids, counts)]
                if decoded:
                    columns.append(pa.array(codec.decode(ids, counts), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*key, "n_tokens", "ids", *["decoded"] * decoded])

    rows = docs.select(*key, F.col(text).cast("string").alias("__text"))
    schema = rows.select(*key, F.lit(0).cast("bigint").alias("n_tokens"), F.lit(b"").alias("ids"), *[F.lit("").alias("decoded")] * decoded).schema
    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, key: list[str], ids: str = "ids") -> DataFrame:
    """The key columns and ``text``, decoded from an id column as ``encode`` makes it; null ids count as none."""
    source = rows.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(source.value)
        for batch in batches:
            found = [np.frombuffer(x or b"", dtype="<u4") for x in batch.column("__ids").to_pylist()]
            texts = [codec.decode(x, np.array([len(x)]))[0] for x in found]
            yield pa.RecordBatch.from_arrays([*batch.select(key).columns, pa.array(texts, pa.string())], [*key, "text"])

    picked = rows.select(*key, F.col(ids).alias("__ids"))
    return picked.mapInArrow(run, picked.select(*key, F.lit("").alias("text")).schema)
