"""Byte-level BPE encoding of a corpus by batched numpy merge rounds.

A batch of texts is held as one flat array of code points. Word boundaries come
from array comparisons of character classes, words are keyed by their bytes, and
only words not seen before go through the merge rounds: the symbols of all of
them lie in one flat array, each round finds the rank of every adjacent pair by
binary search over the sorted pair keys and joins the lowest-ranked pair of
every word at once.

Null and empty texts both give the empty list. Nothing is cut off or sampled; a
text longer than ``BLOCK_CHARS`` is taken in blocks that begin at a run of white
space, where a word always begins.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
BLOCK_CHARS = 2_000_000
#: Encoded words are kept per worker up to this many; then the store starts anew.
STORE_WORDS = 400_000

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as one word.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        if 0x32400 <= cp < 0xE0000 or cp > 0xE0200:  # nothing but ideograph gaps and private use
            continue
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def byte_symbols() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class MergeTable:
    """Byte ids and the sorted keys of all mergeable pairs with rank and result."""

    def __init__(self, byte_ids: np.ndarray, keys: np.ndarray, ranks: np.ndarray, results: np.ndarray):
        self.byte_ids, self.keys, self.ranks, self.results = byte_ids, keys, ranks, results

    @staticmethod
    def load(path: str) -> MergeTable:
        """From a ``tokenizers`` JSON file of a byte-level BPE model."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        byte_ids = np.zeros(256, dtype=np.int64)
        for shown, byte in byte_symbols().items():
            byte_ids[byte] = vocab[shown]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        keys = left << 32 | right
        order = np.argsort(keys)
        results = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        return MergeTable(byte_ids, keys[order], order.astype(np.int64), results[order])


def word_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions in ``points`` where a word of the byte-level pattern begins.

    ``text_starts`` are the positions where a new text begins. A word is a
    contraction ending, a run of letters, of numbers or of other characters, each
    with at most one blank before it, or a run of white space up to the last
    blank that belongs to what follows.
    """
    n = len(points)
    kind = char_classes()[points]
    first = np.zeros(n, dtype=bool)
    first[text_starts[text_starts < n]] = True
    before = np.empty(n, dtype=np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[first] = 255
    after = np.empty(n, dtype=np.uint8)
    after[-1], after[:-1] = SPACE, kind[1:]
    after[:-1][first[1:]] = SPACE
    space = kind == SPACE
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = points[:-1] == 0x20
    blank_before &= ~first
    starts = np.where(space, (before != SPACE) | (after != SPACE), (kind != before) & ~blank_before)
    quotes = np.flatnonzero((points == 0x27) & starts & (after == LETTER))
    if len(quotes):
        padded = np.append(points, [0, 0, 0])
        a, b = padded[quotes + 1], padded[quotes + 2]
        b = np.where((quotes + 2 < n) & ~np.append(first, [True] * 3)[quotes + 2], b, 0)
        length = np.zeros(len(quotes), dtype=np.int64)
        for end in ENDINGS:
            hit = (a == ord(end[0])) & ((len(end) == 1) | (b == ord(end[-1])))
            length[hit & (length == 0)] = len(end)
        quotes, length = quotes[length > 0], length[length > 0]
        starts[quotes + 1] = False
        behind = quotes + 1 + length
        starts[behind[behind < n]] = True
    return np.flatnonzero(starts)


class Growing:
    """A flat array that is added to; its room doubles, so that each value is copied a bounded number of times."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(1024, dtype=kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            grown = np.zeros(2 * (self.n + len(values)), dtype=self.room.dtype)
            grown[: self.n] = self.room[: self.n]
            self.room = grown
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.room[at]

    def __len__(self) -> int:
        return self.n


class WordStore:
    """Words already encoded: key, bytes and ids, in growing flat arrays."""

    def __init__(self, merges: MergeTable):
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.blob = np.zeros(1 << 20, dtype=np.uint8)
        self.used = 0
        self.start, self.length, self.id_start, self.id_count = (Growing(np.int64) for _ in range(4))
        self.ids = Growing(np.int32)

    def add(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        flat = gather(data, starts, lengths)
        ids, counts = encode_words(self.merges, flat, lengths)
        if self.used + len(flat) + 8 > len(self.blob):
            grown = np.zeros(2 * (self.used + len(flat)) + 8, dtype=np.uint8)
            grown[: self.used] = self.blob[: self.used]
            self.blob = grown
        self.blob[self.used : self.used + len(flat)] = flat
        at = len(self.start)
        self.index.update(zip(keys.tolist(), range(at, at + len(keys)), strict=True))
        self.start.add(self.used + np.cumsum(lengths) - lengths)
        self.length.add(lengths)
        self.id_start.add(len(self.ids) + np.cumsum(counts) - counts)
        self.id_count.add(counts)
        self.ids.add(ids)
        self.used += len(flat)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``data[s:s+n]`` of all starts and lengths, one after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return data[np.arange(total) + shift]


def encode_words(merges: MergeTable, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words given as bytes in one flat array; and the number of ids of each."""
    n = len(lengths)
    symbols = merges.byte_ids[flat]
    word = np.repeat(np.arange(n), lengths)
    done_ids: list[np.ndarray] = []
    done_word: list[np.ndarray] = []
    absent = np.iinfo(np.int64).max
    while len(symbols):
        if len(symbols) > 1:
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.searchsorted(merges.keys, pair)
            at[at == len(merges.keys)] = 0
            good = (merges.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.append(np.where(good, merges.ranks[at], absent), absent)
        else:
            at, rank = np.zeros(0, dtype=np.int64), np.array([absent])
        begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = np.minimum.reduceat(rank, begins)
        sizes = np.diff(np.append(begins, len(word)))
        floor = np.repeat(least, sizes)
        active = floor != absent
        if not active.all():
            done_ids.append(symbols[~active])
            done_word.append(word[~active])
        if not active.any():
            break
        take = (rank == floor) & active
        # of overlapping equal pairs every second one counts, from the left
        hits = np.flatnonzero(take)
        if len(hits) > 1:
            chain = np.append(True, np.diff(hits) != 1)
            place = np.arange(len(hits)) - np.maximum.accumulate(np.where(chain, np.arange(len(hits)), 0))
            hits = hits[place % 2 == 0]
        symbols[hits] = merges.results[at[hits]]
        keep = active.copy()
        keep[hits + 1] = False
        symbols, word = symbols[keep], word[keep]
    ids = np.concatenate(done_ids) if done_ids else np.zeros(0, dtype=np.int64)
    owner = np.concatenate(done_word) if done_word else np.zeros(0, dtype=np.int64)
    order = np.argsort(owner, kind="stable")
    return ids[order].astype(np.int32), np.bincount(owner, minlength=n)


def _blocks_of(data: np.ndarray, at: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k..8k+7 of each word as one number, with zeros behind its end."""
    raw = data[(at + 8 * k)[:, None] + np.arange(8)].reshape(-1, 8).view("<u8").ravel()
    return raw & _LOW_BYTES[np.minimum(size - 8 * k, 8)]


def word_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each word: its bytes themselves up to 7, a hash beyond."""
    key = _blocks_of(data, starts, lengths, 0)
    short = lengths <= 7
    key[short] |= lengths[short].astype(np.uint64) << np.uint64(56)
    rest, k = np.flatnonzero(~short), 0
    if len(rest):
        key[rest] = (key[rest] ^ lengths[rest].astype(np.uint64)) * _MIX
    while len(rest):
        k += 1
        key[rest] ^= key[rest] >> np.uint64(29)
        rest = rest[lengths[rest] > 8 * k]
        if len(rest):
            key[rest] = (key[rest] ^ _blocks_of(data, starts[rest], lengths[rest], k)) * _MIX
    key[~short] |= np.uint64(1 << 63)
    return key.view(np.int64)


class Encoder:
    """Encodes texts; one per worker process, with its store of known words."""

    def __init__(self, merges: MergeTable):
        self.merges = merges
        self.store = WordStore(merges)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        raw = np.frombuffer(joined.encode("utf-8") + b"\0" * 16, dtype=np.uint8)
        text_starts = np.cumsum(sizes) - sizes
        starts = word_starts(points, text_starts)
        if len(raw) - 16 == len(points):
            byte_at, total = starts, len(points)
        else:
            wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            ends = np.cumsum(wide)
            byte_at, total = (ends - wide)[starts], int(ends[-1])
        lengths = np.diff(np.append(byte_at, total))
        rows = self._rows(raw, byte_at, lengths)
        counts = self.store.id_count[rows]
        ids = gather(self.store.ids, self.store.id_start[rows], counts)
        text_of = np.searchsorted(text_starts, starts, side="right") - 1
        return ids, np.bincount(text_of, weights=counts, minlength=len(texts)).astype(np.int64)

    def _rows(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The store's row of each word, after adding those it lacks."""
        if len(self.store.index) > STORE_WORDS:
            self.store.clear()
        keys = word_keys(raw, starts, lengths)
        codes, distinct = pd.factorize(keys)
        row = np.array([self.store.index.get(k, -1) for k in distinct.tolist()], dtype=np.int64)
        new = np.flatnonzero(row < 0)
        if len(new):
            seen = np.full(len(distinct), -1, dtype=np.int64)
            seen[codes[::-1]] = np.arange(len(codes))[::-1]
            at = seen[new]
            row[new] = len(self.store.start) + np.arange(len(new))
            self.store.add(distinct[new], raw, starts[at], lengths[at])
        rows = row[codes]
        wrong = self._clashes(raw, starts, lengths, rows)
        if len(wrong):  # two words of one key: those not in the store are stored apart
            rows = rows.copy()
            apart: dict[bytes, int] = {}
            for i in wrong.tolist():
                word = raw[starts[i] : starts[i] + lengths[i]].tobytes()
                if word not in apart:
                    apart[word] = len(self.store.start)
                    self.store.add(np.array([-len(self.store.start) - 1]), raw, starts[i : i + 1], lengths[i : i + 1])
                rows[i] = apart[word]
        return rows

    def _clashes(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Words whose bytes aren't those of their row; only hashed ones can be."""
        rest, k = np.flatnonzero(lengths > 7), 0
        bad = [rest[self.store.length[rows[rest]] != lengths[rest]]]
        rest = rest[self.store.length[rows[rest]] == lengths[rest]]
        while len(rest):
            mine = _blocks_of(raw, starts[rest], lengths[rest], k)
            kept = _blocks_of(self.store.blob, self.store.start[rows[rest]], lengths[rest], k)
            bad.append(rest[mine != kept])
            k += 1
            rest = rest[(mine == kept) & (lengths[rest] > 8 * k)]
        return np.unique(np.concatenate(bad))


def blocks(text: str, size: int = BLOCK_CHARS) -> list[str]:
    """``text`` in pieces of about ``size``, each but the first beginning with white space after none."""
    out, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (ord(text[cut]) in _SPACES and ord(text[cut - 1]) not in _SPACES):
            cut += 1
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


_SPACES = frozenset(WHITE_SPACE)


def encode_column(encoder: Encoder, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of a string column, taken in blocks of bounded size."""
    pieces: list[str] = []
    owner: list[int] = []
    ids: list[np.ndarray] = []
    counts = np.zeros(len(column), dtype=np.int64)
    held = 0

    def flush() -> None:
        nonlocal held
        if pieces:
            got, per = encoder.encode(pieces)
            ids.append(got)
            np.add.at(counts, np.array(owner), per)
            pieces.clear()
            owner.clear()
            held = 0

    for i, value in enumerate(column.to_pylist()):
        for piece in blocks(value or ""):
            pieces.append(piece)
            owner.append(i)
            held += len(piece)
            if held >= BLOCK_CHARS:
                flush()
    flush()
    return (np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)), counts


_encoders: dict[object, Encoder] = {}


def _encoder(merges: Broadcast) -> Encoder:
    key = merges.value.keys.tobytes()[:64], len(merges.value.keys)
    if key not in _encoders:
        _encoders[key] = Encoder(merges.value)
    return _encoders[key]


def merge_table(spark: SparkSession, tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> Broadcast:
    """The merge table of a public tokenizer; about 1 MB whatever the corpus."""
    return spark.sparkContext.broadcast(MergeTable.load(f"{folder}/{tokenizer}.json"))


def encode_ids(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``id_col`` and ``ids``, one row for each row of ``df``; no shuffle.

    Null and empty texts give the empty list; repeated rows stay repeated; a null
    id stays null; other columns, whatever their names, are not read. Strings of
    special tokens are ordinary text.
    """
    merges = merge_table(df.sparkSession, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(merges)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, counts = encode_column(encoder, part.column(1))
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], names=["id", "ids"])

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, text_col: str, out: str = "n_tokens", tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` without ``text_col`` and with the number of its tokens as ``out``; no shuffle.

    Null and empty texts have none. A column of ``df`` already named ``out`` is replaced.
    """
    merges = merge_table(df.sparkSession, tokenizer, folder)
    kept = [c for c in df.columns if c not in (text_col, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(merges)
        for batch in batches:
            *rest, texts = batch.columns
            _, counts = encode_column(encoder, texts)
            yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64())], names=[*kept, out])

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.LongType())])
    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)
