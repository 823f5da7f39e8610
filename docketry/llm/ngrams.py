"""LM scoring with an Elias-Fano n-gram trie.

Counts come from all training documents. Every word's count is exact and enters the unigram probability
``(c + 1) / (N + V + 1)``, whose last part is left for unknown words. The trie holds every word and every n-gram that is
found at least ``Sizes.least`` times, however many they are; an n-gram is never more frequent than its parts, so
each level is counted over the entries of the one above. What the trie does not hold is scored by backing off, down to
the exact unigram: words of the trie by their counts there, all others by a join with the counts, so no word is
approximated. A limit on a level is left to the caller; it cuts at a count, never inside one.

A kept n-gram has probability ``(c - D) / c(context)``; the context's weight passes what is left to the shorter
context: probabilities over all words sum to one. Logarithms are kept in 16 bits.

A level numbers its entries; the children of entry p are the numbers ``p * words + w``, one rising sequence over
the level. It is cut into ranges of contexts; counting tasks send each range its numbers, rising, as differences, and one
task adds them up, range by range, drops the rare ones and codes the rest of some ranges as a part: Elias-Fano coding stores the part as low bits and
a bit vector of high parts, and the number of an entry is its place in it after the entries of earlier parts. A lookup
selects the zero that ends the part before the wanted one and walks to the successor. Words are numbered by a hash, and
their bytes are compared, so equal hashes do no harm.
The tasks write their parts into the shared folder, where workers map them into memory. If that folder is not mounted but
reached through Hadoop, Spark hands the parts to the executors, and each machine unpacks them once. Only one row a part
passes the driver.

Edge cases: a null or empty text is its end token; without training documents every count is 0; null ids are in
training (their remainder is unknown); rows equal in id and text share one computation and are all returned; words
of any length are kept whole; other columns are ignored.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import BATCH_BYTES, bound_batches, mix64, row_slices, worker_cache
from docketry.session import cut_lineage, scratch_path

DISCOUNT = 0.75
#: Range of the 16-bit logarithms.
LOW_LOG, HIGH_LOG = -12.0, 4.0
END = b""  # no word is empty
#: Distinct entries that a counting task holds before it hands them on.
FLUSH = 400_000
#: Entries of a level that are coded as a part; it ends with a range, so it may hold some more.
PART = 2_000_000
#: Ranges that one task counts, one after the other, and the tasks that there are at least, if there are as many ranges.
RANGES, TASKS = 16, 24
#: Bytes up to which a word is hashed with the others of its slice.
LONG = 1 << 12
#: Bytes of a part that go into one row.
PIECE = 4 << 20
#: Places of the set bits of each byte.
SET_BITS = np.array([[*[i for i in range(8) if byte >> i & 1], *[0] * 8][:8] for byte in range(256)], np.uint8)


@dataclass(frozen=True)
class Sizes:
    """The least count of a kept n-gram, and limits of the levels, if the caller wants any (``None``: all entries)."""

    words: int | None = None
    bigrams: int | None = None
    trigrams: int | None = None
    least: int = 2


@dataclass(frozen=True)
class Model:
    """What tasks need to open the trie: totals, and of each level's parts the first and last key, the entries and files.

    A file is a path in the mounted shared folder, or the name under which Spark hands it out.
    """

    label: str
    total: int
    distinct: int
    words: int = 0
    levels: tuple[tuple[tuple[int, int, int, tuple[str, ...]], ...], ...] = ()


def quantise(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.round((logs - LOW_LOG) / (HIGH_LOG - LOW_LOG) * 65535), 0, 65535).astype(np.uint16)


def unquantise(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / 65535 * (HIGH_LOG - LOW_LOG) + LOW_LOG


class EliasFano:
    """A rising sequence of numbers below ``universe``: low bits, and high parts as a bit vector."""

    def __init__(self, bits: int, low: np.ndarray, words: np.ndarray, zeros: np.ndarray | None = None):
        self.bits, self.low, self.words = np.uint64(bits), low, words
        if zeros is None:
            zeros = np.concatenate(([0], np.cumsum(64 - np.bitwise_count(np.asarray(words)).astype(np.int64))))
        self.zeros = zeros  # before each word: the select directory

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[int, np.ndarray, np.ndarray]:
        values = values.astype(np.uint64)
        bits = 0 if not len(values) else min(48, max(0, int(np.log2(max(universe // len(values), 1)))))
        high = (values >> np.uint64(bits)).astype(np.int64)
        size = (int(universe) >> bits) + len(values) + 2
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[high + np.arange(len(values))] = 1
        words = np.packbits(flags, bitorder="little").view("<u8")
        kind = np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64
        return bits, (values & np.uint64((1 << bits) - 1)).astype(kind), words

    def values(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.words).view(np.uint8), bitorder="little"))
        high = (ones - np.arange(len(ones))).astype(np.uint64)
        return ((high << self.bits) | self.low.astype(np.uint64)).astype(np.int64)

    def select_zero(self, rank: np.ndarray) -> np.ndarray:
        """Place of the zero with each rank (from 0)."""
        word = np.searchsorted(self.zeros, rank, side="right") - 1
        left = rank - self.zeros[word]
        value, place = ~self.words[word], word * 64
        for width in (32, 16, 8):
            count = np.bitwise_count(value & np.uint64((1 << width) - 1)).astype(np.int64)
            over = left >= count
            left = left - count * over
            value = np.where(over, value >> np.uint64(width), value)
            place = place + width * over
        return place + SET_BITS[(value & np.uint64(255)).astype(np.int64), left]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the sequence, or -1. Every different key is looked up once."""
        keys, back = np.unique(keys, return_inverse=True)
        return self.find_rising(keys)[back]

    def find_rising(self, keys: np.ndarray) -> np.ndarray:
        """As ``find``, for rising keys: the successor among the entries of a key's high part is found by halving."""
        if not len(self.low) or not len(keys):
            return np.full(len(keys), -1, np.int64)
        keys = keys.astype(np.uint64)
        parts = (keys >> self.bits).astype(np.int64)
        new = np.concatenate(([0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)]))
        parts, times = parts[new[:-1]], new[1:] - new[:-1]
        # A part begins behind the zero that ends the one before; it has an entry for each one bit before its own zero.
        at = np.where(parts > 0, self.select_zero(np.maximum(parts - 1, 0)) + 1, 0)
        rest = ~(self.words[at >> 6] >> (at & 63).astype(np.uint64))
        ones = np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        over = np.flatnonzero(ones == 64 - (at & 63))  # the zero is in a later word
        if len(over):
            ones[over] = self.select_zero(parts[over]) - at[over]
        first, ones = np.repeat(at - parts, times), np.repeat(ones, times)
        out = np.full(len(keys), -1, np.int64)
        todo = np.flatnonzero(ones)
        first, ones = first[todo], ones[todo]
        low = (keys[todo] & ((np.uint64(1) << self.bits) - np.uint64(1))).astype(self.low.dtype)
        # The last entry that is not above a key, by halving.
        while ones.max(initial=1) > 1:
            half = ones >> 1
            first = np.where(self.low[first + half] <= low, first + half, first)
            ones = ones - half
        here = self.low[first] == low
        out[todo[here]] = first[here]
        return out


def pack(head: dict, arrays: dict[str, np.ndarray]) -> bytes:
    """A part's bytes: a head that tells where its arrays are, and the arrays."""
    at, places = 1 << 12, {}
    for name, array in arrays.items():
        places[name] = (at, array.nbytes, array.dtype.str)
        at += -(-array.nbytes // 64) * 64
    text = json.dumps(head | {"arrays": places}).encode()
    out = bytearray(at)
    out[:8], out[8 : 8 + len(text)] = np.array([len(text)], "<u8").tobytes(), text
    for name, array in arrays.items():
        a, b, _ = places[name]
        out[a : a + b] = array.tobytes()
    return bytes(out)


def packed_sequence(name: str, values: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
    """Head and arrays of an Elias-Fano sequence, with its select directory, counted from its first value."""
    bits, low, high = EliasFano.encode(values - values[0], int(values[-1] - values[0]) + 1)
    arrays = {f"{name}_low": low, f"{name}_high": high, f"{name}_zeros": EliasFano(bits, low, high).zeros}
    return {f"{name}_bits": bits, f"{name}_first": int(values[0]), f"{name}_last": int(values[-1])}, arrays


def open_part(files: tuple[str, ...], first: int) -> np.ndarray:
    """The memory map of the part with this first key; if Spark handed it out, the first worker of a machine unpacks it."""
    path = files[0]
    if not os.path.isabs(path):
        path = SparkFiles.get(f"{path}.{first}.part")
        with open(path + ".lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if not os.path.exists(path):
                with open(path + ".new", "wb") as out:
                    for name in files:
                        for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches(1, columns=["first", "at", "content"]):
                            if batch.column(0)[0].as_py() == first:
                                out.seek(batch.column(1)[0].as_py())
                                out.write(batch.column(2)[0].as_buffer())
                os.replace(path + ".new", path)
    return np.memmap(path, np.uint8, "r").view(np.ndarray)


class Part:
    """One range of a level."""

    def __init__(self, buffer: np.ndarray):
        size = int(np.frombuffer(buffer[:8].tobytes(), "<u8")[0])
        self.head = json.loads(buffer[8 : 8 + size].tobytes())
        self.arrays = {n: buffer[a : a + b].view(t) for n, (a, b, t) in self.head["arrays"].items()}

    def sequence(self, name: str) -> EliasFano:
        return EliasFano(self.head[f"{name}_bits"], *[self.arrays[f"{name}_{x}"] for x in ("low", "high", "zeros")])

    def find(self, name: str, values: np.ndarray) -> np.ndarray:
        """Places of rising values in a sequence of the part, or -1."""
        first, last = self.head[f"{name}_first"], self.head[f"{name}_last"]
        out, (a, b) = np.full(len(values), -1, np.int64), np.searchsorted(values, (first, last + 1))
        out[a:b] = self.sequence(name).find_rising(values[a:b] - first)
        return out


class Level:
    """A level in parts, by rising key. Lookups take rising numbers and visit each part at most once."""

    def __init__(self, parts: tuple[tuple[int, int, int, tuple[str, ...]], ...], words: int):
        self.files = [files for *_, files in parts]
        self.first = np.array([first for first, *_ in parts], np.int64)
        self.contexts = self.first // words  # no context lies in two parts
        self.start = np.concatenate(([0], np.cumsum([n for _, _, n, _ in parts], dtype=np.int64)))
        self.opened: dict[int, Part] = {}

    def __len__(self) -> int:
        return int(self.start[-1])

    def part(self, i: int) -> Part:
        if i not in self.opened:
            self.opened[i] = Part(open_part(self.files[i], int(self.first[i])))
        return self.opened[i]

    def cuts(self, borders: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The parts that hold numbers, and which."""
        at = np.append(np.searchsorted(numbers, borders), len(numbers))
        for i in np.flatnonzero(at[1:] > at[:-1]).tolist():
            yield i, slice(at[i], at[i + 1])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        for i, own in self.cuts(self.first, keys):
            found = self.part(i).find("key", keys[own])
            out[own] = np.where(found >= 0, found + self.start[i], -1)
        return out

    def take(self, name: str, places: np.ndarray) -> np.ndarray:
        """Values of entries; 0 for a place of -1."""
        out = np.zeros(len(places), np.float64)
        for i, own in self.cuts(self.start[:-1], places):
            out[own] = self.part(i).arrays[name][places[own] - self.start[i]]
        return out

    def gather(self, name: str, places: np.ndarray) -> np.ndarray:
        """As ``take``, for places in any order."""
        places, back = np.unique(places, return_inverse=True)
        return self.take(name, places)[back]

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (or -1) and logarithms (or 0) of keys in any order."""
        keys, back = np.unique(keys, return_inverse=True)
        places, logs = self.find(keys), np.zeros(len(keys))
        here = places >= 0
        logs[here] = unquantise(self.take("prob", places[here]))
        return places[back], logs[back]

    def keys(self, places: np.ndarray) -> np.ndarray:
        """Keys of entries that lie close together."""
        out = np.zeros(len(places), np.int64)
        for i, own in self.cuts(self.start[:-1], places):
            part = self.part(i)
            out[own] = part.sequence("key").values()[places[own] - self.start[i]] + part.head["key_first"]
        return out

    def weight(self, contexts: np.ndarray) -> np.ndarray:
        """Logarithms of the weights of contexts in any order; 0 for -1 and for a context without children."""
        contexts, back = np.unique(contexts, return_inverse=True)
        out = np.zeros(len(contexts), np.float64)
        for i, own in self.cuts(self.contexts, contexts):
            part = self.part(i)
            found = part.find("context", contexts[own])
            out[own] = np.where(found >= 0, unquantise(part.arrays["back"][np.maximum(found, 0)]), 0.0)
        return out[back]

    @property
    def low(self) -> np.ndarray:
        return np.concatenate([self.part(i).arrays["key_low"] for i in range(len(self.files))] or [np.zeros(0, np.uint16)])


def tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased words of the texts, each text with its end (the empty word), and how many there are in each text."""
    texts = pc.fill_null(pa.concat_arrays([texts]).cast(pa.large_string()), "")  # copied, as a cast slice is lower-cased wrongly
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    # The split leaves an empty word behind a last blank; an empty text is one already.
    blanks = pc.if_else(pc.equal(texts, ""), "", " ").cast(pa.large_string())
    words = pc.ascii_split_whitespace(pc.binary_join_element_wise(texts, blanks, pa.scalar("", pa.large_string())))
    return words.flatten().dictionary_encode(), pc.list_value_length(words).to_numpy()


def ends_and_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places in their joined bytes where words (large binary) begin, with the end of the last one, and these bytes."""
    if not len(words):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, ends, content = words.buffers()
    ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1]
    return ends - ends[0], np.frombuffer(content or b"", np.uint8)[ends[0] : ends[-1]]


def word_hashes(words: pa.Array) -> np.ndarray:
    """60 bits of each word: its bytes, weighted by their places, and its length; of a long word also its MD5."""
    whole = pa.concat_arrays([words]).cast(pa.large_binary())
    sizes = pc.binary_length(whole).to_numpy().astype(np.uint64)
    long = np.flatnonzero(sizes > LONG)
    words = pc.binary_slice(whole, 0, LONG) if len(long) else whole
    ends, content = ends_and_bytes(words)
    place = np.arange(len(content)) - np.repeat(ends[:-1], np.diff(ends))
    weights = mix64(np.arange(1, int(place.max(initial=0)) + 2, dtype=np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weights[place] * content)))  # they wrap, and so do their differences
    sums = sums[ends[1:]] - sums[ends[:-1]] + sizes
    digests = [hashlib.md5(whole[i].as_buffer(), usedforsecurity=False).digest() for i in long.tolist()]
    sums[long] += np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)[:, 0]
    return (mix64(sums) >> np.uint64(4)).astype(np.int64)


def word_hash(word: bytes) -> int:
    """The hash of one word."""
    return int(word_hashes(pa.array([word], pa.large_binary()))[0])


class Words(Level):
    """The words, numbered by their hashes."""

    def numbers(self, words: list[bytes]) -> list[int]:
        """Number of each word, or -1."""
        return self.places(pa.array(words, pa.large_binary()), np.array([word_hash(w) for w in words], np.int64)).tolist()

    def places(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, or -1: words with its hash are compared byte by byte."""
        order, out = np.argsort(hashes), np.full(len(words), -1, np.int64)
        hashes, asked = hashes[order], words.take(pa.array(order))
        for i, own in self.cuts(self.first, hashes):
            arrays, wanted = self.part(i).arrays, hashes[own]
            table = arrays["hash"]
            stored = pa.Array.from_buffers(pa.large_binary(), len(table), [None, pa.py_buffer(arrays["ends"]), pa.py_buffer(arrays["text"])])
            places = np.searchsorted(table, wanted)
            todo = np.arange(len(wanted))
            while len(todo := todo[places[todo] < len(table)]) and len(todo := todo[table[places[todo]] == wanted[todo]]):
                same = pc.equal(stored.take(pa.array(places[todo])), asked.take(pa.array(todo + own.start))).to_numpy(zero_copy_only=False)
                out[order[todo[same] + own.start]] = places[todo[same]] + self.start[i]
                todo = todo[~same]
                places[todo] += 1
        return out

    def __contains__(self, word: bytes) -> bool:
        return self.get(word) is not None

    def __getitem__(self, word: bytes) -> int:
        return self.numbers([word])[0]

    def __iter__(self) -> Iterator[bytes]:
        for i in range(len(self.files)):
            arrays = self.part(i).arrays
            for a, b in zip(arrays["ends"][:-1].tolist(), arrays["ends"][1:].tolist()):
                yield arrays["text"][a:b].tobytes()

    def get(self, word: bytes, default=None):
        at = self[word]
        return at if at >= 0 else default


class Trie:
    """The levels of a model: words, bigrams and trigrams, as far as they are built."""

    def __init__(self, model: Model):
        self.total, self.distinct = model.total, model.distinct
        self.floor = -np.log10(self.total + self.distinct + 1)
        self.n = max(model.words, 1)
        self.at = Words(model.levels[0] if model.levels else (), 1)
        self.level = [Level(parts, self.n) for parts in model.levels[1:]]
        self.end = self.at.get(END, -1)

    def token_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
        """Word numbers of the texts with their ends, marks of first tokens, the numbers of the different words, and the words."""
        words, sizes = tokens(texts)
        different = words.dictionary.cast(pa.large_binary())
        numbers = self.at.places(different, word_hashes(different))
        first = np.zeros(len(words), bool)
        first[np.cumsum(sizes) - sizes] = True
        return numbers[words.indices.to_numpy()], first, numbers, words

    def unigrams(self, ids: np.ndarray) -> np.ndarray:
        """Exact unigram logarithms of words of the trie; 0 for others."""
        return np.where(ids >= 0, np.log10(self.at.gather("count", ids) + 1.0) + self.floor, 0.0)

    def bigrams(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place (or -1) and logarithm (or 0) of the bigram that ends at each token."""
        places, logs = np.full(len(ids), -1, np.int64), np.zeros(len(ids))
        which = bigram_ends(ids, first)
        places[which], logs[which] = self.level[0].look(ids[which - 1] * self.n + ids[which])
        return places, logs

    def score(self, ids: np.ndarray, first: np.ndarray, unigrams: np.ndarray | None = None) -> np.ndarray:
        """Logarithm of each token's probability; for tokens not in the trie, their unigram part is left out.

        ``ids`` are word numbers or -1, ``first`` marks tokens without a context.
        """
        place, out = self.bigrams(ids, first)
        none = np.flatnonzero(place < 0)
        before = np.where(first[none], -1, ids[none - 1])
        out[none] = self.level[0].weight(before) + (self.unigrams(ids) if unigrams is None else unigrams)[none]
        context = np.concatenate(([-1], place[:-1]))
        which = np.flatnonzero((context >= 0) & ~first)
        both = which[place[which] >= 0]
        place3, logs = np.full(len(ids), -1, np.int64), np.zeros(len(ids))
        place3[both], logs[both] = self.level[1].look(context[both] * self.n + ids[both])
        none = which[place3[which] < 0]
        out[none] += self.level[1].weight(context[none])
        return np.where(place3 >= 0, logs, out)


def bigram_ends(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where both words of a bigram are in the trie."""
    return np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0) & ~first[1:]) + 1


def planes(numbers: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones and so on, so that small ones compress well."""
    return np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(content: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(content, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def added_up(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, rising, and their sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(n[order], at) if len(at) else n


def range_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of each range from what the counting tasks sent (range: rising, keys as differences, n)."""
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, size, now = [], 0, None
    for batch in batches:
        for place, key, times in zip(batch.column("range").to_pylist(), batch.column("keys"), batch.column("times")):
            if place != now and now is not None:
                yield added_up(*[np.concatenate(x) for x in zip((keys, n), *held)])
                keys, n = keys[:0], n[:0]
                held, size = [], 0
            now = place
            held.append((np.cumsum(from_planes(key.as_py())), from_planes(times.as_py())))
            size += len(held[-1][0])
            if size > max(4 * FLUSH, len(keys)):
                keys, n = added_up(*[np.concatenate(x) for x in zip((keys, n), *held)])
                held, size = [], 0
    if now is not None:
        yield added_up(*[np.concatenate(x) for x in zip((keys, n), *held)])


def word_part(batches: Iterator[pa.RecordBatch], trie: Trie) -> tuple[np.ndarray, bytes]:
    """Keys and bytes of a range of words (key: hash, word, n), in rising order."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return np.zeros(0, np.int64), b""
    table = pa.Table.from_batches(held)
    hashes, counts = (table.column(c).to_numpy() for c in ("key", "n"))
    ends, text = ends_and_bytes(table.column("word").cast(pa.large_binary()).combine_chunks())
    return hashes, pack({}, {"hash": hashes, "ends": ends, "text": text, "count": counts})


def gram_part(keys: np.ndarray, own: np.ndarray, trie: Trie) -> tuple[np.ndarray, bytes]:
    """Keys and bytes of a range of n-grams (place of the context * words + word) of the first level that the trie lacks."""
    if not len(keys):
        return keys, b""
    context, word = keys // trie.n, keys % trie.n
    if not trie.level:
        above = trie.at.gather("count", context)
        lower = (trie.at.gather("count", word) + 1) / (trie.total + trie.distinct + 1)
    else:
        # Both parts of a kept trigram are kept bigrams, so its shorter context has the word too.
        level = trie.level[0]
        above = level.gather("count", context)
        parents, back = np.unique(context, return_inverse=True)
        last = (level.keys(parents) % trie.n)[back]
        middle, back = np.unique(last * trie.n + word, return_inverse=True)
        lower = (level.take("count", level.find(middle))[back] - DISCOUNT) / trie.at.gather("count", last)
    prob = (own - DISCOUNT) / above
    contexts, at = np.unique(context, return_index=True)
    left, rest = 1 - np.add.reduceat(prob, at), 1 - np.add.reduceat(lower, at)
    weight = np.where((left > 0) & (rest > 0), np.maximum(left, 1e-12) / np.maximum(rest, 1e-12), 1.0)
    head, arrays = packed_sequence("key", keys)
    more, others = packed_sequence("context", contexts)
    arrays |= others | {"prob": quantise(np.log10(np.maximum(prob, 1e-12))), "back": quantise(np.log10(weight))}
    if not trie.level:  # the next level is built on these
        arrays["count"] = own.astype(np.uint32) if own.max() < 1 << 32 else own
    return keys, pack(head | more, arrays)


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path of a shared folder as the machines see it, if it is mounted there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path.toUri().getPath() if system.getUri().getScheme() == "file" else None


def add_level(model: Model, rows: DataFrame, code) -> Model:
    """The model with one more level: ``code`` makes keys and bytes of parts from each partition of ``rows``."""
    spark = rows.sparkSession
    path = scratch_path(spark, "lm-trie")
    folder = mounted(spark, path)
    schema = "first bigint, last bigint, entries bigint, file string, at bigint, content binary"

    def run(batches):
        for keys, content in code(batches, open_trie(model)):
            if len(keys):
                yield from written(keys, content)

    def written(keys, content):
        file, pieces = None, range(0, len(content), PIECE)
        if folder:
            os.makedirs(folder + "-parts", exist_ok=True)
            with tempfile.NamedTemporaryFile(dir=folder + "-parts", delete=False) as out:
                out.write(content)
            os.chmod(out.name, 0o644)
            file, content, pieces = out.name, b"", (0,)
        for at in pieces:
            row = {"first": int(keys[0]), "last": int(keys[-1]), "entries": len(keys), "file": file, "at": at, "content": content[at : at + PIECE]}
            yield pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.int64()) for c in ("first", "last", "entries")] + [("file", pa.string()), ("at", pa.int64()), ("content", pa.binary())]))

    rows.mapInArrow(run, schema).write.parquet(path)
    name = F.coalesce("file", F.regexp_extract("_metadata.file_path", "[^/]+$", 0))
    stored = spark.read.schema(schema).parquet(path)
    parts = stored.groupBy("first", "last", "entries").agg(F.sort_array(F.collect_set(name)).alias("files")).collect()
    level = tuple(sorted((r["first"], r["last"], r["entries"], tuple(r["files"])) for r in parts))
    for file in sorted({f for *_, files in level for f in files if not os.path.isabs(f)}):
        spark.sparkContext.addFile(f"{path}/{file}")
    return replace(model, label=uuid.uuid4().hex, levels=(*model.levels, level))


def open_trie(model: Model) -> Trie:
    """The worker's maps of a published trie."""
    cache = worker_cache()
    if cache.get("trie_name") != model.label:
        cache["trie"], cache["trie_name"] = Trie(model), model.label
    return cache["trie"]


def least_count(counts: DataFrame, most: int | None, least: int) -> int:
    """The count from which rows are kept: ``least``, or more if the caller wants at most ``most`` rows.

    For a limit, counts are grouped by sixteenths of their binary logarithm, about a thousand groups whatever the input.
    """
    if most is None:
        return least
    group = F.when(F.col("n") <= 16, F.col("n").cast("double")).otherwise(16 + F.floor((F.log2("n") - 4) * 16))
    found = sorted(counts.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).collect(), reverse=True)
    cut, kept = 1 << 62, 0
    for row in found:
        kept += row["k"]
        if kept > most or row["n"] < least:
            break
        cut = row["n"]
    return cut


def train(docs: DataFrame, sizes: Sizes = Sizes()) -> tuple[Model, DataFrame]:
    """Count ``docs`` (text), build and publish the trie and return it and all word counts (word, n)."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col("text").alias("text"))

    def count_words(batches):
        held, size = [], 0

        def flush():
            return pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches()

        for batch in batches:
            for part in row_slices(batch, 0, BATCH_BYTES):
                own, _ = tokens(part.column(0))
                n = np.bincount(own.indices.to_numpy(), minlength=len(own.dictionary))
                held.append(pa.RecordBatch.from_arrays([own.dictionary.cast(pa.binary()), pa.array(n, pa.int64())], names=["word", "n"]))
                size += len(n)
                if size > 4 * FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    words = cut_lineage(texts.mapInArrow(count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    cut = least_count(words, sizes.words, sizes.least)

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(batch.column(0))), *batch.columns], names=["key", "word", "n"])

    kept = words.where((F.col("n") >= cut) | (F.col("word") == F.lit(bytearray(END)))).select("word", "n")
    size = kept.count()
    kept = kept.mapInArrow(hashed, "key bigint, word binary, n bigint")
    ranges = size // PART + 1
    ranged = kept.repartitionById(ranges, F.shiftright(F.shiftright("key", 40) * ranges, 20).cast("int"))
    model = add_level(Model(uuid.uuid4().hex, total, distinct, size), ranged.sortWithinPartitions("key", "word"), lambda *x: [word_part(*x)])

    def add_grams(model, contexts, keys_of, most):
        """``contexts`` of the level above are cut into equal ranges, for about ``2 * PART`` tokens each.

        A task counts some ranges, as what is found once is most of a range, and lookups take longer the more parts there are.
        """
        n, ranges = max(model.words, 1), total // (2 * PART) + 1
        tasks = max(-(-ranges // RANGES), min(ranges, TASKS))
        borders = np.array([-(-i * contexts // ranges) * n for i in range(ranges)], np.int64)

        def count(batches):
            trie = open_trie(model)
            held, size = [], 0

            def flush():
                keys, times = np.unique(np.concatenate(held), return_counts=True)
                cuts = np.append(np.searchsorted(keys, borders), len(keys))
                own = [(i, slice(cuts[i], cuts[i + 1])) for i in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()]
                columns = [
                    pa.array([i for i, _ in own], pa.int32()),
                    pa.array([planes(np.diff(keys[x], prepend=0)) for _, x in own], pa.binary()),
                    pa.array([planes(times[x]) for _, x in own], pa.binary()),
                ]
                return pa.RecordBatch.from_arrays(columns, names=["range", "keys", "times"])

            for batch in batches:
                for part in row_slices(batch, 0, BATCH_BYTES):
                    held.append(keys_of(trie, *trie.token_ids(part.column(0))[:2]))
                    size += len(held[-1])
                    if size > 6 * FLUSH:
                        yield flush()
                        held, size = [], 0
            if size:
                yield flush()

        def sums(batches):
            for _, n in range_counts(batches):
                yield pa.RecordBatch.from_arrays([pa.array(n)], names=["n"])

        sent = texts.mapInArrow(count, "range int, keys binary, times binary")
        sent = sent.repartitionById(tasks, F.expr(f"int(range * {tasks}L div {ranges})")).sortWithinPartitions("range")
        cut = least_count(sent.mapInArrow(sums, "n bigint"), most, sizes.least)

        def code(batches, trie):
            held, size = [], 0
            for keys, n in range_counts(batches):
                held.append((keys[n >= cut], n[n >= cut]))
                size += len(held[-1][0])
                if size >= PART:
                    yield gram_part(*map(np.concatenate, zip(*held)), trie)
                    held, size = [], 0
            if size:
                yield gram_part(*map(np.concatenate, zip(*held)), trie)

        return add_level(model, sent, code)

    def bigram_keys(trie, ids, first):
        which = bigram_ends(ids, first)
        return ids[which - 1] * trie.n + ids[which]

    def trigram_keys(trie, ids, first):
        place, _ = trie.bigrams(ids, first)
        which = np.flatnonzero((place[1:] >= 0) & (place[:-1] >= 0)) + 1
        return place[which - 1] * trie.n + ids[which]

    model = add_grams(model, size, bigram_keys, sizes.bigrams)
    model = add_grams(model, sum(n for _, _, n, _ in model.levels[1]), trigram_keys, sizes.trigrams)
    return model, words


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document (doc_id, text)."""
    bound_batches(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("doc_id", "text").alias("digest"))

    def run(batches):
        trie = open_trie(model)
        for batch in batches:
            for part in row_slices(batch, 1, BATCH_BYTES):
                ids, first, numbers, found = trie.token_ids(part.column(1))
                starts = np.flatnonzero(first)
                known = (ids >= 0) & (trie.total > 0)
                unigrams = trie.unigrams(numbers)[found.indices.to_numpy()]
                sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), unigrams, trie.score(ids, first, unigrams))]
                sizes = np.diff(np.append(starts, len(ids)))
                missing = np.flatnonzero((ids < 0) & (np.arange(len(ids)) != np.append(starts[1:], len(ids)).repeat(sizes) - 1))
                offsets = np.searchsorted(missing, np.append(starts, len(ids))).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(offsets), found.take(pa.array(missing)).dictionary_decode().cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sizes), *[pa.array(s) for s in sums], rare],
                    names=["doc_id", "digest", "n_tokens", "n_known", "base", "model", "rare"],
                )

    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    floor = -float(np.log10(total + distinct + 1))
    local = cut_lineage(
        chosen.mapInArrow(
            run, "doc_id bigint, digest bigint, n_tokens bigint, n_known bigint, base double, model double, rare array<binary>"
        ),
        "lm-local",
    )
    if not total:  # without training even the end is unknown
        local = local.withColumn("rare", F.array().cast("array<binary>"))
    pieces = local.select("digest", F.explode("rare").alias("word"))
    rare = (
        pieces.join(words, "word", "left")
        .groupBy("digest")
        .agg(
            F.count("n").alias("known"),
            F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0) + F.lit(floor)).alias("logs"),
        )
    )
    # Rows equal in id and text share a digest: their rare words were summed once for each of them.
    copies = local.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    extra = rare.join(copies, "digest").select(
        "digest", (F.col("known") / F.col("copies")).cast("bigint").alias("known"), (F.col("logs") / F.col("copies")).alias("logs")
    )
    return local.drop("rare").join(extra, "digest", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )

