"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as lower-cased letters and digits with one blank between runs. A benchmark item is cut into
overlapping segments of ``SEGMENT`` characters and denser ones of ``SHORT`` (a shorter item is one segment), so every
quote of ``REGION`` or more characters of an item covers a segment wherever it starts. A segment of m characters with at
most k edits keeps at least ``m + 1 - q * (k + 1)`` of its q-grams, all of them within k diagonals. So shared
q-grams are counted in bands of diagonals that overlap by half, bands with fewer are dropped, and the others are
verified by a banded alignment that may start and end anywhere in the band. Every quote of a segment with at most k
edits is found: filter and bands have no false negatives. So is every quote of ``REGION`` characters of an item with at
most ``budget(SHORT)`` edits. Segments found at overlapping places are one region.

Benchmarks are taken in blocks of bounded size, each broadcast in turn: work grows with the number of blocks, memory
does not. Documents are scanned where they are; a text longer than ``CHUNK`` is scanned in parts that overlap by
normalised characters.

Short items are sought exactly, so that clean documents are spared: with fewer than ``LEAST`` such characters as whole
words, with fewer than Q only where they are a whole line or a whole text.

Edge cases: null and empty texts have no leaks; items without a letter or digit match nothing; equal
rows of an item count once; a null item id is an id like others; documents repeated in the table each give
their rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import bound_batches, code_points, filter_rows, mix64, text_slices, worker_cache

Q = 10
SEGMENT, STEP = 96, 48
SHORT, SHORT_STEP = 48, 8
#: Any so many characters of an item cover one of its segments.
REGION = SHORT + SHORT_STEP - 1
#: Shorter items are sought exactly, as whole words; below Q characters as a whole line or text.
LEAST = 24
#: Edits for each character of a segment.
EDIT_SHARE = 0.07
#: Width of the bands' overlapping halves: one more than the most edits, so k + 1 diagonals lie in some band.
HALF = int(SEGMENT * EDIT_SHARE) + 1
#: Each character of an item is in about eight segments, so the index of a block is several times the block.
BLOCK_CHARS = 1_000_000
CHUNK = 1_000_000
SLICE_BYTES = 1 << 20
BORDER = 0x10FFFF  # between texts; no text of the benchmark holds it
BITS = 22


def budget(m: int) -> int:
    """Edits that a segment of m characters may have, such that the lemma still asks for a few q-grams."""
    return 0 if m < LEAST else max(0, min(int(m * EDIT_SHARE), (m - 3) // Q - 1))


def least_shared(m: int) -> int:
    return m + 1 - Q * (budget(m) + 1)


def _alnum() -> np.ndarray:
    cache = worker_cache()
    if "alnum" not in cache:
        cache["alnum"] = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return cache["alnum"]


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def normalise(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters, digits and borders kept, other runs as one blank; and where each kept character was."""
    solid = _alnum()[codes] | (codes == BORDER)
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    return np.where(solid, codes, 32)[keep].astype(np.uint32), np.flatnonzero(keep)


def as_text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each q-gram, by doubling."""
    base = 0x9E3779B97F4A7C15
    value, width, done, at = codes.astype(np.uint64), 1, None, 0
    power = {1: base}
    rest = Q
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if done is None:
                    done, at = value, width
                else:
                    n = len(codes) - at - width + 1
                    done, at = done[:n] * np.uint64(pow(base, width, 1 << 64)) + value[at : at + n], at + width
            rest >>= 1
            if rest:
                n = len(value) - width
                value = value[:n] * np.uint64(pow(base, width, 1 << 64)) + value[width : width + n]
                width *= 2
        return mix64(done)


class Benchmark:
    """Segments of a block of items and where their q-grams stand."""

    def __init__(self, items: list[tuple[int, str]]):
        self.segments: list[np.ndarray] = []
        self.owner: list[int] = []
        self.items = [item for item, _ in items]
        self.tiny: dict[str, list[int]] = {}
        grams, refs = [], []
        for at, (_, text) in enumerate(items):
            codes, _ = normalise(code_points(lowered(text or "")))
            codes = codes[:-1] if len(codes) and codes[-1] == 32 else codes
            codes = codes[1:] if len(codes) and codes[0] == 32 else codes
            if len(codes) < Q:
                if len(codes):
                    self.tiny.setdefault(as_text(codes), []).append(at)
                continue
            spans = set()
            for size, step in ((SEGMENT, STEP), (SHORT, SHORT_STEP)):
                last = max(0, len(codes) - size)
                spans |= {(start, min(start + size, len(codes))) for start in (*range(0, last + 1, step), last)}
            for start, end in sorted(spans):
                segment = codes[start:end]
                own = hashes(segment)
                grams.append(own)
                refs.append(np.arange(len(own)) + (len(self.segments) << 8))
                self.segments.append(segment)
                self.owner.append(at)
        grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        refs = np.concatenate(refs) if refs else np.zeros(0, np.int64)
        order = np.argsort(grams, kind="stable")
        self.refs = refs[order]  # segment number and place of the q-gram in it
        self.grams, self.firsts, self.counts = np.unique(grams[order], return_index=True, return_counts=True)
        self.lengths = np.array([len(s) for s in self.segments], np.int64)
        self.edits = np.array([budget(m) for m in self.lengths], np.int64)
        self.least = np.array([least_shared(m) for m in self.lengths], np.int64)
        self.marks = np.zeros(1 << BITS, bool)
        self.marks[(self.grams >> np.uint64(64 - BITS)).astype(np.int64)] = True


def align(patterns: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern against its text, both ends of the text free, and how far the best match reaches.

    Row j holds the diagonals of the band: cell d stands for j pattern characters and j + d text characters read.
    """
    n, m = patterns.shape
    width = texts.shape[1] - m + 1
    steps = np.arange(width, dtype=np.int32)
    row = np.zeros((n, width), np.int32)
    for j in range(m):
        best = row + (texts[:, j : j + width] != patterns[:, j : j + 1])
        np.minimum(best[:, :-1], row[:, 1:] + 1, out=best[:, :-1])
        row = np.minimum.accumulate(best - steps, axis=1) + steps
    ends = row.argmin(axis=1)
    return row[np.arange(n), ends], m + ends


def find_leaks(own: Benchmark, codes: np.ndarray, borders: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, segment, start, end, edits) of each region in normalised texts; ``borders`` are their end positions."""
    if len(codes) < Q or not len(own.grams):
        return []
    grams = hashes(codes)
    at = np.flatnonzero(own.marks[(grams >> np.uint64(64 - BITS)).astype(np.int64)])
    place = np.searchsorted(own.grams, grams[at])
    place[place == len(own.grams)] = 0
    true = own.grams[place] == grams[at]
    at, place = at[true], place[true]
    if not len(at):
        return []
    counts = own.counts[place]
    refs = own.refs[np.repeat(own.firsts[place] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
    segment = refs >> 8
    unit = (np.repeat(at, counts) - (refs & 255) + SEGMENT) // HALF
    base = (len(codes) + 2 * SEGMENT) // HALF + 2
    keys, shared = np.unique(segment * base + unit, return_counts=True)
    # A band is a unit and the next one; it may begin at a unit without q-grams of its own.
    starts = np.unique(np.concatenate((keys, keys - 1)))
    first, second = np.searchsorted(keys, starts), np.searchsorted(keys, starts + 1)
    total = np.where((first < len(keys)) & (keys[np.minimum(first, len(keys) - 1)] == starts), shared[np.minimum(first, len(keys) - 1)], 0)
    total += np.where((second < len(keys)) & (keys[np.minimum(second, len(keys) - 1)] == starts + 1), shared[np.minimum(second, len(keys) - 1)], 0)
    segment, unit = starts // base, starts % base
    good = total >= own.least[segment]
    segment, left = segment[good], unit[good] * HALF - SEGMENT
    if not len(segment):
        return []
    # A band near a border may belong to the text before or after it.
    begins = np.concatenate(([0], borders[:-1] + 1))
    low = np.searchsorted(borders, np.maximum(left, 0))
    high = np.searchsorted(borders, np.minimum(left + own.lengths[segment] + 2 * HALF, len(codes) - 1))
    high = np.minimum(high, len(borders) - 1)
    found = []
    spread = np.repeat(np.arange(len(segment)), high - low + 1)
    text = np.repeat(low - np.cumsum(high - low + 1) + (high - low + 1), high - low + 1) + np.arange(len(spread))
    segment, left = segment[spread], left[spread]
    for m in np.unique(own.lengths[segment]):
        for chunk in np.array_split(np.flatnonzero(own.lengths[segment] == m), max(1, (own.lengths[segment] == m).sum() // 2000)):
            k = budget(int(m))
            reach = np.arange(m + 2 * HALF + 2 * k)
            where = left[chunk, None] - k + reach
            inside = (where >= begins[text[chunk], None]) & (where < borders[text[chunk], None])
            window = np.where(inside, codes[np.clip(where, 0, len(codes) - 1)], BORDER)
            patterns = np.stack([own.segments[s] for s in segment[chunk]])
            edits, ends = align(patterns, window)
            ok = np.flatnonzero(edits <= k)
            if not len(ok):
                continue
            # The start is the end of the alignment of both reversed, from the end found.
            back = np.where(reach[None, :] < ends[ok, None], window[ok], BORDER)[:, ::-1]
            shift = len(reach) - ends[ok]
            back = np.take_along_axis(back, np.minimum(reach[None, : m + k] + shift[:, None], len(reach) - 1), axis=1)
            _, lengths = align(patterns[ok][:, ::-1], np.concatenate((back, np.full((len(ok), k), BORDER)), axis=1))
            for i, n in zip(ok, lengths, strict=True):
                end = int(where[i, 0] + ends[i])
                found.append((int(text[chunk[i]]), int(segment[chunk[i]]), end - int(n), end, int(edits[i])))
    return found


def merged(spans: list[tuple[int, int]]) -> int:
    """How many regions the spans make, overlapping ones together."""
    count, reach = 0, -1
    for start, end in sorted(spans):
        count, reach = count + (start >= reach), max(reach, end)
    return count


def long_parts(low: str) -> Iterator[tuple[str, np.ndarray]]:
    """A long text in parts of at most ``CHUNK`` normalised characters, and where each of these was.

    Parts overlap by normalised characters, so a region is whole in one of them however many blanks it holds.
    """
    plain, where, first = np.zeros(0, np.uint32), np.zeros(0, np.int64), True
    for start in range(0, len(low), CHUNK):
        before = max(0, start - 1)  # whether a blank follows a letter shows with the character before
        own, places = normalise(code_points(low[before : start + CHUNK]))
        own, places = own[places + before >= start], places[places + before >= start] + before
        plain, where = np.concatenate((plain, own)), np.concatenate((where, places))
        while len(plain) > CHUNK:
            yield as_text(plain[:CHUNK]), where[:CHUNK]
            plain, where, first = plain[CHUNK - 4 * SEGMENT :], where[CHUNK - 4 * SEGMENT :], False
    if first or len(plain) > 4 * SEGMENT:
        yield as_text(plain), where


def tiny_leaks(own: Benchmark, low: str) -> Iterator[tuple[int, int, int]]:
    """(item, start, end) of the items below Q characters that are a line of the text, or all of it."""
    codes = code_points(low + "\n")
    for at, line in enumerate((np.where(codes == 10, BORDER, codes), codes)):
        plain, where = normalise(line)
        ends = np.append(np.flatnonzero(plain == BORDER), len(plain) if at else len(plain) + 1)
        starts = np.append(0, ends[:-1] + 1)
        for a, b in zip(starts, ends, strict=True):
            if 0 < b - a <= Q + 1 and b <= len(plain):
                for item in own.tiny.get(as_text(plain[a:b]).strip(" "), ()):
                    solid = np.flatnonzero(plain[a:b] != 32) + a
                    yield item, int(where[solid[0]]), int(where[solid[-1]]) + 1


def whole_words(plain: np.ndarray, segment: np.ndarray, a: int, b: int, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Where a short item stands as whole words near a place it was found at, inside its text [begin, end)."""
    low = max(begin, a - 4 * HALF)
    near, item = as_text(plain[low : min(end, b + 4 * HALF)]), as_text(segment)
    at = near.find(item)
    while at >= 0:
        start, stop = low + at, low + at + len(item)
        if (start == begin or plain[start - 1] == 32) and (stop == end or plain[stop] == 32):
            yield start, stop
        at = near.find(item, at + 1)


def scan_texts(own: Benchmark, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, regions, start, end, edits): per text and item its regions, their extent in the text and least edits."""
    parts, owners, places = [], [], []
    best: dict[tuple[int, int], list] = {}
    for at, text in enumerate(texts):
        low = lowered(text)
        for part, where in long_parts(low) if len(low) > CHUNK else ((low, None),):
            parts.append(part)
            owners.append(at)
            places.append(where)
        for item, start, end in tiny_leaks(own, low) if own.tiny else ():
            best.setdefault((at, item), []).append((-1, start, end, 0))
    group, size = 0, 0
    for upto in range(len(parts)):
        size += len(parts[upto])
        if upto + 1 < len(parts) and size + len(parts[upto + 1]) <= CHUNK:
            continue
        mine = parts[group : upto + 1]
        codes = code_points("".join(p + chr(BORDER) for p in mine))
        starts = np.cumsum([0] + [len(p) + 1 for p in mine])
        plain, where = normalise(codes)
        borders = np.flatnonzero(plain == BORDER)
        for text, segment, a, b, edits in find_leaks(own, plain, borders):
            spans = [(a, b)]
            if own.lengths[segment] < LEAST:
                spans = whole_words(plain, own.segments[segment], a, b, int(borders[text - 1]) + 1 if text else 0, int(borders[text]))
            for a, b in spans:
                low, high = int(where[a] - starts[text]), int(where[b - 1] - starts[text])
                map_back = places[group + text]
                if map_back is not None:
                    low, high = int(map_back[low]), int(map_back[high])
                key = (owners[group + text], own.owner[segment])
                best.setdefault(key, []).append((segment, low, high + 1, edits))
        group, size = upto + 1, 0
    return [
        (text, item, merged([s[1:3] for s in spans]), min(s[1] for s in spans), max(s[2] for s in spans), min(s[3] for s in spans))
        for (text, item), spans in sorted(best.items())
    ]


SCHEMA = "doc_id bigint, item_id bigint, regions int, start bigint, end bigint, edits int"


def blocks_of(benchmark: DataFrame) -> Iterator[Callable[[], Benchmark]]:
    """For each block of the benchmark a function that gives its index in a worker.

    Blocks are dealt by hash: about ``BLOCK_CHARS`` characters each, one item at least.
    """
    items = benchmark.select(F.col("item_id").alias("item_id"), F.col("text").alias("text")).distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        rows = sorted(((r[0], r[1]) for r in rows), key=repr)
        shared, key = benchmark.sparkSession.sparkContext.broadcast(rows), zlib.crc32(repr(rows).encode("utf-8", "surrogatepass"))

        def index(shared=shared, key=key):
            cache = worker_cache()
            if cache.get("benchmark_key") != key:
                cache["benchmark"], cache["benchmark_key"] = Benchmark(shared.value), key
            return cache["benchmark"]

        yield index


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that shares a region with it: its regions, extent and least edits.

    ``start`` and ``end`` are code points of the text: from the first region's start to the last one's end.
    """
    bound_batches(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    found = None
    for index in blocks_of(benchmark):

        def scan(batches, index=index):
            own = index()
            for batch in batches:
                for part, texts in text_slices(batch, 1, SLICE_BYTES):
                    ids = part.column(0).to_pylist()
                    rows = [
                        dict(zip(OUT.names, (ids[t], own.items[i], n, a, b, e), strict=True)) for t, i, n, a, b, e in scan_texts(own, texts)
                    ]
                    yield pa.RecordBatch.from_pylist(rows, schema=OUT)

        here = chosen.mapInArrow(scan, SCHEMA)
        found = here if found is None else found.unionByName(here)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text shares no region with a benchmark item."""
    for index in blocks_of(benchmark):

        def keep(texts, index=index):
            clean = np.ones(len(texts), bool)
            clean[[found[0] for found in scan_texts(index(), texts)]] = False
            return clean

        docs = filter_rows(docs, keep)
    return docs


OUT = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("regions", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]
)
