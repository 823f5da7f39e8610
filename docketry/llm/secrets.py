"""Secret scans: fixed rules, and two character Markov models compared by log-likelihood ratio.

The rules give the base spans. The models are trained on labelled samples: random strings are what the rules
capture in a sample of documents, and digests of a counter in usual alphabets; ordinary identifiers are the other
long words of these documents. Base spans are cut out of the runs of identifier characters; what is left of a run, 20
characters or more, is a secret if it is likelier under the first model, in all and per character. If the whole is not,
its best stretch is looked for: the consecutive parts between ``/ = _ -`` that exceed the least mean by most.

The sample is bounded: about ``SAMPLE_ROWS`` documents by the hash of their ids and texts; equal rows count once.

Edge cases: a null or empty text has no spans; runs of any length are scored; equal spans of two kinds are
both given; repeated rows each get their result; without documents nothing is learnt but the counter digests;
other columns are ignored. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import bound_batches, text_slices

# The base rules and their least lengths.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
ASSIGN_MARKS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

KINDS = ("assign", "access", "hex", "model")
LEAST_RUN = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PARTING = re.compile(r"[/=_-]")
WORD = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
SAMPLE_ROWS = 20_000
#: Least log-likelihood ratio (natural logs) of a run, in all and per character.
LEAST_RATIO, LEAST_MEAN = 12.0, 0.6
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # one more for the start

CODES = np.full(128, 0, np.uint8)
for _at, _char in enumerate(ALPHABET):
    CODES[ord(_char)] = _at + 1


def base_spans(text: str, data: bytes | None = None) -> list[tuple[int, int, str, int, int]]:
    """(start, rank of the kind, kind, end, start of the value) of the fixed rules, by start and kind."""
    data = text.encode("utf-8", "surrogatepass") if data is None else data
    found = []
    lowered = data.lower()
    if any(mark in lowered for mark in ASSIGN_MARKS):
        found += [
            (m.start(), 0, "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE
        ]
    if b"AKIA" in data:
        found += [(m.start(), 1, "access", m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    for run in RUN.finditer(text):  # a hex string of 32 characters lies inside such a run
        found += [
            (m.start(), 2, "hex", m.end(), m.start())
            for m in HEX.finditer(text, run.start(), run.end())
            if m.end() - m.start() >= LEAST_HEX
        ]
    return sorted(found)


def _pairs(word: str) -> np.ndarray:
    """Pairs of neighbouring characters as numbers, the first with the start."""
    codes = CODES[np.frombuffer(word.encode(), np.uint8)].astype(np.int64)
    return np.concatenate(([0], codes[:-1])) * STATES + codes


def counter_digests(rows: int = 600) -> list[str]:
    """Random-looking strings in usual alphabets, from digests of a counter."""
    found = []
    for at in range(rows):
        digest = hashlib.sha256(str(at).encode()).digest()
        found += [digest.hex()[: 32 + at % 33], base64.b64encode(digest).decode().rstrip("="), base64.b32encode(digest).decode()[: 16 + at % 24]]
    return found


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each pair of characters, random strings over identifiers, from labelled samples."""
    bound_batches(docs.sparkSession)
    rows = docs.count()
    one_in = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(rows, 1)))
    chosen = docs.where(one_in < SAMPLE_ROWS).select("doc_id", F.col("text").alias("text")).distinct().select("text")

    def count(batches):
        cells = np.zeros((2, STATES * STATES), np.int64)
        for batch in batches:
            for _, texts in text_slices(batch, 0):
                for text in texts:
                    spans, at, words = base_spans(text), 0, Counter()
                    for start, _, _, end, value in spans:
                        cells[1] += np.bincount(_pairs(re.sub(r"[^A-Za-z0-9+/_=-]", "", text[value:end])), minlength=STATES**2)
                        words.update(WORD.findall(text, at, start) if start > at else [])
                        at = max(at, end)
                    words.update(WORD.findall(text, at))
                    for word, n in words.items():
                        cells[0] += n * np.bincount(_pairs(word), minlength=STATES**2)
        label, pair = np.nonzero(cells)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(cells[label, pair])], names=["label", "pair", "n"]
        )

    counts = np.zeros((2, STATES, STATES))
    # At most two labels times the pairs of the alphabet.
    for r in chosen.mapInArrow(count, "label int, pair int, n bigint").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        counts[r["label"], r["pair"] // STATES, r["pair"] % STATES] += r["n"]
    for word in counter_digests():
        np.add.at(counts[1].reshape(-1), _pairs(word), 1)
    smooth = counts + 0.5
    logs = np.log(smooth / smooth.sum(axis=2, keepdims=True))
    return (logs[1] - logs[0]).reshape(-1)


def best_stretch(run: str, ratio: np.ndarray) -> tuple[int, int] | None:
    """Start and end of the secret in a run: all of it, or its best consecutive parts."""
    scores = ratio[_pairs(run)]
    if len(run) >= LEAST_RUN and scores.sum() >= max(LEAST_RATIO, LEAST_MEAN * len(run)):
        return 0, len(run)
    sums = np.concatenate(([0.0], np.cumsum(scores - LEAST_MEAN)))
    # A part ends before its separator; the next one begins after it. The least sum so far begins the best stretch.
    best, least, start = (0.0, 0, 0), sums[0], 0
    for cut in PARTING.finditer(run + "-"):
        gain = sums[cut.start()] - least
        if gain > best[0]:
            best = (gain, start, cut.start())
        if cut.end() < len(sums) and sums[cut.end()] < least:
            least, start = sums[cut.end()], cut.end()
    _, a, b = best
    own = float(ratio[_pairs(run[a:b])].sum()) if b > a else 0.0
    return (a, b) if b - a >= LEAST_RUN and own >= max(LEAST_RATIO, LEAST_MEAN * (b - a)) else None


def scan_text(text: str, ratio: np.ndarray) -> list[tuple[int, int, str, int, int]]:
    """Base spans and those of the models, by start and kind."""
    found = base_spans(text)
    taken = [(s[0], s[3]) for s in found]
    for run in RUN.finditer(text):
        at, left = run.start(), []
        for a, b in taken:
            if a < run.end() and b > at:
                left.append((at, a))
                at = b
        left.append((at, run.end()))
        while left:
            a, b = left.pop()
            while a > run.start() and a < b and text[a] in "/=_-":  # what parted it from a base span
                a += 1
            if b - a >= LEAST_RUN and (stretch := best_stretch(text[a:b], ratio)):
                low, high = a + stretch[0], a + stretch[1]
                found.append((low, 3, "model", high, low))
                left += [(a, low), (high, b)]
    return sorted(found)


SCHEMA = "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (kind, start, end), by start and then kind."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))  # one number for each pair of the alphabet
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def find(batches):
        ratio = shared.value
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                spans = [[{"kind": k, "start": a, "end": b} for a, _, k, b, _ in scan_text(t, ratio)] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, span)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).mapInArrow(find, SCHEMA)
