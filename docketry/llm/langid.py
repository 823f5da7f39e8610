"""Language ID by segmentation-marginalised unigrams over the pieces of a fixed public vocabulary.

Every language has a probability for each piece of the vocabulary. The likelihood of a word is the sum over all
ways to cut it into pieces, computed by a forward recursion; that of a text is the product over its words, as no
piece spans two words. Words are runs of letters, lower-cased, with the vocabulary's word mark in front; a word of
more than 32 characters is cut every 32 characters. A character that is no piece has a small fixed probability.

Piece probabilities come from a few rounds of expectation-maximisation over the word counts of a bounded sample of
labelled documents (``SAMPLE_ROWS``, those with the smallest hashes, copies once): each round is one Spark job that sums
expected piece counts, and only languages x pieces numbers reach the driver.

Scoring handles all new words of a slice at once, by length, and remembers word scores per worker (bounded by
``CACHE_WORDS``; this only saves time).

Edge cases: a text without a letter, or null, is ``und`` with score 0; without labelled documents every text is;
a null language is not learnt from; ties go to the language that sorts first; repeated rows each get their result;
texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import bound_batches, filter_rows, text_slices, worker_cache
from docketry.session import cut_lineage



def _numerals() -> str:
    """Word characters that are no letters, such as ½ and Ⅷ, as ranges of a character class."""
    found: list[list[int]] = []
    for code in range(0x80, 0x20000):  # none lies beyond
        char = chr(code)
        if char.isalnum() and not char.isalpha():
            if found and found[-1][1] == code - 1:
                found[-1][1] = code
            else:
                found.append([code, code])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in found)


LETTERS = re.compile(rf"[^\W\d_{_numerals()}]+")
WORD_CHARS = re.compile(r"[^\W\d_]+")


def words_in(text: str) -> list[str]:
    """Runs of letters. Numerals are rare, so the plain class of word characters is tried first."""
    found = WORD_CHARS.findall(text)
    return found if not found or "".join(found).isalpha() else LETTERS.findall(text)
MARK = "▁"
LONGEST = 32
SAMPLE_ROWS = 5_000
#: Rows that a language has in the sample however rare it is (all of its rows, if fewer).
LEAST_ROWS = 500
ROUNDS = 3
UNKNOWN = 1e-7
CACHE_WORDS = 600_000
BASE = np.uint64(0x9E3779B97F4A7C15)
SLOTS_BITS = 21


def load_pieces(model_path: str) -> list[str]:
    """The pieces of a public vocabulary that can occur in lower-cased words."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found = []
    for at in range(model.get_piece_size()):
        piece = model.id_to_piece(at)
        body = piece.removeprefix(MARK)
        if not (model.is_control(at) or model.is_unknown(at) or model.is_byte(at)) and (body == "" or LETTERS.fullmatch(body)) and body == body.lower():
            found.append(piece)
    return found


def _hash(text: str) -> int:
    value = 0
    for char in text:
        value = (value * int(BASE) + ord(char) + 1) % (1 << 64)
    return value


class Pieces:
    """Looks pieces up by the rolling hash of their characters, many at a time."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([_hash(p) for p in pieces], np.uint64)
        assert len(np.unique(hashes)) == len(hashes)
        for step in range(1, 1000):  # a multiplier that puts at most two pieces in a slot
            self.multiplier = np.uint64((0xD6E8FEB86659FD93 * (2 * step + 1)) % (1 << 64))
            slots = self.slot(hashes)
            order = np.argsort(slots, kind="stable")
            if len(order) < 3 or not (slots[order][2:] == slots[order][:-2]).any():
                break
        self.tables = [np.full(1 << SLOTS_BITS, self.size, np.int32) for _ in range(2)]
        self.hashes = np.append(hashes, np.uint64(0))
        for at in order:
            table = self.tables[int(self.tables[0][slots[at]] != self.size)]
            table[slots[at]] = at

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * self.multiplier) >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece with each hash; ``size`` where there is none."""
        slots = self.slot(hashes)
        first = self.tables[0][slots]
        found = np.where(self.hashes[first] == hashes, first, self.size)
        rest = np.flatnonzero((found == self.size) & (first != self.size))
        if len(rest):
            second = self.tables[1][slots[rest]]
            found[rest] = np.where(self.hashes[second] == hashes[rest], second, self.size)
        return found

    def spans(self, words: list[str]):
        """For words of one length: (end, start, piece of each word), ends ascending; ``size + 1`` is an unknown character."""
        width = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)
        heads = [np.zeros(len(words), np.uint64)]
        powers = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for at in range(width):
                heads.append(heads[-1] * BASE + codes[:, at].astype(np.uint64) + np.uint64(1))
                powers.append(powers[-1] * BASE)
            for end in range(1, width + 1):
                for start in range(max(0, end - self.longest), end):
                    found = self.find(heads[end] - heads[start] * powers[end - start])
                    if end - start == 1:
                        found = np.where(found == self.size, self.size + 1, found)
                    elif (found == self.size).all():
                        continue
                    yield end, start, found


def blocks(word: str) -> list[str]:
    """A word with its mark, cut every ``LONGEST`` characters."""
    return [MARK + word] if len(word) <= LONGEST else [MARK + word[:LONGEST]] + [word[i : i + LONGEST] for i in range(LONGEST, len(word), LONGEST)]


def by_length(parts: list[str]):
    groups: dict[int, list[int]] = {}
    for at, part in enumerate(parts):
        groups.setdefault(len(part), []).append(at)
    return groups.values()


def forward(pieces: Pieces, parts: list[str], table: np.ndarray) -> np.ndarray:
    """Log-likelihood of each part in each language; ``table`` is pieces (and none, unknown) x languages."""
    out = np.zeros((len(parts), table.shape[1]))
    for group in by_length(parts):
        words = [parts[i] for i in group]
        width = len(words[0])
        alpha = np.zeros((width + 1, len(words), table.shape[1]))
        alpha[0] = 1
        for end, start, found in pieces.spans(words):
            alpha[end] += alpha[start] * table[found]
        out[group] = np.log(alpha[width])
    return out


def expected(pieces: Pieces, parts: list[str], counts: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Expected occurrences of each piece over all ways to cut the parts, for the piece probabilities ``row``."""
    total = np.zeros(pieces.size + 2)
    for group in by_length(parts):
        words, times = [parts[i] for i in group], counts[group]
        width = len(words[0])
        spans = list(pieces.spans(words))
        alpha, beta = np.zeros((2, width + 1, len(words)))
        alpha[0] = beta[width] = 1
        for end, start, found in spans:
            alpha[end] += alpha[start] * row[found]
        for end, start, found in reversed(spans):
            beta[start] += beta[end] * row[found]
        for end, start, found in spans:
            total += np.bincount(found, alpha[start] * row[found] * beta[end] * times / alpha[width], minlength=len(total))
    return total


def probabilities(counts: np.ndarray) -> np.ndarray:
    """Piece probabilities from (expected) counts by language, with the rows for none and unknown."""
    smooth = counts + 0.01
    table = np.zeros((counts.shape[0] + 2, counts.shape[1]))
    table[:-2] = smooth / smooth.sum(axis=0)
    table[-1] = UNKNOWN
    return table


def train(labelled: DataFrame, names: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities from ``labelled`` (text, lang)."""
    spark = labelled.sparkSession
    bound_batches(spark)
    known = labelled.where(F.col("lang").isNotNull())
    # One row for each language: equal rows count once, as they share a hash.
    digest = F.xxhash64("lang", "text")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(digest).alias("texts")).collect()
    rows = sum(r["rows"] for r in sizes)
    share = [(F.lit(r["lang"]), F.lit(max(LEAST_ROWS, SAMPLE_ROWS * r["rows"] // rows) / max(r["texts"], 1))) for r in sizes]
    part = F.create_map(*[x for pair in share for x in pair])[F.col("lang")] if share else F.lit(1.0)
    chosen = known.where(F.pmod(digest, F.lit(1 << 40)) < part * (1 << 40)).select("lang", "text").distinct()

    def count(batches):
        words: dict[str, Counter] = {}
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    words.setdefault(lang, Counter()).update(words_in(text.lower()))
        rows = [(lang, w, n) for lang, seen in words.items() for w, n in seen.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))], names=["lang", "word", "n"]
        )

    words = cut_lineage(
        chosen.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        .repartition(min(64, 2 * spark.sparkContext.defaultParallelism)),
        "langid-words",
    )
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    table = np.zeros((len(names) + 2, len(langs)))
    table[:-2], table[-1] = 1 / max(len(names), 1), UNKNOWN
    at = {lang: i for i, lang in enumerate(langs)}
    for _ in range(ROUNDS if langs else 0):
        shared = spark.sparkContext.broadcast((names, table))  # pieces x languages

        def expect(batches, shared=shared):
            names, table = shared.value
            pieces, sums = pieces_of(names), {}
            rows: dict[str, list] = {}  # a part of the sample's words
            for batch in batches:
                for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    rows.setdefault(lang, []).extend((b, n) for b in blocks(word))
            for lang, all_words in rows.items():
                for low in range(0, len(all_words), 50_000):
                    own = all_words[low : low + 50_000]
                    found = expected(pieces, [b for b, _ in own], np.array([n for _, n in own], float), table[:, at[lang]])
                    sums[lang] = sums.get(lang, 0) + found[: pieces.size]
            for lang, own in sums.items():
                which = np.flatnonzero(own > 1e-6)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(which), pa.string()), pa.array(which.astype(np.int32)), pa.array(own[which])], names=["lang", "piece", "n"]
                )

        sums = words.mapInArrow(expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        counts = np.zeros((len(names), len(langs)))
        for r in sums.collect():
            counts[r["piece"], at[r["lang"]]] = r["n"]
        table = probabilities(counts)
    return langs, table


def pieces_of(names: list[str]) -> Pieces:
    """The worker's piece table of a vocabulary."""
    cache, key = worker_cache(), (len(names), hash(tuple(names)))
    if cache.get("pieces_key") != key:
        cache["pieces"], cache["pieces_key"] = Pieces(names), key
    return cache["pieces"]


class Scores:
    """Word scores in all languages, computed for new words together and remembered."""

    def __init__(self, pieces: Pieces, table: np.ndarray):
        self.pieces, self.table = pieces, table
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, self.table.shape[1]))

    def add(self, words: set[str]) -> None:
        fresh = list(words)
        parts, owner = [], []
        for at, word in enumerate(fresh):
            own = blocks(word)
            parts += own
            owner += [at] * len(own)
        scores = np.zeros((len(fresh), self.table.shape[1]))
        for low in range(0, len(parts), 50_000):  # bounds the working memory
            np.add.at(scores, owner[low : low + 50_000], forward(self.pieces, parts[low : low + 50_000], self.table))
        base = len(self.at)
        while len(self.rows) < base + len(fresh):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[base : base + len(fresh)] = scores
        self.at.update((w, base + i) for i, w in enumerate(fresh))

    def texts(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text in each language; not a number where there is no word."""
        out = np.full((len(texts), self.table.shape[1]), np.nan)
        found = [words_in(text.lower()) for text in texts]
        seen = set().union(*found)
        if fresh := seen.difference(self.at):
            if len(self.at) + len(fresh) > CACHE_WORDS:
                self.clear()
                fresh = seen
            self.add(fresh)
        for at, words in enumerate(found):
            if words:
                out[at] = self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0)
        return out


def scorer(key: int, names: list[str], table: np.ndarray) -> Scores:
    """The worker's word scores of a model."""
    cache = worker_cache()
    if cache.get("scores_key") != key:
        cache["scores"], cache["scores_key"] = Scores(pieces_of(names), table), key
    return cache["scores"]


def verdicts(own: Scores, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each text's language, -1 for none, and its posterior under equal priors."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    if own.table.shape[1]:
        logs = own.texts(texts)
        known = ~np.isnan(logs).all(axis=1)
        best[known] = logs[known].argmax(axis=1)
        score[known] = 1 / np.exp(logs[known] - logs[known].max(axis=1, keepdims=True)).sum(axis=1)
    return best, score


def keep_identified(docs: DataFrame, langs: list[str], table: np.ndarray, names: list[str], least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language with a posterior of at least ``least``.

    Without any language nothing can be told, and all rows stay.
    """
    if not langs:
        return docs
    shared, key = docs.sparkSession.sparkContext.broadcast((names, table)), hash(table.tobytes())

    def keep(texts):
        best, score = verdicts(scorer(key, *shared.value), texts)
        return (best >= 0) & (score >= least)

    return filter_rows(docs, keep)


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, names: list[str]) -> DataFrame:
    """doc_id, lang_pred and score (posterior under equal priors) of every document."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((names, table))
    key = hash(table.tobytes())

    def guess(batches):
        own = scorer(key, *shared.value)
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                best, score = verdicts(own, texts)
                labels = [langs[b] if b >= 0 else "und" for b in best]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(labels, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).mapInArrow(guess, "doc_id bigint, lang_pred string, score double")
