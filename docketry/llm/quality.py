"""Quality rules: base counts and the divergence of a document's histograms from language references.

References are corpus statistics over all documents of each language: a histogram over character classes, and one
over the language's most frequent short words (and one more cell for every other word). A document is compared
with the reference of its own language, or with every reference where its language is not known, by
Jensen-Shannon distance (base 2, square root, 0 to 1). It is rejected if either distance passes its limit, unless
the text is too short for a histogram to mean anything (minimum-length guards).

Edge cases: a null text counts as empty; a text without words fails the base rule; a language without references
is compared with all references, and no references at all means no verdict against the text; a null language is
unknown; repeated rows each get their result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import bound_batches, text_slices

SYMBOLS = "#*$%&|<>"
#: Cells: lower, upper, digit, blank, comma, full stop, other ASCII punctuation, other letter with case, other character.
N_CLASSES = 9
WINDOW = 5


@dataclass(frozen=True)
class Divergence:
    """Limits of the method: distances, and the lengths from which each histogram counts."""

    class_limit: float = 0.3
    #: A histogram of n words strays from its reference by chance, in proportion to the root of 1 / n.
    word_limit: float = 0.15
    word_noise: float = 3.6
    min_chars: int = 200
    min_words: int = 50
    #: A common word has at most so many letters, and so many of each language's most frequent ones have a cell.
    word_chars: int = 5
    words: int = 48


def _class_table() -> np.ndarray:
    table = np.full(256, 6, np.uint8)
    table[[*range(97, 123)]] = 0
    table[[*range(65, 91)]] = 1
    table[[*range(48, 58)]] = 2
    table[[9, 10, 11, 12, 13, 32]] = 3
    table[44], table[46] = 4, 5
    # In UTF-8, first bytes up to 0xDF start letters of two-byte scripts; later ones start other characters.
    table[0xC0:0xE0], table[0xE0:] = 7, 8
    table[0x80:0xC0] = 255
    return table


CLASSES = _class_table()


def class_counts(data: bytes) -> np.ndarray:
    """Characters of each class in a UTF-8 text; continuation bytes do not count."""
    cells = np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=256)
    return cells[:N_CLASSES]


def base_counts(text: str, data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    n = len(words)
    chars = sum(map(len, words)) if len(data) == len(text) else len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line and line.split(None, 1)]
    repeated = 0
    if n >= WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            covered = 0
            for at, window in enumerate(windows):
                if counts[window] > 1:
                    repeated += at + WINDOW - max(covered, at)
                    covered = at + WINDOW
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def common_words(counts: Counter, most: int) -> Counter:
    """Counts of words that are short and all letters, lower-cased."""
    found: Counter = Counter()
    for word, n in counts.items():
        text = word.decode("utf-8", "surrogatepass").strip(",.").lower()
        if len(text) <= most and text.isalpha():
            found[text] += n
    return found


def references(docs: DataFrame, rule: Divergence) -> list[tuple[str, str, int]]:
    """(language, cell, count) of all documents: ``c0``.. for classes, ``w:`` and a word, ``w`` for all words."""
    bound_batches(docs.sparkSession)

    def count(batches):
        chars: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def flush():
            rows = [(lang, f"c{i}", int(n)) for lang, cells in chars.items() for i, n in enumerate(cells) if n]
            for lang, seen in words.items():
                rows.append((lang, "w", sum(seen.values())))
                rows += [(lang, f"w:{w}", n) for w, n in common_words(seen, rule.word_chars).items()]
            chars.clear()
            words.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))],
                names=["lang", "cell", "n"],
            )

        for batch in batches:
            for part, texts in text_slices(batch, 1):
                for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    chars[lang] = chars.get(lang, 0) + class_counts(data)
                    words.setdefault(lang, Counter()).update(data.split())
            if sum(map(len, words.values())) > 300_000:
                yield flush()
        if words:
            yield flush()

    known = docs.where(F.col("lang").isNotNull()).select(F.col("lang").alias("lang"), F.col("text").alias("text"))
    cells = known.mapInArrow(count, "lang string, cell string, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    is_word = F.col("cell").startswith("w:")
    rank = F.row_number().over(Window.partitionBy("lang", is_word).orderBy(F.desc("n"), "cell"))
    kept = cells.withColumn("rank", rank).where(~is_word | (F.col("rank") <= rule.words))
    return [(r["lang"], r["cell"], r["n"]) for r in kept.select("lang", "cell", "n").collect()]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to ``q``, both normalised."""
    middle = (p + q) / 2

    def part(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / middle), 0.0).sum(axis=-1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


class References:
    """Normalised histograms by language and the cells of their words."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.classes = np.zeros((len(self.langs), N_CLASSES))
        self.cells: list[dict[str, int]] = []
        self.words: list[np.ndarray] = []
        for i, lang in enumerate(self.langs):
            own = {cell: n for at, cell, n in rows if at == lang}
            for k in range(N_CLASSES):
                self.classes[i, k] = own.get(f"c{k}", 0)
            self.classes[i] /= max(self.classes[i].sum(), 1)
            words = sorted(c[2:] for c in own if c.startswith("w:"))
            counts = np.array([own[f"w:{w}"] for w in words] + [0.0])
            counts[-1] = max(own.get("w", 0) - counts.sum(), 0)
            self.cells.append({w: k for k, w in enumerate(words)})
            self.words.append(counts / max(counts.sum(), 1))
        self.at = {lang: i for i, lang in enumerate(self.langs)}
        #: Every written form that counts for a word: as it is, with a capital or all capitals, before a comma or full stop.
        self.forms = {
            (shape(w) + end).encode(): w
            for cells in self.cells for w in cells for shape in (str.lower, str.capitalize, str.upper) for end in ("", ",", ".")
        }

    def distances(self, lang: str | None, classes: np.ndarray, seen: Counter) -> tuple[float, float]:
        """Class and word distance of a document: to its language, or the least over all."""
        n_chars, n_words = classes.sum(), sum(seen.values())
        if not self.langs or not n_chars or not n_words:
            return 0.0, 0.0
        which = [self.at[lang]] if lang in self.at else range(len(self.langs))
        found = []
        common = [(self.forms[w], n) for w, n in seen.items() if w in self.forms]
        for i in which:
            counts = np.zeros(len(self.words[i]))
            for word, n in common:
                if (cell := self.cells[i].get(word)) is not None:
                    counts[cell] += n
            counts[-1] = n_words - counts.sum()
            found.append((float(distance(classes / n_chars, self.classes[i])), float(distance(counts / n_words, self.words[i]))))
        return min(found, key=sum)


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, class_distance double, word_distance double"
)


def judge(docs: DataFrame, rule: Divergence = Divergence()) -> DataFrame:
    """Base counts, both distances and the verdict of every document (doc_id, text, lang)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(references(docs, rule))  # languages x (words + classes) rows

    def measure(batches):
        refs = References(shared.value)
        for batch in batches:
            for part, texts in text_slices(batch, 2):
                rows = []
                for key, lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    words = data.split()
                    n, chars, symbols, lines, repeated = base_counts(text, data, words)
                    failed = n < 10 or 100 * repeated > 20 * n
                    by_class, by_word = refs.distances(lang, class_counts(data), Counter(words))
                    odd = (len(text) >= rule.min_chars and by_class > rule.class_limit) or (
                        n >= rule.min_words and by_word > rule.word_limit + rule.word_noise / n**0.5
                    )
                    rows.append((key, n, chars, symbols, lines, repeated, failed, not failed and not odd, by_class, by_word))
                yield pa.RecordBatch.from_pylist([dict(zip(OUT.names, r, strict=True)) for r in rows], schema=OUT)

    chosen = docs.select(F.col("doc_id").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").alias("text"))
    return chosen.mapInArrow(measure, SCHEMA)


OUT = pa.schema(
    [("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64())]
)
