"""Token ids of documents as ORC files in ascending id order, and their readers.

Each document is one row: doc_id, file_start (ids of earlier documents in the same file), n_tokens and ids, the
last of which is the end id. Integers are run-length encoded; stripes carry row indexes and Bloom filters on
doc_id, so a reader skips files, stripes and row groups by id, and Spark reads the stripes of a file in parallel.

Texts are encoded by a public vocabulary given as a path on the driver; its content (a few MB) is broadcast.
Byte-level vocabularies cut a text before each single blank, and those with the usual pattern also where ASCII letters
or digits meet other ASCII signs, and around a single newline. The pieces between are encoded once per worker, many new
ones in one text, and looked up afterwards: the bytes of a slice are cut as one column, Arrow numbers their different
pieces, and the ids of all pieces are gathered in one step. Texts with white space beside a blank, or with a special
token's string, are encoded as a whole. The lookup table is bounded by ``CACHE_WORDS`` and only saves time.

Edge cases: a null or empty text has only the end id; null ids come first; rows with equal ids keep all their
rows; very long texts are one row; an empty table writes an empty folder that reads as empty; other columns are
ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import bound_batches, row_slices, worker_cache

CACHE_WORDS = 700_000
#: White space on either side of a blank may join it in one token. Most texts know only blanks and newlines.
SPACE = r"[\t\n\v\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BESIDE_BLANK = rf"{SPACE} | {SPACE}"
#: Kinds of bytes. Bytes beyond ASCII and control bytes are of no known kind, and no cut is made beside them.
WORD, SIGN, APOSTROPHE, BREAK, GAP, KINDS = 1, 2, 3, 4, 5, 6
KIND = np.zeros(256, np.uint8)
KIND[33:127] = [WORD if chr(byte).isalnum() else SIGN for byte in range(33, 127)]
KIND[[ord("'"), ord("\n"), ord(" ")]] = APOSTROPHE, BREAK, GAP
#: Where to cut between two kinds (KINDS * left + right): always before a blank ...
BEFORE_BLANK = np.zeros(256, np.uint8)
BEFORE_BLANK[GAP : KINDS * KINDS : KINDS] = 1
#: ... and by the usual pattern of byte-level vocabularies. An apostrophe may belong to the letters after it ('s).
USUAL = BEFORE_BLANK.copy()
for _left, _right in ((WORD, SIGN), (WORD, APOSTROPHE), (SIGN, WORD), (WORD, BREAK), (SIGN, BREAK), (APOSTROPHE, BREAK)):
    USUAL[KINDS * _left + _right] = 1
#: How byte-level vocabularies write a blank and a newline.
BLANK, NEWLINE = "Ġ", "Ċ"
RUN_PIECES = 1000
#: Bytes cut at a time, so that one very long text takes little more memory than itself.
CUT_BYTES = 8 << 20
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000
FILE_SCHEMA = "doc_id bigint, file_start bigint, n_tokens int, ids array<int>"


class Encoder:
    """Encodes texts with one vocabulary; pieces after single blanks are remembered in two generations."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(vocabulary)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.irregular = "|".join([BESIDE_BLANK, *special])
        own = self.tokenizer.pre_tokenizer
        self.usual = isinstance(own, pre_tokenizers.ByteLevel) and own.use_regex and not own.add_prefix_space and not self.tokenizer.normalizer
        self.after_blank, self.newline = np.zeros((2, self.tokenizer.get_vocab_size()), bool)
        for token, at in self.tokenizer.get_vocab().items():
            self.after_blank[at], self.newline[at] = token.startswith(BLANK), token == NEWLINE
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in done]

    def runs(self, pieces: list[str], apart: bool = False) -> list[bytes]:
        """Ids of pieces that each start with their only blank, or that a newline is to keep apart: many in one text."""
        out: list[bytes] = []
        groups = [pieces[low : low + RUN_PIECES] for low in range(0, len(pieces), RUN_PIECES)]
        before, opens, skip = ("\n", self.newline, 4) if apart else ("", self.after_blank, 0)
        for group, ids in zip(groups, self.whole([before + before.join(g) for g in groups]), strict=True):
            starts = np.flatnonzero(opens[np.frombuffer(ids, "<u4")])
            if len(starts) != len(group):  # the vocabulary joins the blank or newline with what is beside it
                out += self.whole(group)
                continue
            cuts = [*(4 * starts).tolist(), len(ids)]
            out += [ids[a + skip : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces that the younger half does not hold, and now does."""
        if len(self.young) + len(pieces) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        known = dict(zip(pieces, map(self.old.get, pieces), strict=True))
        missing = [piece for piece, ids in known.items() if ids is None]
        closed = [p for p in missing if not p[-1].isspace()]
        inner = [p for p in closed if p[0] == " "]
        apart = [p for p in closed if not p[0].isspace() and "\n" not in p] if self.usual else []
        known.update(zip(inner, self.runs(inner), strict=True))
        known.update(zip(apart, self.runs(apart, apart=True), strict=True))
        single = [p for p in missing if known[p] is None]
        known.update(zip(single, self.whole(single), strict=True))
        self.young.update(known)
        return list(known.values())

    def look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces; new ones are learned first."""
        ids = list(map(self.young.get, pieces))
        missing = [at for at, own in enumerate(ids) if own is None]
        if missing:
            for at, own in zip(missing, self.learn([pieces[at] for at in missing]), strict=True):
                ids[at] = own
        return ids

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Marks the bytes of regular texts where a piece starts; the starts of texts are not marked."""
        table = (USUAL if self.usual else BEFORE_BLANK).tobytes()
        cut = np.zeros(len(data), bool)
        for low in range(0, len(data), CUT_BYTES):
            start = max(low - 2, 0)  # a cut depends on two bytes before it
            kind = np.frombuffer(data[start : low + CUT_BYTES].tobytes().translate(KIND.tobytes()), np.uint8)
            own, pairs = cut[start : low + CUT_BYTES], kind[:-1] * np.uint8(KINDS) + kind[1:]
            own[1:] |= np.frombuffer(pairs.tobytes().translate(table), bool)
            if self.usual:  # after a single newline; how several are grouped depends on what follows
                after = np.flatnonzero(kind[1:-1] == BREAK) + 2
                own[after] |= np.isin(kind[after - 2], (WORD, SIGN, APOSTROPHE)) & np.isin(kind[after], (WORD, SIGN, APOSTROPHE))
        return cut

    def flat(self, column: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), each with the ids of ``end``, one after the other, and their number in each text."""
        column = pc.fill_null(column.cast(pa.string()), "")
        whole = pc.match_substring_regex(column, self.irregular)
        direct = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        wholes = self.whole(column.take(pa.array(direct)).to_pylist())
        if wholes:
            column = pc.if_else(whole, "", column)
        bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        cut = self.cuts(data)
        cut[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut).astype(np.int32)
        edges = pa.py_buffer(np.append(starts, np.int32(len(data))))
        coded = pa.StringArray.from_buffers(len(starts), edges, pa.py_buffer(data)).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [*self.look_up(pieces), *wholes, end]
        # After the pieces of each text comes the end; before it comes the whole text, if it was not cut.
        last = np.searchsorted(starts, bounds[1:])
        extra = np.insert(np.full(len(last), len(ids) - 1, np.int32), direct, len(pieces) + np.arange(len(direct)))
        code = np.insert(coded.indices.to_numpy(), np.insert(last, direct, last[direct]), extra)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        table = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        taken = table.take(pa.array(code))
        stops = last + np.searchsorted(direct, np.arange(len(last)), side="right") + np.arange(1, len(last) + 1)
        return taken.flatten().to_numpy(), np.diff(taken.offsets.to_numpy()[stops], prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, counts = self.flat(pa.array(texts, pa.string()))
        return [part.astype("<u4").tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def encoder(key: str, vocabulary) -> Encoder:
    """The worker's encoder of a vocabulary, loaded once."""
    cache = worker_cache()
    if cache.get("encoder_key") != key:
        cache["encoder"], cache["encoder_key"] = Encoder(vocabulary()), key
    return cache["encoder"]


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 0) -> None:
    """Write the ids of ``docs`` (doc_id, text) to ``path``."""
    spark = docs.sparkSession
    bound_batches(spark)
    with open(vocabulary_path, encoding="utf-8") as file:
        content = file.read()
    shared, name = spark.sparkContext.broadcast(content), f"{os.path.basename(vocabulary_path)}:{zlib.crc32(content.encode())}"

    def encode(batches):
        own, start, end = encoder(name, lambda: shared.value), 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in row_slices(batch, 1, 8 << 20):
                flat, counts = own.flat(part.column(1), end)
                ends = np.cumsum(counts)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(start + ends - counts), pa.array(counts.astype(np.int32)), ids],
                    names=["doc_id", "file_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    chosen = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    ordered = chosen.repartitionByRange(F.col("doc_id").asc()).sortWithinPartitions(F.col("doc_id").asc())
    (
        ordered.mapInArrow(encode, FILE_SCHEMA)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", "0")  # a task writes one file, so its running number is the file's
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """Rows of the files; with ``doc_ids``, stripes and row groups without them are skipped by their metadata."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its name and the ids in all files before it. Only the small columns are read."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path).select("doc_id", "n_tokens", F.col("_metadata.file_name").alias("file"))
    totals = rows.groupBy("file").agg(
        F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("has_null"), F.sum("n_tokens").alias("n")
    )
    order = Window.orderBy(F.desc("has_null"), "first")  # one row per file
    return totals.select("file", (F.sum("n").over(order) - F.col("n")).alias("before"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the crc32 of the ids, all from the files."""
    bound_batches(spark)
    rows = spark.read.schema(FILE_SCHEMA).orc(path).select(
        "doc_id", "file_start", "ids", F.col("_metadata.file_name").alias("file")
    )

    def check(batches):
        for batch in batches:
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())],
                names=["doc_id", "file_start", "file", "n_tokens", "ids_crc32"],
            )

    checked = rows.mapInArrow(check, "doc_id bigint, file_start bigint, file string, n_tokens bigint, ids_crc32 bigint")
    return checked.join(file_starts(spark, path), "file").select(
        "doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32"
    )
