"""Best-fit decreasing packing of token sequences, exact at any size."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import limit_arrow_batches, settle

CAPACITY = 4096
RANK_ROWS = 128
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = ".,;:!?*$%&#"
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")
# Words remembered by a worker between rows, the longest of them, and characters of a text that are split at a time.
REMEMBERED = 1_000_000
LONGEST = 64
SLICE = 1 << 20


class FitTree:
    """A segment tree over remaining capacities 0..capacity that finds the tightest one in use.

    `bins[c]` holds the open bins with c tokens left, as [first, last) ranges of bin numbers.
    """

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.used = [0] * (2 * self.width)
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, capacity: int, used: int) -> None:
        node = capacity + self.width
        self.used[node] = used
        while node > 1:
            node >>= 1
            self.used[node] = self.used[2 * node] | self.used[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least `length` that some bin has."""
        node = length + self.width
        if self.used[node]:
            return length
        while node > 1:
            if not node & 1 and self.used[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.used[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None

    def put(self, capacity: int, first: int, last: int) -> None:
        if capacity and first < last:
            self.bins.setdefault(capacity, []).append((first, last))
            self._mark(capacity, 1)

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """Up to `most` bins of this capacity, as one range."""
        first, last = self.bins[capacity].pop()
        if last - first > most:
            self.bins[capacity].append((first + most, last))
            last = first + most
        elif not self.bins[capacity]:
            self._mark(capacity, 0)
        return first, last


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths: rows (length, rank, bin, per_bin, offset).

    Pieces of one length are alike, so a run of them is placed at once: those of rank `rank` onward go
    to bins `bin` onward, `per_bin` in each, from `offset`; a row holds until the next one of its length.
    A bin that has just taken a piece and can take another of the same length is the tightest, so it
    takes as many as it can. The number of rows depends on the lengths in use and not on their counts.
    """
    tree, opened, plan = FitTree(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            per = (room or capacity) // length
            wanted = max(1, left // per)  # bins to be filled alike; the last, partly filled one comes alone
            if room is None:
                first, last, room = opened, opened + wanted, capacity
                opened = last
            else:
                first, last = tree.take(room, wanted)
            each = min(per, left)
            plan.append((length, rank, first, each, capacity - room))
            tree.put(room - each * length, first, last)
            rank += each * (last - first)
            left -= each * (last - first)
    return plan


def _slices(text: str) -> Iterator[str]:
    """The text in parts of about SLICE characters, cut at spaces, so that no word is split."""
    at = 0
    while len(text) - at > SLICE:
        cut = text.find(" ", at + SLICE)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _words(text: str) -> list[str]:
    """Split at Unicode white space. str.split() also splits at four control characters that are none."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


class WordIds(dict):
    """word -> its ids as little-endian bytes, tokenized when first met; for tokenizers that fold case, drop
    white space and never join what it or a change from letters to other marks parts. A full one is emptied.

    Words of Latin letters, with or without marks behind them, skip the steps before the merges: their
    parts are known beforehand. All others go the tokenizer's whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = [c for c in map(chr, range(0x250)) if _LETTERS.fullmatch(c)]
        split = lambda c: self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(c))
        self.spelled = {ord(c): "".join(part for part, _ in split(c)) for c in letters}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        core = word.rstrip(_MARKS)
        if core and len(core) < len(word) and _LETTERS.fullmatch(core[-1]):
            ids = self[core] + self[word[len(core):]]
        elif word.isascii() and word != word.lower() and "<" not in word:  # special tokens keep their case
            ids = self[word.lower()]
        elif _LETTERS.fullmatch(word):
            ids = array("I", [t.id for t in self.model.tokenize(word.translate(self.spelled))]).tobytes()
        else:
            ids = self._whole(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def parts(self, text: str) -> Iterator[bytes]:
        """The ids of a text, in parts."""
        for part in _slices(text):
            yield b"".join(map(self.__getitem__, _words(part)))


_KNOWN: dict[str, WordIds] = {}

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut after every `capacity` ids."""

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_path not in _KNOWN:
            _KNOWN[tokenizer_path] = WordIds(tokenizer_path)
        known = _KNOWN[tokenizer_path]
        end, full = array("I", [end_id]).tobytes(), 4 * capacity
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                piece, held = 0, b""
                for part in known.parts(text or ""):
                    held += part
                    while len(held) > full:
                        out.append((doc, piece, piece * capacity, capacity, zlib.crc32(held[:full])))
                        piece, held = piece + 1, held[full:]
                held += end
                for at in range(0, len(held), full):
                    some = held[at:at + full]
                    out.append((doc, piece, piece * capacity, len(some) // 4, zlib.crc32(some)))
                    piece += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Each piece's place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and the end id; NULL or empty text is the end id alone. Only documents
    longer than `capacity` are cut. Pieces are packed best-fit decreasing: a histogram of lengths, at
    most `capacity` rows, is enough to plan the packing exactly, and each piece finds its bin by its rank
    among the pieces of its length. Ranks are counted in blocks, so a length that most pieces share
    is spread over tasks. NULL and repeated ids are rows like any other; other columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    limit_arrow_batches(spark)
    pieces = settle(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col)
                    .withColumn("_row", F.monotonically_increasing_id()))
    per_length = pieces.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_length.collect()}  # at most `capacity` rows
    plan = best_fit(counts, capacity)
    blocks = spark.createDataFrame([(n, -(-c // RANK_ROWS)) for n, c in counts.items()], "length long, _blocks long")
    placed = pieces.join(F.broadcast(blocks), "length").withColumn("_block", F.pmod(F.xxhash64("_row"), F.col("_blocks")))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("length", "_block").agg(F.count("*").alias("_n")).select(
        "length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("length", "_block").orderBy("_row")) - 1
    ranked = placed.withColumn("_at", inside).join(starts, ["length", "_block"]).withColumn("_rank", F.col("_first") + F.col("_at"))
    columns = "doc_id", "piece", "start", "length", "ids_crc32"
    return ranked.select(*columns, "_rank").mapInArrow(
        _places(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _places(plan: list[tuple[int, int, int, int, int]]):
    """Adds (sequence_id, offset) to (length, _rank) rows by looking the rank up in the plan."""
    table = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    longest = int(table[:, 0].max(initial=0)) + 1

    def run(batches):
        # (length, rank) in one sortable number: ranks stay below 2**48.
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            row = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            found = [row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * length]
            kept = [batch.column(c) for c in _PIECES.names]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int64()) for x in found)],
                                             names=[*_PIECES.names, "sequence_id", "offset"])

    assert longest < 1 << 15
    return run
