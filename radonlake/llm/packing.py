"""Best-fit packing (operator 7) by exact-complement hashing.

Only lengths matter to a packing, so that the plan is made on the histogram of lengths: at most as many counts
as a sequence has places, whatever the corpus. Indexes of single lengths and of the sums of pairs and triples
give combinations that exactly fill the gap beside a length, each taken as often as its lengths are available;
best fit places what remains. Every step uses up a length or a group of open sequences, which bounds the plan's
patterns by a few times the sequence length. Workers then deal pieces, ranked within their length, to the patterns.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

SIZE, END_ID = 2048, 0
#: A run of white space from which the compiled pattern may run out of its stack; such texts are cut into pieces here.
LONG_RUN = 100_000
_LONG = re.compile(r"\s{%d}" % LONG_RUN)
#: Pieces of one length are ranked in this many parts at least, and in one for each so many pieces of the corpus.
PARTS, PART_PIECES, MOST_PARTS = 64, 200_000, 4096


class FastBPE(bpe.ByteBPE):
    """The same ids, from a compiled encoder of the same vocabulary and pattern."""

    def __init__(self, path: str, ranks_path: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        core = tiktoken._tiktoken.CoreBPE(ranks, {}, bpe.PIECES.pattern)
        super().__init__(path, lambda piece: core.encode_single_piece(piece.encode("utf-8")))
        self.whole = tiktoken.Encoding("own", pat_str=bpe.PIECES.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ordinary(self, text: str) -> list[int]:
        return self.by_pieces(text) if len(text) >= LONG_RUN and _LONG.search(text) else self.whole(text)


@functools.lru_cache(2)
def coder(path: str, ranks_path: str) -> FastBPE:
    return FastBPE(path, ranks_path)


class Plan:
    """Patterns of lengths, each with how often it is used. counts[x]: how many pieces have length x."""

    def __init__(self, counts: np.ndarray, size: int):
        self.size, self.left = size, counts.astype(np.int64).copy()
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        there = (self.left > 0).astype(np.int64)
        self.pairs = np.convolve(there, there)[: size + 1]  # by sum: ordered pairs of lengths that are there
        self.take((size,))
        for length in range(size - 1, 0, -1):
            while self.left[length] > 0 and (rest := self.complement(length)):
                self.take((length, *rest))
        self.best_fit()

    def take(self, lengths: tuple[int, ...]) -> None:
        """Uses a combination as often as its lengths are available."""
        each = {x: lengths.count(x) for x in lengths}
        n = min(int(self.left[x]) // k for x, k in each.items())
        if n:
            self.patterns.append((lengths, n))
            for x, k in each.items():
                self.left[x] -= n * k
                if not self.left[x]:
                    there = self.left[: self.size + 1 - x] > 0
                    self.pairs[x : self.size + 1] -= 2 * there
                    if 2 * x <= self.size:
                        self.pairs[2 * x] -= 1

    def complement(self, length: int) -> tuple[int, ...] | None:
        gap = self.size - length
        self.left[length] -= 1
        try:
            if self.left[gap] > 0:
                return (gap,)
            if pair := self.pair(gap, gap - 1):
                return pair
            first = np.arange(gap - 2, 0, -1)
            for a in first[(self.left[first] > 0) & (self.pairs[gap - first] > 0)].tolist():
                self.left[a] -= 1
                pair = self.pair(gap - a, a)
                self.left[a] += 1
                if pair:
                    return (a, *pair)
            return None
        finally:
            self.left[length] += 1

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two available lengths with this sum, the larger one as large as can be, but no larger than most."""
        if total < 2 or self.pairs[total] <= 0:
            return None
        a = np.arange(min(total - 1, most), (total + 1) // 2 - 1, -1)
        if not a.size:
            return None
        fits = (self.left[a] > 0) & (self.left[total - a] > 0) & ((2 * a != total) | (self.left[a] > 1))
        k = int(fits.argmax())
        return (int(a[k]), total - int(a[k])) if fits[k] else None

    def best_fit(self) -> None:
        """What no combination fills goes, longest first, to the open sequences with the least room that is enough."""
        opened: list[list[list]] = [[] for _ in range(self.size + 1)]
        for length in range(self.size, 0, -1):
            n, self.left[length] = int(self.left[length]), 0
            room = length
            while n and room <= self.size:
                if not opened[room]:
                    room += 1
                    continue
                group = opened[room][-1]
                k = min(n, group[1])
                opened[room - length].append([(*group[0], length), k])
                n, group[1] = n - k, group[1] - k
                if not group[1]:
                    opened[room].remove(group)
            each = self.size // length
            for fill, k in ((each, n // each), (n % each, 1)) if n else ():
                if fill and k:
                    opened[self.size - fill * length].append([(length,) * fill, k])
        self.patterns += [(tuple(x), k) for groups in opened for x, k in groups]

    def places(self) -> np.ndarray:
        """Rows (length, first rank, first sequence, offset), sorted: the rank r of a length from there goes to the sequence as far from the first."""
        rows, rank, sequence = [], [0] * (self.size + 1), 0
        for lengths, n in self.patterns:
            offset = 0
            for x in lengths:
                rows.append((x, rank[x], sequence, offset))
                rank[x] += n
                offset += x
            sequence += n
        return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, path: str | None = None, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part): each document's ids and end id in pieces of at most size.

    Only the first piece may be shorter. part is the row's number in its task, to deal rows out by.
    """
    path = path or common.load_tokenizer_path(bpe.FILE)
    ranks_path = ranks_path or common.load_tokenizer_path(bpe.FILE.replace(".json", ".tiktoken"))

    def run(batches):
        own, n = coder(path, ranks_path), 0
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*own.encode(text), end_id], "<u4")
                start, k, stop = 0, 0, len(ids) % size or size
                while start < len(ids):
                    rows.append((doc, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), n))
                    start, stop, k, n = stop, stop + size, k + 1, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part"])

    source = common.texts(docs, id_col, text_col)
    return common.map_arrow(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part long")


def pack(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, part); each sequence is gapless from 0.

    Ties and repeated rows are pieces like any others. An empty table has no sequences. The pieces are written to the
    shared folder; the driver gets their histogram of at most size rows. The rank of a piece within its length
    comes from its rank in a part of the length and the counts of the parts before it, so that a length that
    many documents share is no single group.
    """
    rows = common.cut(cut_pieces)
    counts = rows.groupBy("length").count().collect()  # at most size rows
    total = sum(x["count"] for x in counts)
    n_parts = min(MOST_PARTS, max(PARTS, total // PART_PIECES))
    histogram = np.zeros(size + 1, np.int64)
    for x in counts:
        histogram[x["length"]] = x["count"]
    places = Plan(histogram, size).places()
    keys = places[:, 0] << 44 | places[:, 1]

    parted = rows.withColumn("part", F.pmod(F.col("part"), F.lit(n_parts)))
    sums = parted.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = parted.withColumn("rank", rank).join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base") - 1)

    def deal(batches):
        for batch in batches:
            length, at = (batch.column(k).to_numpy() for k in ("length", "rank"))
            k = np.searchsorted(keys, length << 44 | at, "right") - 1
            named = {x: batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(named | {"sequence_id": places[k, 2] + at - places[k, 1], "offset": places[k, 3]})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return common.map_arrow(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), deal, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, **tokenizer) -> DataFrame:
    """Packs whole documents; see pieces and pack. A null text counts as empty: its end id is its only token."""
    return pack(pieces(docs, size, end_id, **tokenizer), size)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir))
