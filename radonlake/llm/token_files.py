"""Token-ID output (operator 4): shards of ids under a Re-Pair grammar, with expansion lengths for random access.

A shard holds the ids of some consecutive documents. Rounds replace the pairs of neighbours that are frequent in the shard by new
symbols until no pair is frequent: in each round every pair that is more frequent than those it overlaps gives way. A pair never spans two
documents, as its left symbol never ends in the end id. The file keeps the rules by round, each symbol's expansion length, the
remaining symbols and, for each document, where its symbols begin, so that any range of ids is decoded by itself.
Shards are rows of a Parquet table, which Spark writes to and reads from any store.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import common
from .bpe import Words, byte_alphabet

FILE, END_ID = "word_bpe_49k.json", 2
#: Ids of a shard, about; how often a pair must be there to give way (6 to 12 give the smallest files: rarer pairs save less than their rules take); size of the table of pairs.
SHARD_IDS, LEAST, TABLE_BITS = 1_000_000, 8, 18
#: Texts with these are encoded whole by the library: special tokens, and separators that Python alone takes for white space.
WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: The file's pattern on lower-case ASCII words.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Stands for a null doc_id, below all others.
NO_ID = -(1 << 63)
MAGIC, HEAD = b"RPG2", "<4sIIIIQQ"


def lower_ascii(text: str) -> str:
    """The text with A-Z lower-cased, which the library does too, so that words meet whatever their case.

    The library composes characters first. All marks that compose with an ASCII character are in U+0300 to U+036F, whose UTF-8 begins with CC or CD; a text
    with such bytes stays as it is.
    """
    if text.isascii():
        return text.lower()
    data = text.encode()
    return text if b"\xcc" in data or b"\xcd" in data else data.lower().decode()


class WordCoder:
    """Ids as little-endian 16-bit numbers, as the tokenizers library gives them.

    The file's normalizer makes white space one space and its pattern drops it, so that a text's ids are those of its words one after the
    other. Words with any character outside ASCII are encoded by the library itself. ASCII words, whose normalization and pieces follow from
    letters, digits and other characters alone, take compiled merges of the same vocabulary: a word's end is one more byte, 255, and merges go by the id
    of what they make, which the file's merges do too (checked: each makes another token, in ascending order of ids). Both ways are compared at start-up
    on every pair of ASCII characters and on what the pattern names; should any differ, all words are left to the library. The ids of words that were met
    are kept.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.base = self.own.get_vocab_size(with_added_tokens=True)
        if self.base > 1 << 16:
            raise ValueError(f"ids of {path} take more than 16 bits")
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        vocab, alphabet, end = made["model"]["vocab"], byte_alphabet(), made["model"].get("end_of_word_suffix") or ""
        merged = [vocab["".join(x.split(" ") if isinstance(x, str) else x)] for x in made["model"]["merges"]]
        special = {x["content"] for x in made["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token.removesuffix(end)) + b"\xff" * token.endswith(end): i for token, i in vocab.items() if token not in special}
        self.bpe = tiktoken._tiktoken.CoreBPE(ranks | {b"\xff": self.base}, {}, r"\S+")
        plain = [chr(x) for x in range(33, 127) if not chr(x).isupper()]
        probes = [a + b for a in plain for b in plain] + [f"{a}{x}{b}" for a in "a1'!" for x in ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "''", "'r") for b in "a1'!"]
        self.merges = bool(end) and merged == sorted(set(merged)) and [self.by_merges(x) for x in probes] == self.by_library(probes)
        self.tails = {x: self.by_library([x])[0] for x in ".,"}
        self.words = Words(self.word, {})

    def word(self, word: str) -> bytes:
        """The ids of a word that isn't known. A stop or comma after an ASCII letter or digit is a piece by itself at its end, so that the word before it is looked up without it."""
        if word[-1] in self.tails and word[-2:-1].isascii() and word[-2:-1].isalnum():
            return self.words[word[:-1]] + self.tails[word[-1]]
        if self.merges and word.isascii():
            return self.by_merges(word)
        return array("H", self.own.encode(word, add_special_tokens=False).ids).tobytes()

    def by_merges(self, word: str) -> bytes:
        word = word.lower()
        if word.isalpha():  # one piece
            return array("H", self.bpe.encode_single_piece(word.encode() + b"\xff")).tobytes()
        ids: list[int] = []
        for piece in PIECES.findall(word):
            ids += self.bpe.encode_single_piece(piece.encode() + b"\xff")
        return array("H", ids).tobytes()

    def by_library(self, words: list[str]) -> list[bytes]:
        return [array("H", x.ids).tobytes() for x in self.own.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        if any(x in text for x in WHOLE):
            return array("H", self.own.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.words.__getitem__, lower_ascii(text).split()))


@functools.lru_cache(2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def every_other(keys: np.ndarray) -> np.ndarray:
    """False where a key is the second, fourth ... of a run of equal ones, which overlap."""
    out = np.ones(len(keys), bool)
    same = np.flatnonzero(keys[1:] == keys[:-1]) + 1
    if len(same):
        first = np.concatenate(([True], np.diff(same) != 1))
        run = np.maximum.accumulate(np.where(first, np.arange(len(same)), 0))
        out[same[(np.arange(len(same)) - run) % 2 == 0]] = False
    return out


def hashed(keys: np.ndarray) -> np.ndarray:
    """A place in a table of 1 << TABLE_BITS for each pair."""
    if keys.dtype == np.uint32:
        return (keys * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


def frequent(seq: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, number of the pair at each, pairs): where pairs stand that are there least times without overlap, pairs as left << 32 | right.

    Numbers ascend with frequency, so that the larger of two numbers is the more frequent pair. Places are found by a table of hashed pairs; of pairs
    that share a place there the most frequent is found, the others in a later round.
    """
    if len(last) <= 1 << 16:  # half as wide, which sorts faster
        keys, shift = seq[:-1] << np.uint32(16) | seq[1:], 16
    else:
        keys, shift = seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:], 32
    place = hashed(keys)
    free = ~last[seq[:-1]] & every_other(keys)
    at = np.flatnonzero(free & (np.bincount(place[free], minlength=1 << TABLE_BITS) >= least)[place])  # all places of frequent pairs, and some others
    here = keys[at]
    ordered = np.sort(here)
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    counts = np.diff(starts, append=len(ordered))
    often = np.flatnonzero(counts >= least)
    pairs = ordered[starts[often[np.argsort(counts[often], kind="stable")]]]
    if not len(pairs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    table = np.full(1 << TABLE_BITS, -1, np.int32)
    np.maximum.at(table, hashed(pairs), np.arange(len(pairs), dtype=np.int32))
    number = table[place[at]]
    there = number >= 0
    at, number, here = at[there], number[there], here[there]
    there = pairs[number] == here
    wide = pairs.astype(np.uint64)
    return at[there], number[there], (wide >> np.uint64(shift)) << np.uint64(32) | wide & np.uint64((1 << shift) - 1)


def apart(at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which of the places are taken, so that none overlap: again and again those whose pair is more frequent than their free neighbours' pairs."""
    taken, free = np.zeros(len(at), bool), np.arange(len(at))
    while len(free):
        a, n = at[free], number[free]
        near = a[1:] == a[:-1] + 1
        wins = ~(np.concatenate(([False], near & (n[1:] < n[:-1]))) | np.concatenate((near & (n[:-1] < n[1:]), [False])))
        taken[free[wins]] = True
        beside = np.concatenate(([False], near & wins[:-1])) | np.concatenate((near & wins[1:], [False]))
        free = free[~(wins | beside)]
    return taken


def repair(ids: np.ndarray, base: int, end_id: int, rounds: int | None = None, least: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The symbols that remain, and for each round the pairs (as left << 32 | right) that its new symbols stand for.

    It ends when no pair is there least times without overlap; rounds: or after so many. The most frequent pair of all gives way at
    each of its places, so that every round makes the sequence shorter.
    """
    least = least or LEAST
    seq, rules, first = ids.astype(np.uint32), [], base
    last = np.zeros(base, bool)  # symbols that end a document
    last[end_id] = True
    while len(seq) > 1 and (rounds is None or len(rules) < rounds):
        at, number, pairs = frequent(seq, last, least)
        if not len(at):
            break
        taken = apart(at, number)
        at, number = at[taken], number[taken]
        used = np.bincount(number, minlength=len(pairs)) >= least
        taken = used[number]
        at, number = at[taken], number[taken]
        seq[at] = (np.cumsum(used) - 1 + first)[number]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(pairs[used])
        last = np.concatenate((last, last[(rules[-1] & np.uint64(0xFFFFFFFF)).astype(np.int64)]))
        first += len(rules[-1])
    return seq, rules


def expand(seq: np.ndarray, rules: list[np.ndarray], base: int) -> np.ndarray:
    """The ids that symbols stand for: each round's symbols give way to their pairs, the last round's first."""
    tops = base + np.cumsum([0, *map(len, rules)])
    for pairs, low in zip(reversed(rules), reversed(tops[:-1].tolist()), strict=True):
        new = seq >= low
        if not new.any():
            continue
        out = np.repeat(seq, 1 + new)
        at = np.flatnonzero(new)
        at += np.arange(len(at))
        pair = pairs[seq[new] - low]
        out[at], out[at + 1] = pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)
        seq = out
    return seq


def lengths(rules: list[np.ndarray], base: int) -> np.ndarray:
    """Expansion length by symbol."""
    each = np.ones(base + sum(map(len, rules)), np.uint32)
    low = base
    for pairs in rules:
        each[low : low + len(pairs)] = each[(pairs >> np.uint64(32)).astype(np.int64)] + each[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        low += len(pairs)
    return each


def to_shard(docs: list[int | None], sizes: list[int], ids: np.ndarray, before: int, base: int, end_id: int) -> bytes:
    """File form of consecutive documents; before: ids of the bucket's documents before them. Symbols take 16 bits if all fit there, else 32."""
    seq, rules = repair(ids, base, end_id)
    each = lengths(rules, base)
    starts = np.concatenate(([0], np.cumsum(sizes))).astype("<u8")
    ends = np.concatenate(([0], np.cumsum(each[seq], dtype=np.uint64)))
    symbols = np.searchsorted(ends, starts).astype("<u8")
    head = struct.pack(HEAD, MAGIC, base, end_id, len(rules), len(docs), len(seq), before)
    null = np.array([x is None for x in docs], "u1")
    narrow = len(each) <= 1 << 16
    halves = [x.astype("<u8").view("<u4").astype("<u2" if narrow else "<u4").tobytes() for x in rules]
    return b"".join((head, np.array([len(x) for x in rules], "<u4").tobytes(), *halves, each[base:].astype("<u4").tobytes(), np.array([x or 0 for x in docs], "<i8").tobytes(), null.tobytes(), starts.tobytes(), symbols.tobytes(), seq.astype("<u2" if narrow else "<u4").tobytes()))


class Shard:
    """A shard's documents, from its file form."""

    def __init__(self, data: bytes):
        magic, self.base, self.end_id, n_rounds, n_docs, n_symbols, self.before = struct.unpack(HEAD, data[: struct.calcsize(HEAD)])
        if magic != MAGIC:
            raise ValueError("this is no shard of token ids")
        at = struct.calcsize(HEAD)

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        sizes = read("<u4", n_rounds)
        kind = "<u2" if self.base + int(sizes.sum()) <= 1 << 16 else "<u4"
        self.rules = [read(kind, 2 * int(n)).astype("<u4").view("<u8") for n in sizes]
        self.expansions = read("<u4", int(sizes.sum()))
        docs, null = read("<i8", n_docs), read("u1", n_docs)
        self.docs = [None if empty else int(x) for x, empty in zip(docs, null, strict=True)]
        self.starts, self.symbols = read("<u8", n_docs + 1), read("<u8", n_docs + 1)
        self.seq = read(kind, n_symbols)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document alone."""
        return expand(self.seq[int(self.symbols[k]) : int(self.symbols[k + 1])].astype(np.uint32), self.rules, self.base)

    def all_ids(self) -> np.ndarray:
        return expand(self.seq.astype(np.uint32), self.rules, self.base)

    @functools.cached_property
    def pairs(self) -> np.ndarray:
        return np.concatenate(self.rules) if self.rules else np.zeros(0, np.uint64)

    def length(self, symbol: int) -> int:
        return 1 if symbol < self.base else int(self.expansions[symbol - self.base])

    def part(self, symbol: int, skip: int, take: int) -> Iterator[int]:
        """The ids of a symbol from skip on, take of them at most; what lies outside isn't expanded, by the expansion lengths."""
        todo = [symbol]
        while todo and take > 0:
            x = todo.pop()
            if skip >= (n := self.length(x)):
                skip -= n
            elif x < self.base:
                take -= 1
                yield x
            else:
                pair = int(self.pairs[x - self.base])
                todo += (pair & 0xFFFFFFFF, pair >> 32)

    def slice(self, i: int, j: int) -> np.ndarray:
        """The ids from place i up to place j of the shard, of which only the symbols that cover them are expanded."""
        i, j = max(0, i), min(j, int(self.starts[-1]))
        if i >= j:
            return np.zeros(0, np.uint32)
        first, last = int(np.searchsorted(self.starts, i, "right")) - 1, int(np.searchsorted(self.starts, j, "left"))
        low = int(self.symbols[first])
        near = self.seq[low : int(self.symbols[last])].astype(np.int64)
        each = np.ones(len(near), np.int64)
        new = near >= self.base
        each[new] = self.expansions[near[new] - self.base]
        ends = int(self.starts[first]) + np.cumsum(each)
        a, b = int(np.searchsorted(ends, i, "right")), int(np.searchsorted(ends, j, "left"))
        begins = ends - each
        if a == b:
            return np.fromiter(self.part(int(near[a]), i - int(begins[a]), j - i), np.uint32, j - i)
        head = np.fromiter(self.part(int(near[a]), i - int(begins[a]), int(each[a])), np.uint32)
        tail = np.fromiter(self.part(int(near[b]), 0, j - int(begins[b])), np.uint32)
        return np.concatenate((head, expand(near[a + 1 : b].astype(np.uint32), self.rules, self.base), tail))


def write(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all documents, each with end_id after it, in ascending order of doc_id, as a Parquet table of shards at out.

    Rows: bucket, a range of doc_ids; seq, the shard's number there; n_ids; payload. A null text is empty; a null doc_id comes first; rows
    with one doc_id follow each other in any order. Ids are shuffled once, as 16-bit numbers, to ranges found from doc_id alone; a doc_id (or
    null) that fills several ranges is dealt to them by text. doc_id must be of an integer type, else this raises.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} gives the order of the files and must be an integer")
    path = path or common.load_tokenizer_path(FILE)
    spark = docs.sparkSession
    source = common.texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = source.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")).approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n)
    bounds = np.sort(np.array(found, np.float64))

    def encode(batches):
        own = coder(path)
        end = struct.pack("<H", end_id)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            place = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.float64)
            low, bucket = np.searchsorted(bounds, place, "left"), np.searchsorted(bounds, place, "right")
            for k in np.flatnonzero(bucket - low > 1).tolist():
                bucket[k] = low[k] + 1 + zlib.crc32(texts[k].encode()) % int(bucket[k] - low[k])
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), ids, pa.array([own.encode(x) + end for x in texts], pa.binary())], ["bucket", "doc_id", "ids"])

    def shards(batches):
        base = coder(path).base
        held: list[tuple[int | None, bytes]] = []
        bucket, seq, before, size = None, 0, 0, 0

        def flush():
            nonlocal held, seq, before, size
            ids = np.frombuffer(b"".join(x for _, x in held), "<u2")
            payload = to_shard([x for x, _ in held], [len(x) // 2 for _, x in held], ids, before, base, end_id)
            row = pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], ["bucket", "seq", "n_ids", "payload"])
            held, seq, before, size = [], seq + 1, before + len(ids), 0
            return row

        for batch in batches:
            for b, doc, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (b != bucket or size >= shard_ids):
                    yield flush()
                if b != bucket:
                    bucket, seq, before = b, 0, 0
                held.append((doc, ids))
                size += len(ids) // 2
        if held:
            yield flush()

    coded = common.map_arrow(source, encode, "bucket int, doc_id long, ids binary")
    dealt = coded.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first())
    common.map_arrow(dealt, shards, "bucket int, seq int, n_ids long, payload binary").write.option("compression", "zstd").parquet(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary as little-endian 32-bit numbers) of the files that write() made.

    The driver gets one count for each bucket, of which there are as many as shuffle partitions at most.
    """
    table = spark.read.parquet(path)
    sums, base = dict(table.groupBy("bucket").agg(F.sum("n_ids")).collect()), {}
    at = 0
    for bucket in sorted(sums):
        base[bucket], at = at, at + sums[bucket]

    def decode(batches):
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(payload.as_py())
                ids, starts = shard.all_ids().astype("<u4").tobytes(), shard.starts.astype(np.int64)
                offsets = (starts * 4).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(shard.docs, pa.int64()), pa.array(starts[:-1] + (base[bucket] + shard.before)), pa.array(np.diff(starts)), pa.array([ids[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return common.map_arrow(table.select("bucket", "payload"), decode, "doc_id long, start long, n_tokens long, ids binary")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{common.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(common.documents(spark, sf_dir), out)
    return read(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
