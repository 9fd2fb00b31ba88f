"""Byte-level BPE (operator 5): a segment tree over the ranks of adjacent pairs picks each merge.

The tree's leaves are the pairs of neighbours, each with the rank of its merge and its place; the root
is the least of them, which is the leftmost pair of the lowest rank. A merge changes three leaves, each in
logarithmic time, until no mergeable pair remains, so that a word of n bytes takes O(n log n).

Texts are cut where the pre-tokenizer cuts in any context (before a single space between other characters),
and a bounded cache of each Python worker holds the ids of the words met.
"""

from __future__ import annotations

import functools
import json
import re
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FILE = "byte_bpe_50k.json"
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space other than the space and the line feed; a text that has some is cut by the pattern alone.
ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CACHE_WORDS, CACHE_CHARS, RENEW = 500_000, 32, 8
NONE = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_all(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The ids that remain of symbols. merges: for a pair its rank and the id it becomes."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = merges.get
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree, made = [NONE] * (2 * size), [0] * n
    for i in range(n - 1):
        if found := get((symbols[i], symbols[i + 1])):
            tree[size + i] = found[0] << 32 | i
            made[i] = found[1]
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before, out = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
    while (top := tree[1]) != NONE:
        i = top & 0xFFFFFFFF
        j = after[i]
        out[i], out[j] = made[i], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        changed = []
        if j < size and tree[size + j] != NONE:
            tree[size + j] = NONE
            changed.append(j)
        for p in (before[i], i):
            if p >= 0 and p < size:
                q = after[p]
                value = NONE
                if q < n and (found := get((out[p], out[q]))):
                    value, made[p] = found[0] << 32 | p, found[1]
                if tree[size + p] != value:
                    tree[size + p] = value
                    changed.append(p)
        for p in changed:
            at = (size + p) >> 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                least = a if a < b else b
                if tree[at] == least:
                    break
                tree[at] = least
                at >>= 1
    return [x for x in out if x >= 0]


class Words(dict):
    """Ids by word. Full, it takes no more words in, until as many as RENEW times its size have been encoded anew; then it starts afresh.

    A stop or comma after a letter or digit is a piece by itself at a word's end, so that the word before it is looked up without it.
    """

    def __init__(self, encode, tails: dict):
        super().__init__()
        self.encode, self.tails, self.missed = encode, tails, 0

    def __missing__(self, word: str):
        tail = self.tails.get(word[-1:])
        ids = self[word[:-1]] + tail if tail is not None and word[-2:-1].isalnum() else self.encode(word)
        if len(self) < CACHE_WORDS:
            if len(word) <= CACHE_CHARS:
                self[word] = ids
        else:
            self.missed += 1
            if self.missed > RENEW * CACHE_WORDS:
                self.missed = 0
                self.clear()
        return ids


class ByteBPE:
    """Encodes and decodes as the tokenizers library does with this file and add_special_tokens=False."""

    def __init__(self, path: str, piece_encoder=None):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        vocab, alphabet = made["model"]["vocab"], byte_alphabet()
        special = {x["content"]: x["id"] for x in made["added_tokens"]}
        by_id = {i: token for token, i in vocab.items()} | {i: token for token, i in special.items()}
        ids = {i: i for i in by_id}  # one object for each id
        self.bytes = [bytes(alphabet[c] for c in by_id[i]) if all(c in alphabet for c in by_id[i]) else by_id[i].encode() for i in range(max(by_id) + 1)]
        self.of_byte = [ids[vocab[c]] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        pairs = (x.split(" ") if isinstance(x, str) else x for x in made["model"]["merges"])
        self.merges = {(ids[vocab[a]], ids[vocab[b]]): (rank, ids[vocab[a + b]]) for rank, (a, b) in enumerate(pairs)}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.piece = piece_encoder or self.by_tree
        tails = {x: (self.of_byte[ord(x)],) for x in ".,"}
        self.line_end = (self.of_byte[ord("\n")],)
        self.line_start = Words(lambda word: tuple(self.by_pieces(word)), tails)
        self.after_space = Words(self.spaced, tails)

    def spaced(self, word: str) -> tuple[int, ...]:
        """Ids of a space and the word, which may hold a line feed."""
        a, _, b = word.partition("\n")
        if a and b and "\n" not in b:
            return self.after_space[a] + self.line_end + self.line_start[b]
        return tuple(self.by_pieces(" " + word))

    def by_tree(self, piece: str) -> list[int]:
        return merge_all([self.of_byte[b] for b in piece.encode("utf-8")], self.merges)

    def by_pieces(self, text: str) -> list[int]:
        found = PIECES.findall(text)
        return self.piece(found[0]) if len(found) == 1 else list(chain.from_iterable(map(self.piece, found)))

    def ordinary(self, text: str) -> list[int]:
        if not text:
            return []
        if "  " in text or " \n" in text or "\n " in text or ODD_SPACE.search(text):
            return list(chain.from_iterable(self.after_space[p[1:]] if p[0] == " " and len(p) > 1 and not p[1].isspace() else self.piece(p) for p in PIECES.findall(text)))
        words = text.split(" ")
        ids = self.by_pieces(words[0]) if words[0] else []
        ids.extend(chain.from_iterable(map(self.after_space.__getitem__, words[1:])))
        return ids

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(x in text for x in self.special):
            return self.ordinary(text)
        ids: list[int] = []
        for part in self.cut.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids.extend(self.ordinary(part))
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(2)
def coder(path: str) -> ByteBPE:
    """One for each Python worker, with its cache."""
    return ByteBPE(path)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ids and the text that they decode to: (doc_id, ids array<int>, decoded string).

    A null text counts as empty and has no ids; an id may be null or repeat, each row is encoded by itself; other
    columns are left out. A text of any length is encoded whole. No shuffle.
    """
    path = path or common.load_tokenizer_path(FILE)

    def run(batches):
        own = coder(path)
        for batch in batches:
            encoded = [own.encode(x) for x in batch.column(1).to_pylist()]
            decoded = [own.decode(x) for x in encoded]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoded, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    source = common.texts(docs, id_col, text_col)
    return common.map_arrow(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(common.documents(spark, sf_dir))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
