"""SimHash near-duplicates (operator 2) with a hierarchical index over fingerprints in Gray order.

Fingerprints that differ in at most t bits agree in one of t + 1 blocks of bits. Each block's masked pattern is
an upper node; below it the node's fingerprints are sorted by Gray rank, runs of them share the bits in which all
agree, and a parent takes over what its children share. A search adds up the differences in each node's own bits and
leaves out the whole group once they exceed t. Nodes with too many fingerprints are dealt out again by the blocks of their
remaining bits, until they are small enough, so that no task gets an unbounded group. Tasks join what they link and
emit one link for each fingerprint, to the first of its local group, which is enough for components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

BITS, MOST_DIFFERENT, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints below one upper node before it is dealt out again; of a leaf; children of an inner node; fingerprints searched for at once.
NODE, LEAF, FANOUT, BLOCK = 1 << 15, 16, 8, 256
#: Fingerprints of complete nodes that a task holds before it compares them.
AT_ONCE = 1 << 17
#: Groups up to this size are compared directly.
SMALL = 48
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits by majority over the XXH64 of word shingles; a text without words has none set."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(x, seed) for x in shingles]), np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, h): the fingerprint of every whole text as a signed 64-bit number, and a hash of the text. Null texts count as empty."""
    source = common.as_bytes(common.texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text")))

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], ["doc_id", "fp", "h"])

    return common.map_arrow(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long, h long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where each number stands in Gray order, in which neighbours differ in one bit."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def refine(mask: int, most: int = MOST_DIFFERENT) -> list[int]:
    """The masks that add to mask each of most + 1 blocks of the bits it lacks."""
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    cuts = [len(free) * k // (most + 1) for k in range(most + 2)]
    return [mask | sum(free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Groups:
    """Labels of what is linked so far: the least index of each group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (shorter := self.label[self.label]).tolist() != self.label.tolist() if len(self.label) < 64 else not np.array_equal(shorter := self.label[self.label], self.label):
                self.label = shorter


class GrayIndex:
    """Hierarchical index over fingerprints sorted by Gray rank."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        starts = np.arange(0, len(fps), LEAF)
        first = fps[starts]
        differ = np.bitwise_or.reduceat(fps ^ np.repeat(first, np.diff(starts, append=len(fps))), starts)
        levels = [(~differ, first & ~differ, starts)]
        while len(levels[-1][0]) > FANOUT:
            mask, pattern, begin = levels[-1]
            at = np.arange(0, len(mask), FANOUT)
            top = pattern[at]
            differ = np.bitwise_or.reduceat((pattern ^ np.repeat(top, np.diff(at, append=len(mask)))) | ~mask, at)
            levels.append((~differ, top & ~differ, begin[at]))
        self.levels = levels[::-1]
        own = [self.levels[0][0]]  # the bits that a node shares and its parent doesn't
        for above, (mask, _, _) in zip(self.levels, self.levels[1:], strict=False):
            own.append(mask & ~np.repeat(above[0], FANOUT)[: len(mask)])
        self.own = own

    def one_group(self, label: np.ndarray) -> list[np.ndarray]:
        """For each node the group that all below it are in, else -1."""
        out = []
        for _, _, begin in self.levels:
            low, high = np.minimum.reduceat(label, begin), np.maximum.reduceat(label, begin)
            out.append(np.where(low == high, low, -1))
        return out

    def search(self, queries: np.ndarray, most: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query's index, index) of at most most different bits. With label, pairs of one group may be left out."""
        group = None if label is None else self.one_group(label)
        n = len(self.levels[0][0])
        at, node, far = np.repeat(queries, n), np.tile(np.arange(n), len(queries)), np.zeros(n * len(queries), np.uint8)
        for k, (_, pattern, _) in enumerate(self.levels):
            if k:
                wide = len(pattern)
                at, far = np.repeat(at, FANOUT), np.repeat(far, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                there = node < wide
                at, node, far = at[there], node[there], far[there]
            far = far + np.bitwise_count((self.fps[at] ^ pattern[node]) & self.own[k][node])
            near = far <= most
            if group is not None:
                near &= group[k][node] != label[at]
            at, node, far = at[near], node[near], far[near]
        at, member = np.repeat(at, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
        there = member < len(self.fps)
        at, member = at[there], member[there]
        near = np.bitwise_count(self.fps[at] ^ self.fps[member]) <= most
        return at[near], member[near]


def link_groups(node: np.ndarray, fps: np.ndarray, most: int = MOST_DIFFERENT) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, first of its local group). node: number of each fingerprint's upper node, below which it is compared."""
    order = np.lexsort((gray_rank(fps), node))
    node, fps = node[order], fps[order]
    starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
    sizes = np.diff(starts, append=len(node))
    groups = Groups(len(fps))
    small = np.repeat(sizes <= SMALL, sizes)
    for d in range(1, min(SMALL, int(sizes.max(initial=0)))):
        a = np.flatnonzero(small[:-d] & (node[:-d] == node[d:]))
        if not len(a):
            break
        near = np.bitwise_count(fps[a] ^ fps[a + d]) <= most
        groups.link(a[near], a[near] + d)
    for k in np.flatnonzero(sizes > SMALL).tolist():
        at, n = int(starts[k]), int(sizes[k])
        index, own = GrayIndex(fps[at : at + n]), Groups(n)
        for q in range(0, n, BLOCK):
            own.link(*index.search(np.arange(q, min(q + BLOCK, n)), most, own.label))
        groups.label[at : at + n] = own.label + at
    moved = np.flatnonzero(groups.label != np.arange(len(fps)))
    return fps[moved], fps[groups.label[moved]]


def near_links(distinct: DataFrame, most: int = MOST_DIFFERENT) -> DataFrame:
    """(a, b): links whose components are those of all pairs of at most most different bits. distinct: (fp), without repeats."""
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    masks, found, rows = refine(0, most), [], None

    def run(batches):
        """Nodes come one after the other, sorted; those that are complete are compared once there are AT_ONCE fingerprints."""
        held: list[np.ndarray] = []  # mask, value and fp of what isn't compared yet
        size = 0

        def compare(rows: np.ndarray):
            mask, value, fps = rows
            node = np.cumsum(np.concatenate(([True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))))
            a, b = link_groups(node, fps.view(np.uint64), most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy() for k in ("mask", "value", "fp")]))
            size += batch.num_rows
            if size >= AT_ONCE:
                rows = np.concatenate(held, 1)
                new = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))
                done = int(new[-1]) + 1 if len(new) else 0  # where the last node, which may go on, begins
                if done:
                    yield compare(rows[:, :done])
                held = [rows[:, done:]]
                size = rows.shape[1] - done
        if size:
            yield compare(np.concatenate(held, 1))

    def spread(df: DataFrame, by: dict[int, list[int]]) -> DataFrame:
        finer = F.col("finer")
        if len(by) == 1:
            finer = F.array(*(F.lit(signed(x)) for x in next(iter(by.values()))))
        else:
            table = F.create_map(*(x for k, v in by.items() for x in (F.lit(signed(k)), F.array(*(F.lit(signed(y)) for y in v)))))
            finer = table[F.col("mask")]
        return df.select("fp", F.explode(finer).alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")

    rows = spread(distinct, {0: masks})
    while True:
        full = common.cut(rows.groupBy("mask", "value").count().where(F.col("count") > NODE).select("mask", "value"), 8)
        last = BITS - masks[0].bit_count() <= 16
        done = last or full.isEmpty()
        now = rows if done else rows.join(full, ["mask", "value"], "left_anti")
        found.append(common.map_arrow(now.repartition("mask", "value").sortWithinPartitions("mask", "value"), run, "a long, b long"))
        if done:
            break
        finer = {x: refine(x, most) for x in masks}
        rows = spread(rows.join(full, ["mask", "value"]), finer)
        masks = [y for v in finer.values() for y in v]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, most: int = MOST_DIFFERENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, h, component_id, root): every row with the least doc_id that links of at most most different bits reach.

    Null and wordless texts have fingerprint zero and are linked like others. Rows that repeat a doc_id each get a row. A component whose
    doc_ids are all null has a null id; root, one of its fingerprints, names it too. An empty table gives an empty one. Copies meet as one fingerprint before
    the search; a fingerprint that many rows have isn't shuffled to one task.
    """
    each = common.cut(fingerprints(docs, id_col, text_col))
    least = common.cut(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    total, distinct = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    joined = components(near_links(least.select("fp"), most))
    root = common.cut(least.join(joined.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")))
    ids = root.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    by_fp = common.cut(common.join_hot(root, ids, "root", "prints", distinct).select("fp", "component_id", "root", "n"))
    return common.join_hot(each, by_fp, "fp", "n", total).select("doc_id", "fp", "h", "component_id", "root")


def drop_near_duplicates(docs: DataFrame, most: int = MOST_DIFFERENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component of near duplicates: that of the least doc_id, of rows with that one that of the least hash of its text.

    A row without a doc_id stays only if no row of its component has one. All columns stay as they are; an empty table gives an empty one.
    """
    fresh = lambda name: name if name not in docs.columns else fresh(name + "_")
    own, h = fresh("_own"), fresh("_h")
    found = near_duplicates(docs, most, id_col, text_col)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("x")).select(F.col("x.doc_id").alias(own), F.col("x.h").alias(h))
    rows = found.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("x")).agg(F.count("*").alias("n"))
    same = lambda a, b, x, y: a.eqNullSafe(b) & (x == y)
    stay = common.cut(first.join(rows, same(F.col(own), F.col("d"), F.col(h), F.col("x"))).select(own, h, "n"))
    tagged = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))).withColumn(own, F.col(f"`{id_col}`"))
    pick = lambda kept: tagged.alias("t").join(kept.alias("k"), same(F.col(f"t.{own}"), F.col(f"k.{own}"), F.col(f"t.{h}"), F.col(f"k.{h}")), "left_semi")
    out = pick(stay.where("n = 1"))
    repeated = stay.where("n > 1")
    if not repeated.isEmpty():  # the rows of these alone are shuffled to choose one
        out = out.unionByName(pick(repeated).dropDuplicates([own, h]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
