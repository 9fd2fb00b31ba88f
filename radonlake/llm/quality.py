"""Quality classifier (operator 9): ridge regression on random Fourier features of document statistics, with isotonic calibration.

The features approximate a Gaussian kernel. Tasks sum their rows' normal equations, whose size is that of the features;
the driver adds the sums of a fixed number of tasks and solves. Scores are calibrated on counts by bin of the raw score, of labelled
rows that the regression wasn't fitted on.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FEATURES, WIDTH, RIDGE, SEED = 384, 0.6, 1e-3, 7
#: Labelled rows that are fitted at most (by the hash of their ids), tasks that sum them, bins of calibration, and of how many rows one is left to calibration.
MOST_ROWS, TASKS, BINS, ONE_OF = 50_000, 16, 400, 5
THRESHOLD = 0.7
_SETS = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "mark": b"!?", "bar": b"|", "symbol": b"#*$%&<>~^=+\\@_", "stop": b".", "comma": b",;:", "quote": b"\"'()[]{}", "slash": b"/-", "line": b"\n", "odd": bytes(x for x in range(32) if x not in (9, 10, 13)) + b"\x7f"}.items()}
_GROUPS = np.stack([*_SETS.values(), (np.arange(256) >= 97) & (np.arange(256) <= 122), np.arange(256) >= 192, (np.arange(256) >= 128) & (np.arange(256) < 192)]).astype(np.float64)
N_STATS = 24


def statistics(data: bytes) -> np.ndarray:
    """What a whole text is like, in N_STATS numbers; all zero for a text without words."""
    words = data.split()
    n = len(words)
    if not n:
        return np.zeros(N_STATS)
    upper, digit, mark, bar, symbol, stop, comma, quote, slash, line, odd, lower, lead, more = _GROUPS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = max(1.0, len(data) - more)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    threes = max(1, n - 2)
    sizes = np.fromiter(map(len, words), np.int64, n)
    root = np.sqrt
    return np.array([
        np.log1p(n), np.log1p(sizes.mean()), np.log1p(sizes.std()), root((sizes == 1).mean()), root((sizes > 20).mean()), root(upper / max(1.0, upper + lower)), root(digit / chars), root(mark / n), root(bar / n), root(symbol / n), root(stop / n), root(comma / n),
        root(quote / n), root(slash / n), np.log1p(n / len(lines)), root(odd / chars), root(lead / chars), np.log(len(counts)) / np.log(n + 1.0), root(max(counts.values()) / n), root(same / n), root(1 - len(set(zip(words, words[1:], words[2:], strict=False))) / threes) if n > 2 else 0.0, root(1 - len(set(lines)) / len(lines)), np.log1p(len(lines)), root(np.mean([x.isupper() for x in words])),
    ])


def statistics_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats array<float>) of every row."""
    source = common.as_bytes(common.texts(docs, id_col, text_col))

    def run(batches):
        for batch in batches:
            rows = [statistics(x).astype(np.float32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "stats"])

    return common.map_arrow(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, stats array<float>")


def as_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, N_STATS)


class Fourier:
    """cos and sin of random projections; inner products approximate a Gaussian kernel of standardized statistics."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, n: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        self.mean, self.deviation = mean, np.maximum(deviation, 1e-3)
        self.ways = np.random.default_rng(seed).normal(0, 1 / (width * np.sqrt(2 * len(mean))), (len(mean), n // 2))

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        angle = np.clip((stats - self.mean) / self.deviation, -6, 6) @ self.ways
        return np.concatenate((np.cos(angle), np.sin(angle), np.ones((len(angle), 1))), 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to values, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


class Model:
    """Fourier features, their weights, and the calibration from raw scores to chances."""

    def __init__(self, features: Fourier | None, weights: np.ndarray | None, raw: np.ndarray, chance: np.ndarray):
        self.features, self.weights, self.raw, self.chance = features, weights, raw, chance

    def raw_scores(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, -1, 2)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(stats), self.chance[0])
        return np.clip(np.interp(self.raw_scores(stats), self.raw, self.chance), 0, 1)


def to_calibrate() -> Column:
    """The rows that are left to calibration, by the hash of their statistics, so that copies of a text are on one side."""
    return F.pmod(F.xxhash64("stats"), F.lit(ONE_OF)) == 0


def fit(rows: DataFrame) -> Model:
    """rows (stats, y): labelled rows, of a bounded number. Without rows, or with one label alone, every score is that label's share, or 1/2.

    One of ONE_OF rows is left to calibration, the others to the regression; where either part lacks a label, all rows are in both.
    """
    rows = common.cut(rows.withColumn("calibrate", to_calibrate()).repartition(TASKS))
    counts = {(c, y): n for c, y, n in rows.groupBy("calibrate", "y").count().collect()}  # four rows
    n, positive = sum(counts.values()), sum(k for (_, y), k in counts.items() if y > 0.5)
    if not n or positive in (0, n):
        return Model(None, None, np.zeros(1), np.array([positive / n if n else 0.5]))
    if len(counts) == 4:
        rows_fit, rows_scale = rows.where("NOT calibrate"), rows.where("calibrate")
        n, positive = counts[False, 0.0] + counts[False, 1.0], counts[False, 1.0]
    else:
        rows_fit = rows_scale = rows

    def partials(of, what):
        def run(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = what(as_matrix(batch.column(0)), batch.column(1).to_numpy())
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

        parts = common.map_arrow(of.select("stats", "y"), run, "sums binary").collect()  # one from each of TASKS tasks
        return sum(np.frombuffer(x[0]) for x in parts)

    moments = partials(rows_fit, lambda x, _: np.concatenate((x.sum(0), (x * x).sum(0))))
    mean = moments[:N_STATS] / n
    features = Fourier(mean, np.sqrt(np.maximum(0, moments[N_STATS:] / n - mean**2)))
    share = positive / n

    def equations(x, y):
        z = features(x)
        w = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))  # both labels weigh the same
        return np.concatenate(((z * w[:, None]).T @ z, ((z * w[:, None]).T @ y)[:, None]), 1).ravel()

    size = FEATURES // 2 * 2 + 1
    sums = partials(rows_fit, equations).reshape(size, size + 1)
    weights = np.linalg.solve(sums[:, :-1] + RIDGE * n * np.eye(size), sums[:, -1])
    model = Model(features, weights, np.zeros(1), np.zeros(1))

    def histogram(x, y):
        bins = np.clip(((model.raw_scores(x) + 1) / 3 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate((np.bincount(bins, minlength=BINS), np.bincount(bins, y, BINS))).astype(np.float64)

    seen, ones = partials(rows_scale, histogram).reshape(2, BINS)
    there = np.flatnonzero(seen)
    model.raw = (there + 0.5) / BINS * 3 - 1
    model.chance = isotonic(ones[there] / seen[there], seen[there])
    return model


def in_training(doc_id: str = "doc_id"):
    """Rows that labels are learned from: those whose crc32 of the id as text isn't 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(True))


def fit_labelled(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of docs' labels (doc_id, quality 0 or 1).

    Labels of ids that are held out, null or unknown are not used; repeated labels of an id count as their mean, rounded. Of more than most_rows labelled
    ids, those with the least hashes are fitted, about as many; they bound what is sent to all workers, so that texts aren't shuffled.
    """
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(in_training())
    known = known.groupBy("doc_id").agg(F.round(F.avg("y")).alias("y"))
    n = known.count()
    if n > most_rows:
        known = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < int((1 << 20) * most_rows / n))
    chosen = common.texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id")
    return fit(statistics_of(chosen.select(F.col("y").alias("doc_id"), "text")).select("stats", F.col("doc_id").alias("y")))


def score(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; see fit_labelled for labels.

    Statistics of texts are the only input of a score, so that equal texts have equal scores; null texts count as empty. A null doc_id is not held out.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_labelled(docs, labels, most_rows, id_col, text_col))
    source = common.as_bytes(common.texts(docs, id_col, text_col))

    def run(batches):
        for batch in batches:
            stats = np.array([statistics(x) for x in batch.column(1).to_pylist()]).astype(np.float32).astype(np.float64).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(model.value.scores(stats), 9))], ["doc_id", "score"])

    scored = common.map_arrow(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (~in_training()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose texts score at least threshold, with all columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit_labelled(docs, labels, most_rows, id_col, text_col))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            stats = np.array([statistics((x or "").encode()) for x in batch.column(at).to_pylist()]).astype(np.float32).astype(np.float64).reshape(-1, N_STATS)
            yield batch.filter(pa.array(np.round(model.value.scores(stats), 9) >= threshold))

    return common.map_arrow(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
