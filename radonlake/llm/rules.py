"""Quality rules (operator 6): fixed rules on counts, then robust multivariate outliers, without Python on the data's path.

Each language and source has a minimum-covariance-determinant estimate of location and scatter: from each of four starts, concentration
steps take the KEEP share of rows nearest to the estimate and estimate anew from those, until the determinant no longer falls, and the
estimate of the least determinant stays. A row is an outlier by its Mahalanobis distance. The scatter is regularized: the squares of
least deviations are added to its diagonal, with which steps still can't raise the determinant. Quantiles are exact ones of values on a grid, so that
their maps are bounded and sums can be made before the shuffle, also where one source has most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
MIN_WORDS, MOST_REPEATED = 50, 50
KEEP, STEPS = 0.75, 3
#: A step counts as one that lowers the determinant if its logarithm falls by more; steps of the slowest group at most (some 10 are usual).
LESS, MOST_STEPS = 1e-4, 60
#: Deviation of each statistic whose square is added to its scatter: a group whose rows are all alike rejects nothing near them, but each
#: statistic by itself inside its range: beyond some 0.1 symbols a word, 29% duplicate lines, 20% repeated words, or words 1.5 times as long or short.
FLOOR = {"symbols": 0.07, "lines": 0.12, "repeats": 0.045, "size": 0.09}
#: Squared distance beyond which a row is an outlier; rows below which a group takes the whole table's estimate.
CUTOFF, LEAST_ROWS = 20.0, 40
#: What a median absolute deviation of normal rows is multiplied by, and the share of its scatter that their nearest KEEP have in four dimensions.
NORMAL_MAD, TRIMMED = 1.4826, 0.617
#: Groups whose estimates (some 300 bytes each) are sent to all executors; parts of a group beyond that.
MOST_SENT, SALTS = 20_000, 32
#: Files of a table of estimates, a row for each group.
FILES = 8
STATS = tuple(FLOOR)


def word_counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep and the counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (those with a word).

    Windows of three words are compared by 64-bit hashes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.trim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    d = docs.select(*keep, text.alias("text"), words.alias("words"), lines.alias("lines"))
    window = lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))
    n = F.size("words")
    d = d.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n > 2, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))).alias("windows"),
    )
    d = d.withColumn("again", F.filter("windows", lambda x, k: F.coalesce(F.get("windows", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("windows", k + 1)["h"] == x["h"], F.lit(False)))).drop("windows")
    places = F.sort_array(F.transform("again", lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(places, start, lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n")), lambda acc: acc["n"])
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(F.when(F.size("again") > 0, covered), F.lit(0)).cast("long").alias("n_repeat_words"))


def transformed() -> list[Column]:
    """The statistics whose outliers count: square roots of shares and a logarithm, so that the usual range is even."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.sqrt(F.least(F.col("n_symbols") / n, F.lit(9.0))).alias("symbols"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("lines"),
        (F.col("n_repeat_words") / n).alias("repeats"),
        F.log(F.greatest(F.col("word_chars") / n, F.lit(0.5))).alias("size"),
    ]


def distance(estimate: str) -> Column:
    """Squared Mahalanobis distance by the estimate's location m_* and the inverse v_*_* of its scatter's Cholesky factor."""
    off = [F.col(c) - F.col(f"{estimate}.m_{i}") for i, c in enumerate(STATS)]
    ys = [sum((F.col(f"{estimate}.v_{i}_{j}") * off[j] for j in range(1, i + 1)), F.col(f"{estimate}.v_{i}_0") * off[0]) for i in range(len(STATS))]
    return F.round(sum((y * y for y in ys[1:]), ys[0] * ys[0]), 6)


def _factors(estimates: DataFrame, scatter, keys: tuple[str, ...] = ("g",)) -> DataFrame:
    """(keys, e): estimates as a struct of n, m_*, v_*_* and logdet, the logarithm of the scatter's determinant. scatter(i, j): the scatter's entry, to which the floor is added."""
    d, n = estimates, len(STATS)
    for i in range(n):
        for j in range(i + 1):
            rest = scatter(i, j) + (FLOOR[STATS[i]] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            d = d.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    for j in range(n):
        d = d.withColumn(f"v_{j}_{j}", 1 / F.col(f"l_{j}_{j}"))
        for i in range(j + 1, n):
            d = d.withColumn(f"v_{i}_{j}", -sum((F.col(f"l_{i}_{k}") * F.col(f"v_{k}_{j}") for k in range(j + 1, i)), F.col(f"l_{i}_{j}") * F.col(f"v_{j}_{j}")) / F.col(f"l_{i}_{i}"))
    logdet = F.round(2 * sum((F.log(f"l_{i}_{i}") for i in range(1, n)), F.log("l_0_0")), 9)
    return d.select(*keys, F.struct("n", *(f"m_{i}" for i in range(n)), *(f"v_{i}_{j}" for i in range(n) for j in range(i + 1)), logdet.alias("logdet")).alias("e"))


def by_group(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with their groups' estimates: sent to all executors while there are few, else met in SALTS parts of each group."""
    if estimates.count() <= MOST_SENT:
        return rows.join(F.broadcast(estimates), "g", how)
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    return salted.join(estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), ["g", "salt"], how).drop("salt")


def moments(rows: DataFrame, keys: tuple[str, ...], *more: Column) -> DataFrame:
    """Means m_* and covariances c_*_* of the statistics by keys, and more aggregates."""
    n = len(STATS)
    return rows.groupBy(*keys).agg(*more, *(F.avg(c).alias(f"m_{i}") for i, c in enumerate(STATS)), *(F.covar_pop(STATS[i], STATS[j]).alias(f"c_{i}_{j}") for i in range(n) for j in range(i + 1)))


def concentrate(rows: DataFrame, now: DataFrame, keep: float, keys: tuple[str, ...]) -> DataFrame:
    """(keys, e): one concentration step from the estimates now (keys, e): moments of the keep share of rows nearest to each."""
    far = by_group(rows, now).select(*keys, "e", *STATS, F.least(F.round(distance("e"), 2), F.lit(1000.0)).alias("far"))
    cut = far.groupBy(*keys).agg(F.percentile("far", F.lit(keep)).alias("cut"))
    inner = by_group(rows, common.cut(now.join(cut, list(keys)), FILES)).where(F.round(distance("e"), 2) <= F.col("cut"))
    return common.cut(_factors(moments(inner, keys, F.max("e.n").alias("n")), lambda i, j: F.col(f"c_{i}_{j}") / TRIMMED, keys), FILES)


def middles(rows: DataFrame) -> DataFrame:
    """(g, n, m_*, d_*): medians and median absolute deviations of each group's statistics."""
    grid = [F.round(c, 3).alias(c) for c in STATS]
    middle = rows.select("g", *grid).groupBy("g").agg(F.count("*").alias("n"), *(F.percentile(c, F.lit(0.5)).alias(f"m_{i}") for i, c in enumerate(STATS)))
    middle = common.cut(middle, FILES)
    spread = by_group(rows, middle).groupBy("g").agg(*(F.percentile(F.round(F.abs(F.col(c) - F.col(f"m_{i}")), 3), F.lit(0.5)).alias(f"d_{i}") for i, c in enumerate(STATS)))
    return common.cut(middle.join(spread, "g"), FILES)


def _from_middles(middle: DataFrame) -> DataFrame:
    return _factors(middle, lambda i, j: (NORMAL_MAD * F.col(f"d_{i}")) ** 2 if i == j else F.lit(0.0))


def estimate(rows: DataFrame, steps: int = STEPS, keep: float = KEEP) -> DataFrame:
    """(g, e): location and scatter of each group g of rows (g and the statistics), by so many concentration steps from medians and median deviations."""
    now = common.cut(_from_middles(middles(rows)), FILES)
    for _ in range(steps):
        now = concentrate(rows, now, keep, ("g",))
    return now


def starts(rows: DataFrame) -> DataFrame:
    """(g, s, e): each group's starts. 0: medians and median deviations. 1: means and covariances of all rows. 2 and 3 are around the medians, by rows in units
    of median deviations: covariances of their directions alone, and correlations of their hyperbolic tangents."""
    middle, n = middles(rows), len(STATS)
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    unit = [F.greatest(NORMAL_MAD * F.col(f"d_{i}"), F.lit(FLOOR[c])) for i, c in enumerate(STATS)]
    d = by_group(rows, middle).select("g", "n", *(f"m_{i}" for i in range(n)), *(x.alias(f"u_{i}") for i, x in enumerate(unit)), *((F.col(c) - F.col(f"m_{i}")).alias(f"o_{i}") for i, c in enumerate(STATS)))
    d = d.select("*", *((F.col(f"o_{i}") / F.col(f"u_{i}")).alias(f"z_{i}") for i in range(n)))
    length = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, n)), F.col("z_0") * F.col("z_0"))
    z = lambda i: F.col(f"z_{i}")
    sums = d.groupBy("g").agg(
        F.max("n").alias("n"),
        *(F.max(f"{x}_{i}").alias(f"{x}_{i}") for x in "mu" for i in range(n)),
        *(F.avg(f"o_{i}").alias(f"a_{i}") for i in range(n)),
        *(F.covar_pop(f"o_{i}", f"o_{j}").alias(f"c_{i}_{j}") for i, j in pairs),
        *(F.avg(F.when(length > 0, z(i) * z(j) / length).otherwise(0.0)).alias(f"w_{i}_{j}") for i, j in pairs),
        *(F.covar_pop(F.tanh(z(i)), F.tanh(z(j))).alias(f"t_{i}_{j}") for i, j in pairs),
    )
    sums = common.cut(sums, FILES)
    own = lambda i: F.col(f"u_{i}")
    correlation = lambda i, j: F.lit(1.0) if i == j else F.coalesce(F.col(f"t_{i}_{j}") / F.sqrt(F.nullif(F.col(f"t_{i}_{i}") * F.col(f"t_{j}_{j}"), F.lit(0.0))), F.lit(0.0))
    mean = sums.select("g", "n", *((F.col(f"m_{i}") + F.col(f"a_{i}")).alias(f"m_{i}") for i in range(n)), *(f"c_{i}_{j}" for i, j in pairs))
    made = [
        _from_middles(middle),
        _factors(mean, lambda i, j: F.col(f"c_{i}_{j}")),
        _factors(sums, lambda i, j: n * F.col(f"w_{i}_{j}") * own(i) * own(j)),
        _factors(sums, lambda i, j: correlation(i, j) * own(i) * own(j)),
    ]
    out = None
    for s, one in enumerate(made):
        one = one.select("g", F.lit(s).alias("s"), "e")
        out = one if out is None else out.unionByName(one)
    return common.cut(out, FILES)


def least_determinant(rows: DataFrame, keep: float = KEEP) -> DataFrame:
    """(g, s, e): of each group's starts, the estimate of the least determinant that concentration steps reach; s is its start, the first among equals.

    Every start goes on until a step doesn't lower its determinant; starts that are done take no part in further steps. The driver gets one count a step.
    """
    keys = ("g", "s")
    now = concentrate(rows, starts(rows), keep, keys)
    done = None
    for _ in range(MOST_STEPS):
        new = concentrate(rows, now, keep, keys)
        both = now.join(new.withColumnRenamed("e", "x"), list(keys))
        lower = F.col("x.logdet") < F.col("e.logdet") - LESS
        still = both.where(~lower).select(*keys, "e")
        done = still if done is None else done.unionByName(still)
        now = both.where(lower).select(*keys, F.col("x").alias("e"))
        if now.isEmpty():
            break
    else:
        done = done.unionByName(now)
    return common.cut(done.groupBy("g").agg(F.min_by(F.struct("s", "e"), F.struct(F.round("e.logdet", 3), "s")).alias("x")).select("g", "x.s", "x.e"), FILES)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept) of every row.

    base_failed: fewer than MIN_WORDS words, or over half of them in repeated windows of three. Others are kept within the
    cutoff of their group's estimate; rows that base rules fail don't count in estimates. Null languages and sources are groups of their own; a small group
    takes the whole table's estimate, and a table without one of these columns counts as null in it. A null or empty text has no words and fails. The counts are written to the shared folder.
    """
    own = lambda c: F.col(f"`{c}`") if c in docs.columns else F.lit(None).cast("string")
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.to_json(F.struct(own(lang_col).alias("l"), own(source_col).alias("s"))).alias("g"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    d = common.cut(word_counts(d, ("doc_id", "g")).withColumn("base_failed", failed).select("*", *transformed()))
    rows = d.where("NOT base_failed").select(F.explode(F.array(F.col("g"), F.lit("all"))).alias("g"), *STATS)
    found = least_determinant(rows)
    few = found.where((F.col("e.n") >= LEAST_ROWS) & (F.col("g") != "all")).select("g", "e")
    whole = found.where("g = 'all'").select(F.col("e").alias("w"))
    joined = by_group(d, common.cut(few, FILES), "left").join(F.broadcast(whole), F.lit(True), "left")  # one row
    far = F.coalesce(distance("e"), distance("w"), F.lit(0.0))
    return joined.withColumn("distance", far).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir)).drop("distance")
