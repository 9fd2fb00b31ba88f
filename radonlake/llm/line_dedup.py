"""Line dedup (operator 10): two Bloom filters, for hashes seen once and twice, then exact counts of the suspects.

Tasks send each segment of the filters the bits that their keys set, once or more often; a segment's merge keeps two
bitmaps, and a bit that two tasks set once, or one task twice, is set in the second. Its size is fixed beforehand (at most MOST_BITS).
Keys with all their bits there may be repeated; only those are shuffled, whole and counted by task, for the exact count and
the first occurrence. Keys found often enough go to all workers as 128-bit digests while there are few; else the suspect lines
are joined with them and the drops with the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHARS, MIN_DOCS = 1, 10
HASHES, BITS_A_LINE, LEAST_BITS, MOST_BITS, SEGMENT_BITS = 2, 16, 1 << 20, 1 << 28, 1 << 19
#: Digests sent to all workers at most (48 bytes each), and keys a task counts before it passes them on.
MOST_SENT, HELD = 1_000_000, 300_000
#: Bytes of a usual line, by which the number of lines is told from the texts' length where it only sets what counts as a hot key.
MEAN_LINE, COUNTS = 60, ("n_lines", "n_dropped")


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [x.strip() for x in text.lower().split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars) and bool(key)


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, a row for each. bits is a power of two, up to 2**32."""
    mask = np.uint64(bits - 1)
    return np.stack([(hashes >> np.uint64(32 * k)) & mask for k in range(HASHES)], 1)


def suspects_filter(docs: DataFrame, min_chars: int = MIN_CHARS) -> np.ndarray:
    """The filter of hashes that at least two documents have, or may have, as a bitmap of at most MOST_BITS bits."""
    rows = docs.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = 1 << (min(MOST_BITS, max(LEAST_BITS, BITS_A_LINE * rows)) - 1).bit_length()
    source = common.as_bytes(docs).select("text")

    def scatter(batches):
        digest = xxhash.xxh3_64_intdigest
        held: list[np.ndarray] = []

        def flush():
            nonlocal held
            hashes, counts = np.unique(np.concatenate(held), return_counts=True)
            held = []
            at = places(hashes, bits).ravel()
            again = np.repeat(counts > 1, HASHES)
            at, often = np.unique(at << np.uint64(1) | again, return_counts=True)
            bit, twice = at >> np.uint64(1), (at & np.uint64(1) == 1) | (often > 1)
            segment = (bit // SEGMENT_BITS).astype(np.int32)
            edges = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1], [True])))
            inner = (bit % SEGMENT_BITS).astype("<u4")
            out = [(int(segment[a]), inner[a:b].tobytes(), inner[a:b][twice[a:b]].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["segment", "once", "twice"])

        n = 0
        for batch in batches:
            found = [digest(k) for text in batch.column(0).to_pylist() for k in set(line_keys(text)) if long_enough(k, min_chars)]
            held.append(np.array(found, np.uint64))
            n += len(found)
            if n >= 8 * HELD:
                yield flush()
                n = 0
        if n:
            yield flush()

    def merge(batches):
        segment, once, twice = None, None, None
        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != segment:
                    if segment is not None:
                        yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "bits": [np.packbits(twice).tobytes()]})
                    segment, once, twice = s, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                a, b = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                twice[a[once[a]]] = True
                twice[b] = True
                once[a] = True
        if segment is not None:
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "bits": [np.packbits(twice).tobytes()]})

    sent = common.map_arrow(source, scatter, "segment int, once binary, twice binary")
    merged = common.map_arrow(sent.repartition("segment").sortWithinPartitions("segment"), merge, "segment int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for segment, part in merged.collect():  # bits / 8 bytes in all
        out[segment * (SEGMENT_BITS // 8) :][: len(part)] = np.frombuffer(part, np.uint8)
    return out


def is_set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = places(hashes, len(bitmap) * 8)
    return ((bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1).all(1)


def repeated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(digest, first_doc, first_line, n): keys of at least min_chars code points in at least min_docs rows, and in how many. docs: (doc_id, text)."""
    bitmap = docs.sparkSession.sparkContext.broadcast(suspects_filter(docs, min_chars))

    def count(batches):
        digest, kind = xxhash.xxh3_64_intdigest, None
        held: dict[bytes, list] = {}

        def flush():
            nonlocal held
            rows, held = held, {}
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array([x[0] for x in rows.values()], pa.int64()), pa.array([x[1] for x in rows.values()], kind), pa.array([x[2] for x in rows.values()], pa.int64())], ["key", "n", "first_doc", "first_line"])

        for batch in batches:
            kind = batch.schema.types[0]
            keys, owner, line = [], [], []
            docs_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for d, text in enumerate(texts):
                for n, k in enumerate(line_keys(text)):
                    if long_enough(k, min_chars):
                        keys.append(k)
                        owner.append(d)
                        line.append(n)
            if not keys:
                continue
            here, last = bitmap.value, {}
            for k in np.flatnonzero(is_set(here, np.array(list(map(digest, keys)), np.uint64))).tolist():
                key, d = keys[k], owner[k]
                if last.get(key) == d:
                    continue
                last[key] = d
                if (x := held.get(key)) is None:
                    held[key] = [1, docs_[d], line[k]]
                else:
                    x[0] += 1
                    if docs_[d] is not None and (x[1] is None or docs_[d] < x[1]):
                        x[1:] = docs_[d], line[k]
            if len(held) >= HELD:
                yield flush()
        if held:
            yield flush()

    source = common.as_bytes(docs)
    kind = source.schema["doc_id"].dataType.simpleString()
    counted = common.map_arrow(source, count, f"key binary, n long, first_doc {kind}, first_line long")
    often = counted.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.when(F.col("first_doc").isNotNull(), F.struct("first_doc", "first_line"))).alias("first")).where(F.col("n") >= min_docs)

    def digests(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(k) for k in batch.column(0).to_pylist()], pa.binary()), *batch.columns[1:]], ["digest", "first_doc", "first_line", "n"])

    return common.map_arrow(often.select("key", "first.first_doc", "first.first_line", "n"), digests, f"digest binary, first_doc {kind}, first_line long, n long")


def kept_lines(text: bytes, doc, dropped: dict, keep_first: bool) -> tuple[bytes, int, int]:
    """The text without the lines whose keys' digests are in dropped; how many lines it had and lost."""
    lines, digest = text.split(b"\n"), xxhash.xxh3_128_digest
    if not dropped:
        return text, len(lines), 0
    out = []
    for n, (line, key) in enumerate(zip(lines, line_keys(text), strict=True)):
        first = dropped.get(digest(key)) if key else None
        if first is None or keep_first and doc is not None and first == (doc, n):
            out.append(line)
    return b"\n".join(out), len(lines), len(lines) - len(out)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", most_sent: int = MOST_SENT, counts: bool = True) -> DataFrame:
    """docs with each text less its repeated lines, and, with counts, n_lines (before) and n_dropped.

    A row is a document, whether or not its doc_id repeats. A null or empty text is one empty line, which is never dropped; the text becomes an empty
    string. keep_first leaves a key's first line where it is: in the least doc_id that has it (rows that share that doc_id and place all keep it; keys
    of documents without a doc_id only lose all). Columns of the input named n_lines or n_dropped give way to the new ones, or stay as they are without counts.
    """
    rest = docs.drop(*COUNTS) if counts else docs
    hot = common.cut(repeated(common.texts(rest, id_col, text_col), min_chars, min_docs))
    names, kinds = rest.columns, {f.name: f.dataType.simpleString() for f in rest.schema.fields}
    schema = ", ".join(f"`{k}` {'string' if k == text_col else kinds[k]}" for k in names) + ", n_lines long, n_dropped long" * counts
    data = rest.withColumn(text_col, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"))
    few = hot.count() <= most_sent

    def with_counts(batch: pa.RecordBatch, at: int, found: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
        own = [pa.array([x[0] for x in found], pa.binary()).cast(pa.string()) if k == at else batch.column(k) for k in range(len(names))]
        more = [pa.array([x[k] for x in found], pa.int64()) for k in (1, 2)] if counts else []
        return pa.RecordBatch.from_arrays([*own, *more], [*names, *COUNTS[: len(more)]])

    if few:
        sent = docs.sparkSession.sparkContext.broadcast({bytes(d): (doc, line) for d, doc, line, _ in hot.collect()})

        def apply(batches):
            for batch in batches:
                at, doc_at = batch.schema.get_field_index(text_col), batch.schema.get_field_index(id_col)
                found = [kept_lines(t, d, sent.value, keep_first) for t, d in zip(batch.column(at).to_pylist(), batch.column(doc_at).to_pylist(), strict=True)]
                yield with_counts(batch, at, found)

        return common.map_arrow(data, apply, schema)

    # What a text loses depends on its lines alone, or on its doc_id too where first lines stay, so that copies share their drops.
    own = F.sha2(F.col(f"`{text_col}`"), 256) if not keep_first else F.sha2(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"), F.lit(b":"), F.col(f"`{text_col}`")), 256)
    fresh = lambda name: name if name not in names else fresh(name + "_")
    tag, drops = fresh("_own"), fresh("_drops")

    def explode(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            rows = [(t, d, digest(k), n) for t, d, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for n, k in enumerate(line_keys(text)) if long_enough(k, min_chars)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), batch.schema.types[1], pa.binary(), pa.int64()))], ["tag", "doc", "digest", "line"])

    tagged = data.withColumn(tag, own)
    kind = rest.schema[id_col].dataType.simpleString()
    once = common.cut(tagged.groupBy(F.col(tag).alias("tag")).agg(F.min(f"`{id_col}`").alias("doc"), F.first(f"`{text_col}`").alias("text"), F.count("*").alias("n")))
    lines = common.map_arrow(once.select("tag", "doc", "text"), explode, f"tag string, doc {kind}, digest binary, line long")
    size = once.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.length("text")), F.lit(0)) / MEAN_LINE).first()
    gone = common.join_hot(lines, hot, "digest", "n", int(size[1]))
    if keep_first:
        gone = gone.where(~F.coalesce((F.col("doc") == F.col("first_doc")) & (F.col("line") == F.col("first_line")), F.lit(False)))
    by_tag = gone.groupBy("tag").agg(F.collect_list("line").alias(drops))
    by_tag = common.cut(once.select("tag", "n").join(by_tag, "tag", "left")).withColumnRenamed("tag", tag).withColumnRenamed("n", fresh("_n"))
    joined = common.join_hot(tagged, by_tag, tag, fresh("_n"), size[0])

    def without(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            found = []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                parts, gone = text.split(b"\n"), set(gone or ())
                found.append((b"\n".join(x for k, x in enumerate(parts) if k not in gone) if gone else text, len(parts), len(gone)))
            yield with_counts(batch, at, found)

    return common.map_arrow(joined.select(*(F.col(f"`{k}`") for k in names), drops), without, schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(common.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM d),
y AS (SELECT r, line, k, translate(regexp_replace(line, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
hot AS (SELECT key FROM y WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY k) AS text, count(*) AS n FROM y WHERE key NOT IN (SELECT key FROM hot) GROUP BY r)
SELECT d.doc_id, CAST(len(d.lines) AS BIGINT) AS n_lines, CAST(len(d.lines) - coalesce(kept.n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
