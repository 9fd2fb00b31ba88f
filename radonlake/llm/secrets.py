"""Secret scans (operator 1): Markov models of random strings and of ordinary identifiers, compared by log-likelihood ratio.

Base kinds are found by pattern. In every other run of token characters, also in what a base span leaves of one, two character models of
second order, trained from labelled samples, score each character; the segments of the largest sums are reported where a
random string explains them better by a margin, so that ordinary words beside a token don't hide it.
"""

from __future__ import annotations

import functools
import math
import random
import re
import string
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4))
HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
#: Runs that the models score, by their least length, and that of a segment, the margins of its log-likelihood ratio, in all and for a character, and how far
#: a segment reaches on to the separator or run's end next to it.
RUN_LEAST, SEGMENT_LEAST = 20, 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % RUN_LEAST)
MARGIN, MARGIN_CHAR, REACH, SEPARATORS = 12.0, 0.45, 4, "/_=-"
ALPHABET = {c: i for i, c in enumerate(string.ascii_letters + string.digits + "+/_=-")}
EDGE = len(ALPHABET)
#: Samples of each label by default, and the seed that they are made from.
SAMPLES, SEED = 4000, 17
#: Words of ordinary identifiers.
IDENTIFIER_WORDS = """
account action active address agent alert amount array async attribute author auto available average background balance base batch binary block
body border buffer build bundle button byte cache calculate callback camera cancel catalog center channel character check child class clean client
clock close cluster code collection color column command comment commit common compare compile component config connection console container content
context control convert copy count create current custom cycle data database date debug decode default define delete depth description detail device
directory disable display document domain download driver duration dynamic edit element email enable encode engine entity entry error event example
execute export expression extension extract factory feature field file filter final find first flag folder font format forward frame function generate
global graph group handle hash header height helper hidden history host image import index info initial input insert instance integer interface
internal interval item iterator job join journal kernel key keyboard label language last layer layout length level library limit line link list load
local location lock logger login loop machine main manager map margin master match matrix maximum member memory menu merge message method metric
minimum mobile mode model module monitor mouse move multiple name native network next node normal notify null number object offset option order origin
output override owner package page panel parameter parent parse partition password path pattern pending permission phone pixel player plugin point
policy port position post prefix prepare present previous price primary print priority private process product profile project property protocol
provider proxy public query queue random range rate read ready receive record reference region register release remote remove render replace report
request require reset resource response result return role root route rule runtime sample scale schedule schema scope screen script scroll search
second section security select sender sequence serial server service session setting shape share signal simple single size snapshot socket source
space special stack stage standard start state static status storage stream string structure style submit success suffix summary support switch symbol
sync system table target task template temp terminal test text theme thread threshold time title token tool total trace track transaction transfer
transform tree trigger type unique unit update upload url user utility valid value variable vector vendor version vertical video view virtual visible
wait warning watch weight widget width window word worker wrapper write zone
""".split()


#: Beginnings, vowels and ends of syllables, for words of no list.
ONSETS = "b br c ch d dr f fl g gr h j k kl l m n p pf pr qu r s sch sh sp st str t th tr v w z".split()
VOWELS = "a e i o u ai au ea ee ei ie io ou eu".split()
CODAS = ["", "", "", *"b ch ck d f g h k l ld lich ll m n nd ng ns nt p r rd rk rn s ss st t ten tion tz ung x".split()]


def spoken(made: random.Random) -> str:
    """A word of a few syllables, of no language."""
    return "".join(made.choice(ONSETS) + made.choice(VOWELS) + made.choice(CODAS) for _ in range(made.randint(1, 5)))


def default_samples(n: int = SAMPLES, seed: int = SEED) -> list[tuple[str, bool]]:
    """(string, whether it is random): generated strings of usual alphabets; and identifiers of ordinary words, paths, times, versions, rulers and numbers in groups."""
    made, out = random.Random(seed), []
    alphabets = [string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "-_", "0123456789abcdef"]
    for k in range(n):
        out.append(("".join(made.choices(alphabets[k % len(alphabets)], k=made.randint(20, 64))), True))
        words = [w if made.random() < 0.6 else spoken(made) for w in made.choices(IDENTIFIER_WORDS, k=made.randint(2, 7))]
        number = lambda n=0: str(made.randrange(10 ** (n or made.randint(1, 4)))).zfill(n)
        style = k % 12
        if style == 0:
            name = "_".join(words)
        elif style == 1:
            name = words[0] + "".join(x.title() for x in words[1:])
        elif style == 2:
            name = "".join(x.title() for x in words)
        elif style == 3:
            name = "-".join(words)
        elif style == 4:
            name = "_".join(words).upper()
        elif style == 5:
            name = "".join(words)
        elif style == 6:
            name = "/".join(words)
        elif style == 7:  # times
            name = f"{made.randint(1970, 2039)}-{made.randint(1, 12):02}-{made.randint(1, 31):02}T{number(2)}{number(2)}{number(2)}" + made.choice(("", "Z", "+0000", "+0200", f"-{number(4)}"))
        elif style == 8:  # versions and builds
            name = "-".join(words[:3]) + f"-{number()}-{number(1)}-{number()}" + made.choice(("", "-linux-x86_64", "-win32", "-amd64", "-SNAPSHOT", "_final"))
        elif style == 9:  # rulers
            name = "".join(made.choice("-=_+/") * made.randint(4, 40) for _ in range(made.randint(1, 3)))
        elif style == 10:
            name = "_".join(x + number() * made.randint(0, 1) for x in words)
        else:  # numbers in groups
            name = made.choice("-/_").join(number(made.randint(2, 6)) for _ in range(made.randint(3, 6)))
        out.append((name + (str(made.randint(0, 2030)) if k % 5 == 0 else ""), False))
    return out


def symbols(text: str) -> list[int]:
    return [EDGE, EDGE, *map(ALPHABET.__getitem__, text)]


def train(samples: Iterable[tuple[str, bool]], smooth: float = 0.05) -> np.ndarray:
    """Log-likelihood ratio of each character after each two before it: how much likelier a random string has it.

    A character's chance after a pair is smoothed by its chance after one, and that by its chance overall. Characters outside the
    alphabet cut a sample; a null or empty sample counts for nothing.
    """
    n = EDGE + 1
    logs = {}
    for label in (True, False):
        three = np.zeros((n, n, n))
        for text, is_random in samples:
            if bool(is_random) == label and text:
                for part in re.findall(r"[A-Za-z0-9+/_=-]+", text):
                    s = np.array(symbols(part))
                    np.add.at(three, (s[:-2], s[1:-1], s[2:]), 1)
        two, one = three.sum(0), three.sum((0, 1))
        chance1 = (one + smooth * 20) / (one + smooth * 20).sum()
        chance2 = (two + 4 * chance1) / (two + 4 * chance1).sum(1, keepdims=True)
        chance3 = (three + 2 * chance2[None]) / (three + 2 * chance2[None]).sum(2, keepdims=True)
        logs[label] = np.log(chance3)
    return logs[True] - logs[False]


@functools.lru_cache(1)
def default_model() -> np.ndarray:
    return train(default_samples())


def ratio(model: np.ndarray, run: str) -> float:
    s = symbols(run)
    return math.fsum(model[a, b, c] for a, b, c in zip(s, s[1:], s[2:], strict=False))


def segments(model: np.ndarray, run: str) -> list[tuple[int, int]]:
    """The segments of a run that are likelier random, from left to right.

    A segment has the largest sum of what its characters' ratios exceed MARGIN_CHAR by, so that its mean is at least that; what is left and right of it
    is searched on. At its ends it takes in up to REACH characters before a separator or the run's end.
    """
    s = np.array(symbols(run))
    over = model[s[:-2], s[1:-1], s[2:]] - MARGIN_CHAR
    sums = np.concatenate(([0.0], np.cumsum(over)))
    out, todo = [], [(0, len(run))]
    while todo:
        a, b = todo.pop()
        if b - a < SEGMENT_LEAST:
            continue
        part = sums[a : b + 1]
        low = np.minimum.accumulate(part)
        end = int(np.argmax(part - low))
        start = int(np.argmin(part[: end + 1]))
        if end <= start:
            continue
        i, j = a + start, a + end
        first = next((k for k in range(i, max(a, i - REACH) - 1, -1) if k == a or run[k - 1] in SEPARATORS), i)
        last = next((k for k in range(j, min(b, j + REACH) + 1) if k == b or run[k] in SEPARATORS), j)
        gain = sums[j] - sums[i] + MARGIN_CHAR * (j - i)
        if gain < MARGIN:
            continue
        if last - first >= SEGMENT_LEAST:
            out.append((first, last))
        todo += ((a, first), (last, b))
    return sorted(out)


def find(text: str, model: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in code points, sorted. Model spans are outside base spans, also those of a run that a base span is part of."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for a, _, b in found)
    k, high = 0, 0
    for m in RUN.finditer(text):
        a, b = m.span()
        a = max(a, high)
        parts = []
        while k < len(base) and base[k][0] < b:
            parts.append((a, base[k][0]))
            high = max(high, base[k][1])
            a = max(a, high)
            k += 1
        parts.append((a, b))
        for i, j in parts:
            if j - i >= SEGMENT_LEAST:
                found += [(i + x, 3, i + y) for x, y in segments(model, text[i:j])]
    return sorted(found)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each group of overlapping spans replaced by mark."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += (text[at:a], mark)
        at = max(at, b)
    return "".join((*out, text[at:]))


def scan(docs: DataFrame, samples: list[tuple[str, bool]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>): the secrets of every whole text, by start, then kind.

    Null and empty texts have none; a text of any length is scanned whole, in time that grows with its length. Rows that repeat a doc_id are scanned each,
    other columns are left out, an empty table gives an empty one. samples: labelled strings to train the models from,
    a list that the driver holds; by default generated ones.
    """
    model = train(samples) if samples is not None else None

    def run(batches):
        own = default_model() if model is None else model
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(x, own)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    source = common.texts(docs, id_col, text_col)
    return common.map_arrow(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(docs: DataFrame, samples: list[tuple[str, bool]] | None = None, text_col: str = "text") -> DataFrame:
    """docs with every secret in its texts replaced. Null and empty texts stay as they are, and so do all other columns, whatever their names; a text of any
    length is redacted whole, rows that repeat are redacted each, an empty table gives an empty one."""
    model = train(samples) if samples is not None else None

    def run(batches):
        own = default_model() if model is None else model
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            clean = [x and redact(x, find(x, own)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return common.map_arrow(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return scan(common.documents(spark, sf_dir)).select("doc_id", *map(count, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
