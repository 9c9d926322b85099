"""Language ID by prediction by partial matching.

Each language has a context tree over bytes (A-Z lower-cased) of orders 0 to ORDER. A context gives a byte it has
seen its count over n + d (n bytes seen, d different ones) and leaves d / (n + d) to escape to the next shorter
context, in which bytes already seen are excluded. With frozen counts the code length of a text is exact: a sum
over its bytes, each from the longest context that the language has seen. The shortest code wins.

Bytes are coded in two steps: the CLASSES - 1 most frequent ones by themselves, all others by one class and then
evenly. So a context of three bytes is a number below CLASSES ** 3, and the code lengths of all languages stand
in one table with a row for each context seen, at most CLASSES ** 3 + CLASSES ** 2 + CLASSES + 1 rows.

The folding keeps the table small. It costs nothing where the languages use few bytes in common, as those in Latin letters
do; among several languages of one other script most of a letter's last bytes can fall into the one class, and close ones
are told apart less well.

Learned from at most MAX_DOCS texts of each of the MAX_LANGS most frequent languages, those with the smallest hash; scored
on whole texts, a long one slice by slice. The driver gets one row a language and the counts of the sample's byte contexts.

Defined cases: an empty table gives no rows; other columns are not read; null or letterless text: ``und``, score 0; no row to learn from: ``und``, score 0; null ids are
not held out; rows with null language teach nothing; ties go to the language first by name; repeated rows give
one result each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_text import SLICE_BYTES, buffers, frugal, groups, segment_sums, spaced
from .common import remainder, small_batches

ORDER = 3
CLASSES = 64
MAX_DOCS, MAX_LANGS = 2000, 200
NONE = "und"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Model:
    langs: list[str]
    classes: np.ndarray  #: class of each byte
    rows: np.ndarray  #: row of each context of ORDER classes
    bits: np.ndarray  #: (rows * CLASSES, languages): code length of a class in a row's context
    other_bits: float  #: bits to tell the bytes of the last class apart


def contexts(x: np.ndarray) -> np.ndarray:
    """Number of the ORDER classes before each element but the first ORDER, the nearest as the lowest digit."""
    n = len(x) - ORDER
    c = np.zeros(n, np.int32)
    for k in range(ORDER, 0, -1):
        c = c * CLASSES + x[ORDER - k : ORDER - k + n]
    return c


def pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices as (bytes with ORDER bytes of context before each row, starts, ends, row numbers). Long rows come in pieces."""
    for first, last in groups(offsets):
        a, b = int(offsets[first]), int(offsets[last])
        if last - first == 1 and b - a > SLICE_BYTES:
            for at in range(a, b, SLICE_BYTES):
                to = min(b, at + SLICE_BYTES)
                head = raw[max(a, at - ORDER) : at]
                head = np.concatenate((np.full(ORDER - len(head), 32, np.uint8), head))
                yield np.concatenate((head, raw[at:to])), np.array([ORDER]), np.array([ORDER + to - at]), np.array([first])
        else:
            x, starts = spaced(raw[a:b], offsets[first : last + 1] - a, ORDER, 32)
            yield x, starts, starts + np.diff(offsets[first : last + 1]), np.arange(first, last)


@frugal
def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, four bytes as a number, count) of each slice."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            raw, offsets = buffers(batch.column("t").filter(pa.array(langs == lang)))
            for x, starts, ends, _ in pieces(LOWER[raw], offsets):
                inside = np.zeros(len(x) + 1, np.int32)
                np.add.at(inside, starts, 1)
                np.add.at(inside, ends, -1)
                code = np.zeros(len(x) - ORDER, np.int64)
                for k in range(ORDER + 1):
                    code = code * 256 + x[k : len(x) - ORDER + k]
                values, counts = np.unique(code[np.cumsum(inside[:-1])[ORDER:] > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


def sample(docs: DataFrame, train: Column, max_docs: int = MAX_DOCS) -> DataFrame:
    """(lang, t) of at most max_docs rows of each language: those with the smallest hash of id and text."""
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    # The share drawn before ranking is twice what is needed, so that ranking sees a bounded number of rows.
    share = F.when(F.lit(False), 0)
    for lang, n in sorted(sizes.items()):
        share = share.when(F.col("lang") == lang, min(1 << 20, 64 + (2 * max_docs << 20) // n))
    drawn = rows.withColumn("draw", F.xxhash64("doc_id", "text")).filter(draw < share.otherwise(0)) if sizes else rows.withColumn("draw", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    return drawn.withColumn("r", rank).filter(F.col("r") <= max_docs).select("lang", F.col("text").cast("binary").alias("t"))


def probabilities(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Of each class in contexts with these counts (rows, CLASSES); shorter: the same in the next shorter context."""
    n, d = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    rest = np.where(counts > 0, 0, shorter)
    left = rest.sum(1, keepdims=True)
    full = left <= 0  # every class seen: nothing to escape to
    own = counts / np.maximum(1, n + np.where(full, 0, d))
    out = own + np.where(full, 0, d / np.maximum(1, n + d)) * rest / np.where(full, 1, left)
    return np.where(n > 0, out, shorter)


def build(grams: pa.Table) -> Model | None:
    """Model from (lang, gram, n); None without rows."""
    if grams.num_rows == 0:
        return None
    names = grams.column("lang").to_pylist()
    langs = sorted(set(names))
    index = {x: i for i, x in enumerate(langs)}
    lang = np.fromiter((index[x] for x in names), np.int64, len(names))
    gram, n = grams.column("gram").to_numpy(), grams.column("n").to_numpy().astype(np.float64)
    seen = np.bincount(gram & 255, weights=n, minlength=256)
    frequent = np.argsort(-seen, kind="stable")[: CLASSES - 1]
    classes = np.full(256, CLASSES - 1, np.uint8)
    classes[frequent[seen[frequent] > 0]] = np.arange(int((seen[frequent] > 0).sum()))
    others = int((classes[LOWER] == CLASSES - 1)[np.unique(LOWER)].sum())
    code = np.zeros(len(gram), np.int64)  # of the context; its nearest byte is the lowest digit, so a shorter one is the remainder
    for k in range(ORDER, 0, -1):
        code = code * CLASSES + classes[(gram >> (8 * k)) & 255]
    sym = classes[gram & 255].astype(np.int64)
    tables = []
    used = [np.unique(code % CLASSES**k) for k in range(ORDER + 1)]
    for i in range(len(langs)):
        mine = lang == i
        p = np.full((1, CLASSES), 1 / CLASSES)
        levels = []
        for k in range(ORDER + 1):
            at = np.searchsorted(used[k], code[mine] % CLASSES**k)
            counts = np.bincount(at * CLASSES + sym[mine], weights=n[mine], minlength=len(used[k]) * CLASSES).reshape(-1, CLASSES)
            shorter = p if k == 0 else levels[-1][np.searchsorted(used[k - 1], used[k] % CLASSES ** (k - 1))]
            levels.append(probabilities(counts, shorter))
        tables.append(np.concatenate(levels))
    first = np.cumsum([0, *map(len, used)])
    rows = np.zeros(CLASSES**ORDER, np.int32)
    every = np.arange(CLASSES**ORDER)
    for k, u in enumerate(used):
        at = np.minimum(np.searchsorted(u, every % CLASSES**k), len(u) - 1)
        here = u[at] == every % CLASSES**k
        rows[here] = first[k] + at[here]
    bits = -np.log2(np.stack(tables, axis=-1)).astype(np.float32)
    return Model(langs, classes, rows, bits.reshape(-1, len(langs)), float(np.log2(max(1, others))))


def code_lengths(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each row under each language."""
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    fold = model.classes[LOWER]
    for x, starts, ends, rows in pieces(raw, offsets):
        c = fold[x]
        at = model.rows[contexts(c)].astype(np.int64) * CLASSES + c[ORDER:]
        sums = segment_sums(model.bits[at], starts - ORDER, ends - ORDER)
        other = segment_sums((c[ORDER:] == CLASSES - 1).astype(np.float32), starts - ORDER, ends - ORDER)
        np.add.at(out, rows, sums + model.other_bits * other[:, None])
    return out


def train_model(docs: DataFrame, train: Column, max_docs: int = MAX_DOCS) -> Model | None:
    grams = sample(docs, train, max_docs).mapInArrow(_grams, "lang string, gram long, n long")
    return build(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, held_out, text) -> doc_id, held_out, lang_pred, score (posterior of the language, equal priors), bits_per_byte."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, offsets = buffers(batch.column("t"))
            known = batch.column("letter").to_numpy(zero_copy_only=False)
            if m is None:
                pred, score, rate = np.full(batch.num_rows, NONE, object), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            else:
                bits = code_lengths(m, raw, offsets)
                best = bits.argmin(1)
                least = bits[np.arange(len(best)), best]
                odds = np.exp2(np.maximum(-1000, least[:, None] - bits)).sum(1)
                pred = np.where(known, np.array(m.langs, object)[best], NONE)
                score, rate = np.where(known, 1 / odds, 0.0), least / np.maximum(1, np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(list(pred), pa.string()), pa.array(score), pa.array(rate)], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    df = docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).cast("binary").alias("t"), letter.alias("letter"))
    return df.mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out)
    return identify(docs, train_model(docs, ~F.col("held_out")))
