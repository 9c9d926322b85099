"""N-gram Jaccard join by MinHash banding.

A text's words are its runs without ASCII white space, A-Z lower-cased; its shingles are the sets of N words in a row
(one shingle of all words if it has fewer). Two texts are linked if their sets have a Jaccard similarity of THRESHOLD
or more. BANDS bands of ROWS minima are the candidates' keys; numbers chosen so that a pair at the threshold shares a
band with probability 1 - (1 - THRESHOLD ** ROWS) ** BANDS > 0.999, and a pair at half similarity with 0.14.

1. Documents with equal sets form a class at once; only one of each goes on, with the class's size as its weight.
2. Band hashes are shuffled, and members of a bucket point to its least one (a star, never all pairs); connected components
   of these stars bring all candidates of a class together. A batch of documents sends each of its band hashes once and
   links the others of the batch to it at the source, so a bucket with a third of all documents gets one row a batch.
3. Each component's full sets are compared in one task, or in pairs of blocks if it has over BLOCK members or BLOCK_BYTES
   of text: texts move once for each block of their component. Pairs that share a band are verified on the full sets
   inside the task, tile by tile, and only sums of links and a spanning forest leave it, although every link is found.
4. Components of the verified links are the classes.

Texts without a partner are kept out of the shuffle of step 3 by a Bloom filter as long as the others are not too many for
one; beyond that all texts move once. Classes and buckets with a large share of all rows are joined by broadcasting them
(there are few), see ``common.skew_join``.

Defined cases: texts without words (null, empty, white space) have no shingles and no links: each row is a class of its
own with class_id doc_id; null ids take part, a class_id is the least id that is not null; repeated rows are copies; a very
long text is hashed in parts and has a block of its own; an empty table gives no rows; near_duplicates reads doc_id and
text only, and stage carries all other columns, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_text import buffers, frugal
from .bloom import possible
from .common import skew_join, small_batches, unwrapped, wrapped, written
from .components import components

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 8
BLOCK, BLOCK_BYTES = 8192, 8 << 20
#: Members that are compared with all others at a time, and shingles that are counted at a time.
TILE, WIDTH = 256, 2048
#: Documents that are signed together and send each of their band hashes once.
SIGNED_ROWS = 4096
#: Bytes of text whose words are hashed at a time.
PART_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd numbers of 64 bits."""
    return mixed((np.arange(n, dtype=np.uint64) + U(seed << 20)) * U(0x9E3779B97F4A7C15)) | U(1)


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 ** 64, and of its inverse."""
    base = 0x9E3779B97F4A7C55
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of each word of one text, in order."""
    if len(raw) > PART_BYTES:  # cut at white space
        blanks = np.flatnonzero(SPACE[raw])
        parts, at = [], 0
        while at < len(raw):
            k = int(np.searchsorted(blanks, at + PART_BYTES))
            to = int(blanks[k]) if k < len(blanks) else len(raw)
            parts.append(_word_hashes(raw[at:to]))
            at = to + 1
        return np.concatenate(parts)
    return _word_hashes(raw)


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = ~SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(max(PART_BYTES, 1 << int(len(raw)).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((LOWER[raw].astype(np.uint64) + U(1)) * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def shingles(raw: np.ndarray, n: int = N) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = word_hashes(raw)
    if not len(words):
        return words
    k = min(n, len(words))
    factors = constants(n, 1)
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total = total + words[i : len(words) - k + 1 + i] * factors[i]
    return np.unique(mixed(total))


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    a = mixed(np.array([s.sum(dtype=np.uint64) + U(len(s))], np.uint64))
    b = mixed(s ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)[0]), int(np.array([b], np.uint64).view(np.int64)[0])


@functools.lru_cache(maxsize=4)
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    c = constants(2 * n, 2)
    return (c[:n] >> U(32)).astype(np.uint32) | np.uint32(1), (c[n:] >> U(32)).astype(np.uint32)


def band_hashes(s: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Hash of each band's minima over the set, as signed numbers."""
    a, b = permutations(bands * rows)
    least = np.full(bands * rows, np.uint32(0xFFFFFFFF))
    small = (s >> U(32)).astype(np.uint32)
    for i in range(0, len(small), 256):
        np.minimum(least, (small[i : i + 256, None] * a + b).min(0), out=least)
    mix = constants(rows, 3)
    h = (least.reshape(bands, rows).astype(np.uint64) * mix).sum(1, dtype=np.uint64) + constants(bands, 4)
    return mixed(h).view(np.int64)


def first_of_batch(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys are the first of their value, owner of the first one of each key's value)."""
    _, first, at = np.unique(keys, return_index=True, return_inverse=True)
    lead = np.zeros(len(keys), bool)
    lead[first] = True
    return lead, owner[first[at]]


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """n lists of the values by their row; rows ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _signatures(bands: int, rows: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SIGNED_ROWS) for b in batches for k in range(0, b.num_rows, SIGNED_ROWS)):
            raw, offsets = buffers(batch.column("t"))
            n = batch.num_rows
            h = np.zeros((2, n), np.int64)
            size = np.zeros(n, np.int64)
            keys = []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                s = shingles(raw[a:b])
                size[i] = len(s)
                if len(s):
                    h[:, i] = set_hash(s)
                    keys.append(band_hashes(s, bands, rows))
            every = np.concatenate([*keys, np.zeros(0, np.int64)])
            row = np.repeat(np.flatnonzero(size), bands)
            lead, to = first_of_batch(every, h[0][row])
            star = ~lead & (to != h[0][row])
            columns = [batch.column("doc_id"), batch.column("rk"), *map(pa.array, (h[0], h[1], size, np.diff(offsets))), _lists(every[lead], row[lead], n), _lists(to[star], row[star], n)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rk", "h1", "h2", "n_shingles", "n_bytes", "bands", "stars"])

    return run


SIGNATURES = "doc_id long, rk long, h1 long, h2 long, n_shingles long, n_bytes long, bands array<long>, stars array<long>"


class Overlaps:
    """Sizes of the intersections of sets.

    Shingles of one member don't count. Those of most members are held by who lacks them: near copies lack few, so few
    columns are left whatever the length of their texts.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.n = sets, len(sets)
        owner = np.repeat(np.arange(self.n), [len(s) for s in sets])
        _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = 2 * counts > self.n
        self.core = int(common.sum())
        rest = ~common[column] & (counts > 1)[column]
        some_lack = np.flatnonzero(common & (counts < self.n))
        has = np.zeros((self.n, len(some_lack)), bool)
        place = np.searchsorted(some_lack, column)
        mine = (place < len(some_lack)) & (some_lack[np.minimum(place, len(some_lack) - 1)] == column) if len(some_lack) else np.zeros(len(column), bool)
        has[owner[mine], place[mine]] = True
        who, what = np.nonzero(~has)
        self.lacks = np.bincount(who, minlength=self.n)
        _, others = np.unique(column[rest], return_inverse=True)
        who, what = np.concatenate((who, owner[rest])), np.concatenate((what, others + len(some_lack)))
        order = np.argsort(what, kind="stable")
        self.who, self.what = who[order], what[order]

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Matrix of the sizes for members left and right."""
        out = np.zeros((len(left), len(right)), np.float32)
        for c in range(0, int(self.what[-1]) + 1 if len(self.what) else 0, WIDTH):
            x, y = np.searchsorted(self.what, [c, c + WIDTH])
            part = np.zeros((self.n, WIDTH), np.float32)
            part[self.who[x:y], self.what[x:y] - c] = 1
            out += part[left] @ part[right].T
        return out.astype(np.int64) + (self.core - self.lacks[left])[:, None] - self.lacks[right][None, :]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes for members a[k] and b[k]."""
        return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)


def links(sets: list[np.ndarray], keys: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tile of left, right, matrix of who is linked) of members that share a band and have the similarity; each pair of
    members once."""
    sizes = np.array([len(s) for s in sets], np.int64)
    overlaps = None
    for k in range(0, len(left), TILE):
        tile = left[k : k + TILE]
        small, large = np.minimum(sizes[tile][:, None], sizes[right]), np.maximum(sizes[tile][:, None], sizes[right])
        fits = small >= threshold * large - 1e-9
        if left is right:
            fits &= right > tile[:, None]
        same = np.zeros(fits.shape, bool)
        for band in range(keys.shape[1]):
            same |= keys[tile, band][:, None] == keys[right, band]
        same &= fits
        i, j = np.nonzero(same)
        if not len(i):
            continue
        overlaps = overlaps or Overlaps(sets)
        dense = len(i) > 3 * (len(tile) + len(right))
        both = overlaps(tile, right)[i, j] if dense else overlaps.pairs(tile[i], right[j])
        same[i, j] = both >= threshold * (sizes[tile[i]] + sizes[right[j]] - both) - 1e-9
        yield tile, right, same


def unite(label: np.ndarray, tile: np.ndarray, right: np.ndarray, linked: np.ndarray) -> None:
    """Give all members that a tile's links join the least of their labels."""
    for k in np.flatnonzero(linked.any(1)).tolist():
        found = np.unique(np.append(label[right[linked[k]]], label[tile[k]]))
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]


def _verify(bands: int, rows: int, threshold: float):
    def task(group: list[tuple], i: int, j: int) -> list[tuple]:
        members: dict[tuple[int, int], tuple] = {}
        for h1, h2, size, block, s in group:
            if (h1, h2) not in members:
                if len(s) and set_hash(s) == (h1, h2):
                    members[(h1, h2)] = (s, size, block)
        names = sorted(members)
        sets = [members[x][0] for x in names]
        weight = np.array([members[x][1] for x in names], np.int64)
        blocks = np.array([members[x][2] for x in names], np.int64)
        if len(names) < 2:
            return []
        keys = np.stack([band_hashes(s, bands, rows) for s in sets])
        left = np.flatnonzero(blocks == i)
        right = left if i == j else np.flatnonzero(blocks == j)
        count, root = np.zeros(len(names), np.int64), np.arange(len(names))
        for tile, others, linked in links(sets, keys, left, right, threshold):
            count[tile] += linked @ weight[others]
            count[others] += weight[tile] @ linked
            unite(root, tile, others, linked)
        return [(*names[k], int(count[k]), *names[root[k]]) for k in np.flatnonzero(count).tolist()]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("label", "i", "j", "h1", "h2", "size", "block")]
            for (label, i, j, *row), text in zip(zip(*columns, strict=True), batch.column("t"), strict=True):
                if (label, i, j) != now:
                    if now is not None:
                        out += task(group, now[1], now[2])
                    now, group = (label, i, j), []
                group.append((*row, shingles(np.frombuffer(text.as_buffer(), np.uint8))))
            yield _rows(out)
        if now is not None:
            yield _rows(task(group, now[1], now[2]))

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h1", "h2", "n_links", "r1", "r2"])

    return run


def _name(a: str, b: str):
    """Name of a class of equal sets, from both parts of its hash."""
    return F.concat(F.hex(a), F.lit("-"), F.hex(b))


def with_blocks(members: DataFrame, members_a_block: int = BLOCK, bytes_a_block: int = BLOCK_BYTES) -> DataFrame:
    """Append n_blocks of the member's component, and the member's block."""
    n = F.greatest(F.ceil(F.count("*") / members_a_block), F.ceil(F.sum("n_bytes") / bytes_a_block)).cast("int")
    blocks = members.groupBy("label").agg(n.alias("n_blocks"), F.count("*").alias("n"))
    return skew_join(members, blocks, ["label"], "n").withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.col("n_blocks")).cast("int"))


def text_tasks(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """A row with the member's text for each task (pair of blocks) of its component that it is in."""
    with_text = wanted.join(texts.dropDuplicates(["rk"]), "rk")
    tasks = with_text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return tasks.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select("label", "i", "j", "h1", "h2", "size", "block", "t")


def join(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(signatures, classes): a row (doc_id, rk, h1, h2, n_shingles) for each document, and a row for each distinct set:
    h1, h2, size (documents with it), n_links (documents linked to it, its other copies included), class_id, class_size,
    and k1, k2, the set that stands for the class."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rk"))
    signed = texts.select("doc_id", "rk", F.coalesce("text", F.lit("")).cast("binary").alias("t")).mapInArrow(_signatures(bands, rows), SIGNATURES)
    signed = written(signed, "signatures")
    some = signed.filter("n_shingles > 0")
    sets = some.groupBy("h1", "h2").agg(F.count("*").alias("size"), F.min("doc_id").alias("least_id"), F.min("rk").alias("rk"), F.max("n_bytes").alias("n_bytes"))
    sets = written(sets, "sets")

    keys = some.select("h1", F.explode("bands").alias("key"))
    first = F.min("h1").over(Window.partitionBy("key").orderBy("h1").rowsBetween(Window.unboundedPreceding, 0))
    stars = keys.select(F.col("h1").alias("a"), first.alias("b")).filter("a <> b")
    labels = components(stars.unionByName(some.select(F.col("h1").alias("a"), F.explode("stars").alias("b"))))

    labels = labels.withColumnRenamed("node", "h1").withColumnRenamed("root", "label")
    members = written(sets.join(labels, "h1"), "members")
    wanted = written(with_blocks(members).select("label", "n_blocks", "block", "h1", "h2", "size", "rk"), "blocks")
    bytes_ = texts.select("rk", F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    tasks = text_tasks(wanted, possible(bytes_, "rk", wanted, wanted.count()))
    found = tasks.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(_verify(bands, rows, threshold), "h1 long, h2 long, n_links long, r1 long, r2 long")
    found = written(found, "links")

    groups = components(found.select(_name("h1", "h2").alias("a"), _name("r1", "r2").alias("b")))
    linked = found.groupBy("h1", "h2").agg(F.sum("n_links").alias("n_links"))
    classes = sets.join(linked, ["h1", "h2"], "left").withColumn("node", _name("h1", "h2")).join(groups, "node", "left")
    classes = classes.withColumn("root", F.coalesce("root", "node"))
    # The set that stands for a class has the least id; ties (and classes of null ids) by hash.
    first = F.min(F.struct(F.col("least_id").isNull().alias("no_id"), "least_id", "h1", "h2"))
    classes = written(classes, "classes")
    heads = classes.groupBy("root").agg(first.alias("f"), F.sum("size").alias("class_size"), F.count("*").alias("n"))
    heads = heads.select("root", "class_size", F.col("f.least_id").alias("class_id"), F.col("f.h1").alias("k1"), F.col("f.h2").alias("k2"), "n")
    classes = skew_join(classes, heads, ["root"], "n").select("h1", "h2", "size", "rk", (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "class_id", "class_size", "k1", "k2", "least_id")
    return signed, classes


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, class_id, class_size, n_links, n_shingles."""
    signed, classes = join(docs)
    joined = skew_join(signed.filter("n_shingles > 0"), classes.drop("rk"), ["h1", "h2"], "size")
    linked = joined.select("doc_id", "class_id", "class_size", "n_links", "n_shingles")
    alone = signed.filter("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), "n_shingles")
    return linked.unionByName(alone)


def stage(docs: DataFrame) -> DataFrame:
    """One document of each class: the one with the least id (of equal sets, the one with the least hash), and all
    documents without words. Columns as in the input."""
    signed, classes = join(docs)
    heads = classes.filter("h1 = k1 AND h2 = k2").select("h1", "h2", "size")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk"))
    kept = skew_join(signed.filter("n_shingles > 0"), heads, ["h1", "h2"], "size").groupBy("h1", "h2").agg(best.alias("b")).select(F.col("b.rk").alias("n_key"))
    marked = wrapped(docs, n_key=F.xxhash64("doc_id", "text"), n_text=F.col("text"))
    chosen = marked.drop("n_text").dropDuplicates(["n_key"]).join(kept, "n_key", "left_semi")
    wordless = marked.filter(~F.coalesce(F.regexp_like("n_text", F.lit(r"[^ \t\n\x0b\f\r]")), F.lit(False)))
    return unwrapped(chosen, docs.columns).unionByName(unwrapped(wordless, docs.columns))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
