"""Packing in the order of a space-filling curve.

Each document's token counts are hashed to VECTOR numbers, scaled to length one and projected to DIMENSIONS
coordinates; its key is its place on the Hilbert curve through them. Documents are range-sorted by key (ties by a hash
of id, text and row number, so that copies, repeated rows and any one hot key spread over partitions) and laid end to end
along the curve; every SEQUENCE tokens make a sequence. What is left at the end of a partition is cut into sequences whose lengths are
powers of two, so no token of padding is needed anywhere.

Tokens of a document: the tokenizer's ids of its text, then END_ID. The tokenizer drops white space and never joins
characters over it, so texts are tokenized word by word, each distinct word of WORD_BYTES of text once.

Defined cases: a null or empty text has END_ID alone; null ids and repeated rows are documents of their own; a very long
text is tokenized by itself and cut over as many sequences as it needs; an empty table gives no pieces; only doc_id and
text are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import buffers, frugal, groups, sole, words
from .common import small_batches, written

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 2048
END_ID = 1
VECTOR, DIMENSIONS, BITS = 64, 4, 8
#: Tokens that a task packs: 32 MB of 16-bit ids.
TASK_TOKENS = 1 << 24
#: Bytes of text whose words are told apart together.
WORD_BYTES = 2 << 20
#: A character that is a token of its own between words; words with it are tokenized one by one.
MARK = "\x01"


#: A longer piece goes through the whole tokenizer.
SIMPLE_BYTES = 48


def byte_letters() -> list[str]:
    """The character that stands for each byte inside byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


LETTERS = byte_letters()


def marked(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes are in these ranges (both ends included)."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


SMALL, CAPITAL = marked((97, 122)), marked((65, 90))
#: Second bytes of the Latin letters of two bytes whose first one is LEAD.
LEAD, SMALL_2, CAPITAL_2 = 0xC3, marked((0x9F, 0xB6), (0xB8, 0xBF)), marked((0x80, 0x96), (0x98, 0x9E))
#: Signs of ASCII but the apostrophe; a word may be cut before these but the bar, which stands inside special tokens.
SIGN = marked((33, 38), (40, 47), (58, 64), (91, 96), (123, 126))
CUT_BEFORE = SIGN | marked((39, 39))
CUT_BEFORE[ord("|")] = False


def after_lead(raw: np.ndarray) -> np.ndarray:
    """Which bytes follow LEAD."""
    out = np.zeros(len(raw), bool)
    out[1:] = raw[:-1] == LEAD
    return out


def cut_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(pieces of the words of all rows, how many each row has). A word is cut where a sign follows a Latin letter, which
    the tokenizer's pattern always tells apart."""
    letter = (SMALL | CAPITAL)[raw] | (after_lead(raw) & (SMALL_2 | CAPITAL_2)[raw])
    cuts = np.zeros(len(raw), bool)
    cuts[1:] = letter[:-1] & CUT_BEFORE[raw[1:]]
    return words(raw, offsets, cuts)


class Merges:
    """The merges of a byte-pair vocabulary, applied to many pieces at once.

    Pieces of one length are the rows of a matrix of symbols. Each step looks for the pair of the least rank in every row,
    merges its leftmost place and looks up the two pairs that are new, until no row has a known pair.
    """

    SLOTS = 1 << 20
    NONE = np.int32(2**31 - 1)

    def __init__(self, model: dict):
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or model["continuing_subword_prefix"] or model["ignore_merges"]:
            raise ValueError("only plain byte-pair vocabularies")
        self.first = np.array([vocabulary[c] for c in LETTERS], np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in LETTERS], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.whole = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        self.slots = np.full(self.SLOTS, self.NONE, np.int32)
        waiting = np.arange(len(pairs), dtype=np.int32)[::-1]
        step = 0
        while len(waiting):  # one of those that want a free slot gets it, the others try the next one
            at = self.slot(self.keys[waiting], step)
            free = self.slots[at] == self.NONE
            self.slots[at[free]] = waiting[free]
            waiting, step = waiting[self.slots[at] != waiting], step + 1

    def slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((mixed(keys) >> np.uint64(40)).astype(np.int64) + step) & (self.SLOTS - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32 | right).ravel()
        out = np.full(len(keys), self.NONE, np.int32)
        asked, step = np.arange(len(keys)), 0
        while len(asked):
            found = self.slots[self.slot(keys[asked], step)]
            some = found != self.NONE
            asked, found = asked[some], found[some]
            right_one = self.keys[found] == keys[asked]
            out[asked[right_one]] = found[right_one]
            asked, step = asked[~right_one], step + 1
        return out.reshape(left.shape)

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one row after the other, how many each row has) of pieces of one length (rows, bytes)."""
        n, width = rows.shape
        symbols = self.first[rows]
        symbols[:, -1] = self.last[rows[:, -1]]
        sizes = np.full(n, width)
        live = np.arange(n)
        s = symbols.copy()
        r = np.full((n, width), self.NONE, np.int32)  # the last column has no pair
        r[:, :-1] = self.ranks(s[:, :-1], s[:, 1:])
        for size in range(width, 0, -1):
            at = r[:, :size].argmin(1)
            least = r[np.arange(len(live)), at]
            more = least != self.NONE
            done = live[~more]
            symbols[done, :size], sizes[done] = s[~more, :size], size
            live, at, least, s, r = live[more], at[more], least[more], s[more, :size], r[more, :size]
            if not len(live):
                break
            line = np.arange(len(live))
            keep = np.arange(size) != (at + 1)[:, None]
            s[line, at] = self.whole[least]
            s = s[keep].reshape(-1, size - 1)
            r[line, at] = r[line, at + 1]  # of the pair that goes; NONE stays at the end
            r = r[keep].reshape(-1, size - 1)
            for place in (at - 1, at):
                ok = np.flatnonzero((place >= 0) & (place < size - 2))
                r[ok, place[ok]] = self.ranks(s[ok, place[ok]], s[ok, place[ok] + 1])
        return symbols[np.arange(width) < sizes[:, None]], sizes


class Words:
    """Tokens of texts by their distinct pieces of words, without a cache.

    Short pieces of Latin letters or of signs alone need no pattern and have their merges applied here, which gives the
    same ids as the whole tokenizer for a fraction of its time; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.merges = Merges(json.load(file)["model"])
        (self.mark,) = self.ids(MARK)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, start, size): the ids of piece k are pool[start[k] : start[k] + size[k]]."""
        raw, offsets = buffers(pieces)
        n, length = len(pieces), np.diff(offsets)
        second = after_lead(raw)
        small = raw + ((CAPITAL[raw] | (second & CAPITAL_2[raw])).astype(np.uint8) << 5)
        lead = np.append(second[1:], False) & (raw == LEAD)
        letter = SMALL[small] | (second & SMALL_2[small]) | (lead & np.append(SMALL_2[small[1:]], False))
        counts = np.zeros((2, len(raw) + 1), np.int64)
        np.cumsum(letter, out=counts[0, 1:])
        np.cumsum(SIGN[raw], out=counts[1, 1:])
        simple = ((counts[:, offsets[1:]] - counts[:, offsets[:-1]]) == length).any(0) & (length <= SIMPLE_BYTES)
        size = np.zeros(n, np.int64)
        order, pool = [], []
        for width in np.unique(length[simple]).tolist():
            mine = np.flatnonzero(simple & (length == width))
            ids, size[mine] = self.merges(small[offsets[mine][:, None] + np.arange(width)])
            order.append(mine)
            pool.append(ids)
        together, alone = [], []
        others = np.flatnonzero(~simple)
        for k in others.tolist():
            text = raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
            (alone if MARK in text else together).append((k, text))
        found = [(k, np.array(self.ids(text), np.int64)) for k, text in alone]
        if together:  # in one go, told apart by the mark between them
            ids = np.array(self.ids(f" {MARK} ".join([t for _, t in together])), np.int64)
            cuts = np.concatenate(([-1], np.flatnonzero(ids == self.mark), [len(ids)])).tolist()
            assert len(cuts) == len(together) + 1
            found += [(k, ids[a + 1 : b]) for (k, _), a, b in zip(together, cuts[:-1], cuts[1:], strict=True)]
        for k, ids in found:
            size[k] = len(ids)
        order.append(np.array([k for k, _ in found], np.int64))
        pool += [ids for _, ids in found]
        order = np.concatenate(order)
        start = np.zeros(n, np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([*pool, np.zeros(0, np.int64)]).astype(np.uint32), start, size

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts (binary, no nulls), each with the end token."""
        pieces, counts = cut_words(*buffers(texts))
        coded = pieces.dictionary_encode()
        pool, start, size = self.of_pieces(coded.dictionary)
        # The end token is one more piece, put after those of each text.
        start, size, pool = np.append(start, len(pool)), np.append(size, 1), np.append(pool, np.uint32(END_ID))
        ends = np.cumsum(counts)
        k = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(size) - 1)
        n = size[k]
        upto = np.cumsum(n)
        ids = pool[np.repeat(start[k] - (upto - n), n) + np.arange(upto[-1] if len(k) else 0)]
        return ids, np.concatenate(([0], upto[ends + np.arange(len(ends))]))


@sole
def words_of(tokenizer: str) -> Words:
    import public_tokenizers

    return Words(public_tokenizers.path(tokenizer))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers, well mixed."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def token_slots(n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each id in the hashed vector, and the projection of the slots."""
    slots = (mixed(np.arange(n_ids)) % np.uint64(VECTOR)).astype(np.int64)
    signs = mixed(np.arange(VECTOR * DIMENSIONS) + (1 << 32)) & np.uint64(1)
    return slots, (signs.astype(np.float64) * 2 - 1).reshape(VECTOR, DIMENSIONS)


def coordinates(ids: np.ndarray, offsets: np.ndarray, n_ids: int = 1 << 16) -> np.ndarray:
    """(documents, DIMENSIONS) integers below 2 ** BITS from the documents' hashed token counts."""
    n = len(offsets) - 1
    slots, project = token_slots(n_ids)
    row = np.repeat(np.arange(n) * VECTOR, np.diff(offsets))
    counts = np.bincount(row + slots[ids], minlength=n * VECTOR).reshape(n, VECTOR).astype(np.float64)
    unit = counts / np.sqrt((counts * counts).sum(1, keepdims=True))
    spread = (unit @ project) / np.sqrt(VECTOR)  # within -1 and 1
    return np.clip(((np.tanh(4 * spread) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points (rows, dimensions): coordinates to transposed index, then bits interleaved."""
    x = x.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _kind(wide: bool) -> str:
    return "<u4" if wide else "<u2"


def _tokenize(tokenizer: str, wide: bool):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, kind = words_of(tokenizer), np.dtype(_kind(wide))
        n_ids = of.tokenizer.get_vocab_size()
        if n_ids > 1 << 8 * kind.itemsize:
            raise ValueError(f"{tokenizer} has {n_ids} ids: wide=True is needed")
        for batch in batches:
            column = batch.column("t")
            _, offsets = buffers(column)
            for first, last in groups(offsets, WORD_BYTES):
                ids, at = of.tokens(column.slice(first, last - first))
                keys = hilbert(coordinates(ids, at, max(1 << 16, n_ids)))
                data = pa.Array.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer((at * kind.itemsize).astype(np.int64)), pa.py_buffer(ids.astype(kind))])
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([pa.array(keys), rows.column("tie"), rows.column("doc_id"), pa.array(np.diff(at)), data.cast(pa.binary())], names=["key", "tie", "doc_id", "n", "ids"])

    return run


def cut(pieces: list[tuple], lengths: list[int]) -> Iterator[tuple[int, int, tuple, int, int]]:
    """Lay pieces (row, first, last) end to end into parts of these lengths: (part, offset, row, first, last)."""
    part, at = 0, 0
    for row, a, b in pieces:
        while a < b:
            n = min(b - a, lengths[part] - at)
            yield part, at, row, a, a + n
            a, at = a + n, at + n
            if at == lengths[part]:
                part, at = part + 1, 0


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(wide: bool):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        sequence, held, fill = 0, [], 0
        out: list[tuple] = []

        def emit(pieces: list[tuple], lengths: list[int]) -> None:
            nonlocal sequence
            for part, at, (doc_id, ids), a, b in cut(pieces, lengths):
                out.append((doc_id, a, b - a, zlib.crc32(ids[a:b]), len(ids), base + sequence + part, at))
            sequence += len(lengths)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(data.as_buffer(), _kind(wide)).astype("<u4")
                held.append(((doc_id, ids), 0, len(ids)))
                fill += len(ids)
                if fill >= SEQUENCE:
                    whole, rest = divmod(fill, SEQUENCE)
                    row, a, b = held[-1]
                    tail = [(row, b - rest, b)] if rest else []
                    held[-1] = (row, a, b - rest)
                    emit(held, [SEQUENCE] * whole)
                    held, fill = tail, rest
            yield batch_of(out)
            out = []
        if fill:
            emit(held, [1 << k for k in range(SEQUENCE.bit_length(), -1, -1) if fill >> k & 1])
            yield batch_of(out)

    return run


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER, wide: bool = False) -> DataFrame:
    """docs(doc_id, text) -> key, tie, doc_id, n, ids (little-endian, 16 bits each, or 32 if wide)."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t"), F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("tie"))
    return df.mapInArrow(_tokenize(tokenizer, wide), "key long, tie long, doc_id long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, wide: bool = False) -> DataFrame:
    """docs(doc_id, text) -> one row for each piece: its ids are those of its document from start on."""
    small_batches(docs.sparkSession)
    rows = written(tokenized(docs, tokenizer, wide), "pack-tokens")  # the ties are as they are written from here on
    n_tokens = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // TASK_TOKENS))
    return rows.select("key", "tie", "doc_id", "ids").repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie", "doc_id").mapInArrow(_pack(wide), PIECES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
