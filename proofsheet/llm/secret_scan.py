"""Secret scans: fixed patterns plus a token-efficiency test.

A tokenizer's vocabulary packs natural language and code into few tokens; a random string falls apart into
many. A run of key characters, without what fixed patterns cover, is reported if it has few characters per token as
a whole, or those of its parts that a window of MIN_RUN characters finds so, unless it is a known digest (hex
of a usual digest length, UUID), an alphabet, or an identifier (parts of one case that mostly tokenize like words, or short numbers).

A first pass over the Arrow bytes finds texts that can match at all: those with a run of MIN_RUN key characters
or a ``:`` or ``=``. Only these are decoded and searched.

Defined cases: a null text is empty and has no span; positions count code points, ends are exclusive; null ids
and repeated rows give one row each; a very long text is searched as a whole, its long runs in parts; an empty table gives
no rows. scan and stage carry all other columns as they are; scan's own result columns replace any of their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import buffers, frugal, sole
from .common import small_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_RUN = 6, 20, 24, 20
LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
#: At most this many characters per token: random base64 has about 1.5, hex 1.9, identifiers of words 3 and more.
MAX_CHARS_PER_TOKEN = 2.1
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})")
IDENTIFIER = re.compile(r"[+/_=-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,10})(?:[+/_=-]+|$))+")
LETTERS = re.compile(r"[A-Za-z]+")
ALPHABETS = "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz0123456789+/0123456789abcdefghijklmnopqrstuvwxyz"
WHOLE_DIGEST = re.compile(rf"(?<![A-Za-z0-9]){DIGEST.pattern}(?![A-Za-z0-9])")
SUB_RUN = re.compile(r"[A-Za-z0-9]+")
NUMBER = re.compile(r"[0-9]{1,10}")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Runs are tokenized in parts of this length, which bounds the work on very long ones.
PART = 256
MARK = "[SECRET]"

KEY_BYTES = np.zeros(256, bool)
KEY_BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


@sole
def encoding(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def chars_per_token(run: str, vocabulary: str = VOCABULARY) -> float:
    enc = encoding(vocabulary)
    return len(run) / sum(len(enc.encode_ordinary(run[i : i + PART])) for i in range(0, len(run), PART))


def of_words(parts: list[str], vocabulary: str = VOCABULARY) -> bool:
    """Whether half of the letters are in parts that tokenize like words, and no other part is as long as a key."""
    odd = [x for x in parts if chars_per_token(x, vocabulary) <= min(MAX_CHARS_PER_TOKEN, len(x) - 1)]
    return max(map(len, odd), default=0) < MIN_RUN and 2 * sum(map(len, odd)) <= sum(map(len, parts))


def looks_random(run: str, vocabulary: str = VOCABULARY) -> bool:
    if DIGEST.fullmatch(run) or run.lower() in ALPHABETS or chars_per_token(run, vocabulary) > MAX_CHARS_PER_TOKEN:
        return False
    return not (IDENTIFIER.fullmatch(run) and of_words(LETTERS.findall(run), vocabulary))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def stretches(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs without what base spans and digests in them cover; MIN_RUN characters at least. base is in order of starts."""
    first = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))  # how far the spans up to each one go
    for m in RUN.finditer(text):
        at, end = m.span()
        taken = [(s, e) for s, _, e in base[bisect_right(reach, at) : bisect_left(first, end)] if at < e]
        taken += [d.span() for d in WHOLE_DIGEST.finditer(text, at, end)]
        for s, e in [*sorted(taken), (end, end)]:
            if s - at >= MIN_RUN:
                yield at, s
            at = max(at, e)


def in_many_tokens(run: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Which characters are in a window of whole tokens, the shortest of MIN_RUN characters or more from its first token on,
    that has few characters per token."""
    enc = encoding(vocabulary)
    ends = np.cumsum([len(enc.decode_single_token_bytes(t)) for i in range(0, len(run), PART) for t in enc.encode_ordinary(run[i : i + PART])])
    starts = np.concatenate(([0], ends[:-1]))
    last = np.searchsorted(ends, starts + MIN_RUN)
    first = np.flatnonzero(last < len(ends))
    last = last[first]
    good = ends[last] - starts[first] <= MAX_CHARS_PER_TOKEN * (last - first + 1)
    inside = np.zeros(len(run) + 1, np.int64)
    np.add.at(inside, starts[first[good]], 1)
    np.add.at(inside, ends[last[good]], -1)
    return np.cumsum(inside[:-1]) > 0


def dense(run: str, vocabulary: str = VOCABULARY) -> Iterator[tuple[int, int]]:
    """Parts of a run that look random: those that meet windows of at least MIN_RUN characters in many tokens.

    The windows slide over the tokens of the whole run. A window that meets a part between separators takes all of it and
    its neighbours that are no words or numbers, as a key must not stay in pieces; words at both ends go again, and paths of mostly words and short numbers go whole.
    """
    inside = in_many_tokens(run, vocabulary)
    parts = [m.span() for m in SUB_RUN.finditer(run)]
    hit = [bool(inside[a:b].any()) for a, b in parts]
    more = lambda i: hit[i] or not (NUMBER.fullmatch(run[slice(*parts[i])]) or word_like(run[slice(*parts[i])], vocabulary))
    k = 0
    while k < len(parts):
        if not hit[k]:
            k += 1
            continue
        lo = hi = k
        while lo and more(lo - 1):
            lo -= 1
        while hi + 1 < len(parts) and more(hi + 1):
            hi += 1
        k = hi + 1
        while lo < hi and word_like(run[slice(*parts[lo])], vocabulary):
            lo += 1
        while lo < hi and word_like(run[slice(*parts[hi])], vocabulary):
            hi -= 1
        a, b = parts[lo][0], parts[hi][1]
        found = [run[slice(*p)] for p in parts[lo : hi + 1]]
        plain = sum(len(x) for x in found if len(x) <= 3 or NUMBER.fullmatch(x) or word_like(x, vocabulary))
        if b - a >= MIN_RUN and 2 * plain <= sum(map(len, found)) and looks_random(run[a:b], vocabulary):
            yield a, b


def word_like(part: str, vocabulary: str = VOCABULARY) -> bool:
    """Whether a part is a word: letters of one case, three characters a token at least."""
    return len(part) > 3 and WORD.fullmatch(part) is not None and chars_per_token(part, vocabulary) >= 3


def all_spans(text: str, base: list[tuple[int, int, int]], vocabulary: str = VOCABULARY) -> list[tuple[int, int, int]]:
    """Base spans and the random stretches outside them: a stretch as a whole, or its dense parts."""
    more = []
    for a, b in stretches(text, base):
        run = text[a:b]
        if looks_random(run, vocabulary):
            more.append((a, 3, b))
        else:
            more += [(a + s, 3, a + e) for s, e in dense(run, vocabulary)]
    return sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def possible(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold a span: a run of MIN_RUN key bytes (runs over a row's end count for both) or : or =."""
    hit = np.zeros(len(offsets) - 1, bool)
    if len(raw) == 0:
        return hit
    breaks = np.concatenate(([-1], np.flatnonzero(~KEY_BYTES[raw]), [len(raw)]))
    long = np.flatnonzero(np.diff(breaks) > MIN_RUN)
    first = np.searchsorted(offsets, breaks[long] + 1, side="right") - 1
    last = np.searchsorted(offsets, breaks[long + 1] - 1, side="right") - 1
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        hit[a : b + 1] = True
    signs = np.flatnonzero((raw == 58) | (raw == 61))
    hit[np.searchsorted(offsets, signs, side="right") - 1] = True
    return hit


NOTHING = hashlib.sha256(b"").hexdigest()
FOUND = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def _scan(vocabulary: str, source: str, redact: str | None):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(source)
            raw, offsets = buffers(text)
            n = batch.num_rows
            counts, digests, spans = np.zeros((4, n), np.int64), [NOTHING] * n, [""] * n
            clean: dict[int, str] = {}
            for i in np.flatnonzero(possible(raw, offsets)).tolist():
                t = text[i].as_py()
                base = base_spans(t)
                every = all_spans(t, base, vocabulary)
                if not every:
                    continue
                for _, kind, _ in every:
                    counts[kind, i] += 1
                if base:
                    digests[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(every)
                if redact is not None:
                    clean[i] = redacted(t, every)
            if redact is None:
                names = [c for c in batch.schema.names if c != source]
                kept = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, counts), pa.array(digests), pa.array(spans)], names=[*names, "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])
            else:
                yield _replaced(batch, clean, source, redact)

    return run


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Text with each maximal stretch of overlapping spans replaced by MARK."""
    parts, at, i = [], 0, 0
    while i < len(spans):
        a, _, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][2])
        parts += [text[at:a], MARK]
        at, i = b, i + 1
    return "".join([*parts, text[at:]])


def _replaced(batch: pa.RecordBatch, clean: dict[int, str], source: str, column: str) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c != source]
    arrays = [batch.column(c) for c in names]
    if clean:
        k = names.index(column)
        old = arrays[k]
        parts, at = [], 0
        for i in sorted(clean):
            parts += [old.slice(at, i - at), pa.array([clean[i]], old.type)]
            at = i + 1
        arrays[k] = pa.concat_arrays([*parts, old.slice(at)])
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _free(name: str, columns: list[str]) -> str:
    """name, made longer until no column has it."""
    while name in columns:
        name += "_"
    return name


def scan(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs without its text column, with the counts, base_sha256 and all spans in place of any columns of these names."""
    small_batches(docs.sparkSession)
    made = [f.split()[0] for f in FOUND.split(", ")]
    keep = [c for c in docs.columns if c != text and c not in made]
    source = _free("s_text", keep)
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias(source))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), FOUND])
    return df.mapInArrow(_scan(vocabulary, source, None), schema)


def stage(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with every span replaced by MARK; n_chars follows. Columns as in the input."""
    small_batches(docs.sparkSession)
    source = _free("s_text", docs.columns)
    df = docs.withColumn(source, F.coalesce(F.col(text), F.lit("")))
    df = df.mapInArrow(_scan(vocabulary, source, text), docs.schema)
    return df.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else df


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
