"""Comparison of two texts by matching blocks, and language context between neighbouring lines."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx

CONTEXT_OVERLAP, CONTEXT_GAP, CONTEXT_LINES = 0.20, 90, 3


def _per_pair(df: DataFrame, keys: list[str], schema: str, work) -> DataFrame:
    """work(a, b) gives rows of each pair of token arrays; Arrow batches in and out, no shuffle."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                head = tuple(getattr(r, k) for k in keys)
                rows += [head + tuple(x) for x in work(list(r.a), list(r.b))]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, "a", "b").mapInPandas(run, f"{kinds}, {schema}")


def similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs(keys, a, b: arrays): matched elements and ratio, twice the matches over both lengths."""
    def work(a, b):
        m = SequenceMatcher(None, a, b, autojunk=False)
        n = sum(x.size for x in m.get_matching_blocks())
        return [(n, 2.0 * n / (len(a) + len(b)) if a or b else 1.0)]

    return _per_pair(pairs, keys, "matched long, ratio double", work)


def similar(pairs: DataFrame, keys: list[str], least: float) -> DataFrame:
    """pairs(keys, a, b: arrays): whether the ratio is least or more.

    The longest block is no shorter than the common start, so a long common start decides without the quadratic search.
    """
    def work(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        total = len(a) + len(b)
        return [(2.0 * n >= least * total or SequenceMatcher(None, a, b, autojunk=False).ratio() >= least,)]

    return _per_pair(pairs, keys, "similar boolean", work)


def matching_blocks(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return _per_pair(pairs, keys, "a_start long, b_start long, size long", lambda a, b: [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size])


def differences(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each difference, numbered: kind (replace, missing, added) and both sides' words.

    A replacement of unequal length is cut: as many words as both have are replaced, the rest is missing or added.
    """
    def work(a, b):
        out = []
        for op, i, i2, j, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if op == "equal":
                continue
            n = min(i2 - i, j2 - j)
            parts = (("replace", a[i : i + n], b[j : j + n]), ("missing", a[i + n : i2], []), ("added", [], b[j + n : j2]))
            out += [(kind, " ".join(x), " ".join(y)) for kind, x, y in parts if x or y]
        return [(k, *row) for k, row in enumerate(out, 1)]

    return _per_pair(pairs, keys, "number long, kind string, a_text string, b_text string", work)


def difference_line() -> Column:
    """A difference as a line of the report."""
    a, b = F.col("a_text"), F.col("b_text")
    other = F.when(F.col("kind") == "missing", F.format_string(tx.MISSING_LINE, a)).otherwise(F.format_string(tx.ADDED_LINE, b))
    return F.when(F.col("kind") == "replace", F.format_string(tx.REPLACED_LINE, a, b)).otherwise(other)


def analysed(lines: DataFrame) -> DataFrame:
    """Append the counts of scripts, score_* of each language, language and conflict.

    What several results need is a column of its own, so that no expression is worked out twice.
    """
    text, accented = F.col("a_text"), F.col("a_accented")
    df = lines.withColumn("a_text", F.trim("text"))
    df = df.withColumns({"a_strange": tx.unfamiliar(text), "a_words": tx.words(text), "a_accented": text.rlike(tx.NOT_ASCII)})
    df = df.withColumns({"a_listed": tx.listed_words(F.col("a_words")), "a_n": F.size("a_words"), **tx.script_counts(text, F.col("a_strange"))})
    df = df.withColumns({f"score_{k}": v for k, v in tx.language_scores(text, F.col("a_listed"), accented).items()})
    ranked = tx.best_language({k: F.col(f"score_{k}") for k in tx.LANGUAGES})
    df = df.withColumns(dict(zip(("a_lang", "a_best", "a_second"), ranked, strict=True)))
    language, conflict = tx.analysis({k: F.col(k) for k in tx.SCRIPTS}, tuple(F.col(c) for c in ("a_lang", "a_best", "a_second")), text, accented, F.col("a_n"))
    return df.withColumns({"language": language, "conflict": conflict}).drop(*[c for c in df.columns if c.startswith("a_") and c not in lines.columns])


def _counted() -> dict[str, Column]:
    """Scores as they count for neighbours: only those of lines in Latin letters."""
    scored = (F.col("cyrillic") + F.col("greek") + F.col("other_letters") + F.col("han") == 0) & (F.col("latin") > 0)
    return {k: F.when(scored, F.col(f"score_{k}")).otherwise(0) for k in tx.LANGUAGES}


def context_languages(lines: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """keys, tie, context: the language that a line and its neighbours in the same block point to, or null.

    A neighbour lies within CONTEXT_GAP or CONTEXT_LINES heights of the higher line of both. Lines are dealt into horizontal
    bands by where they begin, as high as the highest line of their page and that distance together, and joined with the
    bands at hand; a page of any length costs its lines times the lines of three bands.
    """
    own = analysed(lines).withColumns({f"c_{k}": v for k, v in _counted().items()})
    own = own.select(*keys, tie, "x1", "y1", "x2", "y2", *[f"c_{k}" for k in tx.LANGUAGES])
    high_most = F.max(F.greatest(F.col("y2") - F.col("y1"), F.lit(1)))
    bands = own.groupBy(*keys).agg((high_most + F.greatest(F.lit(CONTEXT_GAP), CONTEXT_LINES * high_most)).alias("band_height"))
    a = own.join(bands, keys).withColumn("band", F.floor(F.col("y1") / F.col("band_height"))).drop("band_height")
    b = a.withColumn("band", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
    l, r = g.corners(_row("a")), g.corners(_row("b"))
    wide = lambda c: F.greatest(c[2] - c[0], F.lit(1))
    high = lambda c: F.greatest(c[3] - c[1], F.lit(1))
    across, _ = g.overlap(l, r)
    _, gap = g.gaps(l, r)
    same = (across / F.least(wide(l), wide(r)) >= CONTEXT_OVERLAP) & (gap <= F.greatest(F.lit(CONTEXT_GAP), CONTEXT_LINES * F.greatest(high(l), high(r))))
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "band"]] + [F.col(f"a.{tie}") != F.col(f"b.{tie}"), same]
    near = a.alias("a").join(b.alias("b"), on).groupBy(*[F.col(f"a.{k}").alias(k) for k in [*keys, tie]]).agg(*[F.sum(f"b.c_{k}").alias(f"n_{k}") for k in tx.LANGUAGES])
    df = own.join(near, [*keys, tie], "left")
    total = {k: 2 * F.col(f"c_{k}") + F.coalesce(F.col(f"n_{k}"), F.lit(0)) for k in tx.LANGUAGES}
    df = df.select(*keys, tie, *[v.alias(f"t_{k}") for k, v in total.items()])
    best, first, second = tx.best_language({k: F.col(f"t_{k}") for k in tx.LANGUAGES})
    return df.select(*keys, tie, *[f"t_{k}" for k in tx.LANGUAGES], F.when((first >= 2) & (first > second), best).alias("context"))


class _row:
    def __init__(self, alias: str):
        self.alias = alias

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.alias}.{name}")


def applied_reviews(lines: DataFrame) -> DataFrame:
    """lines(text, confidence, context, candidate, candidate_score, similar) with the candidate taken where the rules allow it.

    It must not be in conflict, not turn Latin text to Chinese or back, be similar enough, and settle a conflict, be surer,
    keep a specific language, or restore expected accents.
    """
    old = analysed(lines).withColumnRenamed("language", "old_language").withColumnRenamed("conflict", "old_conflict").drop(*tx.SCRIPTS, *[f"score_{k}" for k in tx.LANGUAGES])
    df = analysed(old.withColumn("was", F.col("text")).withColumn("text", F.col("candidate"))).withColumn("text", F.col("was"))
    swaps = tx.replacements(F.col("text"), F.coalesce("context", "old_language"))
    target = F.aggregate(swaps, F.col("text"), lambda t, r: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), r["token"], F.lit(r"(?![\p{L}\p{N}_])")), r["canonical"]))
    score, sure = F.col("candidate_score"), F.col("confidence")
    latin, chinese = ("en", "de", "fr", "es", "latin"), ("zh", "zh+latin")
    barred = (
        (F.col("candidate") == "") | (F.col("candidate") == F.col("text")) | F.col("conflict") | ~F.col("similar")
        | (F.col("old_language").isin(*latin) & F.col("language").isin(*chinese))
        | (F.col("old_language").isin(*chinese) & ~F.col("language").isin(*chinese))
    )
    good = (
        F.col("old_conflict") | (score >= sure + 0.015)
        | (F.col("old_language").isin("de", "fr", "es") & (F.col("language") == F.col("old_language")) & (score >= sure - 0.01))
        | ((target != F.col("text")) & (tx.folded(F.col("candidate")) == tx.folded(target)) & (score >= sure - 0.08))
    )
    taken = ~barred & good
    return df.select(
        *[c for c in lines.columns if c not in ("text", "confidence")], taken.alias("reviewed"), F.when(taken, F.col("candidate")).otherwise(F.col("text")).alias("text"),
        F.when(taken, score).otherwise(sure).alias("confidence"), F.when(taken, F.col("language")).otherwise(F.col("old_language")).alias("language"), F.when(taken, F.col("text")).alias("primary_text"),
    )
