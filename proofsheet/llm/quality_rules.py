"""Line-first quality rules [native].

Every line is judged by itself: punctuation (mostly signs, repeated marks, no letter or digit at all), navigation (menus of
known words, parts between separators) and boilerplate (notices in four languages). Failing lines are removed, and a
document that loses too much of its text is rejected. Only DataFrame functions run.

Defined cases: a null text counts as the empty text, which has no words and is rejected; blank lines break no rule; a very
long text is worked on by itself, in memory in proportion to it; null ids and repeated rows are kept as they are, one
result per row; an empty table gives no rows; other columns of the input are not touched, but quality's own q_* columns
replace any of these names (stage wraps its rows and so keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CONTROL_SPACES, count_char, unwrapped, words_of, wrapped

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: A document is rejected if less than this percentage of its word characters is left.
MIN_LEFT_PERCENT = 50
#: Notices, prompts and licence lines in the corpus's languages, as whole words.
BOILERPLATE = "|".join((
    "all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings|notice)|(enable|requires) javascript|lorem ipsum|click here",
    "sign up (now|here|today|for)|log in (now|here|to)|subscribe (now|here|today|to our)|(licensed|released) under|under the [a-z]+ license|powered by|copyright (©|[(]c[)]|[0-9]{4})",
    "alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|impressum|hier klicken|cookie-richtlinie|newsletter abonnieren",
    "tous droits réservés|politique de confidentialité|conditions d.utilisation|mentions légales|cliquez ici|abonnez-vous",
    "todos los derechos reservados|política de privacidad|términos (de uso|y condiciones)|aviso legal|haga clic aquí|suscríbase",
))
#: Words of menus in these languages; a line of nothing else is a menu.
MENU = "|".join((
    "home|about( us)?|contact( us)?|log ?in|sign ?(in|up|out)|register|menu|search|help|more|news|blog|shop|cart|faq|next|previous|sitemap|careers",
    "startseite|über uns|kontakt|anmelden|registrieren|suche|hilfe|warenkorb|weiter|zurück|mehr",
    "accueil|à propos|connexion|inscription|recherche|aide|panier|suivant|précédent|plus",
    "inicio|acerca de|contacto|iniciar sesión|registrarse|buscar|ayuda|carrito|siguiente|anterior|más",
))
#: Signs between the parts of menus and paths of places.
BETWEEN = "|>»›·•→"
#: Lines longer than this are prose, whatever phrases they mention.
SHORT_BYTES = 200
_BLANK = "\\x20\\x09-\\x0D"
_PART = f"[^{_BLANK}{BETWEEN}]+(?:[{_BLANK}][^{_BLANK}{BETWEEN}]+){{0,2}}"
BOILERPLATE_LINE = f"(?:^|[^\\p{{L}}])(?:{BOILERPLATE})(?:[^\\p{{L}}]|\\z)"
MENU_LINE = f"^[{_BLANK}]*(?:(?:{MENU})(?:[{_BLANK}{BETWEEN}/,:-]+|\\z)){{2,}}\\z"
PLACES_LINE = f"^[{_BLANK}]*{_PART}(?:[{_BLANK}]*[{BETWEEN}][{_BLANK}]*{_PART}){{2,}}[{_BLANK}]*\\z"
NO_LETTER_LINE = f"^[^\\p{{L}}\\p{{N}}]*[^\\p{{L}}\\p{{N}}{_BLANK}][^\\p{{L}}\\p{{N}}]*\\z"


def line_rule(line: Column) -> Column:
    """Name of the first rule that the line breaks, else null. Words are counted as blanks plus one."""
    words = count_char(line, " ") + 1
    symbols, marks, bars = count_char(line, "#*$%&<>"), count_char(line, "!?"), count_char(line, "|")
    short = F.octet_length(line) <= SHORT_BYTES
    return (
        F.when((bars >= 3) & (bars * 4 > words), "navigation")
        .when((symbols >= 3) & (symbols * 2 > words), "punctuation")
        .when((marks >= 4) & (marks > words), "punctuation")
        .when(line.rlike(NO_LETTER_LINE), "punctuation")
        .when(short & (line.rlike(PLACES_LINE) | line.rlike(f"(?iu){MENU_LINE}")), "navigation")
        .when(short & line.rlike(f"(?iu){BOILERPLATE_LINE}"), "boilerplate")
    )


def repeated_words(hashes: Column) -> Column:
    """From the array of window hashes: words that lie in a window whose hash occurs twice or more."""
    n = F.size(hashes)

    def covered(found: Column) -> Column:
        def twice(k: Column) -> Column:
            h = F.get(found, k)["h"]
            return F.coalesce(F.get(found, k - 1)["h"] == h, F.lit(False)) | F.coalesce(F.get(found, k + 1)["h"] == h, F.lit(False))

        at = F.filter(F.sequence(F.lit(0), F.size(found) - 1), twice)
        places = F.array_sort(F.transform(at, lambda k: F.get(found, k)["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # The sorted array is bound once, as the element of a one-element array.
    slow = F.get(F.transform(F.array(ordered), covered), F.lit(0))
    return F.when(n == F.size(F.array_distinct(hashes)), 0).otherwise(slow)


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append q_* columns to docs (in place of any of these names): counts, base verdict, lines removed, the cleaned text
    and q_kept."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("q_text", t).withColumn("q_words", words_of(F.col("q_text")))
    df = df.withColumn("q_hashes", F.transform("q_words", lambda w: F.xxhash64(w)))
    n = F.size("q_words")
    # Hashes of 2, 4 and 8 words in a row, each from two of the shorter ones.
    of = "q_hashes"
    for k in (1, 2, 4):
        df = df.withColumn(f"q_hashes_{2 * k}", F.zip_with(of, F.slice(of, k + 1, F.greatest(F.lit(0), n - k)), lambda a, b: F.xxhash64(a, b)))
        of = f"q_hashes_{2 * k}"
    df = df.withColumn("q_windows", F.slice(of, 1, F.greatest(F.lit(0), n - (WINDOW - 1))))
    lines = F.split("q_text", "\n")
    blank = F.lit(r"[^ \t\n\x0b\f\r]")
    df = df.withColumn("q_lines", lines)
    worded = F.filter("q_lines", lambda x: F.regexp_like(x, blank))
    df = df.withColumn("q_worded", worded)
    df = df.withColumn("q_left", F.filter("q_lines", lambda x: line_rule(x).isNull()))
    df = df.withColumn("q_clean", F.array_join("q_left", "\n"))
    spaces = count_char(F.col("q_text"), " " + CONTROL_SPACES)
    df = df.withColumns({
        "q_n_words": n.cast("long"),
        "q_word_chars": (F.length("q_text") - spaces).cast("long"),
        "q_n_symbols": count_char(F.col("q_text"), SYMBOLS).cast("long"),
        "q_n_dup_lines": (F.size("q_worded") - F.size(F.array_distinct("q_worded"))).cast("long"),
        "q_n_repeat_words": repeated_words(F.col("q_windows")).cast("long"),
        "q_lines_removed": (F.size("q_lines") - F.size("q_left")).cast("long"),
        "q_chars_left": (F.length("q_clean") - count_char(F.col("q_clean"), " " + CONTROL_SPACES)).cast("long"),
    })
    df = df.withColumn("q_base_failed", (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_n_words")))
    left = 100 * F.col("q_chars_left") >= MIN_LEFT_PERCENT * F.col("q_word_chars")
    df = df.withColumn("q_kept", ~F.col("q_base_failed") & left)
    return df.drop("q_text", "q_words", "q_hashes", "q_hashes_2", "q_hashes_4", "q_hashes_8", "q_windows", "q_lines", "q_worded", "q_left")


def stage(docs: DataFrame) -> DataFrame:
    """Kept documents with their failing lines removed; n_chars follows the text. Columns as in the input."""
    df = quality(wrapped(docs, q_source=F.col("text")), "q_source")
    # A filter below the projections would hold all their expressions again, those inside lambdas once an element. It
    # can't move below a column that is not deterministic.
    df = df.withColumn("q_row", F.monotonically_increasing_id()).filter(F.col("q_kept") & (F.col("q_row") >= 0))
    return unwrapped(df, docs.columns, text=F.col("q_clean"), n_chars=F.length("q_clean").cast("long"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed", "chars_left")
    return df.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in names])


_LINE_SQL = f"""CASE
  WHEN strlen(x) - strlen(replace(x, '|', '')) >= 3 AND (strlen(x) - strlen(replace(x, '|', ''))) * 4 > strlen(x) - strlen(replace(x, ' ', '')) + 1 THEN false
  WHEN strlen(x) - strlen(regexp_replace(x, '[#*$%&<>]', '', 'g')) >= 3 AND (strlen(x) - strlen(regexp_replace(x, '[#*$%&<>]', '', 'g'))) * 2 > strlen(x) - strlen(replace(x, ' ', '')) + 1 THEN false
  WHEN strlen(x) - strlen(regexp_replace(x, '[!?]', '', 'g')) >= 4 AND strlen(x) - strlen(regexp_replace(x, '[!?]', '', 'g')) > strlen(x) - strlen(replace(x, ' ', '')) + 1 THEN false
  WHEN regexp_matches(x, '{NO_LETTER_LINE}') THEN false
  WHEN strlen(x) <= {SHORT_BYTES} AND (regexp_matches(x, '{PLACES_LINE}') OR regexp_matches(x, '(?i){MENU_LINE}') OR regexp_matches(x, '(?i){BOILERPLATE_LINE}')) THEN false
  ELSE true END"""

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
        FROM w, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 0) + 1)) AS r(i) WHERE len(ws) >= {WINDOW}),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least({WINDOW}, i - coalesce(p, i - {WINDOW}))) AS n_rep
        FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM rep) GROUP BY rid),
f AS (SELECT w.doc_id, t, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS worded, ls,
        list_filter(ls, lambda x: {_LINE_SQL}) AS keep, coalesce(n_rep, 0) AS n_rep
      FROM w LEFT JOIN cov USING (rid)),
g AS (SELECT *, length(regexp_replace(array_to_string(keep, chr(10)), '[\\x20\\x09-\\x0D]', '', 'g')) AS chars_left,
        n_words < {MIN_WORDS} OR 100 * n_rep > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(len(worded) - len(list_distinct(worded)) AS BIGINT) AS n_dup_lines, CAST(n_rep AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * chars_left >= {MIN_LEFT_PERCENT} * word_chars AS kept,
  CAST(len(ls) - len(keep) AS BIGINT) AS lines_removed, CAST(chars_left AS BIGINT) AS chars_left
FROM g
"""
