"""Column expressions on recognised text: tokens, scripts, language scores, spellings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: word lists, accents, names and limits that results depend on ----
LANGUAGE_WORDS = {
    "en": ("the", "and", "with", "for", "from", "ingredients", "warning", "made", "product", "contains", "use", "keep"),
    "de": ("der", "die", "das", "und", "mit", "für", "aus", "zutaten", "achtung", "hergestellt", "enthält", "enthalt", "nicht", "bei", "hinweise", "kinder", "grosse", "große", "kuhl", "kühl"),
    "fr": ("le", "la", "les", "des", "avec", "pour", "ingrédients", "ingredients", "attention", "fabriqué", "fabrique", "contient", "dans", "sur", "france", "precautions", "précautions", "temperature", "température"),
    "es": ("el", "la", "los", "las", "con", "para", "ingredientes", "advertencia", "fabricado", "contiene", "producto", "mantener", "del", "espana", "españa", "informacion", "información", "fabricacion", "fabricación", "atencion", "atención"),
}
ACCENTS = {"de": "äöüÄÖÜß", "fr": "àâçèêëîïôùûÿœæÀÂÇÈÊËÎÏÔÙÛŸŒÆ", "es": "ñÑ¿¡"}
SHARED_ACCENTS = "áéíóúÁÉÍÓÚ"
CANONICAL_WORDS = {
    "de": ("für", "größe", "enthält", "kühl", "außerhalb", "gemäß"),
    "fr": ("fabriqué", "ingrédients", "précautions", "température", "qualité"),
    "es": ("españa", "información", "fabricación", "atención", "precaución"),
}
LANGUAGE_NAMES = {
    "zh": "中文", "zh+latin": "中西混合", "en": "英文", "de": "德文", "fr": "法文", "es": "西班牙文", "latin": "拉丁语系", "numeric": "数字/符号", "conflict": "语言冲突", "unknown": "未知",
}
CRITICAL_KEYWORDS = (
    "ITEM", "MODEL", "LOT", "BATCH", "DATE", "EXP", "WARNING", "STORAGE", "CAPACITY", "型号", "编号", "批号", "日期", "容量", "条码", "警告", "注意",
)
LOW, WESTERN, AMBIGUOUS = 0.90, 0.97, 0.94
REPLACED, MISSING, ADDED = "替换", "缺少", "新增"
REPLACED_LINE, MISSING_LINE, ADDED_LINE = "替换：原图「%s」 → 重排图「%s」", "重排图缺少：「%s」", "重排图新增：「%s」"
REGION_PREFIX = r"^区域\s+\d+："
REVIEW_MARK = " 二次复核"
OUTPUT_LINE = "%6.2f%%  [%s/%s%s]  bbox=(%d, %d, %d, %d)  %s"
REPORT_HEAD, REPORT_CRITICAL, REPORT_NONE = "===== 文字差异 =====", "【关键】", "未发现文字或标点差异。"
# ---- End of fixed values ----

LANGUAGES = tuple(LANGUAGE_WORDS)
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD = r"\p{L}+"
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
SCRIPTS = {
    "han": HAN,
    "latin": r"\p{IsLatin}",
    "cyrillic": r"\p{IsCyrillic}",
    "greek": r"\p{IsGreek}",
    "other_letters": rf"[\p{{L}}&&[^\p{{IsLatin}}\p{{IsCyrillic}}\p{{IsGreek}}]&&[^\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}]]",
}
#: What lines in Latin letters are made of: nothing is left of most of them without these.
FAMILIAR = r"[\p{IsLatin}[\p{IsCommon}\p{IsInherited}&&\P{L}]]+"
NOT_ASCII = r"[^\x00-\x7F]"


def plain_word(word: str) -> str:
    """Casefolded, in compatibility decomposition, without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c))


def _tables() -> tuple[str, str, str, dict[str, str]]:
    """(letters, their single plain letters, marks to drop, letters with more than one plain letter) of lower-case Latin
    letters with accents, wide and ligature forms, by the rule of plain_word."""
    letters = [chr(c) for block in ((0xA0, 0x24F), (0x1E00, 0x1EFF), (0xFB00, 0xFB06), (0xFF10, 0xFF5E)) for c in range(block[0], block[1] + 1)]
    plain = {c: plain_word(c) for c in letters if c.isalnum() and c == c.lower() and plain_word(c) != c}
    one = {c: p for c, p in plain.items() if len(p) == 1}
    marks = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))
    return "".join(one), "".join(one.values()), marks, {c: p for c, p in plain.items() if len(p) > 1 and p.isalnum()}


_ONE, _PLAIN, _MARKS, _MORE = _tables()
#: For translate(): characters without a counterpart are dropped.
_WITH = _ONE + _MARKS


def tokens(text: Column) -> Column:
    """Words (letters, digits, underscore) and single signs, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def folded(text: Column) -> Column:
    """Lower case, with the sharp s as two letters."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def plain(text: Column) -> Column:
    """Casefolded text without accents, as plain_word gives it for Latin letters."""
    low = F.lower(text)
    several = low
    for c, p in _MORE.items():
        several = F.replace(several, F.lit(c), F.lit(p))
    spelled = F.when(low.rlike("[" + "".join(_MORE) + "]"), several).otherwise(low)
    return F.when(text.rlike(NOT_ASCII), F.translate(spelled, _WITH, _PLAIN)).otherwise(low)


def words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def unfamiliar(text: Column) -> Column:
    """What is left of a text without Latin letters, signs, digits and marks."""
    return F.regexp_replace(text, FAMILIAR, "")


def script_counts(text: Column, strange: Column) -> dict[str, Column]:
    """Letters of each script: what removing them shortens the text by. strange is the text's unfamiliar part; only where
    there is one are scripts other than Latin looked for."""
    def count(of: Column, pattern: str) -> Column:
        return (F.length(of) - F.length(F.regexp_replace(of, f"(?:{pattern})+", ""))).cast("long")

    return {k: count(text, p) if k == "latin" else F.when(strange == "", F.lit(0).cast("long")).otherwise(count(strange, p)) for k, p in SCRIPTS.items()}


def listed_words(found: Column) -> Column:
    """Those of the words that are in any language's list."""
    every = sorted({w for words_ in LANGUAGE_WORDS.values() for w in words_})
    return F.filter(found, lambda w: w.isin(*every))


def _among(vocabulary: tuple[str, ...]):
    return lambda w: w.isin(*vocabulary)


def language_scores(text: Column, listed: Column, accented: Column) -> dict[str, Column]:
    """Listed words of each language, and 3 for its own accents (1 for accents that French and Spanish share). accented:
    whether the text has any character beyond ASCII."""
    has = lambda chars: accented & text.rlike("[" + chars + "]")
    out = {}
    for lang, vocabulary in LANGUAGE_WORDS.items():
        score = F.when(F.size(listed) == 0, 0).otherwise(F.size(F.filter(listed, _among(vocabulary))))
        if lang in ACCENTS:
            score = score + F.when(has(ACCENTS[lang]), 3).otherwise(0)
        if lang in ("fr", "es"):
            score = score + F.when(has(SHARED_ACCENTS), 1).otherwise(0)
        out[lang] = score.cast("long")
    return out


def best_language(scores: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(language, its score, the second score); of equal scores the language first in LANGUAGES."""
    best = F.greatest(*scores.values())
    lang, before, others = F.when(F.lit(False), ""), F.lit(False), []
    for name, s in scores.items():
        lang = lang.when(s == best, name)
        others.append(F.when((s == best) & ~before, F.lit(-1)).otherwise(s))
        before = before | (s == best)
    return lang, best, F.greatest(*others)


def analysis(scripts: dict[str, Column], ranked: tuple[Column, Column, Column], text: Column, accented: Column, n_words: Column) -> tuple[Column, Column]:
    """(language, conflict) of a trimmed text with so many words, from its scripts and best language."""
    lang, best, second = ranked
    foreign = (scripts["cyrillic"] > 0) | (scripts["greek"] > 0) | (scripts["other_letters"] > 0)
    language = (
        F.when(text == "", "unknown").when(foreign, "conflict")
        .when(scripts["han"] > 0, F.when(scripts["latin"] > 0, "zh+latin").otherwise("zh"))
        .when(scripts["latin"] == 0, "numeric")
        .when(best == 0, F.when(~accented & (n_words >= 2), "en").otherwise("latin"))
        .when(best == second, "latin").otherwise(lang)
    )
    lettered = (text != "") & ~foreign & (scripts["han"] == 0) & (scripts["latin"] > 0)
    conflict = (text == "") | foreign | (lettered & (best > 0) & (best == second))
    return language, conflict


def canonical_map(language: Column) -> Column:
    """Map from plain spelling to the canonical one, for a language; empty for others."""
    out = F.when(F.lit(False), F.create_map(F.lit(""), F.lit("")))
    for lang, canon in CANONICAL_WORDS.items():
        pairs = [F.lit(x) for w in canon for x in (plain_word(w), w)]
        out = out.when(language == lang, F.create_map(*pairs))
    return out


def replacements(text: Column, language: Column) -> Column:
    """Array of (token, canonical): words whose canonical spelling has accents that they lack, in their own case."""
    known = canonical_map(language)

    def canon(w: Column) -> Column:
        c = F.element_at(known, plain(w))
        upper = (F.upper(w) == w) & (F.lower(w) != w)
        capital = F.upper(F.substring(w, 1, 1)) == F.substring(w, 1, 1)
        cased = F.when(upper, F.upper(c)).when(capital, F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 100))).otherwise(c)
        return F.when(c.isNotNull() & (folded(c) != folded(w)), F.struct(w.alias("token"), cased.alias("canonical")))

    # Few words can have a canonical spelling at all; only those reach the map.
    spellings = sorted({plain_word(w) for ws in CANONICAL_WORDS.values() for w in ws})
    tokens_ = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: plain(w).isin(*spellings)))
    return F.filter(F.transform(tokens_, canon), lambda r: r.isNotNull())


def critical(difference: Column) -> Column:
    """A replaced, missing or added text with a digit or a keyword; the number of the region doesn't count."""
    content = F.regexp_replace(difference, REGION_PREFIX, "")
    important = content.startswith(REPLACED) | content.contains(MISSING) | content.contains(ADDED)
    word = F.lit(False)
    for k in CRITICAL_KEYWORDS:
        word = word | F.upper(content).contains(k)
    return important & (content.rlike(r"\p{Nd}") | word)


def review_needed(text: Column, confidence: Column, language: Column, conflict: Column, n_replacements: Column) -> Column:
    """A line is read again if unsure: limits depend on its language and length."""
    return (
        (confidence < LOW) | conflict | text.contains("�") | (n_replacements > 0)
        | (language.isin("de", "fr", "es") & (confidence < WESTERN))
        | ((language == "latin") & (confidence < AMBIGUOUS))
        | (~language.isin("de", "fr", "es", "latin") & (F.length(F.trim(text)) <= 4) & (confidence < WESTERN))
    )


def output_line(text: Column, confidence: Column, language: Column, reviewed: Column, box: list[Column]) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    mark = F.when(reviewed, REVIEW_MARK).otherwise("")
    return F.format_string(OUTPUT_LINE, confidence * 100, language, F.coalesce(F.element_at(names, language), language), mark, *box, text)
