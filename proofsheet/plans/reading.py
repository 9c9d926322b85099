"""Queries of the text check: tokens, scripts, languages, differences, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import texts
from ..sources.relations import Relations
from .registry import query

_TOKENS = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')"
_FOLD = "replace(lower({0}), 'ß', 'ss')"
_WORDS = "regexp_extract_all(" + _FOLD + ", '\\p{{L}}+')"
_HAN = "\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_SCRIPTS = {
    "han": _count("{0}", f"[{_HAN}]"), "latin": _count("{0}", "\\p{Latin}"), "cyrillic": _count("{0}", "\\p{Cyrillic}"), "greek": _count("{0}", "\\p{Greek}"),
}
_SCRIPTS["other_letters"] = f"{_count('{0}', chr(92) + 'p{L}')} - {_SCRIPTS['latin']} - {_SCRIPTS['cyrillic']} - {_SCRIPTS['greek']} - {_SCRIPTS['han']}"


def _scripts(text: str) -> str:
    return ", ".join(f"{v.replace('{0}', text)} AS {k}" for k, v in _SCRIPTS.items())


def _score(text: str, lang: str) -> str:
    listed = ", ".join(f"'{w}'" for w in tx.LANGUAGE_WORDS[lang])
    out = f"len(list_filter({_WORDS.format(text)}, lambda w: w IN ({listed})))"
    if lang in tx.ACCENTS:
        out += f" + CASE WHEN regexp_matches({text}, '[{tx.ACCENTS[lang]}]') THEN 3 ELSE 0 END"
    if lang in ("fr", "es"):
        out += f" + CASE WHEN regexp_matches({text}, '[{tx.SHARED_ACCENTS}]') THEN 1 ELSE 0 END"
    return out


def _scores(text: str) -> str:
    return ", ".join(f"{_score(text, k)} AS score_{k}" for k in tx.LANGUAGES)


_BEST = "greatest(score_en, score_de, score_fr, score_es)"
_SECOND = "list_sort([score_en, score_de, score_fr, score_es], 'DESC')[2]"
_LANG = " ".join(f"WHEN score_{k} = {_BEST} THEN '{k}'" for k in tx.LANGUAGES)
_LANGUAGE = f"""CASE WHEN t = '' THEN 'unknown' WHEN cyrillic + greek + other_letters > 0 THEN 'conflict' WHEN han > 0 AND latin > 0 THEN 'zh+latin' WHEN han > 0 THEN 'zh' WHEN latin = 0 THEN 'numeric'
    WHEN {_BEST} = 0 AND NOT regexp_matches(t, '[^\\x00-\\x7F]') AND len({_WORDS.format('t')}) >= 2 THEN 'en' WHEN {_BEST} = 0 OR {_BEST} = {_SECOND} THEN 'latin' {_LANG} END"""
_CONFLICT = f"t = '' OR cyrillic + greek + other_letters > 0 OR (han = 0 AND latin > 0 AND {_BEST} > 0 AND {_BEST} = {_SECOND})"


def _analysed(source: str) -> str:
    return f"SELECT *, {_LANGUAGE} AS language, ({_CONFLICT}) AS conflict FROM (SELECT *, trim(text) AS t, {_scripts('trim(text)')}, {_scores('trim(text)')} FROM {source})"


#: Lines that the documents lack: other scripts, packaging words, damaged and short texts.
SPECIAL = (
    "产品型号 12", "产品 LOT", "Привет мир", "Ελληνικά", "12345", "�abc", "FUR Kinder", "Kuhl und trocken", "Espana informacion", "Fabrique en France", "the und", "Größe für alle", "ok", "שלום", "qualite INGREDIENTS", "enthalt Zutaten", "Precaucion con el producto", "le and", "für größe",
)


def lines(t: Relations) -> DataFrame:
    """Recognised lines, and the special ones as lines of pages with negative numbers."""
    rows = [(-1 - k // 4, k, s, 10, k * 24, 200, k * 24 + 18, (80 + k) / 100) for k, s in enumerate(SPECIAL)]
    own = t.spark.createDataFrame(rows, "doc_id long, pos long, text string, x1 long, y1 long, x2 long, y2 long, confidence double")
    return t.ocr_line.unionByName(own)


_SPECIAL = ", ".join(f"({-1 - k // 4}, {k}, '{s}', 10, {k * 24}, 200, {k * 24 + 18}, {(80 + k) / 100}::DOUBLE)" for k, s in enumerate(SPECIAL))
_LINES = f"every AS (SELECT doc_id, pos, text, x1, y1, x2, y2, confidence FROM ocr_line UNION ALL SELECT * FROM (VALUES {_SPECIAL}))"


@query("doc_id long, n_tokens long, n_words long, digest string", f"SELECT doc_id, sum(len(k)) AS n_tokens, sum(len(list_filter(k, lambda w: regexp_matches(w, '^[\\p{{L}}\\p{{N}}_]')))) AS n_words, md5(string_agg(array_to_string(k, ' '), ' ' ORDER BY pos)) AS digest FROM (SELECT doc_id, pos, {_TOKENS.format('text')} AS k FROM ocr_line) GROUP BY doc_id")
def text_tokens(t: Relations) -> DataFrame:
    df = t.ocr_line.withColumn("k", tx.tokens(F.col("text")))
    n_words = F.size(F.filter("k", lambda w: w.rlike(r"^[\p{L}\p{N}_]")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.array_join("k", " ").alias("s")))), lambda r: r["s"]), " ")
    return df.groupBy("doc_id").agg(F.sum(F.size("k")).alias("n_tokens"), F.sum(n_words).alias("n_words"), F.md5(joined.cast("binary")).alias("digest"))


@query("doc_id long, pos long, han long, latin long, cyrillic long, greek long, other_letters long", f"WITH {_LINES} SELECT doc_id, pos, {_scripts('trim(text)')} FROM every")
def script_counts(t: Relations) -> DataFrame:
    df = lines(t).withColumn("strange", tx.unfamiliar(F.trim("text")))
    return df.select("doc_id", "pos", *[v.alias(k) for k, v in tx.script_counts(F.trim("text"), F.col("strange")).items()])


@query("doc_id long, pos long, score_en long, score_de long, score_fr long, score_es long, language string, conflict boolean", f"WITH {_LINES}, a AS ({_analysed('every')}) SELECT * FROM a")
def language_scores(t: Relations) -> DataFrame:
    return texts.analysed(lines(t))


_CONTEXT = f"""{_LINES}, an AS ({_analysed('every')}),
    own AS (SELECT doc_id, pos, x1, y1, x2, y2, {', '.join(f"CASE WHEN cyrillic + greek + other_letters + han = 0 AND latin > 0 THEN score_{k} ELSE 0 END AS c_{k}" for k in tx.LANGUAGES)} FROM an),
    near AS (SELECT a.doc_id, a.pos, {', '.join(f'sum(b.c_{k}) AS n_{k}' for k in tx.LANGUAGES)} FROM own a JOIN own b ON a.doc_id = b.doc_id AND a.pos <> b.pos
      AND greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / least(greatest(a.x2 - a.x1, 1), greatest(b.x2 - b.x1, 1)) >= 0.2
      AND greatest(0, greatest(a.y1, b.y1) - least(a.y2, b.y2)) <= greatest(90, 3 * greatest(a.y2 - a.y1, b.y2 - b.y1, 1)) GROUP BY a.doc_id, a.pos),
    tot AS (SELECT own.doc_id, own.pos, {', '.join(f'2 * c_{k} + coalesce(n_{k}, 0) AS score_{k}' for k in tx.LANGUAGES)} FROM own LEFT JOIN near ON own.doc_id = near.doc_id AND own.pos = near.pos),
    ctx AS (SELECT doc_id, pos, score_en AS t_en, score_de AS t_de, score_fr AS t_fr, score_es AS t_es, CASE WHEN {_BEST} < 2 OR {_BEST} = {_SECOND} THEN NULL {_LANG} END AS context FROM tot)"""


@query("doc_id long, pos long, t_en long, t_de long, t_fr long, t_es long, context string", f"WITH {_CONTEXT} SELECT * FROM ctx")
def context_language(t: Relations) -> DataFrame:
    return texts.context_languages(lines(t), ["doc_id"], "pos")


def _canon_sql(lang: str) -> str:
    """Rows (language, plain, canonical)."""
    return f"SELECT * FROM (VALUES {', '.join(f"('{k}', '{tx.plain_word(w)}', '{w}')" for k, ws in tx.CANONICAL_WORDS.items() for w in ws)}) AS v(lang, plain, canon)"


_SPELLED = "lower(w)"
for _c, _p in tx._MORE.items():
    _SPELLED = f"replace({_SPELLED}, '{_c}', '{_p}')"
_PLAINED = f"translate({_SPELLED}, '{tx._WITH}', '{tx._PLAIN}')"
_SWAPS = f"""canon AS ({_canon_sql('')}),
    tok AS (SELECT DISTINCT doc_id, pos, coalesce(context, language) AS lang, unnest(regexp_extract_all(text, '\\p{{L}}+')) AS w FROM both_),
    swap AS (SELECT doc_id, pos, w AS token, CASE WHEN upper(w) = w AND lower(w) <> w THEN upper(canon) WHEN upper(w[1]) = w[1] THEN upper(canon[1]) || canon[2:] ELSE canon END AS canonical
      FROM tok JOIN canon c ON c.lang = tok.lang AND c.plain = {_PLAINED} WHERE {_FOLD.format('canon')} <> {_FOLD.format('w')})"""
_BOTH = f"{_CONTEXT}, both_ AS (SELECT an.*, ctx.context FROM an JOIN ctx ON an.doc_id = ctx.doc_id AND an.pos = ctx.pos), {_SWAPS}"


def with_context(t: Relations) -> DataFrame:
    """Analysed lines with context and the array of replacements."""
    every = lines(t)
    df = texts.analysed(every).join(texts.context_languages(every, ["doc_id"], "pos").select("doc_id", "pos", "context"), ["doc_id", "pos"])
    return df.withColumn("swaps", tx.replacements(F.col("text"), F.coalesce("context", "language")))


@query("doc_id long, pos long, token string, canonical string", f"WITH {_BOTH} SELECT doc_id, pos, token, canonical FROM swap")
def canonical_replacements(t: Relations) -> DataFrame:
    return with_context(t).select("doc_id", "pos", F.explode("swaps").alias("s")).select("doc_id", "pos", "s.*")


@query(
    "doc_id long, pos long, language string, confidence double",
    f"""WITH {_BOTH} SELECT b.doc_id, b.pos, lang AS language, confidence FROM (SELECT *, coalesce(context, language) AS lang FROM both_) b LEFT JOIN (SELECT doc_id, pos, count(*) AS n FROM swap GROUP BY ALL) s ON b.doc_id = s.doc_id AND b.pos = s.pos
        WHERE confidence < 0.9 OR conflict OR contains(text, '�') OR coalesce(n, 0) > 0 OR (lang IN ('de', 'fr', 'es') AND confidence < 0.97) OR (lang = 'latin' AND confidence < 0.94)
          OR (lang NOT IN ('de', 'fr', 'es', 'latin') AND length(t) <= 4 AND confidence < 0.97)""",
)
def secondary_review_queue(t: Relations) -> DataFrame:
    df = with_context(t).withColumn("language", F.coalesce("context", "language"))
    return df.filter(tx.review_needed(F.col("text"), F.col("confidence"), F.col("language"), F.col("conflict"), F.size("swaps")))


def token_pairs(t: Relations) -> DataFrame:
    return t.text_pair.select("conv_id", "turn", tx.tokens(F.col("a")).alias("a"), tx.tokens(F.col("b")).alias("b"))


#: Longest common runs found again and again: the blocks of a pair, by splitting what is left and right of each.
_BLOCKS = f"""pair AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, conv_id, turn, {_TOKENS.format('a')} AS a, {_TOKENS.format('b')} AS b FROM text_pair),
    ta AS (SELECT id, unnest(a) AS w, unnest(range(len(a))) AS i FROM pair), tb AS (SELECT id, unnest(b) AS w, unnest(range(len(b))) AS j FROM pair),
    m AS (SELECT ta.id, i, j FROM ta JOIN tb ON ta.id = tb.id AND ta.w = tb.w),
    reg(id, i0, i1, j0, j1, bi, bj, bk) AS (SELECT id, 0::BIGINT, len(a)::BIGINT, 0::BIGINT, len(b)::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM pair UNION ALL
      SELECT id, CASE s WHEN 0 THEN i0 ELSE i + k END, CASE s WHEN 0 THEN i ELSE i1 END, CASE s WHEN 0 THEN j0 ELSE j + k END, CASE s WHEN 0 THEN j ELSE j1 END,
        CASE s WHEN 0 THEN i END, CASE s WHEN 0 THEN j END, CASE s WHEN 0 THEN k END
      FROM (SELECT id, i0, i1, j0, j1, i, j, k, row_number() OVER (PARTITION BY id, i0, j0 ORDER BY k DESC, i, j) AS best FROM
        (SELECT id, i0, i1, j0, j1, min(i) AS i, min(j) AS j, count(*) AS k FROM
          (SELECT r.id, i0, i1, j0, j1, i, j, i - row_number() OVER (PARTITION BY r.id, i0, j0, i - j ORDER BY i) AS run FROM reg r JOIN m ON m.id = r.id AND i >= i0 AND i < i1 AND j >= j0 AND j < j1)
        GROUP BY id, i0, i1, j0, j1, i - j, run)) CROSS JOIN (VALUES (0), (1)) AS v(s) WHERE best = 1),
    found AS (SELECT id, bi AS i, bj AS j, bk AS k FROM reg WHERE bk IS NOT NULL),
    block AS (SELECT id, min(i) AS i, min(j) AS j, sum(k)::BIGINT AS k FROM (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS g FROM
      (SELECT *, CASE WHEN lag(i + k) OVER w = i AND lag(j + k) OVER w = j THEN 0 ELSE 1 END AS new FROM found WINDOW w AS (PARTITION BY id ORDER BY i))) GROUP BY id, g)"""


@query("conv_id long, turn long, matched long, ratio double", f"WITH RECURSIVE {_BLOCKS} SELECT conv_id, turn, coalesce(n, 0) AS matched, CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE 2.0::DOUBLE * coalesce(n, 0) / (len(a) + len(b)) END AS ratio FROM pair LEFT JOIN (SELECT id, sum(k) AS n FROM block GROUP BY id) s ON s.id = pair.id")
def text_similarity(t: Relations) -> DataFrame:
    return texts.similarity(token_pairs(t), ["conv_id", "turn"])


@query("conv_id long, turn long, a_start long, b_start long, size long", f"WITH RECURSIVE {_BLOCKS} SELECT conv_id, turn, i AS a_start, j AS b_start, k AS size FROM block JOIN pair ON pair.id = block.id")
def text_matching_blocks(t: Relations) -> DataFrame:
    return texts.matching_blocks(token_pairs(t), ["conv_id", "turn"])


_DIFF = f"""{_BLOCKS}, bound AS (SELECT id, i, j, k FROM block UNION ALL SELECT id, -1, -1, 1 FROM pair UNION ALL SELECT id, len(a), len(b), 0 FROM pair),
    hole AS (SELECT id, i + k AS i, j + k AS j, lead(i) OVER w AS i2, lead(j) OVER w AS j2 FROM bound WINDOW w AS (PARTITION BY id ORDER BY i, j, k DESC)),
    part AS (SELECT h.id, i, j, i2, j2, least(i2 - i, j2 - j) AS n, a, b FROM hole h JOIN pair p ON p.id = h.id WHERE i2 > i OR j2 > j),
    piece AS (SELECT id, i, 0 AS s, 'replace' AS kind, array_to_string(a[i + 1:i + n], ' ') AS a_text, array_to_string(b[j + 1:j + n], ' ') AS b_text FROM part WHERE n > 0 UNION ALL
      SELECT id, i, 1, 'missing', array_to_string(a[i + n + 1:i2], ' '), '' FROM part WHERE i2 - i > n UNION ALL SELECT id, i, 1, 'added', '', array_to_string(b[j + n + 1:j2], ' ') FROM part WHERE j2 - j > n),
    diff AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY x.id ORDER BY i, s) AS number, kind, a_text, b_text,
      CASE kind WHEN 'replace' THEN '替换：原图「' || a_text || '」 → 重排图「' || b_text || '」' WHEN 'missing' THEN '重排图缺少：「' || a_text || '」' ELSE '重排图新增：「' || b_text || '」' END AS line FROM piece x JOIN pair ON pair.id = x.id)"""


def found_differences(t: Relations) -> DataFrame:
    return texts.differences(token_pairs(t), ["conv_id", "turn"]).withColumn("line", texts.difference_line())


@query("conv_id long, turn long, number long, kind string, a_text string, b_text string", f"WITH RECURSIVE {_DIFF} SELECT * FROM diff")
def text_diff_opcodes(t: Relations) -> DataFrame:
    return found_differences(t)


_CRITICAL = f"regexp_matches(line, '\\p{{Nd}}') OR {' OR '.join(f"contains(upper(line), '{k}')" for k in tx.CRITICAL_KEYWORDS)}"


@query("conv_id long, turn long, number long, line string", f"WITH RECURSIVE {_DIFF} SELECT * FROM diff WHERE {_CRITICAL}")
def critical_differences(t: Relations) -> DataFrame:
    numbered = F.concat(F.lit("区域 "), F.col("turn").cast("string"), F.lit("："), F.col("line"))
    return found_differences(t).filter(tx.critical(numbered))


@query("doc_id long, pos long, reviewed boolean, text string, confidence double, language string, primary_text string")
def review_candidate_apply(t: Relations) -> DataFrame:
    """Second readings: the canonical spelling where there is one, else the line without its last character."""
    df = with_context(t)
    spelled = F.aggregate("swaps", F.col("text"), lambda s, r: F.replace(s, r["token"], r["canonical"]))
    other = F.expr("substr(text, 1, length(text) - 1)")
    df = df.select("doc_id", "pos", "text", "confidence", "context", F.when(F.size("swaps") > 0, spelled).otherwise(other).alias("candidate"), (F.col("confidence") + (F.col("pos") % 7 - 3) / 100.0).alias("candidate_score"))
    chars = lambda c: F.split(tx.folded(F.col(c)), "")
    alike = texts.similar(df.select("doc_id", "pos", chars("text").alias("a"), chars("candidate").alias("b")), ["doc_id", "pos"], 0.45)
    return texts.applied_reviews(df.join(alike, ["doc_id", "pos"]))


_NAME = "CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.LANGUAGE_NAMES.items()) + " END"
_LINE = f"printf('%6.2f%%', confidence * 100) || '  [' || language || '/' || {_NAME} || CASE WHEN pos % 5 = 0 THEN '{tx.REVIEW_MARK}' ELSE '' END || ']  bbox=(' || x1 || ', ' || y1 || ', ' || x2 || ', ' || y2 || ')  ' || text"


def formatted(t: Relations) -> DataFrame:
    df = texts.analysed(lines(t))
    return df.withColumn("line", tx.output_line(F.col("text"), F.col("confidence"), F.col("language"), F.col("pos") % 5 == 0, [F.col(c) for c in ("x1", "y1", "x2", "y2")]))


@query("doc_id long, pos long, line string", f"WITH {_LINES}, a AS ({_analysed('every')}) SELECT doc_id, pos, {_LINE} AS line FROM a")
def ocr_output_lines(t: Relations) -> DataFrame:
    return formatted(t)


@query("doc_id long, report string", f"WITH {_LINES}, a AS ({_analysed('every')}) SELECT doc_id, '===== OCR =====' || chr(10) || string_agg({_LINE}, chr(10) ORDER BY pos) || chr(10) || count(*) || ' lines' AS report FROM a GROUP BY doc_id")
def ocr_report(t: Relations) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n")
    return formatted(t).groupBy("doc_id").agg(F.concat_ws("\n", F.lit("===== OCR ====="), body, F.concat(F.count("*").cast("string"), F.lit(" lines"))).alias("report"))


@query(
    "conv_id long, turn long, report string",
    f"""WITH RECURSIVE {_DIFF}, body AS (SELECT conv_id, turn, string_agg(number || '. ' || CASE WHEN {_CRITICAL} THEN '{tx.REPORT_CRITICAL}' ELSE '' END || line, chr(10) ORDER BY number) AS s FROM diff GROUP BY conv_id, turn)
    SELECT p.conv_id, p.turn, '{tx.REPORT_HEAD}' || chr(10) || coalesce(s, '{tx.REPORT_NONE}') AS report FROM pair p LEFT JOIN body ON body.conv_id = p.conv_id AND body.turn = p.turn""",
)
def comparison_report(t: Relations) -> DataFrame:
    mark = F.when(tx.critical(F.col("line")), tx.REPORT_CRITICAL).otherwise("")
    row = F.struct("number", F.concat(F.col("number").cast("string"), F.lit(". "), mark, F.col("line")).alias("s"))
    body = found_differences(t).groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["s"]), "\n").alias("s"))
    none = F.lit(tx.REPORT_NONE)
    return t.text_pair.select("conv_id", "turn").join(body, ["conv_id", "turn"], "left").withColumn("report", F.concat_ws("\n", F.lit(tx.REPORT_HEAD), F.coalesce("s", none)))


@query("lines long, unsure long, languages long, pages long", f"WITH {_LINES}, a AS ({_analysed('every')}) SELECT count(*) AS lines, count(*) FILTER (confidence < 0.9) AS unsure, count(DISTINCT language) AS languages, count(DISTINCT doc_id) AS pages FROM a")
def ocr_totals(t: Relations) -> DataFrame:
    return texts.analysed(lines(t)).agg(F.count("*").alias("lines"), F.count(F.when(F.col("confidence") < tx.LOW, 1)).alias("unsure"), F.countDistinct("language").alias("languages"), F.countDistinct("doc_id").alias("pages"))


@query("doc_id long, pos long, best long", "SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, pos) AS best FROM ocr_line QUALIFY best <= 3")
def surest_lines(t: Relations) -> DataFrame:
    """The three surest lines of each page."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "pos")
    return t.ocr_line.withColumn("best", F.row_number().over(order)).filter("best <= 3")
