"""Each query on the small tables, on odd rows and on tables without rows, against SQL or plain Python."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import pytest

from proofsheet.llm import packing
from proofsheet.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def by_sql(name, folder):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in got.description]
    return [dict(zip(names, r, strict=True)) for r in got.fetchall()]


def ordered(rows):
    return sorted(tuple(sorted((k, repr(v)) for k, v in r.items())) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, name):
    assert ordered(rows_of(Q.queries()[name](spark, SMALL))) == ordered(by_sql(name, SMALL))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_odd_rows_equal_sql(spark, odd, name):
    assert ordered(rows_of(Q.queries()[name](spark, odd))) == ordered(by_sql(name, odd))


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_tables_without_rows(spark, bare, name):
    assert Q.queries()[name](spark, bare).collect() == []


def documents(spark, folder):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def held_out(doc_id, modulus):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == 2


@pytest.mark.parametrize("where", ["odd", "small"])
def test_language_id(spark, odd, where):
    folder = odd if where == "odd" else SMALL
    got = rows_of(Q.queries()["op2_language_id"](spark, folder))
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((r["doc_id"], held_out(r["doc_id"], 4)) for r in docs)
    letters = {r["doc_id"]: any(c.isalpha() for c in r["text"] or "") for r in docs}
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not letters[r["doc_id"]]) for r in got if r["doc_id"] is not None)
    if where == "small":
        lang = {r["doc_id"]: r["lang"] for r in docs}
        asked = [r for r in got if r["held_out"]]
        assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in asked) >= 0.95 * len(asked)


def plain_spans(text):
    kinds = (("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6), ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24))
    found = [(m.start(), k, m.end()) for k, (_, p, least) in enumerate(kinds) for m in re.finditer(p, text) if len(m[2] if k == 0 else m[0]) >= least]
    return [(kinds[k][0], a, b) for a, k, b in sorted(found)]


@pytest.mark.parametrize("where", ["odd", "small"])
def test_secret_scan(spark, odd, where):
    folder = odd if where == "odd" else SMALL
    expected = Counter()
    for doc_id, text in documents(spark, folder):
        spans = plain_spans(text)
        n = Counter(k for k, _, _ in spans)
        expected[doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()] += 1
    got = rows_of(Q.queries()["op3_secret_scan"](spark, folder))
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == expected


@pytest.mark.parametrize("where", ["odd", "small"])
def test_packing(spark, odd, where):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    folder = odd if where == "odd" else SMALL
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {}
    for doc_id, text in documents(spark, folder):
        ids.setdefault(doc_id, []).append(np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4"))
    pieces = rows_of(Q.queries()["op4_packing"](spark, folder))
    for p in pieces:
        a, b = p["start"], p["start"] + p["length"]
        assert any(len(x) == p["doc_tokens"] and zlib.crc32(x[a:b].tobytes()) == p["ids_crc32"] for x in ids[p["doc_id"]])
    assert sum(p["length"] for p in pieces) == sum(len(x) for xs in ids.values() for x in xs)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    # Documents lie along the curve: their keys ascend in the order of their first pieces.
    df = spark.read.parquet(f"{folder}/documents.parquet")
    keys = {(r["doc_id"], r["n"]): r["key"] for r in packing.tokenized(df).select("doc_id", "n", "key").collect()}
    order = [keys[p["doc_id"], p["doc_tokens"]] for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])) if p["start"] == 0]
    if where == "small":
        assert order == sorted(order) and len(set(order)) > 50
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


@pytest.mark.parametrize("where", ["odd", "small"])
def test_media_columns(spark, odd, where):
    folder = odd if where == "odd" else SMALL
    expected = Counter()
    for doc_id, text in documents(spark, folder):
        raw = text.encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        expected[doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    got = rows_of(Q.queries()["op6_media_columns"](spark, folder))
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == expected
    assert len({(r["payload_sha256"], r["media_sha256"], r["media_bytes"], r["feature"]) for r in got}) == len({r["payload_sha256"] for r in got})


@pytest.mark.parametrize("where", ["odd", "small"])
def test_lm_score(spark, odd, where):
    folder = odd if where == "odd" else SMALL
    docs = [(i, t, [w.translate(LOWER) for w in WORD.findall(t)]) for i, t in documents(spark, folder)]
    c = Counter()
    for doc_id, _, words in docs:
        if not held_out(doc_id, 7):
            c.update([*words, "\n"])
    n, v = sum(c.values()), len(c)
    got = {}
    for r in Q.queries()["op9_lm_score"](spark, folder).collect():
        got.setdefault((r["doc_id"], r["n_tokens"]), []).append(r)
    for doc_id, text, words in docs:
        r = got[doc_id, len(words) + 1][0]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words, "\n"])
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (held_out(doc_id, 7), sum(c[w] > 0 for w in [*words, "\n"]), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0
        if where == "small" and len(text) > 200:
            assert r["score"] > -len(text.encode()) * math.log10(256) / 2


LOWER = {c: c + 32 for c in range(65, 91)}


def test_quality_repeats_by_brute_force(spark):
    for r in rows_of(Q.queries()["op1_quality_rules"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"), "doc_id")):
        words = WORD.findall(r["text"] or "")
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        n = Counter(windows)
        assert r["n_repeat_words"] == len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)})
        assert r["word_chars"] == sum(map(len, words)) and r["n_words"] == len(words)
