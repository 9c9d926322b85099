"""Stages of the pipeline: columns, what goes and what stays, on odd rows and without rows."""

import duckdb

import corpus_pipeline as P
from proofsheet.llm import mixing, quality_rules, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{i} follows word{i * 7 % 31}." for i in range(60))


def stages(spark, docs):
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], None).cache())
    return out


def test_each_decision_takes_effect(spark):
    near = PROSE.replace("word30 follows", "other follows", 1)
    junk = "a*** b$$$ c### d%%% e&&& f*** g$$$ h### i%%% j&&& k*** l$$$ m### n%%% o&&& p*** q$$$ r### s%%% t&&& u***"
    rows = [(1, PROSE, "en", "src0", 9), (2, near, "en", "src1", 9), (3, PROSE, "en", "src0", 9), (4, junk, "en", "src0", 9), (5, "short", "en", "src0", 9), (6, None, None, None, None)]
    rows += [(10 + i, " ".join(f"tok{i}x{k}" for k in range(40)) + f"\nAll rights reserved.\npassword=abcdef{i:06d}", "de", "src2", 9) for i in range(20)]
    docs, clean, unique, safe, mixed, packed = stages(spark, spark.createDataFrame(rows, SCHEMA))
    for df in (clean, unique, safe, mixed):
        assert df.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in df.collect())
    assert {r["doc_id"] for r in clean.collect()} == {1, 2, 3, *range(10, 30)}
    assert not any("rights" in r["text"] for r in clean.collect())
    assert {r["doc_id"] for r in unique.collect()} == {1, *range(10, 30)}
    assert all(secret_scan.MARK in r["text"] and "abcdef" not in r["text"] for r in safe.collect() if r["doc_id"] >= 10)
    kept = {r["doc_id"] for r in mixed.collect()}
    assert kept < {1, *range(10, 30)} and len(kept) > 10 and mixed.count() == len(kept)
    assert {r["doc_id"] for r in packed.collect()} == kept


def test_odd_rows(spark, odd, odd_rows):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for df in stages(spark, docs)[1:-1]:
        assert df.columns == docs.columns
    assert quality_rules.stage(docs).filter("text IS NULL").count() == 0


def test_run(spark, odd, bare):
    assert P.run(spark, bare).collect() == []
    assert P.run(spark, odd).collect() == []  # all odd documents are short or repeat themselves
    assert P.run(spark, "/root/testdata/sf0.001").collect()


def test_run_on_odd_rows_that_stay(spark, tmp_path):
    """Nulls, ties, repeated rows, a very long text and columns with clashing names, all the way through."""
    long = " ".join(f"lang{i} zaehlt bis{i * 13 % 9973}." for i in range(60_000))
    rows = [(i, " ".join(f"tok{i}x{k}" for k in range(60)), [None, "en"][i % 2], [None, "src1"][i % 2], None, "a", 5) for i in range(40)]
    rows += [rows[0]] * 5 + [(None, rows[1][1], None, None, None, None, None), (None, PROSE, None, None, None, None, None), (99, long, "de", None, 1, "b", 6), (None,) * 7]
    schema = "doc_id long, text string, lang string, source string, n_chars long, m_tokens string, q_text int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = stages(spark, docs)
    assert [df.columns for df in out[1:-1]] == [docs.columns] * 4
    unique = out[2].collect()
    assert sorted(map(str, (r["doc_id"] for r in unique))) == sorted(map(str, [*range(40), 99, None]))
    packed = P.run(spark, str(tmp_path)).collect()
    assert sum(p["length"] for p in packed) == sum(p["doc_tokens"] for p in packed if p["start"] == 0)
    assert any(p["doc_id"] == 99 and p["doc_tokens"] > 100_000 for p in packed) and {p["doc_id"] for p in packed} <= {*range(40), 99, None}


def test_stages_equal_plain_versions(spark):
    """Each stage on the small table against SQL or plain Python over the rows that the stage before kept."""
    folder = "/root/testdata/sf0.001"
    docs, clean, unique, safe, mixed, packed = stages(spark, spark.read.parquet(f"{folder}/documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in clean.collect()} == kept
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    ids = sorted(texts)
    sets = {}
    for i in ids:
        w = texts[i].encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert {r["doc_id"]: r["text"] for r in unique.collect()} == {i: texts[i] for i in set(root.values())}
    found = lambda t: secret_scan.all_spans(t, secret_scan.base_spans(t))
    masked = {i: "".join(secret_scan.MARK if c is None else c for c in marked(texts[i], found(texts[i]))) for i in set(root.values())}
    assert {r["doc_id"]: r["text"] for r in safe.collect()} == masked
    con.register("safe", safe.toArrow())
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM safe")
    chosen = {r[0] for r in con.execute(f"SELECT doc_id FROM ({mixing.oracle(P.MIX)})").fetchall()}
    assert {r["doc_id"] for r in mixed.collect()} == chosen == {r["doc_id"] for r in packed.collect()}


def marked(text, spans):
    """Characters of a text, with None once in place of each stretch of overlapping spans."""
    out, at = [], 0
    while at < len(text):
        here = [e for a, _, e in spans if a <= at < e]
        if not here:
            out.append(text[at])
            at += 1
            continue
        end = max(here)
        while grown := [e for a, _, e in spans if a < end < e]:
            end = max(grown)
        out.append(None)
        at = end
    return out
