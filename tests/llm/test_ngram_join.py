import numpy as np
import pytest

from proofsheet.llm import ngram_join as J
from proofsheet.llm.components import components


def brute(texts):
    """Links and classes by comparing all pairs of shingle sets."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - k + 1)} if w else set())
    n = len(texts)
    links, up = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return links, up


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(3, 120))) for _ in range(60)]
    for i in range(90):
        w = texts[int(rng.integers(0, 20))].split()
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, len(w)))] = "changed"
        texts.append(" ".join(w))
    base = list(rng.choice(words, 150))
    for i in range(300):  # a class of more than one block
        w = list(base)
        w[i % 150] = f"other{i}"
        texts.append(" ".join(w))
    return [*texts, None, "", " \n ", "one", "One", texts[0].upper(), "x" * 70_000, "a b " * 40_000]


def test_links_and_classes_equal_brute_force(spark, corpus):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(corpus)], "doc_id long, text string, h1 string")
    got = {r["doc_id"]: r for r in J.near_duplicates(docs).collect()}
    links, classes = brute(corpus)
    assert len(got) == len(corpus)
    assert {i: r["n_links"] for i, r in got.items()} == dict(enumerate(links))
    assert {i: r["class_id"] for i, r in got.items()} == dict(enumerate(classes))


def test_stage_keeps_one_of_each_class(spark, corpus):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(corpus)]
    rows += [rows[3]] * 3 + [(None, corpus[5], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = J.stage(docs)
    assert kept.columns == docs.columns
    _, classes = brute(corpus)
    wordless = [i for i, t in enumerate(corpus) if not (t or "").split()]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes) | set(wordless))


def test_empty_table_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert J.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = J.near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], schema)).collect()
    assert sorted((r["class_size"], r["n_links"]) for r in rows) == [(1, 0), (2, 1), (2, 1)]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_long_texts_hash_like_short_ones(monkeypatch):
    raw = np.frombuffer(b" ab c\n\tdef  gh " * 50, np.uint8)
    whole = J.word_hashes(raw)
    monkeypatch.setattr(J, "PART_BYTES", 37)
    J.powers.cache_clear()
    assert (J.word_hashes(raw) == whole).all() and len(whole) == 200


def exact_links(texts):
    """Links of each text and classes, by counting the shingles that any two texts share."""
    from collections import Counter

    sets, owners = [], {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - k + 1)} if w else set())
        for s in sets[-1]:
            owners.setdefault(s, []).append(i)
    links, up = [0] * len(texts), list(range(len(texts)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in owners[x] if j < i)
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return links, [find(i) for i in range(len(texts))]


def test_recall_on_the_small_table(spark):
    """All links of the 0.01 GB table at the threshold: none is missed, none is added."""
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    links, classes = exact_links([t for _, t in rows])
    got = {r["doc_id"]: r for r in J.op5_ngram_join(spark, "/root/testdata/sf0.01").collect()}
    assert sum(links) > 200
    assert [got[i]["n_links"] for i, _ in rows] == links
    assert [got[i]["class_id"] for i, _ in rows] == [rows[c][0] for c in classes]


def test_texts_move_once_in_a_large_component(spark):
    """A component of thousands of near copies sends each text to one task; one of more than BLOCK members once a block."""
    rows = [(0, k, k, 1, k, 3000) for k in range(5000)] + [(1, k, k, 1, k, 10) for k in range(10_000, 10_003)]
    members = spark.createDataFrame(rows, "label long, h1 long, h2 long, size long, rk long, n_bytes long")
    texts = spark.createDataFrame([(r[4], bytearray(b"t")) for r in rows] * 2, "rk long, t binary")
    for members_a_block, bytes_a_block, most in ((J.BLOCK, J.BLOCK_BYTES, 2), (2500, 1 << 30, 2), (J.BLOCK, 1 << 30, 1)):
        wanted = J.with_blocks(members, members_a_block, bytes_a_block)
        n = J.text_tasks(wanted, texts).groupBy("label").count().collect()
        assert {r["label"]: r["count"] for r in n} == {0: 5000 * most, 1: 3}
