"""The queries beside their SQL over the smallest tables, held-out accuracy, and the pipeline beside a brute-force version."""

from __future__ import annotations

import hashlib
import os
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_small import brute_lines
from tsunagi.llm import bpe, decontaminate, langid, near_dedup, registry
from tsunagi.llm.shingles import find_words, hashed, word_hashes

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(want)


def test_text_alone_tells_the_language_of_texts_that_were_not_fitted(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs.filter("doc_id % 2 = 0"), "doc_id", "text", "lang")
    found = langid.identify(docs.filter("doc_id % 2 = 1 and n_chars > 100"), declared_col=None, host_col=None, model=model)
    right = found.join(docs, "doc_id").filter("language = lang").count()
    assert right >= 0.95 * found.count()


def test_word_hashes_tell_words_apart():
    texts = [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall()] + ["", "_", "é_É x²  Ⅷ\u0130İ ß１２", "a" * 3000]
    words = [find_words(t.lower()) for t in texts]
    marks = [word_hashes(t) for t in texts]
    assert [len(w) for w in words] == [len(m) for m in marks]
    pairs = {(w, m) for ws, ms in zip(words, marks, strict=True) for w, m in zip(ws, ms.tolist(), strict=True)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({m for _, m in pairs})


def test_banded_distance_equals_a_plain_edit_distance():
    import random

    import numpy as np

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    dice = random.Random(3)
    for _ in range(1500):
        a, b = ([dice.randrange(dice.choice((2, 4, 30))) for _ in range(dice.randrange(1, 30))] for _ in "ab")
        if dice.random() < 0.6:
            b = [x for x in a for x in ([] if dice.random() < 0.1 else [x, 7] if dice.random() < 0.1 else [x])] or [1]
        most = dice.randrange(0, 12)
        assert near_dedup.banded_distance(np.array(a, np.uint64), np.array(b, np.uint64), most) == min(plain(a, b), most + 1)
        assert near_dedup.similar(np.array(a, np.uint64), np.array(b, np.uint64), 0.8) == (plain(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))


def brute_classes(texts):
    words = {i: hashed(find_words(t.lower())) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i in sorted(texts) if len(words[i])]
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if root(i) != root(j) and near_dedup.similar(words[i], words[j], near_dedup.SIMILARITY):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    blank = {}
    for i in sorted(texts):
        if not len(words[i]):
            parent[i] = blank.setdefault(texts[i].strip(), i)
    return {i: root(i) for i in texts}


def brute_contaminated(text, items):
    k, words = decontaminate.SEED, find_words(text.lower())
    seeds = defaultdict(list)
    for at in range(len(words) - k + 1):
        seeds[tuple(words[at : at + k])].append(at)
    import numpy as np

    for item in items:
        pairs = [(d, i) for i in range(len(item) - k + 1) for d in seeds.get(tuple(item[i : i + k]), ())]
        if pairs and sum(t[2] for t in decontaminate.tiles(np.array([p[0] for p in pairs], np.int32), np.array([p[1] for p in pairs], np.int32), k)) >= decontaminate.COVERAGE * len(item):
            return True
    return False


def test_pipeline_equals_brute_force(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    table = lambda name: duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet'")
    docs = [(i, t or "") for i, t in table("documents").select("doc_id, text").fetchall()]
    docs = [(i, t) for i, t in docs if any(c.isalpha() for c in t)]
    texts = dict(brute_lines(docs))
    classes = brute_classes(texts)
    items = [find_words((t or "").lower()) for (t,) in table("benchmark").select("text").fetchall()]
    kept = {i: t for i, t in texts.items() if classes[i] == i and not brute_contaminated(t, items)}
    want = {}
    for i, t in kept.items():
        ids = library.encode_ordinary(t)
        want[i] = (ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: (r["ids"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert sorted(got) == sorted(want)
    assert got == want


def test_near_duplicate_classes_equal_brute_force(spark):
    texts = {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()}
    got = {r["doc_id"]: r["class_id"] for r in registry.queries()["op10_near_dedup"](spark, DATA).collect()}
    assert got == brute_classes(texts)
