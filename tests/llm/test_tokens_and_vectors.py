"""Alignment, token files and whitening beside the libraries and brute force, on small rows with all that data may hold."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from tsunagi.llm import alignment, token_files, whitening
from tsunagi.llm.library import Library

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
EXTRA = "id string, body string, mark string, words string, first string, uid string, a string, count string, v string, component string"
TEXTS = [
    (1, "Hello world, it's a test."), (2, None), (3, ""), (4, "  two  spaces\n\nand\tlines "), (5, "naïve café 日本語のテキスト 👩‍👩‍👧 end"), (6, "x<|endoftext|>y <|endoftext|> z"),
    (7, "a\x1cb \x1f c\u0085d　e"), (8, "word " * 4000), (9, "ab" * 9000), (None, "Hello world, it's a test."), (1, "Hello world, it's a test."), (1, "other"), (10, "ﬁ ligature ①"), (11, " "), (12, "<0x41> ▁ </s>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *["x"] * 10) for i, t in TEXTS], f"doc_id long, text string, {EXTRA}").repartition(3)


def test_library_remembers_what_it_says(monkeypatch):
    from tsunagi.llm import library

    monkeypatch.setattr(library, "REMEMBERED", 20)
    monkeypatch.setattr(library, "AT_ONCE", 30)
    dice, own = random.Random(5), Tokenizer.from_file(BYTES)
    alphabet = [" ", " ", "\n", "\t", " ", "　", "\x1d", "a", "the", "Z", "9", "'s", "'", ".", "é", "日本", "<|endoftext|>", "👍"]
    texts = ["".join(dice.choice(alphabet) for _ in range(dice.randrange(40))) for _ in range(600)] + [t or "" for _, t in TEXTS]
    for plain in (True, False):
        own.encode_special_tokens = plain
        coder = Library(open(BYTES, encoding="utf-8").read(), plain)
        for start in range(0, len(texts), 50):
            some = texts[start : start + 50]
            assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(some)] == [own.encode(t, add_special_tokens=False).ids for t in some]


def test_words_hold_all_ids_and_blocks_are_read_alone():
    dice = np.random.default_rng(2)
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        for most in (1, 2, 3, 300, 50_257, 1 << 30, 1 << 32):
            ids = dice.integers(0, most, n).astype(np.uint32)
            if n > 4:
                ids[dice.integers(0, n, n // 50 + 1)] = 2**32 - 1
                ids[n // 3 : n // 2] = 0
            words, escapes, block_words, block_escapes = token_files.pack(ids)
            assert (token_files.unpack(words, escapes, block_words, n) == ids).all()
            for b in range(len(block_words)):
                assert (token_files.unpack_block(words, escapes, block_words, block_escapes, n, b) == ids[b * 4096 : (b + 1) * 4096]).all()
    plain = np.full(4096, 5, np.uint32)
    plain[::100] = 2**31
    assert len(token_files.pack(plain)[0]) < 500  # rare large ids don't widen the others


@pytest.mark.parametrize("run", [token_files.RUN, 3])
def test_token_files(spark, docs, tmp_path, monkeypatch, run):
    monkeypatch.setattr(token_files, "RUN", run)
    own, path = Tokenizer.from_file(BYTES), str(tmp_path / "files")
    token_files.write_tokens(docs, path, BYTES)
    found = token_files.read_tokens(spark, path).collect()
    ids = lambda t: own.encode(t or "", add_special_tokens=False).ids + [0]
    assert Counter((r["doc_id"], tuple(r["tokens"])) for r in found) == Counter((i, tuple(ids(t))) for i, t in TEXTS)
    start = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == start and r["n_tokens"] == len(r["tokens"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["tokens"], "<u4").tobytes())
        start += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    token_files.write_tokens(docs.limit(0), str(tmp_path / "none"), BYTES)
    assert token_files.read_tokens(spark, str(tmp_path / "none")).collect() == []


def brute_alignment(rows):
    a_own, b_own = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_own.encode_special_tokens = True
    letters = alignment._letters()
    names = {i: bytes(letters.get(c, 63) for c in n) for n, i in a_own.get_vocab(True).items()}
    piece = lambda i: bytes([int(b_own.id_to_piece(i)[3:5], 16)]) if b_own.is_byte(i) else b_own.id_to_piece(i).replace("▁", " ").encode()
    base, links, held = [], [], Counter()
    for doc, text in rows:
        a, b = a_own.encode(" " + (text or ""), add_special_tokens=False).ids, b_own.encode(text or "")
        a_bytes, b_bytes, want = [names[i] for i in a], [piece(i) for i in b], (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            base.append((doc, 0, 0, 0, ""))
            links.append(Counter())
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        found = Counter()
        for i in range(len(a)):
            for j in range(max(0, np.searchsorted(b_end, a_end[i] - len(a_bytes[i]))), len(b)):
                if b_end[j] - len(b_bytes[j]) >= a_end[i]:
                    break
                if b_end[j] > a_end[i] - len(a_bytes[i]):
                    found[a[i], b[j]] += 1
        cuts, groups = sorted(set(a_end) & set(b_end)), []
        i = j = 0
        for cut in cuts:
            k, m = a_end.index(cut) + 1, b_end.index(cut) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        base.append((doc, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(found)
        held.update(found.keys())
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    return [
        (doc, n_a, n_b, n_groups, sum(found.values()), sum(n for (a, b), n in found.items() if held[a, b] == most[a]), sum(n * held[k] for k, n in found.items()), digest)
        for (doc, n_a, n_b, n_groups, digest), found in zip(base, links, strict=True)
    ]


@pytest.mark.parametrize("range_bytes, fan, hot", [(alignment.RANGE, alignment.FAN, alignment.HOT), (7, 3, 4), (500, 2, 1)])
def test_alignment(spark, docs, range_bytes, fan, hot):
    rows = [(i, t) for i, t in TEXTS if i not in (8, 9)] + ([(8, "word " * 300), (9, "ab" * 300)] if range_bytes == 7 else [(8, "word " * 4000), (9, "ab" * 9000)])
    frame = spark.createDataFrame([(i, t, *["x"] * 10) for i, t in rows], docs.schema).repartition(3)
    got = Counter(tuple(r) for r in alignment.align(frame, BYTES, PIECES, range_bytes=range_bytes, fan=fan, hot=hot).collect())
    assert got == Counter(brute_alignment(rows))
    assert alignment.align(frame.limit(0), BYTES, PIECES).collect() == []


def test_stretches_align_as_whole_texts_do():
    """What is remembered of stretches gives the groups and links of whole texts, and texts where that is in doubt are told."""

    class File:
        value = open(BYTES, encoding="utf-8").read()

    tokens = alignment.Tokens(File, BYTES, open(PIECES, "rb").read())
    dice = random.Random(3)
    parts = [" ", "  ", "\n", "\t", " \n", "\r", "\r\n", "a", "don't", "é", "日本", "123", "7", ".", ",", "!!", "()", ";", "▁", "\u3000", "\xa0", "\x00", "<s>", "<|endoftext|>", "👩‍👧", "\x1c", "word ", "Thing, "]
    texts = ["".join(dice.choice(parts) for _ in range(dice.randint(0, 14))) for _ in range(3000)]
    told = [x for start in range(0, len(texts), 500) for x in tokens.aligned(texts[start : start + 500])]
    assert sum(x is not None for x in told) > 1000
    assert all(x is None for x, t in zip(told, texts, strict=True) if not t or "▁" in t or "\r" in t)
    for text, found, (a, b) in zip(texts, told, tokens.encode(texts), strict=True):
        if found is not None:
            whole = alignment.Fragment.of(a.astype(np.int64), np.cumsum(tokens.a_lengths[a.astype(np.int64)]), b, np.cumsum(tokens.b_lengths[b])).closed()
            assert found[:4] == (len(a), len(b), whole.n_groups, hashlib.sha256(";".join(whole.groups).encode()).hexdigest()), text
            assert found[4].tolist() == whole.pairs.tolist() and found[5].tolist() == whole.times.tolist(), text


def test_fragments_compose_in_any_tree():
    dice = random.Random(1)
    for _ in range(300):
        n = dice.randrange(1, 60)
        ends = lambda: np.array(sorted({dice.randrange(1, n) for _ in range(dice.randrange(n))} - {n}) + [n]) if n > 1 else np.array([1])  # noqa: B023, E731
        a_ends, b_ends = ends(), ends()
        a, b = np.arange(len(a_ends)) % 5, np.arange(len(b_ends)) % 3
        want = alignment.Fragment.of(a, a_ends, b, b_ends).closed()
        bounds = sorted({0, n, *(dice.randrange(n + 1) for _ in range(4))})
        parts = []
        for low, high in zip(bounds, bounds[1:], strict=False):
            x, y = (a_ends > low) & (a_ends <= high), (b_ends > low) & (b_ends <= high)
            parts.append(alignment.Fragment.of(a[x], a_ends[x], b[y], b_ends[y]))
        while len(parts) > 1:
            at = dice.randrange(len(parts) - 1)
            parts[at : at + 2] = [parts[at].then(parts[at + 1])]
        got = parts[0].closed()
        assert (got.n_groups, ";".join(got.groups)) == (want.n_groups, ";".join(want.groups))
        assert dict(zip(got.pairs.tolist(), got.times.tolist(), strict=True)) == dict(zip(want.pairs.tolist(), want.times.tolist(), strict=True))


def test_leading_components():
    dice = np.random.default_rng(4)
    for n in (1, 2, 3, 5, 20, 64):
        data = dice.standard_normal((3 * n, n))
        alike = data.copy()
        alike[:, : n // 2] = alike[:, [0]]
        for m in (data.T @ data / n, alike.T @ alike / n, 3 * np.eye(n), np.diag(np.arange(n) * 1.0), np.diag([5.0] * n) + 1e-9 * (data.T @ data)):
            values, vectors = whitening.leading_components(m, 8)
            want, scale = np.linalg.eigvalsh(m)[::-1][:8], max(np.abs(m).max(), 1e-300)
            assert np.abs(values - want).max() < 1e-13 * n * scale
            assert np.abs(m @ vectors - vectors * values).max() < 1e-13 * n * scale
            assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def brute_whitening(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in kept], dtype=np.int64)
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    deviations = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = x - x.mean(axis=0)
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    return kept, n, deviations, centred @ vectors / np.sqrt(values), values / np.trace(covariance)


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    dice = np.random.default_rng(3)
    rows = [(i, [float(c) for c in dice.normal(0.3, np.arange(1, 11) / 5)]) for i in range(90)]
    rows += [(0, rows[0][1]), (None, rows[5][1]), (91, None), (92, [None] + rows[0][1][1:]), (93, [float("nan")] + rows[0][1][1:]), (94, [float("inf")] + rows[0][1][1:])]
    frame = spark.createDataFrame([(i, v, *["x"] * 10) for i, v in rows], f"vec_id long, embedding array<double>, {EXTRA}").repartition(5)
    kept, n, deviations, z, explained = brute_whitening(rows)
    got = whitening.whiten(frame).collect()
    assert Counter((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got) == Counter((i, k, n, d) for (i, _), d in zip(kept, deviations, strict=True) for k in range(1, 9))
    signs = {}
    for r in got:
        at = next(a for a, (i, _) in enumerate(kept) if i == r["vec_id"])
        want, k = z[at, r["component"] - 1], r["component"]
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-9
        if abs(want) > 1e-6:
            assert signs.setdefault(k, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
        assert abs(r["explained"] - explained[k - 1]) < 1e-9 and r["identity_error"] < 1e-9
    # vectors of another length, then nothing to scale by, then nothing at all
    odd = frame.union(spark.createDataFrame([(95, [1.0], *["x"] * 10), (96, [], *["x"] * 10)], frame.schema))
    assert whitening.whiten(odd).count() == 8 * n
    assert whitening.whiten(frame.filter("vec_id = 1")).collect() == [] == whitening.whiten(frame.limit(0)).collect()
    few = spark.createDataFrame([(i, [float(i), 2.0 * i, 1e300 * (i % 2)]) for i in range(4)], "vec_id long, embedding array<double>")
    wide = whitening.whiten(few).collect()
    assert {r["component"] for r in wide} <= {1, 2} and wide and all(r["identity_error"] < 1e-6 for r in wide)
