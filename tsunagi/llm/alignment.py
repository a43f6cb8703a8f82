"""Alignment of two tokenizers' tokens over the same bytes.

Where a token of both ends, the text is cut; what lies between two cuts is a group. A range of bytes has the tokens that
end in it and becomes a fragment: the tokens up to its first cut (open to the left), closed groups, and the tokens after
its last cut (open to the right). Two neighbouring fragments compose: the first one's open end and the second one's open
start become a closed group if the second has a cut, and one open stretch if not. That is associative, so fragments of a
very long document are made apart and composed in a tree of tasks; whole groups are kept as text and as counted links.

Two tokens are linked if their bytes overlap, which happens inside groups alone: every stretch between two neighbouring
ends of either tokenizer lies in one token of each, and is one link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _slices
from .common import map_arrow, staged, table
from .library import BEFORE, LONGEST, MARKS, _odd, _stretches, library

#: Bytes of text that make a fragment, and fragments that a task composes at a time.
RANGE, FAN = 65_536, 8
#: At most so many id pairs, those of the most documents, are broadcast.
HOT = 200_000
#: Stretches of text whose groups and links a worker remembers, twice, and how many it learns at a time.
REMEMBERED, AT_ONCE = 70_000, 20_000

_INTS, _LONGS = T.ArrayType(T.IntegerType(), False), T.ArrayType(T.LongType(), False)
_OPEN = ("head_a", "head_a_ends", "head_b", "head_b_ends", "tail_a", "tail_a_ends", "tail_b", "tail_b_ends")
_NONE = np.zeros(0, np.int64)


class Fragment:
    """What a range of bytes says. `head` and `tail` are (ids of a, ends of a, ids of b, ends of b); without a cut all
    tokens are in the head. `pairs` are links of closed groups as numbers (a << 32 | b), with how often each occurs."""

    def __init__(self, head, cut=False, tail=(_NONE,) * 4, n_groups=0, groups=(), pairs=_NONE, times=_NONE):
        self.head, self.cut, self.tail, self.n_groups, self.groups, self.pairs, self.times = head, cut, tail, n_groups, list(groups), pairs, times

    @classmethod
    def of(cls, a, a_ends, b, b_ends) -> Fragment:
        """The fragment of tokens by their ids and, rising, where they end."""
        if not len(a) or not len(b):
            return cls((a, a_ends, b, b_ends))
        at = np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)
        ia = np.flatnonzero(b_ends[at] == a_ends)
        if not len(ia):
            return cls((a, a_ends, b, b_ends))
        ib = at[ia]
        x, y, u, v = ia[0] + 1, ib[0] + 1, ia[-1] + 1, ib[-1] + 1
        made = cls((a[:x], a_ends[:x], b[:y], b_ends[:y]), True, (a[u:], a_ends[u:], b[v:], b_ends[v:]))
        made._close(a[x:u], a_ends[x:u], b[y:v], b_ends[y:v], (ia[1:] + 1 - x).tolist(), (ib[1:] + 1 - y).tolist())
        return made

    def _close(self, a, a_ends, b, b_ends, cuts_a, cuts_b, before=False) -> None:
        """Adds closed groups, which end at these places of a and of b, after those that are there, or before them."""
        if not cuts_a:
            return
        left, right, groups, i, j = list(map(str, a.tolist())), list(map(str, b.tolist())), [], 0, 0
        for k, m in zip(cuts_a, cuts_b, strict=True):
            groups.append(f"{left[i]}|{right[j]}" if k - i == 1 == m - j else f"{','.join(left[i:k])}|{','.join(right[j:m])}")
            i, j = k, m
        ends = np.union1d(a_ends, b_ends)
        links = a[np.searchsorted(a_ends, ends)].astype(np.int64) << 32 | b[np.searchsorted(b_ends, ends)].astype(np.int64)
        pairs, times = np.unique(links, return_counts=True)
        self._count(pairs, times)
        self.n_groups += len(groups)
        self.groups = [";".join(groups), *self.groups] if before else [*self.groups, ";".join(groups)]

    def _count(self, pairs, times) -> None:
        if not len(self.pairs):
            self.pairs, self.times = pairs, times
        elif len(pairs):
            self.pairs, at = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
            self.times = np.bincount(at, np.concatenate([self.times, times])).astype(np.int64)

    def then(self, other: Fragment) -> Fragment:
        """The fragment of both ranges, `other` being the next one."""
        join = lambda x, y: tuple(np.concatenate([p, q]) for p, q in zip(x, y, strict=True))
        if not self.cut:
            return Fragment(join(self.head, other.head), other.cut, other.tail, other.n_groups, other.groups, other.pairs, other.times)
        if not other.cut:
            return Fragment(self.head, True, join(self.tail, other.head), self.n_groups, self.groups, self.pairs, self.times)
        both = Fragment(self.head, True, other.tail, self.n_groups, self.groups, self.pairs, self.times)
        a, a_ends, b, b_ends = join(self.tail, other.head)
        both._close(a, a_ends, b, b_ends, [len(a)], [len(b)])
        both._count(other.pairs, other.times)
        both.n_groups += other.n_groups
        both.groups = both.groups + other.groups
        return both

    def closed(self) -> Fragment:
        """The fragment of a whole document, whose start counts as a cut; all of its tokens are in closed groups then."""
        if self.cut:
            a, a_ends, b, b_ends = self.head
            self._close(a, a_ends, b, b_ends, [len(a)], [len(b)], before=True)
            self.head = (_NONE,) * 4
        return self


class Tokens:
    """Both tokenizers, with the bytes that each id stands for."""

    def __init__(self, a_definition, a_name: str, b_model: bytes):
        import sentencepiece

        self.a = library(a_definition, a_name, True)
        letters = _letters()
        self.a_bytes = [b""] * len(self.a.lengths)
        for name, i in self.a.names.items():
            self.a_bytes[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        surfaces = [p.replace("▁", " ") for p, is_byte in pieces if not is_byte]
        # white space that a piece has after another character, so that b may not cut before it; U+2581 stands for a space
        self.joined = {y for p in surfaces for x, y in zip(p, p[1:]) if y.isspace() and not x.isspace()} | {"▁"}
        self.before = self.b.encode("\n")
        self.cuts = " " not in self.joined and not any("\n" in p for p in surfaces) and b"".join(self.b_bytes[i] for i in self.before) == b" \n"
        self.signed = [f"{i}{sign}" for t, signs in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for sign in signs for i in range(len(t))]
        self.marks = not any(x in BEFORE and y in MARKS for p in surfaces for x, y in zip(p, p[1:]))
        self.new: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def aligned(self, texts: list[str], most: int = RANGE) -> list[tuple | None]:
        """What each text says as a whole document: (n_a, n_b, n_groups, digest of the groups, links, times). Both tokenizers
        cut between stretches, so its groups and links are those of its stretches, which are remembered. None for
        texts that are to be looked at as a whole: empty or long ones (which may have `most` bytes), and those where a cut or the bytes are in doubt."""
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        plain = lambda t: self.cuts and t and 4 * len(t) < most and not _odd(t) and self.joined.isdisjoint(t)
        stretches = [_stretches(" " + t) if plain(t) else None for t in texts]
        different: set[str] = set()
        for parts in stretches:
            if parts is not None:
                different.update(parts)
        marked, asked = [], set()
        for s in different.difference(new):
            if s in old:
                new[s] = old[s]
            elif self.marks and s[-1] in MARKS and len(s) > 2 and s[-2] in BEFORE:  # what was learned of a word serves with a mark too
                marked.append(s)
                asked.update((s[:-1], s[-1]))
            else:
                asked.add(s)
        for s in asked & old.keys():
            new[s] = old[s]
        missing = [s for s in asked if s not in new]
        for start in range(0, len(missing), AT_ONCE):
            self._align(missing[start : start + AT_ONCE])
        for s in marked:
            word, mark = new[s[:-1]], new[s[-1]]
            new[s] = None if word is None or mark is None else tuple(x + y for x, y in zip(word, mark, strict=True))
        found = []
        for parts in stretches:
            entries = None if parts is None else list(map(new.__getitem__, parts))
            if entries is None or None in entries:
                found.append(None)
                continue
            n_a, n_b, n_groups, groups, links = zip(*entries, strict=True)
            pairs, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
            found.append((sum(n_a), sum(n_b), sum(n_groups), hashlib.sha256("".join(groups)[:-1].encode()).hexdigest(), pairs, times))
        for s in (*missing, *marked):
            if len(s) > LONGEST:  # not kept
                del new[s]
        return found

    def _align(self, missing: list[str]) -> None:
        """Groups and links of stretches that are not known yet: of all of them as of one text, cut at their ends."""
        of_a: dict[str, bytes] = {}
        self.a._learn(missing, of_a)
        raw_a = [np.frombuffer(of_a[s], "<u4") for s in missing]
        raw_b = [b[len(self.before) :] for b in self.b.encode(["\n" + s for s in missing], num_threads=1)] if missing else []
        size = np.array([len(s.encode()) for s in missing], np.int64)
        if not self._whole(missing, raw_a, raw_b, size):
            good = [self._whole([s], [a], [b], n) for s, a, b, n in zip(missing, raw_a, raw_b, size[:, None], strict=True)]
            self.new.update((s, None) for s, fine in zip(missing, good, strict=True) if not fine)
            missing, raw_a, raw_b = ([x for x, fine in zip(rows, good, strict=True) if fine] for rows in (missing, raw_a, raw_b))
            size = size[np.array(good, bool)]
        if not missing:
            return
        (a, a_ends), (b, b_ends) = self._ends(raw_a, raw_b)
        to, ends = np.cumsum(size), np.union1d(a_ends, b_ends)
        cut = a_ends[b_ends[np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)] == a_ends]
        links = (a[np.searchsorted(a_ends, ends)] << 32 | b[np.searchsorted(b_ends, ends)]).tobytes()
        # the texts of the groups: ids with the sign that follows them, those of a before those of b in each group
        group_a, group_b = np.searchsorted(cut, a_ends), np.searchsorted(cut, b_ends)
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        last = lambda group: np.append(group[1:] != group[:-1], True)
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        signed = np.empty(len(a) + len(b), np.int64)
        signed[place_a], signed[place_b] = a + n_a * last(group_a), b + 2 * n_a + n_b * last(group_b)
        words = list(map(self.signed.__getitem__, signed.tolist()))
        bounds = [np.searchsorted(x, to, side="right").tolist() for x in (a_ends, b_ends, cut, ends)]
        i = j = group = link = 0
        for s, k, m, g, x in zip(missing, *bounds, strict=True):
            self.new[s] = (k - i, m - j, g - group, "".join(words[i + j : k + m]), links[8 * link : 8 * x])
            i, j, group, link = k, m, g, x

    def _ends(self, raw_a: list, raw_b: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of both one after the other, and where they end."""
        a = np.concatenate(raw_a).astype(np.int64)
        b = np.fromiter(chain.from_iterable(raw_b), np.int64, sum(map(len, raw_b)))
        return (a, np.cumsum(self.a_lengths[a])), (b, np.cumsum(self.b_lengths[b]))

    def _whole(self, stretches: list[str], raw_a: list, raw_b: list, size: np.ndarray) -> bool:
        """Whether the bytes of both one's ids are those of the stretches, for each of them."""
        if not stretches:
            return True
        want, to = "".join(stretches).encode(), np.cumsum(size)
        for (ids, ends), known in zip(self._ends(raw_a, raw_b), (self.a_bytes, self.b_bytes), strict=True):
            if not len(ids) or ends[-1] != len(want) or (ends[np.searchsorted(ends, to)] != to).any() or b"".join(map(known.__getitem__, ids.tolist())) != want:
                return False
        counts = [np.searchsorted(ends, to, side="right") for _, ends in self._ends(raw_a, raw_b)]
        return all(np.array_equal(n, np.cumsum([len(r) for r in rows])) for n, rows in zip(counts, (raw_a, raw_b), strict=True))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of a and of b for each text; none where either one's bytes aren't those of a space and the text."""
        spaced = [" " + t for t in texts]
        for text, raw, b in zip(spaced, self.a.encode(spaced), self.b.encode(texts, num_threads=1), strict=True):
            a, want = np.frombuffer(raw, "<u4"), text.encode()
            if len(text) > 1 and b"".join(map(self.a_bytes.__getitem__, a.tolist())) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want:
                yield a, np.array(b, np.int64)
            else:
                yield _NONE, _NONE


def _letters() -> dict[str, int]:
    """Which byte a letter of a byte-level name stands for: printable ones for themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


_tokens: dict[str, Tokens] = {}


def _state_schema(id_col: str, id_type: T.DataType) -> T.StructType:
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField(id_col, id_type), T.StructField("seq", T.IntegerType()), T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("groups", T.StringType()), T.StructField("a", _INTS), T.StructField("b", _INTS), T.StructField("times", _INTS), T.StructField("cut", T.BooleanType())])
    for name in _OPEN:
        schema.add(name, _LONGS if name.endswith("ends") else _INTS)
    return schema


def _values(f: Fragment, whole: bool) -> list:
    """The columns of a fragment from n_groups on. Of a whole document the groups are kept as a digest alone."""
    groups = ";".join(f.groups)
    if whole:
        groups = hashlib.sha256(groups.encode()).hexdigest() if f.n_groups else ""
    return [f.n_groups, whole, groups, f.pairs >> 32, f.pairs & 0xFFFFFFFF, f.times, f.cut, *f.head, *f.tail]


def _batch(rows: list[list], schema: T.StructType, ids: list) -> pa.RecordBatch:
    """A batch of rows (all columns but the id's, which are one-row arrays)."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrays = []
    for at, field in enumerate(schema.fields):
        if at == 1:
            arrays.append(pa.concat_arrays(ids))
            continue
        column = [r[at - (at > 1)] for r in rows]
        if isinstance(field.dataType, T.ArrayType):
            ends = np.zeros(len(column) + 1, np.int32)
            np.cumsum([len(x) for x in column], out=ends[1:])
            kind = np.int32 if isinstance(field.dataType.elementType, T.IntegerType) else np.int64
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(column).astype(kind))))
        else:
            arrays.append(pa.array(column, to_arrow_type(field.dataType)))
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def fragments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE) -> DataFrame:
    """Fragments of every text, of `range_bytes` bytes each; documents of one fragment are whole at once.
    Both vocabulary files are read by the driver and broadcast."""
    context = docs.sparkSession.sparkContext
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        a_file, b_file = context.broadcast(a.read()), context.broadcast(b.read())
    source = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    source = source.toDF("id", "body")
    schema = _state_schema(id_col, source.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"{a_path}\n{b_path}"
        if key not in _tokens:
            _tokens.clear()
            _tokens[key] = Tokens(a_file, a_path, b_file.value)
        tokens, uid = _tokens[key], TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in _slices(whole, "body"):
                rows, ids, size = [], [], 0
                texts = batch.column("body").to_pylist()
                known = tokens.aligned(texts, range_bytes)
                others = tokens.encode([t for t, told in zip(texts, known, strict=True) if told is None])
                for at, told in enumerate(known):
                    uid += 1
                    one = batch.column("id").slice(at, 1)
                    if told is not None:
                        n_a, n_b, n_groups, digest, pairs, times = told
                        rows.append([uid, 0, n_a, n_b, n_groups, True, digest, pairs >> 32, pairs & 0xFFFFFFFF, times, True, *(_NONE,) * 8])
                        ids.append(one)
                        size += len(texts[at])
                        if size > 1_000_000:
                            yield _batch(rows, schema, ids)
                            rows, ids, size = [], [], 0
                        continue
                    a, b = next(others)
                    a_ends, b_ends = np.cumsum(tokens.a_lengths[a.astype(np.int64)]), np.cumsum(tokens.b_lengths[b])
                    total = int(a_ends[-1]) if len(a) else 0
                    count = max(1, -(-total // range_bytes))
                    bounds = np.arange(1, count + 1) * range_bytes
                    i, j = (np.concatenate([[0], np.searchsorted(e, bounds, side="right")]) for e in (a_ends, b_ends))
                    for seq in range(count):
                        p, q = slice(i[seq], i[seq + 1]), slice(j[seq], j[seq + 1])
                        made = Fragment.of(a[p], a_ends[p], b[q], b_ends[q])
                        values = _values(made.closed() if count == 1 else made, count == 1)
                        rows.append([uid, seq, p.stop - p.start, q.stop - q.start, *values])
                        ids.append(one)
                        size += total // count + 1
                    if size > 1_000_000:
                        yield _batch(rows, schema, ids)
                        rows, ids, size = [], [], 0
                if rows:
                    yield _batch(rows, schema, ids)

    return map_arrow(source, run, schema)


def compose(parts: DataFrame, id_col: str = "doc_id", fan: int = FAN) -> DataFrame:
    """Whole documents from their fragments, level by level: a task composes `fan` neighbours, on as many levels as the
    longest document needs. Each level is one shuffle, of open tokens and of what closed groups say."""
    schema = parts.schema
    places = {name: at for at, name in enumerate(schema.names)}

    def level(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = one = sums = made = None

            def row() -> pa.RecordBatch:
                done = made.closed() if last else made
                return _batch([[key[0], key[1], *sums, *_values(done, last)]], schema, [one])

            for batch in batches:
                columns = [batch.column(c) for c in schema.names]
                for at in range(batch.num_rows):
                    cell = lambda name: columns[places[name]][at]  # noqa: B023, E731
                    array = lambda name: cell(name).values.to_numpy().astype(np.int64)
                    opened = [array(name) for name in _OPEN]
                    groups = cell("groups").as_py()
                    part = Fragment(tuple(opened[:4]), cell("cut").as_py(), tuple(opened[4:]), cell("n_groups").as_py(), [groups] if groups else [], array("a") << 32 | array("b"), array("times"))
                    here, counts = (cell("uid").as_py(), cell("seq").as_py() // fan), [cell("n_a").as_py(), cell("n_b").as_py()]
                    if here == key:
                        made, sums = made.then(part), [x + y for x, y in zip(sums, counts, strict=True)]
                        continue
                    if key is not None:
                        yield row()
                    key, one, sums, made = here, columns[places[id_col]].slice(at, 1), counts, part
            if key is not None:
                yield row()

        return run

    most = parts.agg(F.max("seq")).collect()[0][0]
    while most:
        most //= fan
        node = F.floor(F.col("seq") / fan).cast("int")
        ordered = parts.repartition("uid", node).sortWithinPartitions("uid", "seq")
        parts = map_arrow(ordered, level(not most), schema)
    return parts


def link_counts(documents: DataFrame) -> DataFrame:
    """a, b, `count`: how many documents hold the pair linked, and `best`: whether no other b has more with this a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("a", "b"))
            pairs, count = np.unique(a << 32 | b, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(count)], names=["a", "b", "count"])

    found = map_arrow(documents.select("a", "b"), run, "a int, b int, count long").groupBy("a", "b").agg(F.sum("count").alias("count"))
    found = staged(found)
    best = found.groupBy("a").agg(F.max("count").alias("most"))
    return found.join(best, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _scores(documents: DataFrame, counts: DataFrame, hot: int) -> DataFrame:
    """uid, n_links, n_best and count_sum of each document that has links. Pairs of the most documents, `hot` at most, are
    looked up in a broadcast; the others meet their counts in a join, where no pair has more than 1/hot of all rows."""
    total = counts.agg(F.sum("count")).collect()[0][0] or 0
    limit = -(-total // hot) if total else 1
    known = counts.filter(F.col("count") >= limit).toArrow()
    keys = known.column("a").to_numpy().astype(np.int64) << 32 | known.column("b").to_numpy()
    order = np.argsort(keys)
    sent = documents.sparkSession.sparkContext.broadcast((keys[order], known.column("count").to_numpy()[order], known.column("best").to_numpy(zero_copy_only=False)[order]))
    schema = "uid long, a int, b int, times long, n_links long, n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = sent.value
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            sizes = np.diff(batch.column("a").offsets.to_numpy())
            a, b, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("a", "b", "times"))
            of, pair = np.repeat(np.arange(len(uid)), sizes), a << 32 | b
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            found = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            here, spot = of[found], at[found]
            n = times[found]
            total = lambda x: np.bincount(here, x, len(uid)).astype(np.int64)  # noqa: B023, E731
            exact = np.zeros(len(uid), np.int64)
            np.add.at(exact, here, n * count[spot])
            cold = np.flatnonzero(~found)
            nothing = lambda size: pa.nulls(size, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid), pa.nulls(len(uid), pa.int32()), pa.nulls(len(uid), pa.int32()), nothing(len(uid)), pa.array(total(n)), pa.array(total(n * best[spot])), pa.array(exact)], names=_SCORED
            )
            if len(cold):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[of[cold]]), pa.array(a[cold].astype(np.int32)), pa.array(b[cold].astype(np.int32)), pa.array(times[cold]), nothing(len(cold)), nothing(len(cold)), nothing(len(cold))], names=_SCORED
                )

    rows = staged(map_arrow(documents.select("uid", "a", "b", "times"), run, schema))
    cold = rows.filter("a is not null").select("uid", "a", "b", "times").join(counts.filter(F.col("count") < limit), ["a", "b"])
    cold = cold.select("uid", F.col("times").alias("n_links"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("count")).alias("count_sum"))
    every = rows.filter("a is null").select(*cold.columns).unionByName(cold)
    return every.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])


_SCORED = ["uid", "a", "b", "times", "n_links", "n_best", "count_sum"]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE, fan: int = FAN, hot: int = HOT) -> DataFrame:
    """One row a document: the id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    `a_path` is a byte-level file of the tokenizers library, whose tokens are those of a space and the text; `b_path` is a
    sentencepiece model, which puts the space itself. Strings of special tokens are plain text. A null or empty text, and
    one whose tokens of either kind do not give its bytes back, has zeros and the digest ''. Repeated rows and null ids
    are documents of their own, each counted; an empty table gives no rows; other columns are ignored, whatever their
    names. Two links with one count are both best if no other has more. `range_bytes`, `fan` and `hot` don't change the
    rows. A text is encoded in one task; its fragments are composed in a tree of tasks.
    """
    parts = staged(fragments(docs, a_path, b_path, id_col, text_col, range_bytes))
    whole = parts.filter("whole")
    columns = ["uid", id_col, "n_a", "n_b", "n_groups", F.col("groups").alias("groups_sha256"), "a", "b", "times"]
    composed = staged(compose(parts.filter(~F.col("whole")), id_col, fan).select(*columns))
    documents = whole.select(*columns).unionByName(composed)
    linked = documents.filter("n_groups > 0")
    scores = _scores(linked, staged(link_counts(linked)), hot)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return documents.drop("a", "b", "times").join(scores, "uid", "left").select(id_col, "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
