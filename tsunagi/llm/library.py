"""The tokenizers library inside tasks, with what it said of stretches of text remembered.

A stretch is white space and the run of other characters after it. The library's pattern always cuts before white space
that follows another character, so a text's ids are those of its stretches, one after the other. Texts with the four
control characters that Python alone counts as white space go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Stretches that a worker remembers, twice, and the longest stretch that it remembers.
REMEMBERED, LONGEST = 300_000, 64
#: Bytes that go to the library at a time.
AT_ONCE = 50_000

_stretches = re.compile(r"\s*\S+|\s+").findall
_odd = re.compile("[\x1c-\x1f]").search
#: A mark at the end of a stretch is a piece of its own after one of these.
MARKS, BEFORE = frozenset(".,;:!?"), frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


class Library:
    """A byte-level tokenizer of the library, from the text of its file.

    `plain`: strings of special tokens inside texts are ordinary text; otherwise the library's way, their own ids.
    """

    def __init__(self, definition: str, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = plain
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(names.values(), default=-1) + 1, np.int64)
        for name, i in names.items():
            self.lengths[i] = len(name)  # a letter of a byte-level name stands for a byte
        self.names = names
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ask(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: list[str], found: dict[str, bytes]) -> None:
        """The ids of stretches. Those that start with white space and end without are put together for the library,
        and the ids are told apart by their bytes."""
        together: list[list[str]] = [[]]
        alone, size = [], 0
        for s in missing:
            if s[0].isspace() and not s[-1].isspace():
                if size > AT_ONCE:
                    together.append([])
                    size = 0
                together[-1].append(s)
                size += len(s)
            else:
                alone.append(s)
        for group in together:
            if not group:
                continue
            (ids,) = self._ask(["".join(group)])
            ends, wanted = np.cumsum(self.lengths[ids]), np.cumsum([len(s.encode()) for s in group])
            at = np.searchsorted(ends, wanted)
            if len(ids) and ends[-1] == wanted[-1] and (ends[at] == wanted).all():
                raw, start = ids.tobytes(), 0
                for s, end in zip(group, (at + 1).tolist(), strict=True):
                    found[s] = raw[4 * start : 4 * end]
                    start = end
            else:
                alone += group
        for start in range(0, len(alone), 1000):
            for s, ids in zip(alone[start : start + 1000], self._ask(alone[start : start + 1000]), strict=True):
                found[s] = ids.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each, little-endian."""
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        stretches = [None if _odd(t) else _stretches(t) for t in texts]
        different: set[str] = set()
        for parts in stretches:
            if parts is not None:
                different.update(parts)
        passing: dict[str, bytes] = {}
        marked, asked = [], set()
        for s in different.difference(new):
            if s in old:
                new[s] = old[s]
            elif s[-1] in MARKS and len(s) > 2 and s[-2] in BEFORE:  # what was learned of a word serves with a mark too
                marked.append(s)
                asked.update((s[:-1], s[-1]))
            else:
                asked.add(s)
        for s in asked & old.keys():
            new[s] = old[s]
        self._learn([s for s in asked if s not in new], passing)
        for s in marked:
            word, mark = s[:-1], s[-1]
            passing[s] = (new.get(word) or passing[word]) + (new.get(mark) or passing[mark])
        new.update(passing)
        coded = [self._ask([t])[0].tobytes() if parts is None else b"".join(map(new.__getitem__, parts)) for t, parts in zip(texts, stretches, strict=True)]
        for s in passing:
            if len(s) > LONGEST:  # not kept
                del new[s]
        return coded


#: One a worker process and vocabulary, so that what it remembers serves all tasks.
_libraries: dict[tuple, Library] = {}


def library(definition, name: str, plain: bool) -> Library:
    """`definition` is a broadcast of the file's text, `name` tells files apart."""
    key = (name, plain)
    if key not in _libraries:
        _libraries.clear()
        _libraries[key] = Library(definition.value, plain)
    return _libraries[key]
