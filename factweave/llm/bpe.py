"""Encoding by a public byte-pair tokenizer with prefix dynamic programming.

A byte string's encoding ends in one last token only, and cutting that token off leaves the encoding of the shorter prefix. So the
last token of every prefix describes all encodings at once: the token that ends at byte i is the one whose start's last token forms
a valid pair with it, where a pair is valid if byte-pair merging would keep the border between the two. Appending bytes extends
the table; an edit keeps the table before it and re-encodes from there until the words are the old ones again.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import ship

#: How the vocabulary's byte-level pre-tokenizer cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHED_WORDS = 400_000

#: White space as PATTERN has it. A word of PATTERN never spans a border of these chunks, so that whole chunks can be cached.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_chunks = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall


def default_vocabulary() -> str:
    """The path of byte_bpe_50k.json; any other path can be given to the operators."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.json"


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others are moved above U+00FF in order."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, and the two tokens each was merged from."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids: dict[bytes, int] = {as_bytes(k): v for k, v in model["vocab"].items() if all(c in letters for c in k)}
        self.lengths: dict[int, int] = {t: len(b) for b, t in self.ids.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for i, m in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.merged[left, right] = whole
            self.halves.setdefault(whole, (left, right))
            self.rank.setdefault(whole, i)
        self.longest = max(map(len, self.ids))
        self.tails = {k[-1:] for k in self.ids}
        self._valid: dict[tuple[int, int], bool] = {}
        self._words: dict[str, list[int]] = {}
        self._packed = _Packed(self)

    def keeps_border(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens together gives just these two tokens.

        Undoes the latest merge at the border again and again: if any pair that meets there would have merged earlier than the
        parts that hold it, the border is lost.
        """
        key = (left, right)
        if (known := self._valid.get(key)) is not None:
            return known
        rank, halves, merged = self.rank, self.halves, self.merged
        never = len(rank) + 1
        # A merge across the border wins if it comes before the merge that made the part on the left, or not after that on the right.
        before, ok = never, True
        a, b = left, right
        while True:
            whole = merged.get((a, b))
            if whole is not None and rank[whole] < before:
                ok = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                before, a = ra, halves[a][1]
            else:
                before, b = rb + 1, halves[b][0]
        if len(self._valid) > 2_000_000:
            self._valid.clear()
        self._valid[key] = ok
        return ok

    def word(self, text: str) -> list[int]:
        """The ids of one word of PATTERN, from the cache where it is known."""
        ids = self._words.get(text)
        if ids is None:
            raw = text.encode("utf-8", "surrogatepass")
            whole = self.ids.get(raw)
            if whole is not None and (whole in self.halves or len(raw) == 1):
                ids = [whole] if len(raw) == 1 or self._makes(whole) else Prefixes(self, raw).ids()
            else:
                ids = Prefixes(self, raw).ids()
            if len(self._words) >= CACHED_WORDS:
                self._words.clear()
            self._words[text] = ids
        return ids

    def _makes(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return self.keeps_border(*self.halves[token]) is False

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as int32 bytes; none for a null or empty one."""
        if not text:
            return b""
        if len(self._packed) > CACHED_WORDS:
            self._packed.clear()
        return b"".join(map(self._packed.__getitem__, _chunks(text)))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or empty one."""
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()


class _Packed(dict):
    """The ids of chunks, as bytes."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, chunk: str) -> bytes:
        word = self.vocabulary.word
        self[chunk] = ids = np.array([t for w in _words(chunk) for t in word(w)], dtype=np.int32).tobytes()
        return ids


_words = regex.compile(PATTERN).findall


class Prefixes:
    """The last token of every prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw, self.last = vocabulary, b"", [-1]
        self.append(raw)

    def append(self, raw: bytes) -> None:
        """Extends the table by the new bytes' prefixes; earlier entries stay right."""
        v, last = self.vocabulary, self.last
        self.raw += raw
        data, ids, keeps = self.raw, v.ids, v.keeps_border
        for i in range(len(last), len(data) + 1):
            found = -1
            for j in range(max(0, i - v.longest), i):
                t = ids.get(data[j:i])
                if t is None or (j and last[j] < 0):
                    continue
                if (j == 0 and (i == 1 or v._makes(t))) or (j and (i - j == 1 or v._makes(t)) and keeps(last[j], t)):
                    found = t
                    break
            last.append(found)

    def edit(self, at: int, removed: int, inserted: bytes) -> None:
        """Replaces `removed` bytes at `at`; prefixes up to there keep their entries."""
        tail = self.raw[at + removed :]
        self.raw, self.last = self.raw[:at], self.last[: at + 1]
        self.append(inserted + tail)

    def ids(self) -> list[int]:
        out, i = [], len(self.raw)
        lengths = self.vocabulary.lengths
        while i:
            t = self.last[i]
            out.append(t)
            i -= lengths[t]
        return out[::-1]


class EncodedText:
    """A text whose encoding can be extended and edited without encoding it all again: the words' ends and ids."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text, self.ends, self.parts = vocabulary, "", [], []
        self.edit(0, 0, text)

    def append(self, text: str) -> None:
        self.edit(len(self.text), 0, text)

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Re-encodes from two words before the edit, whose look-ahead it can reach, until a word ends where an old one did."""
        text = self.text[:at] + inserted + self.text[at + removed :]
        keep = max(0, bisect_right(self.ends, at) - 2)
        begin = self.ends[keep - 1] if keep else 0
        shift, after = len(inserted) - removed, at + len(inserted)
        ends, parts, resume = [], [], len(self.ends)
        for m in regex.finditer(PATTERN, text, pos=begin):
            ends.append(m.end())
            parts.append(self.vocabulary.word(m.group()))
            k = bisect_left(self.ends, m.end() - shift)
            if m.start() >= after and k < len(self.ends) and self.ends[k] == m.end() - shift >= at + removed:
                resume = k + 1
                break
        tail = self.ends[resume:]
        self.ends = self.ends[:keep] + ends + [e + shift for e in tail]
        self.parts = self.parts[:keep] + parts + self.parts[resume:]
        self.text = text

    def ids(self) -> list[int]:
        return [t for p in self.parts for t in p]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and path."""
    v = Vocabulary(path)
    return v


def encode_column(texts: pa.Array, path: str) -> pa.ListArray:
    """list<int32> of a string array, built without a Python object per id."""
    v = vocabulary(path)
    packed = [v.packed(t) for t in texts.to_pylist()]
    offsets = np.zeros(len(packed) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))


def count_column(texts: pa.Array, path: str) -> pa.Array:
    """The number of ids of each text."""
    v = vocabulary(path)
    return pa.array([len(v.packed(t)) // 4 for t in texts.to_pylist()], pa.int64())


def encode_corpus(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, rows_at_once: int = 500) -> DataFrame:
    """(id_col, ids): the token ids of every text, without special tokens; strings that spell special tokens are ordinary text.

    Null and empty texts have the ids []. Repeated rows stay repeated, other columns are dropped. Every row is encoded where it is
    read, without a shuffle; a worker keeps a bounded cache of words.
    """
    ship(documents.sparkSession)
    where = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(i, rows_at_once)
                yield pa.RecordBatch.from_arrays([part.column(0), encode_column(part.column(1), where)], [id_col, "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")
