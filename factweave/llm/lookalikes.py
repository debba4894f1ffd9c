"""One form for texts that look the same: a trie of vocabulary words walked by a weighted edit automaton, and a table for the rest.

Every token with a character beyond ASCII is read against the trie of a public vocabulary's words. The automaton moves along an edge at no cost where
the character read and the edge look the same, and stays where it is on an ignorable; it moves at a cost where they look alike only in
some fonts, in a token that has a plainly Latin letter; any other edit costs more than is allowed. The word reached at the least cost gives the canonical spelling: the ASCII one of the
words that look the same, or else the one ranked first. A token that reaches no word, or two at one cost, is normalized by the table. Words and
tokens are told apart by their looks alone, so that tokens that look the same always get the same form.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

# Letters of other scripts that look like a Latin letter in common fonts.
LOOK_ALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ɑ": "a", "ɡ": "g", "ı": "ı", "ո": "n", "օ": "o", "ս": "u",
}
# Letters that stand for a Latin one only in a word that is Latin otherwise.
WEAK = {
    "к": "k", "κ": "k", "ν": "v", "υ": "u", "ρ": "p", "α": "a", "ι": "i", "τ": "t", "χ": "x", "ε": "e", "η": "n", "в": "b", "н": "h", "м": "m", "т": "t", "г": "r", "п": "n", "и": "u", "ѵ": "v", "ԝ": "w", "ʏ": "y", "ɩ": "i", "ʀ": "r", "ɴ": "n", "ᴛ": "t", "ᴍ": "m",
    "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ᴋ": "k", "ᴅ": "d", "ᴇ": "e", "ᴀ": "a", "ʙ": "b", "ɢ": "g", "ʜ": "h", "ʟ": "l", "ᴘ": "p", "ᴜ": "u",
}
#: What an edit of the automaton costs, and what all edits of a token may cost.
EQUAL, ALIKE, OTHER, ALLOWED = 0, 1, 10, 3
# Joined letters, and hyphens that look like the ordinary one.
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj"}
HYPHENS = {"‐": "-", "‑": "-"}

_SPACES = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_BREAKS = re.compile("[ \t]*(?:\r\n|[\r\n\u0085\u2028\u2029])")
_IGNORED = re.compile(
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb\U000e0000-\U000e0fff"
    "\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]+"
)
_LETTERS = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")


def _wide() -> dict[str, str]:
    """Full-width and half-width forms, from their own compatibility mappings."""
    forms = (chr(c) for c in range(0xFF01, 0xFFEF))
    return {c: n for c in forms if (n := unicodedata.normalize("NFKC", c)) != c}


_TABLE = {k: v for k, v in LOOK_ALIKES.items() if k != v} | JOINED | HYPHENS | _wide()
_MAPPED = str.maketrans(_TABLE)


def looks(token: str) -> str:
    """The token by the table alone: canonically composed, ignorables dropped, look-alikes replaced, composed again."""
    plain = unicodedata.normalize("NFC", _IGNORED.sub("", token)).translate(_MAPPED)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", plain).translate(_MAPPED))


#: Latin letters that no letter of another script looks like: a token that has one is Latin.
_PLAIN = frozenset(c for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in LOOK_ALIKES.values())


class Trie:
    """Words by their looks, one edge a character; each end holds the canonical spelling of the words that look so."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for rank, word in enumerate(words):
            look = looks(word)
            node = self.root
            for c in unicodedata.normalize("NFD", look):
                node = node.setdefault(c, {})
            # the ASCII spelling, where there is one, is what tokens within ASCII have already
            node.setdefault("", look if look.isascii() else word)

    def find(self, token: str) -> str | None:
        """The canonical spelling of the word reached at the least cost; None where there is none or two of one cost."""
        look = unicodedata.normalize("NFD", looks(token))
        states = [(0, self.root)]
        if not _PLAIN.isdisjoint(look):  # look-alikes of some fonts count
            for c in look:
                after: dict[int, tuple[int, dict]] = {}
                for cost, node in states:
                    for edge, price in ((c, EQUAL), (WEAK.get(c), ALIKE)):
                        if (child := node.get(edge)) is not None and cost + price <= ALLOWED and (id(child) not in after or after[id(child)][0] > cost + price):
                            after[id(child)] = (cost + price, child)
                states = list(after.values())
                if not states:
                    return None
        else:
            node = self.root
            for c in look:
                if (node := node.get(c)) is None:
                    return None
            states = [(0, node)]
        ends = sorted((cost, node[""]) for cost, node in states if "" in node)
        # words of some fonts' look-alikes must be ASCII
        ends = [(cost, word) for cost, word in ends if not cost or word.isascii()]
        return ends[0][1] if ends and (len(ends) == 1 or ends[0][0] < ends[1][0]) else None


def default_vocabulary() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def vocabulary_words(path: str) -> tuple[str, ...]:
    """Whole words of a public tokenizer's file, in rank order; a file's size bounds them. A file that is missing on a worker is an error."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    words = (t.decode("utf-8", "ignore").strip() for t in tokens)
    return tuple(dict.fromkeys(unicodedata.normalize("NFC", w) for w in words if len(w) > 1 and w.isalpha()))


class Canonical(dict):
    """Space-separated pieces with characters beyond ASCII -> their one form; bounded."""

    def __init__(self, words: tuple[str, ...]):
        super().__init__()
        self.trie = Trie(list(words))
        self.tokens: dict[str, str] = {}

    def __missing__(self, piece: str) -> str:
        if len(self) > 300_000:
            self.clear()
        out = _IGNORED.sub("", piece)
        out = unicodedata.normalize("NFC", "".join(_MAPPED_PUNCTUATION.get(c, c) for c in out))
        self[piece] = out = _LETTERS.sub(self._token, out)
        return out

    def _token(self, m: re.Match) -> str:
        token = m.group()
        if token.isascii():
            return token
        if (known := self.tokens.get(token)) is None:
            if len(self.tokens) > 300_000:
                self.tokens.clear()
            self.tokens[token] = known = unicodedata.normalize("NFC", self.trie.find(token) or looks(token))
        return known

    def text(self, text: str | None) -> str | None:
        """The one form of a text; line ends become LF, white space before them and at the end goes."""
        if text is None:
            return None
        if not text.isascii():
            text = _SPACES.sub(" ", text)
            text = " ".join([w if w.isascii() else self[w] for w in text.split(" ")])
        if "\r" in text or " \n" in text or "\t\n" in text or not text.isascii():
            text = _BREAKS.sub("\n", text)
        return (text if text.isprintable() else _IGNORED.sub("", text)).rstrip()


#: Everything of the table that is no letter, joined and wide letters included, so that tokens are cut alike whatever form they have.
_MAPPED_PUNCTUATION = {k: v for k, v in _TABLE.items() if k not in LOOK_ALIKES}


@lru_cache(maxsize=2)
def canonical(path: str) -> Canonical:
    return Canonical(vocabulary_words(path))


def one_form(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_text: bool = True, rows_at_once: int = 500) -> DataFrame:
    """id_col, form_hash, text_hash, visible[, form]: the one form of every text, with SHA-256 hashes of it and of the text itself.

    `visible` tells whether the form has anything but white space. A null text has null hashes and form and is not visible; an empty
    one has an empty form. Repeated rows stay repeated, other columns are dropped. No shuffle; a worker's caches are bounded.
    """
    ship(documents.sparkSession)
    where = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = canonical(where)
        digest = lambda t: None if t is None else hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()
        for batch in batches:
            for i in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(i, rows_at_once)
                texts = part.column(1).to_pylist()
                made = [forms.text(t) for t in texts]
                columns = [part.column(0), pa.array(map(digest, made), pa.binary()), pa.array(map(digest, texts), pa.binary()), pa.array([bool(t and not t.isspace()) for t in made], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(made, pa.string())] if keep_text else [])], names)

    names = [id_col, "form_hash", "text_hash", "visible", *(["form"] if keep_text else [])]
    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, form_hash binary, text_hash binary, visible boolean" + ", form string" * keep_text)


def look_alike_pairs(documents: DataFrame, *, path: str | None = None) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents whose texts are unequal but have one visible form.

    The forms are made once; only hashes are shuffled. Forms with a single spelling leave before the join, so exact copies alone
    never meet; the join is an equi-join on the form that AQE splits where a form is hot.
    """
    made = cut(one_form(documents, path=path, keep_text=False).where("visible").select("doc_id", "form_hash", "text_hash"))
    spelled = made.groupBy("form_hash").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).where("lo <> hi").select("form_hash")
    some = made.join(spelled, "form_hash", "left_semi")
    a, b = (some.select(F.col("form_hash"), F.col("doc_id").alias(f"doc_{x}"), F.col("text_hash").alias(f"text_{x}")) for x in "ab")
    return a.join(b, "form_hash").where("doc_a < doc_b and text_a <> text_b").select("doc_a", "doc_b").distinct()
