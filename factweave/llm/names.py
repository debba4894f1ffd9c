"""Linking variant spellings of names: a prefix-filtered set-similarity join on token q-grams, verified by soft weighted token similarity.

The join has two levels. Distinct tokens are sets of q-grams: grams are ordered rare first, tokens within some edits must share a gram
of their prefixes in that order, and an equi-join on prefix grams with a positional bound finds all of them; abbreviations meet by some of
their letters. Names are sets of tokens, where a token also stands for all its partners. In names that are one every token has a partner, but for two
that are run together in the other name, so few of a name's rarest tokens suffice: an equi-join on pairs of tokens finds all names that the
verification can accept. Candidates are verified token by token: each token must find a partner, spelled nearly alike, shortened, an
initial or a nickname, and partners count by the rarity of the token. Links make up components.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship, spread
from .components import connected_components

QGRAM, SCORE = 2, 0.8
#: Names of more tokens than that meet by single tokens, as their pairs of tokens would be too many; it changes no result.
LONGEST = 24

# Legal forms and how they are written, titles, stand-ins, and the short forms of first names.
LEGAL = {
    "limited": "ltd", "ltd": "ltd", "private": "pvt", "pvt": "pvt", "p": "pvt", "company": "co", "co": "co", "incorporated": "inc", "incorp": "inc", "inc": "inc",
    "corporation": "corp", "corpn": "corp", "corp": "corp", "llp": "llp", "llc": "llc", "plc": "plc",
}
TITLES = frozenset({"mr", "mrs", "ms", "miss", "dr", "prof", "shri", "smt", "sri", "sir", "messrs", "the"})
STAND_INS = frozenset({"company", "group", "issuer", "firm", "entity", "corporation", "organisation", "organization", "it", "we", "they", "us", "our", "this", "that", "its", "their", "business", "borrower", "parent", "undertaking", "management", "board", "seller", "buyer", "lender"})
NICKNAMES = {
    "bill": "william", "will": "william", "billy": "william", "rob": "robert", "bob": "robert", "bobby": "robert", "vicky": "victoria", "mike": "michael", "mick": "michael", "greg": "gregory",
    "ted": "theodore", "theo": "theodore", "becky": "rebecca", "debbie": "deborah", "deb": "deborah", "tony": "anthony", "raju": "rajendra", "sue": "susannah", "susie": "susannah", "kate": "katherine",
    "kathy": "katherine", "katie": "katherine", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "chris": "christopher",
    "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "ben": "benjamin", "fran": "francesca", "hans": "johann", "jim": "james", "jimmy": "james", "joe": "joseph", "tom": "thomas",
    "dick": "richard", "rick": "richard", "dan": "daniel", "dave": "david", "ed": "edward", "eddie": "edward", "jack": "john", "johnny": "john", "jenny": "jennifer", "nick": "nicholas", "pat": "patricia",
    "patty": "patricia", "sam": "samuel", "steve": "stephen", "tim": "timothy", "matt": "matthew", "andy": "andrew", "abby": "abigail", "cathy": "catherine", "harry": "henry", "larry": "lawrence",
    "ron": "ronald", "ken": "kenneth", "jeff": "jeffrey", "jerry": "gerald", "lucky": "lakshmi", "laxmi": "lakshmi",
}

_TOKEN = re.compile(r"[^\W_]+")


def allowed_edits(longer: int) -> int:
    """Edits that two tokens may differ by, from the length of the longer one."""
    return 0 if longer <= 3 else 1 if longer <= 5 else 2 if longer <= 9 else 3


@lru_cache(maxsize=200_000)
def edits(a: str, b: str) -> int:
    """Edit distance with neighbour swaps."""
    if a == b:
        return 0
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


def _legal(token: str) -> str | None:
    if (form := LEGAL.get(token)) is not None:
        return form
    if len(token) >= 6:
        return next((form for word, form in LEGAL.items() if len(word) >= 7 and abs(len(word) - len(token)) <= 2 and edits(token, word) <= (1 if len(token) < 9 else 2)), None)
    return None


def tokens_of(surface: str | None) -> list[str]:
    """The name's tokens without titles and legal forms; none for stand-ins, blanks and null."""
    if not surface:
        return []
    plain = unicodedata.normalize("NFKC", surface).lower().replace("m/s", " ").replace("’", "'")
    plain = re.sub(r"\b((?:[^\W\d_]\.){2,})", lambda m: m.group().replace(".", ""), plain)
    tokens = _TOKEN.findall(plain)
    kept = [t for t in tokens if t not in TITLES and _legal(t) is None]
    if not kept or all(t in STAND_INS for t in kept):
        return []
    return kept


def _shortened(a: str, b: str) -> bool:
    """Whether one is the other without some of its letters, as in abbreviations: two letters at least, the first one kept."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 2 or len(a) > 0.7 * len(b) or a[0] != b[0]:
        return False
    rest = iter(b[1:])
    return all(c in rest for c in a[1:])


@lru_cache(maxsize=400_000)
def token_similarity(a: str, b: str) -> float:
    """1 if equal, 0 if they can't be the same token."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.85 if a[0] == b[0] or NICKNAMES.get(b, b)[0] == a[0] or NICKNAMES.get(a, a)[0] == b[0] else 0.0
    n, m = NICKNAMES.get(a), NICKNAMES.get(b)
    if (n or a) == (m or b):
        return 0.95
    d = edits(a, b)
    most = max(len(a), len(b))
    if d <= allowed_edits(most):
        return 1.0 - d / most
    if (n or m) and token_similarity(n or a, m or b) > 0.7:
        return 0.85
    return 0.9 if _shortened(a, b) else 0.0


def _spelled(a: str, b: str) -> float:
    """token_similarity by spelling alone."""
    d, most = edits(a, b), max(len(a), len(b))
    return 1.0 - d / most if d <= allowed_edits(most) else 0.0


def _aligned(a: list[str], b: list[str], wa: list[float], wb: list[float], run: int = -1) -> float:
    """The weighted mean similarity of partners, best first, where every token has one; else 0. Initials stand for tokens of one name only.

    run: the place in `a` of two tokens put together, whose partner must be spelled nearly alike.
    """
    places = defaultdict(list)
    for j, y in enumerate(b):
        places[y].append(j)
    left, total = set(), 0.0
    for i in range(len(a) - 1, -1, -1):
        if places.get(a[i]):
            total += wa[i] + wb[places[a[i]].pop()]
        else:
            left.add(i)
    right = {j for js in places.values() for j in js}
    ranked = []
    for i in left:
        met = [(s, i, j) for j in right if (s := _spelled(a[i], b[j]) if i == run else token_similarity(a[i], b[j])) > 0.5]
        if not met:
            return 0.0
        ranked += met
    initials = [False, False]
    for s, i, j in sorted(ranked, reverse=True):
        if i in left and j in right:
            left.discard(i)
            right.discard(j)
            if len(a[i]) != len(b[j]):
                initials[0] |= len(a[i]) == 1
                initials[1] |= len(b[j]) == 1
            total += s * (wa[i] + wb[j])
    return 0.0 if left or right or all(initials) else total / (sum(wa) + sum(wb))


def name_similarity(a: list[str], b: list[str], wa: list[float], wb: list[float]) -> float:
    """Soft weighted token similarity, 0 where a token has no partner. Two tokens of one name may be run together in the other."""
    if len(a) == len(b):
        return _aligned(a, b, wa, wb)
    if abs(len(a) - len(b)) != 1:
        return 0.0
    if len(a) < len(b):
        a, b, wa, wb = b, a, wb, wa
    joined = lambda x, k: x[:k] + [x[k] + x[k + 1]] + x[k + 2 :]
    return max((_aligned(joined(a, k), b, joined(wa, k), wb, k) for k in range(len(a) - 1)), default=0.0)


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [tokens_of(s) for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.list_(pa.string()))], [*batch.schema.names, "tokens"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = pa.array([i for i in range(len(a)) if edits(a[i], b[i]) <= allowed_edits(max(len(a[i]), len(b[i])))], pa.int64())
        yield batch.take(keep)


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb, wa, wb = (batch.column(i).to_pylist() for i in range(6))
            keep = [k for k in range(len(a)) if name_similarity(ta[k], tb[k], wa[k], wb[k]) >= threshold]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["surface_a", "surface_b"])

    return run


def _most(n: Column, partner: bool = False) -> Column:
    """allowed_edits of the longer one's length n; with `partner`, the most of a string of n letters with one of any length."""
    a, b, c = (2, 3, 6) if partner else (3, 5, 9)
    return F.when(n <= a, 0).when(n <= b, 1).when(n <= c, 2).otherwise(3)


def _grams(strings: DataFrame, counts: DataFrame) -> DataFrame:
    """(s, n, gram, at): the grams of every string's prefix in the order of their rarity, with their places.

    The prefix holds one gram more than the most edits that a partner may have can change, one swap of neighbours among them, and all places of its last gram.
    """
    grams = strings.select("s", F.length("s").alias("n"), F.posexplode(F.expr(f"transform(sequence(1, length(s) + 3 - {QGRAM}), i -> substring(concat(' ', s, ' '), i, {QGRAM}))")).alias("at", "gram"))
    ranked = grams.join(counts, "gram", "left").groupBy("s", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram", "at"))).alias("g"))
    last = F.get("g", F.least(2 * _most(F.col("n"), True) + 1, F.size("g") - 1))
    prefix = F.filter("g", lambda e: (e["df"] < last["df"]) | (e["df"] == last["df"]) & (e["gram"] <= last["gram"]))
    return ranked.select("s", "n", F.explode(prefix).alias("g")).select("s", "n", "g.gram", "g.at")


def _sorted_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, key): strings that may have several swaps, with their sorted letters, and long ones also with these but for one."""
    for batch in batches:
        s, key = [], []
        for x in batch.column(0).to_pylist():
            if len(x) < 6:
                continue
            t = "".join(sorted(x))
            keys = [t] if len(x) < 9 else sorted({t} | {t[:i] + t[i + 1 :] for i in range(len(t))})
            s += [x] * len(keys)
            key += keys
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(key, pa.string())], ["s", "key"])


def close_tokens(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """(z, v): the strings v of `listed` (s) that are spelled nearly like z of `wanted` (s), itself included; both are distinct.

    The prefix-filtered join on q-grams; a shared gram must stand at about the same place in both, and lengths must be near. Of three edits
    two or more can be swaps of neighbours only in strings that have the same letters but for one at most: these meet by their sorted letters.
    """
    grams = listed.select(F.explode(F.expr(f"transform(sequence(1, length(s) + 3 - {QGRAM}), i -> substring(concat(' ', s, ' '), i, {QGRAM}))")).alias("gram"))
    counts = cut(grams.groupBy("gram").agg(F.count("*").alias("df")))
    q = _grams(wanted, counts).select(F.col("s").alias("z"), F.col("n").alias("nz"), "gram", F.col("at").alias("az"))
    # a partner's length is part of the key
    lengths = F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - 3), F.col("n") + 3)).alias("nz")
    x = _grams(listed, counts).select(F.col("s").alias("v"), F.col("n").alias("nv"), "gram", F.col("at").alias("av"), lengths)
    most = _most(F.greatest("nz", "nv"))
    met = q.join(x.where(F.abs(F.col("nz") - F.col("nv")) <= most), ["gram", "nz"]).where(F.abs(F.col("az") - F.col("av")) <= most)
    d = F.levenshtein("z", "v", 4)
    some = cut(met.where(d.between(0, most + F.when(most > 0, 1).otherwise(0))).select("z", "v", (d <= most).alias("sure")).distinct())
    letters = lambda df, c: df.mapInArrow(_sorted_letters, "s string, key string").select(F.col("s").alias(c), "key")
    swapped = letters(wanted, "z").join(letters(listed, "v"), "key").where(F.abs(F.length("z") - F.length("v")) <= 1).select("z", "v").distinct()
    unsure = some.where(~F.col("sure")).select("z", "v").unionByName(swapped)
    return some.where("sure").select("z", "v").unionByName(unsure.mapInArrow(_near, "z string, v string")).distinct()


def _lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, long, key): for every string the key of its abbreviations, which is its first two letters and its last one, and the keys that strings shortened to it may have."""
    for batch in batches:
        s, long, key = [], [], []
        for x in batch.column(0).to_pylist():
            if len(x) < 2:
                continue
            seen: set[str] = set()
            keys: set[str] = set()
            for c in x[1:]:
                keys |= {x[0] + b + c for b in seen} | {x[0] + c + c}
                seen.add(c)
            s += [x] * (1 + len(keys))
            long += [False] + [True] * len(keys)
            key += [x[0] + x[1] + x[-1], *sorted(keys)]
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(long, pa.bool_()), pa.array(key, pa.string())], ["s", "long", "key"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        yield batch.take(pa.array([i for i in range(len(a)) if _shortened(a[i], b[i])], pa.int64()))


def short_tokens(listed: DataFrame) -> DataFrame:
    """(z, v), both ways: the strings (s) of which one is the other without some of its letters, as in abbreviations."""
    keys = cut(spread(listed, "s").mapInArrow(_lettered, "s string, long boolean, key string"))
    side = lambda long, c: keys.where(F.col("long") == long).select(F.col("s").alias(c), "key")
    met = side(False, "z").join(side(True, "v"), "key").where(F.length("z") <= F.length("v") * F.lit(0.7)).select("z", "v")
    found = cut(met.mapInArrow(_short, "z string, v string"))
    return found.unionByName(found.select(F.col("v").alias("z"), F.col("z").alias("v")))


def _pairs_of(x: Column, y: Column, size: Column) -> Column:
    """One number for every pair of a token of x and one of y in names of that size."""
    return F.flatten(F.transform(x, lambda p: F.transform(y, lambda q: F.xxhash64(p, q, size))))


def _met_by_pairs(tokens: Column, first: int, size: Column) -> Column:
    """Numbers of the pairs of the first tokens of a name, to meet names of that size: one with its partners, the other to be met by its own."""
    at = lambda i: F.get(tokens, F.lit(i))
    return F.concat(*(_pairs_of(at(i)["near"], at(j)["called"], size) for i in range(first) for j in range(i + 1, first)))


def _met_by_one(tokens: Column, own: str, first: int | Column, size: Column) -> Column:
    """Numbers of the first single tokens of a name, to meet names of that size."""
    return F.flatten(F.transform(F.slice(tokens, 1, first), lambda t: F.transform(t[own], lambda x: F.xxhash64(x, size))))


def _asked(tokens: Column) -> Column:
    """Numbers by which a name with its tokens' partners, rare first, meets the tokens of every name that may be it.

    Of two names of one size each token has a partner. Where two tokens are run together, at most one of the shorter name's tokens has none,
    and two of the longer name's, so among two more of its tokens a pair is left. An initial stands for its partners only in the name that has
    the whole token, hence both names ask. Two tokens run together are themselves asked for in names of one or two tokens.
    """
    k, none = F.size(tokens), F.array().cast("array<bigint>")
    one = F.when(k == 1, _met_by_one(tokens, "near", 1, k)).otherwise(none)
    two = lambda least, first, size: F.when(k.between(least, LONGEST), _met_by_pairs(tokens, first, size)).otherwise(none)
    long = lambda first, size: F.when(k >= LONGEST, _met_by_one(tokens, "near", first, size)).otherwise(none)
    run = F.when(k == 2, _met_by_pairs(tokens, 2, F.lit(-2))).otherwise(none)
    return F.concat(one, two(2, 2, k), two(3, 3, k + 1), two(4, 4, k - 1), run, long(1, k), long(2, k + 1), long(3, k - 1))


def _held(tokens: Column) -> Column:
    k, none = F.size(tokens), F.array().cast("array<bigint>")
    single = F.when((k == 1) | (k >= LONGEST), _met_by_one(tokens, "forms", k, k)).otherwise(none)
    others = lambda t: F.flatten(F.transform(F.filter(tokens, lambda u: u["i"] != t["i"]), lambda u: _pairs_of(t["forms"], u["alike"], k)))
    return F.concat(single, F.when(k.between(2, LONGEST), F.flatten(F.transform(tokens, others))).otherwise(none))


def name_candidates(classes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) of all names (name, tokens, size) that name_similarity may accept, and (name, tokens, weights); size: how many spellings have these tokens."""
    vocabulary = classes.select(F.explode(F.array_distinct("tokens")).alias("token"), "size").groupBy("token").agg(F.sum("size").alias("df"))
    nick = F.try_element_at(F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv]), F.col("token"))
    forms = F.array_compact(F.array("token", nick))
    known = cut(vocabulary.select("token", "df", forms.alias("forms"), F.transform(F.filter(forms, lambda f: F.length(f) > 1), lambda f: F.substring(f, 1, 1)).alias("initials")))
    listed = cut(known.select(F.explode("forms").alias("s")).distinct())
    # two neighbours of a name, put together, and the place of the third token if there is one
    two = classes.where(F.size("tokens") == 2).select("name", F.array_join("tokens", "").alias("z"), F.lit(None).cast("int").alias("i"))
    three = classes.where(F.size("tokens") == 3).select("name", F.explode(F.array(*(F.struct(F.array_join(F.slice("tokens", 2 - i // 2, 2), "").alias("z"), F.lit(i).alias("i")) for i in (0, 2)))).alias("r")).select("name", "r.z", "r.i")
    run = cut(two.unionByName(three))
    close = cut(close_tokens(cut(listed.unionByName(run.select(F.col("z").alias("s"))).distinct()), listed))
    partners = close.unionByName(short_tokens(listed))
    alike = cut(known.select("token", F.explode("forms").alias("z")).join(partners, "z").select("token", "v").distinct())
    near = alike.groupBy("token").agg(F.collect_set("v").alias("alike"))
    # a misspelled common word is as common as the word
    soft = alike.join(known.select(F.col("token").alias("v"), F.col("df").alias("of")), "v").groupBy("token").agg(F.sum("of").alias("soft"))
    rare = lambda c: F.log(F.lit(1.0) + F.lit(float(n)) / F.col(c))
    # forms are met as they are, alike ones meet them both ways; of a whole token also its initials are called
    of = ["token", rare("df").alias("w"), rare("soft").alias("ws"), "forms", "alike", F.array_union("alike", "initials").alias("near"), F.array_union("forms", "initials").alias("called")]
    described = known.join(near, "token").join(soft, "token").select(*of)
    words = classes.select("name", F.posexplode("tokens").alias("i", "token")).join(described, "token")
    rows = cut(words.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("i", "token", "w", "ws", "forms", "alike", "near", "called"))).alias("t")))
    by_rarity = lambda c: F.array_sort(c, lambda x, y: F.when(x["ws"] > y["ws"], -1).when(x["ws"] < y["ws"], 1).when(x["token"] < y["token"], -1).when(x["token"] > y["token"], 1).otherwise(0))
    names = rows.select("name", by_rarity(F.col("t")).alias("t"))
    beside = rows.join(run.join(close, "z"), "name").select("name", "v", F.get("t", F.col("i")).alias("o"))
    one, two = F.xxhash64("v", F.lit(1)), lambda own: _pairs_of(F.array("v"), F.col("o")[own], F.lit(2 if own == "called" else -2))
    asked_run = F.when(F.col("o").isNull(), F.array(one)).otherwise(two("called"))
    held_run = F.concat(two("alike"), _pairs_of(F.col("o")["forms"], F.array("v"), F.lit(-2)))
    asked = names.select("name", F.explode(_asked(F.col("t"))).alias("sig")).unionByName(beside.select("name", F.explode(asked_run).alias("sig"))).distinct()
    held = names.select("name", F.explode(_held(F.col("t"))).alias("sig")).unionByName(beside.where("o is not null").select("name", F.explode(held_run).alias("sig"))).distinct()
    met = held.select(F.col("name").alias("x"), "sig").join(asked.select(F.col("name").alias("y"), "sig"), "sig").where("x <> y")
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs, rows.select("name", F.transform("t", lambda x: x["token"]).alias("t"), F.transform("t", lambda x: x["w"]).alias("w"))


def name_links(names: DataFrame, *, surface_col: str, key_col: str | None = None, score: float = SCORE) -> DataFrame:
    """(surface_a, surface_b), surface_a < surface_b: verified links between different spellings.

    Null and blank spellings and stand-ins link to nothing. With `key_col`, spellings that have a key in common (whatever its case, blanks
    and hyphens) are linked, and spellings that each have a key but none in common are not. Repeated rows count once; other columns
    are dropped. Grams and tokens are counted over all spellings. Spellings with the same tokens are linked to the least of them and compared
    once. All pairs that name_similarity gives `score` are found, whatever the names' length.
    """
    ship(names.sparkSession)
    key = F.upper(F.regexp_replace(F.col(key_col), r"(?U)[\s\-]+", "")) if key_col else F.lit(None).cast("string")
    listed = names.select(F.col(surface_col).alias("surface"), F.nullif(key, F.lit("")).alias("key")).where("surface is not null")
    distinct = listed.groupBy("surface").agg(F.min("key").alias("key_lo"), F.max("key").alias("key_hi"))
    tokens = spread(distinct, "surface").mapInArrow(_tokenized, "surface string, key_lo string, key_hi string, tokens array<string>").where(F.size("tokens") > 0)
    read = cut(tokens.withColumn("same", F.concat_ws("\u0001", F.concat_ws(" ", "tokens"), F.coalesce("key_lo", F.lit("")), F.coalesce("key_hi", F.lit("")))))
    classes = cut(read.groupBy("same").agg(F.min("surface").alias("name"), F.first("tokens").alias("tokens"), F.first("key_lo").alias("key_lo"), F.first("key_hi").alias("key_hi"), F.count("*").alias("size")))
    alike = read.join(classes.where("size > 1").select("same", "name"), "same").where("name <> surface").select(F.col("name").alias("surface_a"), F.col("surface").alias("surface_b"))
    pairs, spelled = name_candidates(classes.select("name", "tokens", "size"), read.count())
    of = lambda x: spelled.join(classes.select("name", "key_lo", "key_hi"), "name").select(F.col("name").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("t", "w", "key_lo", "key_hi")))
    apart = F.coalesce((F.col("key_loa") == F.col("key_hia")) & (F.col("key_lob") == F.col("key_hib")) & (F.col("key_loa") != F.col("key_lob")), F.lit(False))
    met = pairs.join(of("a"), "a").join(of("b"), "b").where(~apart).select(F.col("a").alias("surface_a"), F.col("b").alias("surface_b"), "ta", "tb", "wa", "wb")
    links = met.mapInArrow(_verified(score), "surface_a string, surface_b string")
    keyed = listed.join(read.select("surface"), "surface", "left_semi").where("key is not null").distinct()
    first = keyed.groupBy("key").agg(F.min("surface").alias("surface_a"))
    by_key = keyed.join(first, "key").where("surface_a < surface").select("surface_a", F.col("surface").alias("surface_b"))
    return links.unionByName(alike).unionByName(by_key).distinct()


def same_name_pairs(facts: DataFrame) -> DataFrame:
    """(surface_a, surface_b): every two spellings of one person or organisation in facts, linked directly or indirectly."""
    of = facts.where(F.coalesce(F.col("subject_type"), F.lit("")) != "sector")
    links = name_links(of, surface_col="subject_surface", key_col="subject_key")
    groups = connected_components(links, "surface_a", "surface_b")
    a, b = (groups.select("component", F.col("node").alias(f"surface_{x}")) for x in "ab")
    return a.join(b, "component").where("surface_a < surface_b").select("surface_a", "surface_b")
