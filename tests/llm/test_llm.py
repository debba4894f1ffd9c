"""Operators on large texts and training data, against brute force, round trips and defined edge cases."""

import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factweave.llm import bpe, canonical, components, lookalikes, names, packing, splitting, vector_graph

TEXT = "id long, text string, item_id string, `text_` string, piece string"


# --- p1


def _split(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], TEXT)
    return splitting.split_oversized(df, id_col="id", **kw).orderBy("item_id", "piece_no").collect()


def test_split_covers_and_overlaps(spark):
    rnd = random.Random(3)
    words = ["alpha", "Бета", "é́", "🚢🚢", "न्यास", "end.", "x" * 30, "\n\n", "\n", "Note 4:"]
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (10, 40, 90, 300)] + ["q" * 1000, "🚢" * 301, "á" * 200, "", None, "short", "x" * 100]
    got = defaultdict(list)
    for r in _split(spark, texts, limit=100, overlap=20):
        got[r.item_id].append(r)
    assert {i for i, t in enumerate(texts) if t and len(t) > 100} == set(got)
    for i, pieces in got.items():
        text, at = texts[i], 0
        for k, p in enumerate(pieces):
            assert p.piece == text[p.piece_start : p.piece_end] and len(p.piece) <= 100
            assert p.body_start == at and p.body_start - 20 <= p.piece_start <= p.body_start and p.n_pieces == len(pieces) and p.piece_no == k
            at = p.piece_end
        assert at == len(text)


def test_split_prefers_boundaries_and_keeps_headings(spark):
    text = "Acme report\nOverview\n" + "One sentence here. " * 6 + "\nRisk factors\n" + "Another sentence there. " * 8
    rows = _split(spark, [text], limit=120, overlap=30)
    assert all(text[r.piece_end - 1] in " \n" for r in rows[:-1])
    assert rows[-1].heading_path == ["Acme report", "Risk factors"]
    assert _split(spark, ["ab " * 50], limit=100, overlap=0)[1].piece_start == _split(spark, ["ab " * 50], limit=100, overlap=0)[1].body_start


def test_split_chunks_with_bases_and_empty_table(spark):
    df = spark.createDataFrame([(1, "w " * 80, ["A", None, "", "A"], 7), (1, "w " * 80, ["A", None, "", "A"], 7), (2, None, None, None)], "id long, text string, path array<string>, at long")
    out = splitting.split_oversized(df, id_col="id", heading_col="path", base_col="at", limit=100, overlap=10)
    assert {r.source_start - r.piece_start for r in out.collect()} == {7} and out.first().heading_path == ["A"]
    assert splitting.oversized_items([out]).count() == 1
    assert splitting.split_oversized(df.limit(0), id_col="id").count() == 0
    with pytest.raises(ValueError):
        splitting.body_pattern(10, 10)


# --- p2

ENTRIES = [("average_revenue_from_products", ["mean_revenue_from_products"]), ("revenue_from_products", ["turnover_from_products"]), ("inventory_value", ["stock_value"]), ("trade_payables", []), ("closing_trade_payables", []), ("capital_expenditure", [])]
NAMES = [
    ("revenueFromProducts", "revenue_from_products"), ("THE  TURNOVER  FROM  PRODUCTS ", "revenue_from_products"), ("products revnue from", "revenue_from_products"), ("avg rev products", "average_revenue_from_products"), ("value of stock value", "inventory_value"),
    ("trade-pybl", "trade_payables"), ("clsng trade payables", "closing_trade_payables"), ("opening trade payables", "unmatched"), ("net trade payables", "unmatched"), ("capitalexpenditure", "capital_expenditure"), ("capex kiosks", "unmatched"), ("", "unmatched"), (None, "unmatched"), ("the", "unmatched"),
]


def test_match_names(spark):
    import json

    ref = spark.createDataFrame([(c, json.dumps(a)) for c, a in ENTRIES] + [("broken", "[oops"), (None, "[]")], "canonical string, aliases_json string")
    df = spark.createDataFrame([(i, n, "x") for i, (n, _) in enumerate(NAMES)], "id int, name string, canonical string")
    for block in (canonical.ENTRIES_PER_BLOCK, 2):
        got = {r.id: r.canonical for r in canonical.match_names(df, ref, id_col="id", name_col="name", block=block).collect()}
        assert {n: got[i] for i, (n, w) in enumerate(NAMES) if got[i] != w} == {}
    assert {r.canonical for r in canonical.match_names(df, ref.limit(0), id_col="id", name_col="name").collect()} == {"unmatched"}
    assert canonical.match_names(df.limit(0), ref, id_col="id", name_col="name").count() == 0


def test_long_names_are_never_matched_by_a_prefix():
    words = [[f"{a}{b}ellow" for b in "bdfgjklmnp"] for a in "aeio"]
    m = canonical.Matcher([("_".join(w), []) for w in zip(*words)])
    assert m.match("aellow eellow iellow oellow") == "unmatched"  # ten entries at one cost
    assert m.match("abellow ebellow ibellow obellow") == "abellow_ebellow_ibellow_obellow"
    assert m.match("abellow ebellow ibellow obellow zzz") == "unmatched" and m.match("x " * 5000) == "unmatched"


def test_blocks_give_the_answers_of_one_block(spark):
    import json
    import pathlib

    import pyarrow.parquet as pq

    d = pathlib.Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no test data")
    ref = [(r["canonical"], json.loads(r["aliases_json"])) for r in pq.read_table(d / "predicate_registry.parquet").to_pylist()]
    asked = sorted({p for p in pq.read_table(d / "facts.parquet", columns=["predicate"]).column(0).to_pylist() if p})
    whole, swaps = canonical.Matcher(ref), canonical.swapped_words(ref)
    for n in (2, 8):
        parts = [canonical.Matcher(ref[i::n], whole.optional, swaps) for i in range(n)]
        for a in asked:
            assert canonical.decided(sorted(c for m in parts for c in m.candidates(a))) == whole.match(a)


@given(st.text("abcd", max_size=7), st.text("abcd", min_size=1, max_size=7))
@settings(max_examples=200, deadline=None)
def test_automaton_is_edit_distance(a, b):
    trie = canonical.WordTrie()
    trie.add(b, "w")
    d = names.edits(a, b)
    assert trie.within(a, 2) == ({"w": d} if d <= 2 else {})


# --- p3


def _groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components_of_a_hot_node_in_levels(spark):
    df = spark.createDataFrame([(0, i) for i in range(1, 900)] + [(i, i + 1) for i in range(2000, 2300)] + [(899, 2300)], "x long, y long")
    got = {r.node: r.component for r in components.connected_components(df, "x", "y", edges_per_partition=100).collect()}
    assert got == {i: 0 for i in [*range(900), *range(2000, 2301)]}


@pytest.mark.parametrize("bound", [1_000_000, 40])
def test_components(spark, bound):
    rnd = random.Random(bound)
    ids = [f"f_{i:04d}" for i in range(400)]
    pairs = [(ids[i], ids[i + 1]) for i in range(0, 90)] + [(ids[100], ids[i]) for i in range(101, 180)] + [(rnd.choice(ids[200:]), rnd.choice(ids[200:])) for _ in range(120)]
    pairs += [(ids[5], ids[5]), (ids[399], None), (None, ids[3]), pairs[0], pairs[0][::-1]]
    rnd.shuffle(pairs)
    df = spark.createDataFrame([(a, b, "n", "c") for a, b in pairs], "x string, y string, node string, component string")
    got = {r.node: r.component for r in components.connected_components(df, "x", "y", edges_per_partition=bound).collect()}
    assert got == _groups(pairs)


def test_components_empty_and_verdicts(spark):
    df = spark.createDataFrame([("b", "a", " Corroborates "), ("b", "c", "CORROBORATES"), ("c", "d", "contradicts"), ("e", "e", "corroborates"), ("g", None, "corroborates"), ("h", "i", None)], "fact_a string, fact_b string, verdict string")
    assert {tuple(r) for r in components.corroborated_groups(df).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert components.corroborated_groups(df.limit(0)).count() == 0


# --- p5


def test_graph_finds_neighbours():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[::10] = x[1::10] + 0.05 * rng.normal(size=(300, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, entries = vector_graph.build_graph(x)
    assert graph.max() < 3000 and all(len(set(r[r >= 0])) == (r >= 0).sum() for r in graph[:200])
    ids, sims = vector_graph.beam_search(x, graph, x[::20], vector_graph.starts(x, entries, x[::20]), 48)
    true = np.argsort(-(x[::20] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true)]) >= 0.9
    assert (np.diff(sims, axis=1) <= 1e-6).all()


def _facts(spark, rows):
    return spark.createDataFrame([(i, v, m, "x", 1.0) for i, v, m in rows], "fact_id string, embedding array<float>, embedding_model string, other string, similarity double")


def test_close_pairs_and_similar(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 16))
    rows = [(f"f{i:04d}", [float(y) for y in v], "m") for i, v in enumerate(base)]
    rows += [(f"g{i:04d}", [float(y) for y in (v * 3 + 0.1 * rng.normal(size=16))], "m") for i, v in enumerate(base[:60])]
    rows += [("h1", rows[0][1], "m"), ("h2", rows[0][1], "m"), ("h2", rows[0][1], "m"), ("o", rows[1][1], "other"), ("z", [0.0] * 16, "m"), ("n", None, "m"), ("nan", [float("nan")] * 16, "m"), ("w", [1.0] * 8, "m"), (None, rows[2][1], "m"), ("nm", rows[2][1], None)]
    ok = {i: (np.array(v), m) for i, v, m in rows if i and m and v is not None and any(v) and not np.isnan(v).any()}
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    true = {(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and cos(ok[a][0], ok[b][0]) >= 0.96}
    df = _facts(spark, rows)
    got = {tuple(r) for r in vector_graph.close_pairs(df).collect()}
    assert got <= true and len(got) >= 0.97 * len(true) and ("h1", "h2") in got
    some = {tuple(r) for r in vector_graph.close_pairs(df, shard_rows=60).collect()}
    assert some <= true and len(some) >= 0.9 * len(true)
    deep = {tuple(r) for r in vector_graph.close_pairs(df, shard_rows=20, max_pivots=3).collect()}
    assert deep <= true and len(deep) >= 0.9 * len(true)
    assert vector_graph.close_pairs(df.limit(0)).count() == 0
    sim = vector_graph.similar_facts(df, k=5, one_in=4, shard_rows=150).collect()
    hit = total = 0
    for q in {r.fact_id for r in sim}:
        own = {r.other for r in sim if r.fact_id == q}
        best = sorted(((cos(ok[q][0], v), i) for i, (v, m) in ok.items() if i != q and m == ok[q][1] and len(v) == len(ok[q][0])), reverse=True)
        floor = best[: len(own)][-1][0] if best else 2
        hit += sum(cos(ok[q][0], ok[o][0]) >= floor - 1e-6 for o in own)
        total += min(5, len(best))
    assert hit >= 0.9 * total


def test_more_partners_than_the_beam(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=12)
    rows = [(f"f{i:03d}", [float(y) for y in centre + 0.02 * rng.normal(size=12)], "m") for i in range(70)]
    assert vector_graph.close_pairs(_facts(spark, rows)).count() == 70 * 69 // 2


def test_a_shard_keeps_all_its_close_pairs(spark):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(20, 1, 256)) + 0.35 * rng.normal(size=(20, 100, 256))).reshape(-1, 256)
    x = np.concatenate([base, base + 0.19 * rng.normal(size=base.shape)]).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    true = {(f"f{a:04d}", f"f{b:04d}") for a, b in zip(*np.nonzero(np.triu(unit @ unit.T, 1) >= 0.96))}
    df = _facts(spark, [(f"f{i:04d}", v, "m") for i, v in enumerate(x.tolist())])
    assert len(true) > 1000
    assert {tuple(r) for r in vector_graph.close_pairs(df).collect()} == true
    found = vector_graph.nearest(df, id_col="fact_id", vector_col="embedding", part_col="embedding_model", at_least=0.96, asked=F.col("fact_id") < "f0500", shard_rows=50_000)
    assert {(r.id, r.other) for r in found.collect()} == {p for a, b in true for p in ((a, b), (b, a)) if p[0] < "f0500"}


# --- p7

SAME = ["Vexalmed Opaeirion Insurance LLP", "M/s. Vexalmed Opaeirion Insurance L.L.P.", "vexalmed opaeirion insce llp", "Vexalmed Opaierion Insurance", "Opaeirion Vexalmed Insurance LLP", "Vexalmed\xa0Opaeirion  Insurance, LLP", "Vexalmedopaeirion Insurance LLP"]
OTHER = ["Vexalmed Opaeirion Cement LLP", "the Company", "Company", "our firm", "", None, "Coastal ports"]
PERSON = ["Robert Balexen Maraurast", "R. Balexen Maraurast", "Maraurast, Bob Balexen", "Dr Robert Balexen Maraurst"]


def test_name_pairs(spark):
    rows = [(s, None, "organisation") for s in SAME + OTHER[:-1]] + [(s, None, "person") for s in PERSON] + [("Coastal ports", None, "sector"), ("Coastal  ports", None, "sector"), ("Alpha Works", "K-1 2", "organisation"), ("Unlike Name Plc", "k12", "organisation"), SAME and (SAME[0], None, "organisation")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "subject_surface string, subject_key string, subject_type string, surface string")
    got = {tuple(r) for r in names.same_name_pairs(df).collect()}
    pairs = lambda xs: {(a, b) for a in xs for b in xs if a < b}
    assert got == pairs(SAME) | pairs(PERSON) | {("Alpha Works", "Unlike Name Plc")}
    assert names.same_name_pairs(df.limit(0)).count() == 0


def test_prefix_filter_finds_every_similar_pair(spark):
    rnd = random.Random(2)
    made = ["".join(rnd.choice("abcde") for _ in range(8)) + " " + "".join(rnd.choice("fghij") for _ in range(8)) for _ in range(60)]
    made += [m[:3] + m[4:] for m in made[:30]] + [m[:12] + "j" + m[12:] for m in made[:10]]
    df = spark.createDataFrame([(m,) for m in made], "n string")
    links = {tuple(r) for r in names.name_links(df, surface_col="n").collect()}
    near = lambda a, b: all(names.token_similarity(x, y) >= names.SCORE for x, y in zip(names.tokens_of(a), names.tokens_of(b)))
    want = {(a, b) for a in made for b in made if a < b and near(a, b)}
    assert want and want <= links


def test_close_tokens_against_brute_force(spark):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(2, 12))) for _ in range(150)})
    edited = sorted({w[:k] + rnd.choice(["", "x", "a"]) + w[k + rnd.randint(0, 2) :] for w in words for k in (1, 2)} - {""})
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "s string")
    got = {tuple(r) for r in names.close_tokens(one(edited), one(words)).collect()}
    within = {(a, b) for a in edited for b in words if names.edits(a, b) <= names.allowed_edits(max(len(a), len(b)))}
    assert got <= within and {(a, b) for a, b in within if _plain_edits(a, b) <= names.allowed_edits(max(len(a), len(b)))} <= got


def _plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_name_candidates_of_other_kinds(spark):
    groups = [["Sharma Intl", "Sharma International"], ["Kalpana Ravindran", "K. Ravindran"], ["Datasoft Widgets", "Data Soft Widgets"], ["Bill Thurgood", "William Thurgod", "Will Thurgood"], ["Zenith", "Zenithh"]]
    alone = ["B. Jasoelgar Wynerast", "Broaxen Jasolgar William", "word " * 400, "word " * 399]
    df = spark.createDataFrame([(m, None) for g in groups for m in g] + [(m, None) for m in alone], "n string, k string")
    links = {tuple(r) for r in names.name_links(df, surface_col="n").collect()}
    of = {m: i for i, g in enumerate(groups) for m in g}
    assert all(of.get(a, -1) == of.get(b, -2) for a, b in links) and {x for p in links for x in p} == set(of)


def test_name_candidates_are_all_that_the_verification_accepts(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdr") for _ in range(rnd.randint(1, 11))) for _ in range(50)] + ["bill", "william", "wm", "bob", "robert", "international", "intl", "de", "silva"]

    def variant(t):
        t = list(t)
        for _ in range(rnd.randint(1, 3)):
            k, kind = rnd.randrange(len(t)), rnd.randrange(6)
            w = t[k]
            if kind == 0 and len(w) > 3:
                i = rnd.randrange(len(w) - 1)
                t[k] = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
            elif kind == 1:
                t[k] = w[0]
            elif kind == 2:
                t[k] = w[0] + "".join(c for c in w[1:] if rnd.random() < 0.6)
            elif kind == 3 and k + 1 < len(t):
                t[k : k + 2] = [w + t[k + 1]]
            elif kind == 4:
                i = rnd.randrange(len(w) + 1)
                t[k] = w[:i] + rnd.choice("abx") + w[i + rnd.randint(0, 1) :]
            else:
                rnd.shuffle(t)
        return t

    made = [[rnd.choice(words) for _ in range(n)] for n in [1, 2, 2, 3, 3, 3, 4, 5, 6] * 4 + [23, 24, 25, 26, 40] * 2]
    made = sorted({" ".join(x) for t in made for x in (t, *(variant(t) for _ in range(4)))})
    classes = {}
    for m in made:
        classes.setdefault(tuple(names.tokens_of(m)), []).append(m)
    classes.pop((), None)
    rows = [(min(v), list(t), len(v)) for t, v in classes.items()]
    pairs, spelled = names.name_candidates(spark.createDataFrame(rows, "name string, tokens array<string>, size long"), sum(r[2] for r in rows))
    of = {r.name: (r.t, r.w) for r in spelled.collect()}
    got = {(r.a, r.b) for r in pairs.collect()}
    want = {(a, b) for a in of for b in of if a < b and names.name_similarity(of[a][0], of[b][0], of[a][1], of[b][1]) >= names.SCORE}
    sizes = {len(of[a][0]) for a, b in want}
    assert {1, 2, 3, 4} <= sizes and max(sizes) > 24 and any(len(of[a][0]) != len(of[b][0]) for a, b in want)
    assert want <= got


def test_long_names_and_abbreviations_are_linked(spark):
    long = " ".join(f"{a}{b}word" for a in "bcdfg" for b in "aeiou")
    groups = [[long + " holdings", long + " holdngs", long.replace("bawordbeword", "baword beword") + " holdings"], ["Chandrasekhar Ravindran Textiles", "Chandrskhr Rvndrn Textiles"], ["Maria De Silva", "Maria Desilva"], ["Sharma Infrastructure", "Sharma Infrstrct"]]
    alone = ["Maria Desouza", "Chandrasekhar Textiles", long, "Sharma"]
    df = spark.createDataFrame([(m,) for m in [m for g in groups for m in g] + alone], "n string")
    links = {tuple(r) for r in names.name_links(df, surface_col="n").collect()}
    assert links == {(a, b) for g in groups for a in set(g) for b in set(g) if a < b}


# --- p8


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.encode_special_tokens = True
    return t


def test_encoding_equals_the_library(tokenizer):
    v = bpe.vocabulary(bpe.default_vocabulary())
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abctheion '  \n\t\r0129.,-é́한国य🚢​ \x1c\xa0") for _ in range(rnd.randint(0, 80))) for _ in range(3000)] + ["<|endoftext|>", "a" * 5000, " " * 300 + "x", "\n \n\n  y", "   ", "don't we'll I'M"]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [v.encode(t) for t in texts] == want
    assert v.encode(None) == [] == v.encode("")


def test_appends_and_edits(tokenizer):
    v = bpe.vocabulary(bpe.default_vocabulary())
    enc = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    rnd = random.Random(9)
    e = bpe.EncodedText(v, "The quick  brown fox\n\njumps over 1234 lazy dogs, isn't it?")
    for _ in range(200):
        at = rnd.randint(0, len(e.text))
        n = rnd.randint(0, min(5, len(e.text) - at))
        e.edit(at, n, "".join(rnd.choice("ab é\n '9t") for _ in range(rnd.randint(0, 4))))
        assert e.ids() == enc(e.text), e.text
    e.append(" and more")
    assert e.ids() == enc(e.text)
    p = bpe.Prefixes(v, b"tokeniz")
    p.append(b"ation")
    assert p.ids() == enc("tokenization")
    p.edit(5, 2, b"s")
    assert p.ids() == enc(p.raw.decode())


def test_encode_corpus(spark, tokenizer):
    df = spark.createDataFrame([(1, "héllo wörld", 5), (2, None, 5), (3, "", 5), (1, "héllo wörld", 5)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect())
    ids = tokenizer.encode("héllo wörld", add_special_tokens=False).ids
    assert got == [(1, ids), (1, ids), (2, []), (3, [])]
    assert bpe.encode_corpus(df.limit(0)).count() == 0


# --- p9


@pytest.mark.parametrize("windows", [1, 16])
def test_pack(spark, windows):
    rnd = random.Random(6)
    sizes = [(i, rnd.choice([None, 0, 5, 100, 100, 300, 999, 1000, 1001, 2500, rnd.randint(1, 900)])) for i in range(600)]
    df = spark.createDataFrame([(i, s, 1) for i, s in sizes], "id long, size long, container_id int")
    out = packing.pack(df, id_col="id", size_col="size", capacity=1000, open_windows=windows).collect()
    used, spans = defaultdict(int), defaultdict(list)
    for r in out:
        spans[r.id].append((r.token_start, r.token_end))
        used[r.container_id] += r.token_end - r.token_start
    assert max(v for k, v in used.items() if k is not None) <= 1000
    for i, s in sizes:
        parts = sorted(spans[i])
        assert parts[0][0] == 0 and parts[-1][1] == (s or 0) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert len(parts) == (1 if not s or s <= 1000 else -(-s // 1000))
    if windows > 1:
        filled = sum(used.values()) / 1000 / (len(used) - (None in used))
        assert filled > 0.93
    assert packing.pack(df.limit(0), id_col="id", size_col="size").count() == 0


# --- p10

ALIKE = [("payment", "pаyment"), ("café", "café"), ("office", "oﬃce"), ("a b", "a\xa0b"), ("a b", "a b"), ("word", "wo​rd"), ("ABC 12", "ＡＢＣ　１２"), ("K", "K"), ("co-op", "co‐op"), ("a\r\nb", "a\nb"), ("рост", "pост"), ("soft", "so\xadft"), ("х5", "x5")]
UNLIKE = [("café", "cafe"), ("m²", "m2"), ("Total", "total"), ("l0", "lO"), ("rate 5", "rate 6"), ("ее", "её"), ("1", "l"), ("a-b", "a–b")]


def test_one_form():
    forms = lookalikes.canonical(lookalikes.default_vocabulary())
    for a, b in ALIKE:
        assert forms.text(a) == forms.text(b), (a, b)
    for a, b in UNLIKE:
        assert forms.text(a) != forms.text(b), (a, b)
    assert forms.text(None) is None and forms.text("") == "" and forms.text("​ \xa0") == ""


def test_the_trie_decides_where_the_table_cannot():
    forms, table = lookalikes.canonical(lookalikes.default_vocabulary()), lookalikes.Canonical(())
    # к, п and в look like k, n and b in some fonts only: a Latin word of the vocabulary is meant
    for a, b in [("market", "marкet"), ("number", "пumвer"), ("Company", "Cоmраnу")]:
        assert forms.text(b) == a, b
    assert forms.text("maркet") != forms.text("market") and table.text("marкet") == "marкet"
    # no Latin word is meant: other scripts stay, words of the vocabulary in their own spelling
    assert forms.text("какая") == forms.text("кaкaя") == "какая" and table.text("какая") != "какая"
    assert forms.text("naïve") != forms.text("naive") and forms.text("кот") != forms.text("kot")
    with pytest.raises(OSError):
        lookalikes.vocabulary_words("/no/such/file")


@given(st.lists(st.sampled_from("abcеорс xＡéè́​ﬁfi‐- \n"), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_form_is_stable_and_follows_the_table(text):
    forms = lookalikes.canonical(lookalikes.default_vocabulary())
    once = forms.text(text)
    assert forms.text(once) == once
    assert forms.text(unicodedata.normalize("NFD", text)) == once == forms.text(unicodedata.normalize("NFC", text))
    assert lookalikes.looks(re.sub(r"\s", "", once)) == lookalikes.looks(re.sub(r"\s", "", text))


def test_look_alike_pairs(spark):
    texts = [(1, "pay it"), (2, "pаy it"), (3, "pay it"), (4, "pay\xa0it"), (5, " "), (6, "\xa0"), (7, None), (8, None), (9, "other"), (10, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, form string")
    assert {tuple(r) for r in lookalikes.look_alike_pairs(df).collect()} == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert lookalikes.look_alike_pairs(df.limit(0)).count() == 0
    got = {r.doc_id: r for r in lookalikes.one_form(df).collect()}
    assert got[7].form is None and got[7].form_hash is None and not got[5].visible and got[2].form == "pay it"


def test_queries_are_registered(spark):
    from factweave.llm import queries

    assert {f"p{n}_found" for n in (1, 2, 3, 5, 7, 10)} | {"p8_ids", "p9_containers"} <= set(queries.QUERIES) and set(queries.SQL) <= set(queries.QUERIES)
    assert F is not None
