"""The SQL of the queries in core, for DuckDB."""

from __future__ import annotations

from ..functions import numbers as N
from ..functions import periods as P
from ..functions import strings as S

_WS = r"[\t-\r \x{85}\p{Z}]"


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_CANONICAL = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '_')"
_PLAIN = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_NAME = "regexp_replace(" + _PLAIN.format("regexp_replace(lower(coalesce({0}, '')), '[''’]s\\b', '', 'g')") + f", '^(?:{'|'.join(S.ARTICLES + S.HONORIFICS)}) (.)', '\\1')"
_RELATIONS = """
    rel AS (SELECT least(fact_a, fact_b) AS fact_a, greatest(fact_a, fact_b) AS fact_b, min(lower(trim(verdict))) AS verdict, min(rule_fired) AS rule_fired,
                   min(qualifier_key) AS qualifier_key, max(judged = 1) AS judged
            FROM relations WHERE fact_a IS NOT NULL AND fact_b IS NOT NULL AND verdict IS NOT NULL GROUP BY 1, 2)"""
_ONCE = "once AS (SELECT * FROM facts WHERE fact_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY created_at NULLS LAST) = 1)"


def _key_matches(key: str, known) -> str:
    return "(" + " OR ".join(f"contains('_' || {key} || '_', '_{k}_')" for k in known) + ")"


_SCALE = "|".join(s.replace(" ", "[ ]+") for s in sorted(N.SCALES, key=len, reverse=True))
_BOUND = "|".join(b + (r"\b" if b[0].isalpha() else "") for b, _ in N.BOUNDS)
_NUM = r"\d[\d,\x{a0}\x{202f}\x{2009}\x{2007}\s]*(?:\.\d+)?"
_FACTOR = "CASE " + " ".join(f"WHEN scale = '{k}' THEN {v!r}" for k, v in N.SCALES.items()) + " ELSE 1.0 END"

_PARTIES = "SELECT printf('%08d', s_suppkey) AS id, s_nationkey AS nation, s_acctbal AS v FROM supplier"
_BANDS = f"""
    band AS (SELECT id, CASE WHEN v = 0 THEN 'zero' WHEN v < 0 THEN '-' ELSE '+' END AS axis, CASE WHEN v = 0 THEN 0 ELSE CAST(floor(log10(abs(v)) / 0.002) AS BIGINT) END AS b FROM ({_PARTIES})),
    vp AS (SELECT x.id AS fact_a, y.id AS fact_b FROM band x JOIN band y ON x.axis = y.axis AND abs(x.b - y.b) <= 1 AND x.id < y.id),
    kp AS (SELECT x.id AS fact_a, y.id AS fact_b FROM ({_PARTIES}) x JOIN ({_PARTIES}) y ON x.nation = y.nation AND x.id < y.id),
    every AS (SELECT fact_a, fact_b, string_agg(s, ',' ORDER BY s) AS blocked_by, count(*) AS k FROM (SELECT *, 'key' AS s FROM kp UNION ALL SELECT *, 'value' AS s FROM vp) GROUP BY 1, 2)"""
_MODIFIERS = "|".join(S.MEASURE_MODIFIERS)
_MONTHS = "CASE " + " ".join(f"WHEN m = '{k}' THEN {v}" for k, v in P.MONTHS.items()) + " END"
_MONTH = "|".join(sorted(P.MONTHS, key=len, reverse=True))

SQL = {
    "canonical_predicates": f"""
        SELECT predicate, c AS canonical, CASE WHEN regexp_matches(c, '^(consolidated|standalone)_.') THEN regexp_replace(c, '^(consolidated|standalone)_', '') ELSE c END AS measure
        FROM (SELECT DISTINCT predicate, {_CANONICAL.format("predicate")} AS c FROM facts WHERE predicate IS NOT NULL)""",
    "surface_names": f"SELECT DISTINCT subject_surface, {_NAME.format('subject_surface')} AS name FROM facts WHERE subject_surface IS NOT NULL",
    "surface_identities": f"""
        WITH n AS (SELECT DISTINCT subject_surface, {_NAME.format("subject_surface")} AS name FROM facts)
        SELECT subject_surface, name AS identity FROM n WHERE name <> ''
        UNION SELECT subject_surface, left(name, length(name) - length(form) - 1) FROM n, (SELECT unnest([{_list(S.LEGAL_FORMS)}]) AS form) WHERE ends_with(name, ' ' || form) AND length(name) > length(form) + 1""",
    "fact_ids": """
        SELECT DISTINCT fact_id, 'f_' || left(sha1(doc_id || ':' || (evidence_json->>'char_start') || ':' || (evidence_json->>'char_end') || ':' || predicate_canonical), 16) AS made_id
        FROM facts WHERE predicate_canonical IS NOT NULL AND evidence_json IS NOT NULL""",
    "dimensions": f"""
        SELECT k, CASE WHEN {_key_matches("k", S.REPORTING_TIME)} AND NOT {_key_matches("k", S.EVENT_TIME)} THEN 'period' ELSE k END AS dim, {_key_matches("k", S.DISCRIMINATING)} AS recognised, count(*) AS n
        FROM (SELECT unnest(json_keys(qualifiers_json)) AS k FROM facts WHERE qualifiers_json IS NOT NULL) GROUP BY k""",
    "quantities": rf"""
        WITH r AS (SELECT DISTINCT value_json->>'raw' AS raw FROM facts WHERE value_kind = 'quantity' AND value_json->>'raw' IS NOT NULL),
        a AS (SELECT raw, regexp_replace(raw, '^{_WS}+|{_WS}+$', '', 'g') AS t FROM r),
        b AS (SELECT raw, t, regexp_extract(lower(t), '^({_BOUND})', 1) AS token FROM a WHERE lower(t) NOT IN ({_list(N.NIL)})),
        c AS (SELECT raw, token, substr(t, length(token) + 1) AS body FROM b),
        d AS (SELECT raw, token, regexp_replace(regexp_extract(body, '{_NUM}'), '[^0-9.]', '', 'g') AS digits, rtrim(regexp_extract(body, '(?s)^(\D*)\d', 1)) AS before, ltrim(regexp_extract(body, '(?s)^\D*{_NUM}(.*)$', 1)) AS after FROM c),
        e AS (SELECT *, ends_with(before, '(') AND contains(after, ')') AS wrapped FROM d WHERE digits <> ''),
        f AS (SELECT *, trim(CASE WHEN wrapped THEN regexp_replace(after, '^([^)]*)\)', '\1') ELSE after END) AS tail, wrapped OR regexp_matches(before, '(^|[^\w])[-−]$') AS negative FROM e),
        g AS (SELECT *, regexp_matches(tail, '(?i)^bps') AS bps, starts_with(tail, '%') OR regexp_matches(tail, '(?i)percent|per cent|bps') AS is_percent,
                     nullif(regexp_replace(regexp_extract(lower(tail), '^({_SCALE})\b', 1), '{_WS}+', ' ', 'g'), '') AS scale FROM f),
        h AS (SELECT *, {_FACTOR} AS factor, CAST(digits AS DOUBLE) * CASE WHEN negative THEN -1 ELSE 1 END / CASE WHEN bps THEN 100.0 ELSE 1.0 END AS number, length(regexp_extract(digits, '\.(\d+)$', 1)) AS places,
                     CASE {" ".join(f"WHEN token = '{t}' THEN '{b}'" for t, b in N.BOUNDS)} END AS bound FROM g WHERE try_cast(digits AS DOUBLE) IS NOT NULL),
        i AS (SELECT *, number * factor AS v, CASE WHEN bound = 'about' THEN greatest(0.5 * pow(10.0, -places) * factor / CASE WHEN bps THEN 100.0 ELSE 1.0 END, abs(number * factor) * 0.05) ELSE 0.5 * pow(10.0, -places) * factor / CASE WHEN bps THEN 100.0 ELSE 1.0 END END AS w FROM h)
        SELECT raw, round(v, 4) AS normalized, CASE WHEN bound IN ('less_than', 'at_most') THEN NULL WHEN bound IN ('greater_than', 'at_least') THEN round(v, 4) ELSE round(v - w, 4) END AS lo,
               CASE WHEN bound IN ('greater_than', 'at_least') THEN NULL WHEN bound IN ('less_than', 'at_most') THEN round(v, 4) ELSE round(v + w, 4) END AS hi, scale, bound, is_percent FROM i""",
    "written_digits": rf"""
        SELECT DISTINCT raw, CASE WHEN n = '' THEN 0 ELSE greatest(1, length(ltrim(regexp_replace(n, '[^0-9]', '', 'g'), '0'))) END AS digits
        FROM (SELECT value_json->>'raw' AS raw, regexp_extract(value_json->>'raw', '{_NUM}') AS n FROM facts WHERE value_json->>'raw' IS NOT NULL)""",
    "periods": r"""
        WITH l AS (SELECT DISTINCT json_extract_string(qualifiers_json, '$.period.value') AS label FROM facts WHERE json_extract_string(qualifiers_json, '$.period.value') IS NOT NULL),
        y AS (SELECT label, trim(regexp_replace(label, '\s+', ' ', 'g')) AS t FROM l),
        z AS (SELECT label, t, regexp_extract(t, '^(Q[1-4]|H[12])? ?(FY|CY)', 1) AS part, regexp_matches(t, 'CY') AS cal,
                     CASE WHEN regexp_matches(t, '^((Q[1-4]|H[12]) )?FY ?\d{2}$') THEN 2000 + CAST(right(t, 2) AS INT) WHEN regexp_matches(t, '^((Q[1-4]|H[12]) )?FY ?\d{4}-\d{2}$') THEN 2000 + CAST(right(t, 2) AS INT)
                          WHEN regexp_matches(t, '^((H[12]) )?CY ?\d{4}$') THEN CAST(right(t, 4) AS INT) END AS yr FROM y),
        s AS (SELECT label, part, CASE WHEN cal THEN make_date(yr, 1, 1) ELSE make_date(yr - 1, 4, 1) END AS base FROM z WHERE yr IS NOT NULL)
        SELECT label, CAST(base + to_months(CASE WHEN part LIKE 'Q%' THEN 3 * (CAST(right(part, 1) AS INT) - 1) WHEN part = 'H2' THEN 6 ELSE 0 END) AS DATE) AS starts,
               CAST(base + to_months(CASE WHEN part LIKE 'Q%' THEN 3 * CAST(right(part, 1) AS INT) WHEN part = 'H1' THEN 6 ELSE 12 END) - INTERVAL 1 DAY AS DATE) AS ends,
               CASE WHEN part LIKE 'Q%' THEN 'quarter' WHEN part LIKE 'H%' THEN 'months' ELSE 'year' END AS granularity FROM s""",
    "fiscal_year_ends": rf"""
        WITH m AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '(?i)\byears?\s+end(?:ed|ing)\s+(?:on\s+)?({_MONTH})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})', 1))) AS m FROM documents),
        c AS (SELECT doc_id, {_MONTHS} AS month, count(*) AS n FROM m GROUP BY 1, 2)
        SELECT doc_id, CAST(min(month) AS INT) AS month, min(n) AS n FROM (SELECT * FROM c QUALIFY rank() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1) GROUP BY doc_id HAVING count(*) = 1""",
    "deliveries": f"WITH {_ONCE} SELECT fact_id, doc_id, predicate, created_at FROM once",
    "best_of_duplicates": """
        SELECT fact_id, known, created_at FROM (SELECT fact_id, created_at, CAST(coalesce(len(json_keys(qualifiers_json)), 0) AS INT) AS known FROM facts)
        QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY known DESC, created_at) = 1""",
    "anaphora": f"""
        WITH {_ONCE}, n AS (SELECT fact_id, doc_id, subject_surface, predicate, {_NAME.format("subject_surface")} AS name, {_CANONICAL.format("coalesce(predicate, '')")} AS p FROM once),
        v AS (SELECT doc_id, name, count(*) AS k, min(subject_surface) AS shown FROM n
              WHERE name <> '' AND name NOT IN ({_list(S.ANAPHORS)}) AND NOT (len(list_filter(string_split(name, ' '), lambda w: NOT list_contains(string_split(p, '_'), w))) = 0) GROUP BY 1, 2),
        d AS (SELECT doc_id, min(shown) AS shown FROM (SELECT * FROM v QUALIFY rank() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1) WHERE k >= 2 GROUP BY doc_id HAVING count(*) = 1)
        SELECT fact_id, n.doc_id, d.shown AS surface_resolved FROM n JOIN d ON d.doc_id = n.doc_id WHERE name IN ({_list(S.ANAPHORS)})""",
    "clear_modes": """
        SELECT o_custkey, min(o_orderpriority) AS o_orderpriority, min(n) AS n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2
        QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC) = 1) GROUP BY 1 HAVING count(*) = 1""",
    "exact_key_pairs": """
        SELECT printf('%08d', a.c_custkey) AS fact_a, printf('%08d', b.c_custkey) AS fact_b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey""",
    "magnitude_pairs": f"WITH {_BANDS} SELECT * FROM vp",
    "neighbours": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
        s AS (SELECT q.vec_id AS query, v.vec_id AS neighbour, list_cosine_similarity(q.e, v.e) AS sim FROM q JOIN v ON v.vec_id <> q.vec_id)
        SELECT query, neighbour, CAST(row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, neighbour) AS INT) AS rank FROM s WHERE sim >= 0 QUALIFY rank <= 10""",
    "blocking_union": f"WITH {_BANDS} SELECT fact_a, fact_b, blocked_by FROM every",
    "blocking_statistics": f"""
        WITH {_BANDS}, n AS (SELECT count(*) AS n FROM supplier), c AS (SELECT count(*) AS candidates, CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS dd FROM every)
        SELECT n AS n_facts, CAST(n * (n - 1) / 2 AS BIGINT) AS theoretical, candidates, dd AS duplicates_dropped, round((n * (n - 1) / 2 - candidates) / (n * (n - 1) / 2), 6) AS reduction FROM n, c""",
    "order_verdicts": """
        WITH o AS (SELECT printf('%010d', o_orderkey) AS id, o_custkey AS c, round(o_totalprice) AS v, year(o_orderdate) AS y, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS s FROM orders),
        p AS (SELECT a.id AS fact_a, b.id AS fact_b, abs(a.v - b.v) < 1 AS agree, a.y <> b.y AS py, (a.s IS NULL) <> (b.s IS NULL) AS miss, coalesce(a.s <> b.s, false) AS ps FROM o a JOIN o b ON a.c = b.c AND a.id < b.id)
        SELECT fact_a, fact_b,
          CASE WHEN agree AND (py OR ps) THEN 'unrelated' WHEN agree THEN 'corroborates' WHEN miss THEN 'insufficient_context' WHEN py OR ps THEN 'reconciled_by_context' ELSE 'contradicts' END AS verdict,
          CASE WHEN agree AND (py OR ps) THEN 'context_differs_values_agree' WHEN agree THEN 'keys_match_intervals_overlap' WHEN miss THEN 'missing_qualifier_guard' WHEN py OR ps THEN 'discriminating_qualifier_differs' ELSE 'same_context_disjoint_intervals' END AS rule_fired,
          CASE WHEN agree AND (py OR ps) THEN CASE WHEN py THEN 'period' ELSE 'segment' END WHEN agree THEN NULL WHEN miss THEN 'segment' WHEN py THEN 'period' WHEN ps THEN 'segment' END AS qualifier_key,
          NOT agree AND NOT miss AS needs_llm FROM p""",
    "partition_groups": """
        WITH t AS (SELECT l_returnflag || '-' || l_linestatus AS k, round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 1) AS s FROM lineitem GROUP BY 1)
        SELECT 'f_' || k AS fact_id, 'class' AS split_key, lower(replace(k, '-', ' ')) AS category FROM t WHERE (SELECT sum(s - 0.05) <= 100 AND sum(s + 0.05) >= 100 AND count(*) >= 2 FROM t)""",
    "text_lines": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
        p AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)
        SELECT doc_id, count(*) AS n_lines, CAST(max(s + length(t)) AS BIGINT) AS last_end, CAST(sum(s) AS BIGINT) AS starts FROM p WHERE regexp_matches(t, '[^\t-\r \x{85}\p{Z}]') GROUP BY doc_id""",
    "furniture": rf"""
        WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
        s AS (SELECT source, doc_id, trim(regexp_replace(regexp_replace(lower(t), '\p{{Nd}}+', '#', 'g'), '{_WS}+', ' ', 'g')) AS shape FROM l WHERE regexp_matches(t, '[^\t-\r \x{{85}}\p{{Z}}]')),
        n AS (SELECT source, count(DISTINCT doc_id) AS total FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1)
        SELECT s.source, shape, count(DISTINCT doc_id) AS n_units FROM s JOIN n ON n.source = s.source WHERE length(shape) >= 4 GROUP BY s.source, shape, total HAVING count(DISTINCT doc_id) >= greatest(3, floor(total * 0.25))""",
    "verify_chunks": """
        SELECT coalesce(substr(d.text, CAST(c.char_start AS INT) + 1, CAST(c.char_end - c.char_start AS INT)) = c.text, false) AS grounded, count(*) AS n FROM chunks c JOIN documents d ON d.doc_id = c.doc_id GROUP BY 1""",
    "evidence_window": """
        WITH e AS (SELECT DISTINCT fact_id, doc_id, CAST(evidence_json->>'char_start' AS BIGINT) AS a, CAST(evidence_json->>'char_end' AS BIGINT) AS b FROM facts)
        SELECT fact_id, greatest(0, a - 60) AS starts, a - greatest(0, a - 60) AS highlight, md5(substr(text, greatest(0, a - 60) + 1, b + 60 - greatest(0, a - 60))) AS window_md5 FROM e JOIN documents d ON d.doc_id = e.doc_id WHERE a >= 0""",
    "content_hashes": "SELECT sha256(text) = sha256 AS same, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "carry_forward": f"""
        WITH {_RELATIONS} SELECT fact_a, fact_b, verdict, CASE WHEN judged THEN rule_fired ELSE 'fresh' END AS rule_fired, NOT judged AS needs_llm, judged FROM rel""",
    "stale_relations": f"WITH {_RELATIONS} SELECT fact_a, fact_b FROM rel WHERE verdict = 'unrelated'",
    "adjudicated": f"""
        WITH {_RELATIONS}, {_ONCE}, k AS (SELECT fact_id, json_keys(qualifiers_json) AS ks FROM once),
        r AS (SELECT rel.*, CASE WHEN rule_fired = 'same_context_disjoint_intervals' THEN verdict ELSE 'unrelated' END AS rv,
                     coalesce(NOT list_contains(list_concat(coalesce(a.ks, []), coalesce(b.ks, [])), qualifier_key), false) AS bad
              FROM rel LEFT JOIN k a ON a.fact_id = fact_a LEFT JOIN k b ON b.fact_id = fact_b),
        o AS (SELECT *, CASE WHEN verdict <> 'contradicts' THEN NULL WHEN bad THEN 'hallucinated_qualifier_rejected' WHEN verdict <> rv THEN 'judge_inconsistent' ELSE 'llm_adjudicated' END AS outcome FROM r)
        SELECT CASE WHEN outcome IN ('hallucinated_qualifier_rejected', 'judge_inconsistent') THEN 'insufficient_context' ELSE verdict END AS verdict, coalesce(outcome, rule_fired) AS rule_fired,
               CASE WHEN outcome = 'llm_adjudicated' OR verdict = 'reconciled_by_context' THEN 'llm' ELSE 'deterministic' END AS decided_by, count(*) AS n FROM o GROUP BY 1, 2, 3""",
    "adjudication_rates": f"""
        WITH {_RELATIONS}, {_ONCE}, k AS (SELECT fact_id, json_keys(qualifiers_json) AS ks FROM once),
        r AS (SELECT rel.*, CASE WHEN rule_fired = 'same_context_disjoint_intervals' THEN verdict ELSE 'unrelated' END AS rv,
                     coalesce(NOT list_contains(list_concat(coalesce(a.ks, []), coalesce(b.ks, [])), qualifier_key), false) AS bad
              FROM rel LEFT JOIN k a ON a.fact_id = fact_a LEFT JOIN k b ON b.fact_id = fact_b),
        o AS (SELECT *, CASE WHEN verdict <> 'contradicts' THEN NULL WHEN bad THEN 'hallucinated_qualifier_rejected' WHEN verdict <> rv THEN 'judge_inconsistent' ELSE 'llm_adjudicated' END AS outcome FROM r)
        SELECT CAST(count(outcome) AS BIGINT) AS adjudicated, count(*) FILTER (outcome = 'llm_adjudicated') AS upheld, count(*) FILTER (outcome <> 'llm_adjudicated') AS downgraded,
               round(CASE WHEN count(*) FILTER (outcome <> 'hallucinated_qualifier_rejected') = 0 THEN 0.0 ELSE count(*) FILTER (outcome = 'llm_adjudicated') / count(*) FILTER (outcome <> 'hallucinated_qualifier_rejected') END, 4) AS self_consistency_rate,
               round(CASE WHEN count(outcome) = 0 THEN 0.0 ELSE count(*) FILTER (outcome = 'hallucinated_qualifier_rejected') / count(outcome) END, 4) AS rejection_rate FROM o""",
    "facts_search": f"""
        WITH {_ONCE} SELECT fact_id, doc_id, page FROM once WHERE coalesce(align_status, '') <> 'unlocated'
          AND (coalesce(claim_text ILIKE '%revenue%', false) OR coalesce(subject_surface ILIKE '%revenue%', false) OR coalesce(predicate ILIKE '%revenue%', false)) ORDER BY doc_id, page NULLS FIRST, fact_id LIMIT 100""",
    "relations_list": f"""
        WITH {_RELATIONS}, {_ONCE} SELECT fact_a, fact_b, verdict, a.doc_id AS doc_a, b.doc_id AS doc_b, md5(a.claim_text) AS claim_a, md5(b.claim_text) AS claim_b
        FROM rel LEFT JOIN once a ON a.fact_id = fact_a LEFT JOIN once b ON b.fact_id = fact_b WHERE verdict <> 'unrelated'""",
    "verdict_histogram": f"WITH {_RELATIONS} SELECT verdict, count(*) AS n FROM rel GROUP BY 1",
    "ledger_stats": f"""
        WITH {_ONCE} SELECT d.doc_id, count(f.fact_id) AS facts, count(*) FILTER (align_status = 'unlocated') AS quarantined,
               CASE WHEN count(f.fact_id) = 0 THEN 0.0 ELSE round((count(f.fact_id) - count(*) FILTER (align_status = 'unlocated')) / count(f.fact_id), 4) END AS located_rate
        FROM documents d LEFT JOIN once f ON f.doc_id = d.doc_id GROUP BY d.doc_id""",
    "health": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "facts", "relations", "predicate_registry", "schema_events")),
    "schema_summary": "SELECT event_type, count(*) AS n, count(DISTINCT subject) AS subjects FROM schema_events GROUP BY 1",
    "registry_aliases": """
        SELECT alias, min(canonical) AS canonical FROM (SELECT canonical, unnest(CAST(aliases_json AS JSON)::VARCHAR[]) AS alias FROM predicate_registry UNION ALL SELECT canonical, canonical FROM predicate_registry) GROUP BY 1""",
    "contrasts": f"""
        WITH r AS (SELECT canonical AS c, regexp_extract(canonical, '^({_MODIFIERS})_.', 1) AS m FROM predicate_registry),
        h AS (SELECT c, nullif(m, '') AS m, CASE WHEN m = '' THEN c ELSE substr(c, length(m) + 2) END AS head FROM r)
        SELECT x.c AS a, y.c AS b, x.m IS DISTINCT FROM y.m AND (x.m IS NOT NULL AND y.m IS NOT NULL OR coalesce(x.m, y.m) NOT IN ({_list(S.RESTATEMENTS)})) AS contrast FROM h x JOIN h y ON x.head = y.head AND x.c < y.c""",
    "invariants": f"""
        SELECT 'dangling' AS rule, count(*) AS n FROM relations r WHERE fact_a IS NOT NULL AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.fact_id = r.fact_a)
        UNION ALL SELECT 'self_pair', count(*) FROM relations WHERE fact_a = fact_b
        UNION ALL SELECT 'scaled_percentage', count(*) FROM facts WHERE value_kind = 'quantity' AND trim(replace(lower(value_json->>'unit'), '-', ' ')) IN ({_list(N.PERCENT_WORDS)}) AND value_json->>'scale' IS NOT NULL
        UNION ALL SELECT 'on_unlocated', count(*) FROM relations r WHERE EXISTS (SELECT 1 FROM facts f WHERE f.fact_id = r.fact_a AND f.align_status = 'unlocated')""",
}
