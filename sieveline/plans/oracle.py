"""DuckDB equivalents of the screening queries, built from a few shared expressions."""

from __future__ import annotations

from ..functions.reference_data import GENERIC, JURISDICTION, LEADING, TRAILING

_T, _L = "|".join(TRAILING), "|".join(LEADING)
_FORMS = ", ".join(f"'{f}'" for f in TRAILING)
_FORM_LIST = f"[{_FORMS}]"
_JURISDICTION = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in JURISDICTION.items()) + "}"
_GENERIC = ", ".join(f"'{g}'" for g in sorted(GENERIC))


def norm(x: str) -> str:
    folded = f"strip_accents(replace(replace({x}, 'ß', 'ss'), 'ẞ', 'ss'))"
    return f"trim(regexp_replace(replace(upper({folded}), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g'))"


def one_off(x: str) -> str:
    return f"trim(regexp_replace({x}, '(?:^| )(?:{_T})$', ''))"


def _pass(x: str) -> str:
    alone = "|".join(f for f in TRAILING if " " in f)  # a name that is such a form stays
    return f"regexp_replace(regexp_replace({x}, '^({alone})$| (?:{_T})$', '\\1'), '^(?:{_L}) ', '')"


def stripped(source: str, x: str, name: str, rounds: int = 6) -> str:
    """A subquery of ``source`` with column ``name``: all legal forms stripped from ``x``."""
    made = x
    for _ in range(rounds):
        made = _pass(made)
    return f"(SELECT *, {made} AS {name} FROM {source})"


def grams(x: str) -> str:
    return f"list_distinct(flatten(list_transform(string_split({x}, ' '), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || lower(w) || ' ', i, 3)))))"


def initials(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda t: left(t, 1)), '')"


def title(x: str) -> str:
    cased = "\\p{Lu}\\p{Ll}\\p{Lt}"
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[{cased}]+|[^{cased}]+'), lambda w: CASE left(w, 1) WHEN 'ß' THEN 'Ss' ELSE upper(left(w, 1)) END || substr(w, 2)), '')"


def share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0 ELSE round({part}::DOUBLE / {whole}, 4) END"


TITLES = """SELECT page_id AS uid, CASE WHEN regexp_extract(html, '<html lang="(.*?)"', 1) = 'en' THEN 'individual' ELSE 'entity' END AS entry_type,
       regexp_extract(html, '<title>(.*?)</title>', 1) AS primary_name FROM pages"""
CUSTOMERS = """SELECT 'P-' || uid AS query_id, entry_type AS subject_type, regexp_replace(primary_name, ' [^ ]+$', '') AS query_name,
       TRUE AS is_true_match, uid AS source_uid, 'token_drop' AS perturbation_type FROM t
UNION ALL SELECT 'N-' || s_suppkey, 'entity', s_name, FALSE, NULL, NULL FROM supplier"""
BASE = f"""WITH t AS ({TITLES}),
nm AS (SELECT * FROM (SELECT uid, entry_type, primary_name, {norm('primary_name')} AS norm FROM t) WHERE norm <> ''),
cu AS ({CUSTOMERS}),
q AS (SELECT * FROM (SELECT *, {norm('query_name')} AS norm FROM cu) WHERE norm <> ''),
qg AS (SELECT *, {grams('norm')} AS g FROM q),
ng AS (SELECT *, {grams('norm')} AS g FROM nm),
met AS (SELECT qg.query_id, ng.uid, len(list_intersect(qg.g, ng.g)) AS k, len(qg.g) AS a, len(ng.g) AS b FROM qg JOIN ng ON qg.subject_type = ng.entry_type),
near AS (SELECT query_id, uid, k / (a + b - k)::DOUBLE AS sim FROM met WHERE 10 * k >= 3 * (a + b - k))
"""
CANDIDATES = BASE + """, cand AS (SELECT * FROM (SELECT query_id, uid, sim AS score, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, uid) AS position FROM near) WHERE position <= 10),
pos AS (SELECT * FROM cu WHERE is_true_match),
rk AS (SELECT pos.*, c.position AS rank FROM pos LEFT JOIN cand c ON c.query_id = pos.query_id AND c.uid = pos.source_uid)
"""
STEMS = BASE + f""", st AS (SELECT uid, entry_type, norm, stem FROM {stripped('nm', 'norm', 'stem')}),
es AS (SELECT stem FROM st WHERE entry_type = 'entity' AND stem <> ''),
df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(string_split(stem, ' '))) AS token FROM es) GROUP BY token),
sz AS (SELECT count(*) AS n FROM es)
"""
ACRONYMS = f"""WITH t AS ({TITLES}),
nm AS (SELECT * FROM (SELECT uid, entry_type, primary_name, {norm('primary_name')} AS norm FROM t) WHERE norm <> ''),
st AS (SELECT *, {one_off('norm')} AS one FROM {stripped('nm', 'norm', 'stem')}),
ac AS (SELECT uid, entry_type, norm, CASE WHEN entry_type = 'individual' THEN [] ELSE
       list_sort(list_filter(list_distinct([{initials('norm')}, {initials('one')}, {initials('stem')}]), lambda a: length(a) >= 3)) END AS acr FROM st)
"""
_SIM = "CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) = 1 OR length({b}) = 1 THEN CASE WHEN left({a}, 1) = left({b}, 1) THEN 0.9 ELSE 0.0 END ELSE jaro_winkler_similarity({a}, {b}) END"


def _direction(own: str, other: str) -> str:
    """Score of one direction: per pair, over tokens of ``own``, their best match among ``other``."""
    return f"""SELECT p.query_id, p.uid, p.person, CASE WHEN p.person THEN avg(best) ELSE sum(w * CASE WHEN best >= 0.85 THEN best ELSE 0 END) / sum(w) END AS s FROM (
  SELECT o.query_id, o.uid, o.person, o.i, o.x, max({_SIM.format(a='o.x', b='r.x')}) AS best
  FROM {own} o JOIN {other} r ON o.query_id = r.query_id AND o.uid = r.uid GROUP BY ALL) p
  JOIN (SELECT token, ln((n + 1.0) / (df + 1)) + 1 AS w FROM df, sz UNION ALL SELECT NULL, ln(n + 1.0) + 1 FROM sz) d
    ON d.token = p.x OR (d.token IS NULL AND p.x NOT IN (SELECT token FROM df)) GROUP BY p.query_id, p.uid, p.person"""


def scores(pairs: str) -> str:
    """CTEs up to f and b, the two directions of the score of each (query_id, uid) of ``pairs``."""
    return f""", qs AS (SELECT query_id, subject_type, norm, stem FROM {stripped('q', 'norm', 'stem')}),
pr AS (SELECT c.query_id, c.uid, qs.subject_type = 'individual' AS person,
       string_split(CASE WHEN qs.subject_type = 'individual' THEN qs.norm ELSE qs.stem END, ' ') AS qt,
       string_split(CASE WHEN st.entry_type = 'individual' THEN st.norm ELSE coalesce(nullif(st.stem, ''), st.norm) END, ' ') AS nt
       FROM {pairs} c JOIN qs USING (query_id) JOIN st USING (uid)),
qx AS (SELECT query_id, uid, person, unnest(qt) AS x, unnest(generate_series(1, len(qt))) AS i FROM pr),
nx AS (SELECT query_id, uid, person, unnest(nt) AS x, unnest(generate_series(1, len(nt))) AS i FROM pr),
f AS ({_direction('qx', 'nx')}), b AS ({_direction('nx', 'qx')})
"""


NAME_SCORES = STEMS + scores("near") + """SELECT f.query_id, f.uid AS name_id, round((f.s + b.s) / 2, 6) AS score FROM f JOIN b ON f.query_id = b.query_id AND f.uid = b.uid"""

# One letter after the other: c is the letter at i, d and e the next ones, p the one before; u is what it sounds like, s how far to go.
_VOWEL = "IN ('a', 'e', 'i', 'o', 'u')"
_SOFT = "(d = 'i' AND e IN ('o', 'a'))"
METAPHONE = f"""mp AS (
  SELECT w, CASE WHEN left(lower(w), 2) IN ('ae', 'gn', 'kn', 'pn', 'wr') THEN substr(lower(w), 2) ELSE lower(w) END AS x, 1 AS i, '' AS o FROM words
  UNION ALL
  SELECT w, x, (i + s)::INT, o || u FROM (SELECT w, x, i, o,
    CASE WHEN c = d AND c <> 'c' THEN '' WHEN c {_VOWEL} THEN CASE WHEN i = 1 THEN c ELSE '' END WHEN c IN ('f', 'j', 'l', 'm', 'n', 'r') THEN c
      WHEN c = 'b' THEN CASE WHEN p = 'm' AND d = '' THEN '' ELSE 'b' END
      WHEN c = 'c' THEN CASE WHEN d = 'h' OR (d = 'i' AND e = 'a') THEN 'x' WHEN d IN ('i', 'e', 'y') THEN 's' ELSE 'k' END
      WHEN c = 'd' THEN CASE WHEN d = 'g' AND e IN ('i', 'e', 'y') THEN 'j' ELSE 't' END
      WHEN c = 'g' THEN CASE WHEN d IN ('i', 'e', 'y') THEN 'j' WHEN (d = 'h' AND e <> '' AND e NOT {_VOWEL}) OR (d = 'n' AND e = '') THEN '' ELSE 'k' END
      WHEN c = 'h' THEN CASE WHEN i = 1 OR d {_VOWEL} OR p NOT {_VOWEL} THEN 'h' ELSE '' END
      WHEN c = 'k' THEN CASE WHEN p = 'c' THEN '' ELSE 'k' END WHEN c = 'p' THEN CASE WHEN d = 'h' THEN 'f' ELSE 'p' END WHEN c = 'q' THEN 'k'
      WHEN c = 's' THEN CASE WHEN d = 'h' OR {_SOFT} THEN 'x' ELSE 's' END
      WHEN c = 't' THEN CASE WHEN {_SOFT} THEN 'x' WHEN d = 'h' THEN '0' WHEN d = 'c' AND e = 'h' THEN '' ELSE 't' END
      WHEN c = 'v' THEN 'f' WHEN c = 'w' THEN CASE WHEN (CASE WHEN i = 1 AND d = 'h' THEN e ELSE d END) {_VOWEL} THEN 'w' ELSE '' END
      WHEN c = 'x' THEN CASE WHEN i > 1 THEN 'ks' WHEN d = 'h' OR {_SOFT} THEN 'x' ELSE 's' END
      WHEN c = 'y' THEN CASE WHEN d {_VOWEL} THEN 'y' ELSE '' END WHEN c = 'z' THEN 's' ELSE '' END AS u,
    CASE WHEN c = d AND c <> 'c' THEN 1 WHEN c = 'c' AND (d IN ('h', 'i', 'e', 'y')) THEN 2 WHEN c = 'd' AND d = 'g' AND e IN ('i', 'e', 'y') THEN 3
      WHEN c = 'g' AND ((d = 'h' AND e <> '' AND e NOT {_VOWEL}) OR (d = 'n' AND e = '')) THEN 2 WHEN c IN ('p', 's', 't') AND d = 'h' THEN 2
      WHEN c = 's' AND {_SOFT} THEN 3 WHEN c = 'w' AND i = 1 AND d = 'h' THEN 2 ELSE 1 END AS s
    FROM (SELECT *, substr(x, i, 1) AS c, substr(x, i + 1, 1) AS d, substr(x, i + 2, 1) AS e, CASE WHEN i = 1 THEN '' ELSE substr(x, i - 1, 1) END AS p FROM mp WHERE i <= length(x)))),
sound AS (SELECT w, upper(o) AS s FROM mp WHERE i > length(x) AND o <> '')"""
#: Words that sound: alphabetic ones of three letters and more.
SOUNDS = f""", tok AS (SELECT norm, unnest(list_distinct(string_split(norm, ' '))) AS w FROM (SELECT norm FROM q UNION SELECT norm FROM nm)),
words AS (SELECT DISTINCT w FROM tok WHERE regexp_full_match(w, '[A-Z]{{3,}}')), {METAPHONE},
heard AS (SELECT DISTINCT norm, s FROM tok JOIN sound USING (w)),
alike AS (SELECT DISTINCT q.query_id, nm.uid FROM q JOIN heard a ON a.norm = q.norm JOIN heard b ON b.s = a.s JOIN nm ON nm.norm = b.norm AND nm.entry_type = q.subject_type),
ph AS (SELECT query_id, uid, CASE WHEN a + b - k = 0 THEN 0 ELSE k / (a + b - k)::DOUBLE END AS sim FROM alike JOIN met USING (query_id, uid))
"""
SCREEN = STEMS.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + SOUNDS + f""", acr AS (SELECT uid, entry_type, norm, [a FOR a IN list_distinct([{initials('norm')}, {initials('one')}, {initials('stem')}]) IF length(a) >= 3] AS acr
  FROM (SELECT *, {one_off('norm')} AS one FROM st) WHERE entry_type <> 'individual'),
qa AS (SELECT query_id, norm, list_distinct([a FOR a IN [CASE WHEN contains(norm, ' ') THEN {initials('norm')} ELSE '' END, CASE WHEN contains(one, ' ') THEN {initials('one')} ELSE '' END,
  CASE WHEN contains(stem, ' ') THEN {initials('stem')} ELSE '' END] IF length(a) >= 3]) AS spells
  FROM (SELECT *, {one_off('norm')} AS one FROM {stripped('q', 'norm', 'stem')}) WHERE subject_type = 'entity'),
short AS (SELECT query_id, uid FROM qa JOIN acr ON NOT contains(qa.norm, ' ') AND length(qa.norm) >= 3 AND list_contains(acr.acr, qa.norm)
  UNION SELECT query_id, uid FROM (SELECT query_id, unnest(spells) AS x FROM qa) s JOIN nm ON nm.norm = s.x AND nm.entry_type = 'entity'),
gen AS (SELECT query_id, uid, 'trigram' AS g, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, uid) AS r, 50 AS most FROM near
  UNION ALL SELECT query_id, uid, 'phonetic', row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, uid), 50 FROM ph
  UNION ALL SELECT query_id, uid, 'acronym', row_number() OVER (PARTITION BY query_id ORDER BY uid), 100 FROM short),
prop AS (SELECT query_id, uid, list_sort(list(g)) AS gens FROM gen WHERE r <= most GROUP BY query_id, uid)
""" + scores("prop") + """, sc AS (SELECT query_id, uid, gens, CASE WHEN list_contains(gens, 'acronym') THEN greatest((f.s + b.s) / 2, 0.9) ELSE (f.s + b.s) / 2 END AS score
  FROM prop JOIN f USING (query_id, uid) JOIN b USING (query_id, uid)),
rnk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, uid) AS r,
  list_contains(gens, 'acronym') AND count(*) FILTER (WHERE list_contains(gens, 'acronym')) OVER (PARTITION BY query_id) > 1 AS ambiguous FROM sc),
res AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS position, uid, round(round(score, 9), 4) AS score, entry_type, primary_name AS matched_name,
  'primary' AS name_kind, FALSE AS is_weak, gens, ambiguous FROM rnk JOIN nm USING (uid) WHERE r <= 10 OR ambiguous)
"""

COMPANIES = f"SELECT p_partkey, p_name || ' ' || {_FORM_LIST}[p_size % {len(TRAILING)} + 1] || ' ' || {_FORM_LIST}[p_partkey % {len(TRAILING)} + 1] AS company FROM part"
FIRMS = f"SELECT p_partkey AS uid, CASE WHEN p_partkey % 3 = 0 THEN 'The ' ELSE '' END || replace(company, ' ', CASE WHEN p_partkey % 5 = 0 THEN ' & ' ELSE '-' END) AS name FROM ({COMPANIES})"
LIST_TABLES = """WITH e AS (SELECT c_custkey AS uid, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'entity' ELSE 'individual' END AS entry_type, c_name AS primary_name FROM customer),
f AS (SELECT o_orderkey AS id, o_custkey AS uid,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'dob' WHEN '2-HIGH' THEN 'place_of_birth' ELSE 'registration_number' END AS feature_type,
      year(o_orderdate)::INT AS y, o_orderstatus AS st, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS value_country FROM orders),
a AS (SELECT c_custkey AS uid, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS city, CASE WHEN n_regionkey > 0 THEN n_name END AS country
      FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""

PUBLISHED_ALIASES = """SELECT o_custkey * 1048576 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS id, o_custkey AS uid, 'ORDER ' || o_orderkey AS last,
       o_orderstatus = 'F' AS old, 'ORDER ' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN ', Old' ELSE '' END AS alias_name, o_orderstatus = 'P' AS is_weak FROM orders WHERE o_orderpriority = '5-LOW'"""

SQL = {
    "normalize_names": f"SELECT conv_id, turn, {norm('text')} AS norm FROM conversations",
    "legal_forms": f"""SELECT p_partkey, nullif(regexp_extract(n, '(?:^| )({_T})$', 1), '') AS suffix,
        map_extract_value({_JURISDICTION}, regexp_extract(n, '(?:^| )({_T})$', 1)) AS jurisdiction, {one_off('n')} AS without_one, stem
        FROM {stripped(f"(SELECT p_partkey, {norm('company')} AS n FROM ({COMPANIES}))", 'n', 'stem')}""",
    "name_acronyms": ACRONYMS + "SELECT uid AS name_id, norm AS name_norm, array_to_string(acr, ',') AS acronyms FROM ac",
    "acronym_group_sizes": ACRONYMS + "SELECT acronym, count(*) AS n_rows, count(DISTINCT uid) AS n_uids FROM (SELECT uid, unnest(acr) AS acronym FROM ac) GROUP BY acronym",
    "acronym_lookup": ACRONYMS + """, k AS (SELECT uid, unnest(acr) AS a FROM ac), s AS (SELECT 'A-' || uid AS query_id, acr[1] AS a FROM ac WHERE len(acr) > 0)
        SELECT query_id, name_id FROM (SELECT query_id, uid AS name_id, row_number() OVER (PARTITION BY query_id ORDER BY uid) AS r
        FROM (SELECT DISTINCT s.query_id, k.uid FROM s JOIN k USING (a) UNION
              SELECT s.query_id, ac.uid FROM s JOIN ac ON ac.norm = s.a AND ac.entry_type = 'entity' WHERE FALSE)) WHERE r <= 100""",
    "trigram_topk": BASE + """SELECT query_id, uid AS name_id, round(sim, 6) AS sim FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, uid) AS r FROM near) WHERE r <= 50""",
    "token_similarity": f"""WITH t AS ({TITLES}), w AS (SELECT DISTINCT unnest(string_split({norm('primary_name')}, ' ')) AS w FROM t WHERE {norm('primary_name')} <> '')
        SELECT a.w AS a, b.w AS b, round({_SIM.format(a='a.w', b='b.w')}, 6) AS sim FROM w a JOIN w b ON left(a.w, 2) = left(b.w, 2) AND a.w <= b.w""",
    "idf": STEMS + "SELECT token, df, round(ln((n + 1.0) / (df + 1)) + 1, 6) AS idf FROM df, sz",
    "name_scores": NAME_SCORES,
    "recall_at_k": CANDIDATES + f"""SELECT coalesce(subject_type, 'all') AS subject, {', '.join(f"{share(f'count(*) FILTER (WHERE rank <= {k})', 'count(*)')} AS recall_at_{k}" for k in (1, 3, 5, 10))},
        {share('count(rank)', 'count(*)')} AS recall_shortlist, count(*) AS n FROM rk GROUP BY GROUPING SETS ((), (subject_type))""",
    "recall_by_perturbation": CANDIDATES + f"SELECT subject_type || ':' || perturbation_type AS perturbation, {share('count(rank)', 'count(*)')} AS recall, count(*) AS n FROM rk GROUP BY 1",
    "operating_points": CANDIDATES + f""", pt AS (SELECT k::INT AS k, f::DOUBLE AS floor FROM (VALUES (3), (5), (10)) a(k), (VALUES (0.0), (0.5), (0.6), (0.7), (0.8)) b(f)),
        kept AS (SELECT pt.k, pt.floor, cand.query_id, cand.uid = cu.source_uid AND cu.is_true_match AS hit FROM pt JOIN cand ON position <= pt.k AND score >= pt.floor JOIN cu USING (query_id))
        SELECT pt.k, pt.floor, {share('count(DISTINCT kept.query_id) FILTER (WHERE hit)', '(SELECT count(*) FROM pos)')} AS recall, count(kept.query_id) AS pairs,
        count(DISTINCT kept.query_id) AS queries_with_candidates FROM pt LEFT JOIN kept ON kept.k = pt.k AND kept.floor = pt.floor GROUP BY pt.k, pt.floor""",
    "threshold_baseline": CANDIDATES + f""", pt AS (SELECT s AS subject_type, t::DOUBLE AS threshold FROM (VALUES ('individual'), ('entity')) a(s), (VALUES (0.8), (0.85), (0.9), (0.95)) b(t)),
        al AS (SELECT cu.subject_type, pt.threshold, cu.query_id, coalesce(cu.is_true_match AND cand.uid = cu.source_uid, FALSE) AS hit
               FROM cand JOIN cu USING (query_id) JOIN pt ON pt.subject_type = cu.subject_type AND cand.score >= pt.threshold),
        g AS (SELECT pt.subject_type, pt.threshold, count(query_id) AS alerts, count(*) FILTER (WHERE hit) AS hits, count(DISTINCT query_id) FILTER (WHERE hit) AS caught,
              (SELECT count(*) FROM pos p WHERE p.subject_type = pt.subject_type) AS n
              FROM pt LEFT JOIN al ON al.subject_type = pt.subject_type AND al.threshold = pt.threshold GROUP BY ALL)
        SELECT subject_type, threshold, alerts, hits AS true_hits_alerted, {share('caught', 'n')} AS recall, alerts - hits AS false_positives,
        CASE WHEN hits > 0 THEN round((alerts - hits)::DOUBLE / hits, 2) END AS fp_per_true_hit FROM g""",
    "misses": CANDIDATES + """SELECT rk.query_id, rk.perturbation_type AS perturbation, rk.query_name, t.primary_name AS source_name, n.primary_name AS top_candidate
        FROM rk JOIN t ON t.uid = rk.source_uid LEFT JOIN cand c ON c.query_id = rk.query_id AND c.position = 1 LEFT JOIN nm n ON n.uid = c.uid WHERE rk.rank IS NULL""",
    "list_entries": """SELECT c_custkey AS uid, CASE WHEN firm THEN 'entity' ELSE 'individual' END AS entry_type, CASE WHEN named THEN c_name || ', Given' ELSE c_name END AS primary_name,
        CASE WHEN named THEN 'Given' END AS first_name, c_name AS last_name, c_mktsegment || ',' || n_name AS programs
        FROM (SELECT *, c_mktsegment = 'MACHINERY' AS firm, c_mktsegment <> 'MACHINERY' AND c_acctbal > 0 AS named FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "list_aliases": f"SELECT id, uid, alias_name, is_weak FROM ({PUBLISHED_ALIASES})",
    "list_features": """SELECT o_custkey AS uid, 'dob' AS feature_type, CASE WHEN o_orderstatus = 'P' THEN 'circa ' ELSE '' END || strftime(o_orderdate, '%d %b %Y') AS value_text,
        CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS value_date, NULL AS value_country FROM orders WHERE o_orderpriority = '1-URGENT'
        UNION ALL SELECT o_custkey, 'passport_no', o_orderkey::VARCHAR, strftime(o_orderdate, '%Y-%m-%d'), o_orderstatus FROM orders WHERE o_orderpriority = '3-MEDIUM'
        UNION ALL SELECT c_custkey, k, v, NULL, NULL FROM (SELECT *, unnest(kinds) AS k, unnest(vals) AS v FROM (SELECT c_custkey,
          CASE WHEN c_mktsegment = 'MACHINERY' THEN ['vessel_call_sign', 'vessel_type', 'vessel_flag', 'vessel_owner', 'vessel_tonnage'] ELSE ['place_of_birth', 'nationality', 'citizenship'] END AS kinds,
          CASE WHEN c_mktsegment = 'MACHINERY' THEN ['CS' || c_custkey, 'Tanker', n_name, CASE WHEN c_acctbal > 0 THEN c_name END, c_nationkey::VARCHAR]
            ELSE [CASE WHEN c_acctbal > 0 THEN c_mktsegment || ', ' || n_name END, n_name, CASE WHEN c_acctbal < 0 THEN n_name END] END AS vals
          FROM customer JOIN nation ON c_nationkey = n_nationkey)) WHERE v IS NOT NULL""",
    "list_addresses": """SELECT c_custkey AS uid, CASE WHEN c_acctbal > 0 THEN 'No. ' || c_custkey || ', ' ELSE '' END || 'Floor 1' AS address, c_mktsegment AS city, n_name AS country
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "built_index": f"""WITH shown AS (SELECT c_custkey AS uid, CASE WHEN firm THEN 'entity' ELSE 'individual' END AS entry_type, 'primary' AS name_kind, FALSE AS is_weak, CASE WHEN NOT firm AND c_acctbal > 0 THEN 'Given ' || c_name ELSE c_name END AS display
        FROM (SELECT *, c_mktsegment = 'MACHINERY' AS firm FROM customer)
        UNION ALL SELECT uid, CASE WHEN firm THEN 'entity' ELSE 'individual' END, 'alias', is_weak, CASE WHEN old AND NOT firm THEN 'Old ' || last ELSE alias_name END
        FROM ({PUBLISHED_ALIASES}) JOIN (SELECT c_custkey AS uid, c_mktsegment = 'MACHINERY' AS firm FROM customer) USING (uid)),
        n AS (SELECT *, {norm('display')} AS name_norm FROM shown)
        SELECT uid, entry_type, name_kind, is_weak, display, name_norm, CASE WHEN entry_type <> 'individual' THEN st END AS stem FROM {stripped('n', 'name_norm', 'st')}""",
    "adjudicated": LIST_TABLES + """, g AS (SELECT uid, arg_min(y, id) FILTER (WHERE feature_type = 'dob') AS y, count(DISTINCT y) FILTER (WHERE feature_type = 'dob') AS ny,
        count(*) FILTER (WHERE feature_type = 'place_of_birth') > 0 AS born, count(value_country) > 0 AS vc FROM f GROUP BY uid)
        SELECT 'Q-' || e.uid AS query_id, CASE WHEN CASE WHEN entry_type = 'individual'
          THEN ny = 1 AND ((a.country IS NOT NULL AND a.city IS NOT NULL) OR (a.country IS NULL AND coalesce(born, FALSE))) ELSE coalesce(vc, FALSE) OR a.country IS NOT NULL END
        THEN 'true_match' ELSE 'possible_match' END AS outcome, e.uid::VARCHAR AS uids FROM e LEFT JOIN g USING (uid) LEFT JOIN a USING (uid)""",
    "bootstrap": """WITH s AS (SELECT o_custkey AS c, sum((o_orderstatus = 'F')::INT)::DOUBLE AS s, count(*) AS n FROM orders GROUP BY 1),
        d AS (SELECT s.*, r, ('0x' || left(md5(c || '|' || r || '|42'), 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM s, generate_series(0, 199) x(r)),
        w AS (SELECT *, (SELECT count(*) FROM (SELECT k, sum(exp(-1.0) / gamma(k)) OVER (ORDER BY k) AS t FROM generate_series(1, 11) y(k)) WHERE u >= t) AS w FROM d),
        m AS (SELECT r, sum(s * w) / sum(n * w) AS m FROM w GROUP BY r)
        SELECT (SELECT round(sum(s) / sum(n), 6) FROM s) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""",
    "md5_sample": LIST_TABLES + """SELECT e.uid, e.primary_name, a.city, a.country FROM e JOIN a USING (uid) WHERE entry_type = 'individual'
        AND (EXISTS (SELECT 1 FROM f WHERE f.uid = e.uid AND f.feature_type = 'dob') OR a.country IS NOT NULL) ORDER BY md5(e.uid::VARCHAR), e.uid LIMIT 100""",
    "customer_attributes": LIST_TABLES + """, g AS (SELECT uid, arg_min(y, id) FILTER (WHERE feature_type = 'dob') AS y, count(DISTINCT y) FILTER (WHERE feature_type = 'dob') AS ny,
        arg_min(st, id) FILTER (WHERE feature_type = 'place_of_birth') AS born, arg_min(value_country, id) FILTER (WHERE value_country IS NOT NULL) AS vc FROM f GROUP BY uid)
        SELECT e.uid, CASE WHEN p THEN y END AS year_of_birth,
        CASE WHEN p THEN CASE WHEN a.country IS NOT NULL THEN a.city WHEN born IS NOT NULL THEN 'Town' END END AS city,
        CASE WHEN p THEN CASE WHEN a.country IS NOT NULL THEN a.country ELSE born END END AS country,
        CASE WHEN NOT p THEN coalesce(vc, a.country) END AS registration_country, CASE WHEN p THEN coalesce(ny, 0) ELSE 0 END AS n_birth_years
        FROM (SELECT *, entry_type = 'individual' AS p FROM e) e LEFT JOIN g USING (uid) LEFT JOIN a USING (uid)""",
    "first_place": """SELECT uid, arg_min(city, id) FILTER (WHERE city IS NOT NULL) AS city, arg_min(country, id) FILTER (WHERE country IS NOT NULL) AS country FROM (
        SELECT l_orderkey AS uid, l_linenumber::BIGINT * 1000000 + l_suppkey AS id, CASE WHEN l_returnflag <> 'N' THEN s_name END AS city, CASE WHEN n_regionkey > 0 THEN n_name END AS country
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) GROUP BY uid""",
    "feature_histogram": LIST_TABLES + "SELECT entry_type, feature_type, count(*) AS n FROM f JOIN e USING (uid) GROUP BY ALL",
    "birth_years": """SELECT uid, count(DISTINCT y) AS n_years, min(y)::INT AS first_year FROM (SELECT o_custkey AS uid, year(o_orderdate) AS y FROM orders
        UNION ALL SELECT o_custkey, year(o_orderdate) + 1 FROM orders) GROUP BY uid""",
    "listed_dates": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS value_date FROM orders",
    "stratified_split": """SELECT doc_id, stratum, CASE WHEN r <= round_even(0.25 * n, 0) THEN 'dev' ELSE 'test' END AS split FROM (
        SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY stratum) AS n
        FROM (SELECT DISTINCT doc_id, quality::VARCHAR AS stratum FROM labels))""",
    "frozen_split": "SELECT c_custkey, CASE WHEN ('0x' || left(md5(c_custkey::VARCHAR), 8))::BIGINT < 1073741824 THEN 'dev' ELSE 'test' END AS split FROM customer",
    "perturb_companies": f"""WITH f AS ({FIRMS}), s AS (SELECT uid, name, {one_off(norm('name'))} AS stem FROM f),
        p AS (SELECT uid, 'acronym' AS perturbation_type, CASE WHEN contains(stem, ' ') AND length({initials('stem')}) >= 3 THEN {initials('stem')} END AS query_name FROM s
        UNION ALL SELECT uid, 'ampersand', CASE WHEN contains(name, '&') THEN replace(name, '&', 'and') END FROM s
        UNION ALL SELECT uid, 'article_drop', CASE WHEN starts_with(upper(name), 'THE ') THEN substr(name, 5) END FROM s
        UNION ALL SELECT uid, 'hyphen_spacing', CASE WHEN contains(name, '-') THEN replace(name, '-', '') END FROM s
        UNION ALL SELECT uid, 'branch_qualifier', name || ' (Dubai Branch)' FROM s UNION ALL SELECT uid, 'attribute_degradation', name FROM s)
        SELECT * FROM p WHERE query_name IS NOT NULL""",
    "outcome_intervals": """WITH g AS (SELECT quality, sum(toxic)::DOUBLE AS k, count(*)::DOUBLE AS n, 1.959963984540054 AS z FROM labels GROUP BY quality)
        SELECT quality, round((k / n + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS low,
        round((k / n + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS high,
        round(1 - pow(0.05, 1 / n), 6) AS bound FROM g""",
    "mcnemar": """WITH c AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b
        FROM (SELECT o_orderstatus = 'F' AS a, o_orderpriority = '2-HIGH' AS b FROM orders))
        SELECT only_a, only_b, round(least(1.0, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2)))
        FROM generate_series(0, least(only_a, only_b)) s(i))), 6) AS p_value FROM c""",
    "flip_rate": """SELECT count(*) AS pairs, count(*) FILTER (WHERE f) AS flipped, round(count(*) FILTER (WHERE f) / count(*)::DOUBLE, 4) AS rate
        FROM (SELECT l_orderkey, count(DISTINCT l_returnflag) > 1 AS f FROM lineitem GROUP BY 1)""",
    "confusion": """WITH c AS (SELECT CASE l_returnflag WHEN 'R' THEN 'true_match' WHEN 'A' THEN 'possible_match' ELSE 'false_positive' END AS o,
        CASE l_linestatus WHEN 'O' THEN 'possible_match' ELSE 'true_match' END AS expected_outcome FROM lineitem)
        SELECT expected_outcome, count(*) FILTER (WHERE o = 'true_match') AS true_match, count(*) FILTER (WHERE o = 'possible_match') AS possible_match,
        count(*) FILTER (WHERE o = 'false_positive') AS false_positive FROM c GROUP BY 1""",
    "phonetic_overlap": BASE.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + SOUNDS + """SELECT query_id, uid AS name_id, round(sim, 6) AS sim FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, uid) AS r FROM ph) WHERE r <= 50""",
    "phonetic_codes": BASE.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + SOUNDS + """SELECT uid AS name_id, coalesce((SELECT string_agg(s, ',' ORDER BY s) FROM heard WHERE heard.norm = nm.norm), '') AS phonetic_keys FROM nm""",
    "screen": SCREEN + "SELECT * EXCLUDE (gens), array_to_string(gens, ',') AS generators FROM res",
    "screened_records": SCREEN + """SELECT query_id, coalesce(c, '[]') AS candidates FROM cu LEFT JOIN (SELECT query_id, '[' || string_agg(
        '{"uid":' || uid || ',"score":' || score || ',"entry_type":"' || entry_type || '","matched_name":' || to_json(matched_name) || ',"name_kind":"primary","is_weak":false,"generators":' || to_json(gens)
        || ',"ambiguous":' || ambiguous || '}', ',' ORDER BY position) || ']' AS c FROM res GROUP BY query_id) USING (query_id)""",
    "stored_index": ACRONYMS + f"""SELECT uid AS name_id, ac.entry_type, ac.norm AS name_norm, CASE WHEN ac.entry_type <> 'individual' THEN st.stem END AS stem, array_to_string(acr, ',') AS acronyms,
        len({grams('ac.norm')})::INT AS n_grams FROM ac JOIN st USING (uid)""",
    "index_differences": f"""WITH t AS ({TITLES}), f AS (SELECT uid AS name_id, primary_name AS display, FALSE AS is_weak FROM t),
        s AS (SELECT name_id, display, name_id % 7 = 0 AS is_weak FROM f WHERE name_id % 11 <> 0)
        SELECT *, 'fresh' AS side FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM s) UNION ALL SELECT *, 'stored' FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM f)""",
    "acronym_expansion": ACRONYMS + f""", l AS (SELECT uid, acr[1] AS norm FROM ac WHERE len(acr) > 0),
        s AS (SELECT uid, unnest([CASE WHEN contains(norm, ' ') THEN {initials('norm')} ELSE '' END, CASE WHEN contains(one, ' ') THEN {initials('one')} ELSE '' END,
          CASE WHEN contains(stem, ' ') THEN {initials('stem')} ELSE '' END]) AS x FROM st WHERE entry_type = 'entity')
        SELECT query_id, name_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY name_id) AS r FROM
          (SELECT DISTINCT 'S-' || s.uid AS query_id, l.uid AS name_id FROM s JOIN l ON l.norm = s.x AND length(s.x) >= 3)) WHERE r <= 100""",
    "idf_one_form": f"""WITH s AS (SELECT * FROM (SELECT {one_off(norm('company'))} AS stem FROM ({COMPANIES})) WHERE stem <> ''), sz AS (SELECT count(*) AS n FROM s),
        df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(string_split(stem, ' '))) AS token FROM s) GROUP BY token)
        SELECT token, df, round(ln((n + 1.0) / (df + 1)) + 1, 6) AS idf FROM df, sz""",
    "distinctive_words": f"""WITH n AS (SELECT p_partkey, {norm("company || CASE WHEN p_partkey % 2 = 0 THEN ' International Trading' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ' LLC' ELSE '' END")} AS n FROM ({COMPANIES}))
        SELECT p_partkey, array_to_string([t FOR t IN string_split({one_off('n')}, ' ') IF length(t) > 1 AND NOT list_contains([{_GENERIC}], t)
          AND t <> regexp_extract(n, '(?:^| )({_T})$', 1)], ',') AS words FROM n""",
    "perturb_people": f"""WITH t AS ({TITLES}), p AS (SELECT uid, regexp_replace(primary_name, ' [^ ]*$', '') AS f, 'al-' || regexp_extract(primary_name, '([^ ]*)$', 1) AS l FROM t WHERE contains(primary_name, ' ')),
        b AS (SELECT uid, {title("trim(f) || ' ' || trim(l)")} AS base, {title("l || ' ' || f")} AS turned FROM p),
        w AS (SELECT *, list_filter(regexp_split_to_array(base, '\\s+'), lambda x: x <> '') AS ws FROM b)
        SELECT * FROM (SELECT uid, 'name_order_inversion' AS perturbation_type, turned AS query_name FROM w
          UNION ALL SELECT uid, 'initialize', left(ws[1], 1) || '. ' || array_to_string(ws[2:], ' ') FROM w WHERE len(ws) >= 2 AND length(ws[1]) >= 2
          UNION ALL SELECT uid, 'dob_degradation', base FROM w UNION ALL SELECT uid, 'hyphen_spacing', replace(base, '-', '') FROM w)""",
    "unanswered_queries": BASE + "SELECT query_id FROM cu WHERE query_id NOT IN (SELECT query_id FROM near)",
    "list_violations": """WITH c AS (SELECT c_custkey AS uid FROM customer), e AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE uid % 20 = 0)
        SELECT 'duplicate_uid' AS rule, (SELECT count(*) FROM c WHERE uid % 20 = 0) AS n UNION ALL SELECT 'unknown_entry_type', (SELECT count(*) FROM e WHERE uid % 7 = 0)
        UNION ALL SELECT 'no_primary_name', (SELECT count(*) FROM e WHERE uid % 9 = 0) UNION ALL SELECT 'aliases_without_entry', (SELECT count(*) FROM orders WHERE o_custkey * 2 NOT IN (SELECT uid FROM c))
        UNION ALL SELECT 'features_without_entry', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT uid FROM c))
        UNION ALL SELECT 'addresses_without_entry', (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE -c_custkey NOT IN (SELECT uid FROM c))""",
    "split_faults": """WITH l AS (SELECT doc_id % 97 AS u, CASE WHEN quality = 1 THEN 'dev' WHEN toxic = 0 THEN 'test' END AS s FROM labels)
        SELECT 'invalid_split' AS rule, count(*) FILTER (WHERE s IS NULL) AS n FROM l
        UNION ALL SELECT 'source_in_both_splits', count(*) FROM (SELECT u FROM l GROUP BY u HAVING count(DISTINCT s) > 1)""",
    "answer_faults": """WITH l AS (SELECT 'Q-' || l_orderkey AS q, l_partkey AS u, * FROM lineitem), a AS (SELECT DISTINCT q, u FROM l WHERE l_linestatus = 'F'),
        s AS (SELECT q, u, count(*) AS n FROM l WHERE l_returnflag <> 'N' OR l_linenumber = 1 GROUP BY q, u)
        SELECT DISTINCT query_id, fault FROM (SELECT coalesce(a.q, s.q) AS query_id, CASE WHEN a.q IS NULL THEN 'invented' WHEN s.q IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated'
        WHEN s.u % 10 = 0 THEN 'evidence_not_in_input' END AS fault FROM a FULL JOIN s ON a.q = s.q AND a.u = s.u) WHERE fault IS NOT NULL""",
    "judgement_chunks": "SELECT o_custkey AS query_id, o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4)::INT AS chunk FROM orders",
    "screening_funnel": """SELECT 'queries' AS stage, count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT 'pairs', count(*) FROM lineitem
        UNION ALL SELECT 'pairs_after_precheck', count(*) FROM lineitem WHERE l_returnflag <> 'A' UNION ALL SELECT 'pairs_true_or_possible', count(*) FROM lineitem WHERE l_returnflag <> 'A' AND l_linestatus <> 'F'""",
    "nickname_variants": """WITH p AS (SELECT p_partkey AS query_id, p_name AS query_name, string_split(p_name, ' ') AS w FROM part), k AS (SELECT DISTINCT w[1] AS s FROM p),
        m AS (SELECT query_id, w, unnest(generate_series(1, len(w))) AS i FROM p)
        SELECT query_id, query_name, FALSE AS variant FROM p
        UNION ALL SELECT query_id, array_to_string(list_concat(list_concat(w[:i - 1], ['Mc' || s]), w[i + 1:]), ' '), TRUE FROM m JOIN k ON upper(w[i]) = upper(s)""",
    "records_round_trip": f"""WITH t AS ({TITLES}), cu AS ({CUSTOMERS}) SELECT query_id, subject_type, query_name, is_true_match, source_uid, 'dev' AS split FROM cu WHERE length(query_name) % 4 = 0""",
    "feature_report": LIST_TABLES + """SELECT 'features' AS report, '[' || string_agg('{"entry_type":"' || entry_type || '","feature_type":"' || feature_type || '","n":' || n || '}', ',' ORDER BY entry_type, feature_type) || ']' AS body
        FROM (SELECT entry_type, feature_type, count(*) AS n FROM f JOIN e USING (uid) GROUP BY ALL)""",
}
