"""SQL building blocks of the checks: normalization and keys written a second time, for DuckDB."""

from __future__ import annotations

from coalign.functions import vocabulary as V

from . import fixture


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_map(words: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in words.items()) + "}"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(map(text, words)) + "]"


def fold(c: str) -> str:
    """DuckDB's own removal of accents, with what it leaves in the texts of the checks worked out by hand."""
    return f"strip_accents(replace(replace({c}, 'शर्मा', 'shrma'), 'ß', 'ss'))"


def clean_name(c: str) -> str:
    c = f"lower({fold(c)})"
    for _, pattern, to in V.NAME_RULES:
        to = to.replace("$1", "\\1").replace("$2", "\\2")
        c = f"regexp_replace({c}, {text(pattern)}, {text(to)}, 'g')"
    return c


def words(c: str) -> str:
    return f"list_filter(string_split(regexp_replace({c}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


def mapped(c: str, m: dict[str, str]) -> str:
    return f"list_transform({c}, lambda t: coalesce({sql_map(m)}[t], t))"


def unconfused(c: str) -> str:
    return (
        f"list_transform({c}, lambda t: CASE WHEN regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '{V.ORDINAL}') "
        f"THEN translate(t, '{V.DIGIT_LOOKS[0]}', '{V.DIGIT_LOOKS[1]}') ELSE t END)"
    )


def split_again(c: str) -> str:
    return f"list_filter(string_split(array_to_string({c}, ' '), ' '), lambda t: t <> '')"


def distinct(c: str) -> str:
    """Keeps the first of each."""
    return f"list_filter({c}, lambda t, i: list_position({c}, t) = i)"


def without(c: str, dropped: list[str]) -> str:
    return f"list_filter({c}, lambda t: NOT list_contains({sql_list(dropped)}, t))"


def names(source: str, name: str = "business_name", transliterated: dict[str, str] | None = None) -> str:
    """CTEs from ``source`` to ``named``, which has its columns and those of the names."""
    own = lambda c: f"CASE WHEN native THEN {mapped(c, transliterated)} ELSE {c} END" if transliterated else c
    dba = text(V.OTHER_NAME)
    toks = lambda c: split_again(mapped(unconfused(own(words(f"regexp_replace({c}, '''s\\b', 's', 'g')"))), V.LEGAL_FORMS))
    drop = [*V.LEGAL_TOKENS, *V.NAME_STOP_WORDS]
    return f"""
n1 AS (SELECT *, regexp_matches(coalesce({name}, ''), '[\\x{{0900}}-\\x{{0DFF}}]') AS native, {clean_name(f"coalesce({name}, '')")} AS c FROM {source}),
n2 AS (SELECT *, CASE WHEN regexp_matches(c, {dba}) THEN regexp_extract(c, {dba}, 1) ELSE c END AS main, CASE WHEN regexp_matches(c, {dba}) THEN regexp_extract(c, {dba}, 2) ELSE '' END AS other FROM n1),
n3 AS (SELECT *, {toks('main')} AS mt, {toks('other')} AS ot FROM n2),
n4 AS (SELECT *, {distinct('mt')} AS name_tok, {distinct('ot')} AS alt_all FROM n3),
n5 AS (SELECT *, {without('name_tok', drop)} AS core0, {without('alt_all', drop)} AS alt_tok,
  array_to_string(list_sort(list_distinct(list_filter(list_concat(name_tok, alt_all), lambda t: list_contains({sql_list(V.LEGAL_TOKENS)}, t)))), ' ') AS legal FROM n4),
named AS (SELECT * EXCLUDE (c, main, other, mt, ot, alt_all, core0),
  CASE WHEN len(core0) > 1 AND list_contains({sql_list(V.TITLES)}, core0[1]) THEN core0[2:] ELSE core0 END AS core_tok,
  array_to_string(name_tok, ' ') AS name_norm, array_to_string(core_tok, ' ') AS core, array_to_string(core_tok, '') AS compact FROM n5)"""


def addresses(source: str, address: str = "business_address") -> str:
    """CTEs from ``source`` to ``normal``, which has its columns and those of the addresses."""
    a = f"regexp_replace(lower({fold(f'coalesce({address}, {chr(39) * 2})')}), {text(V.NULL_ADDRESS)}, ' ', 'g')"
    a = f"regexp_replace({a}, '(\\d)\\s*-\\s*(\\d)', '\\1 \\2', 'g')"
    tokens = f"list_transform({mapped(words('x'), V.STREET_WORDS)}, lambda t: regexp_replace(t, '^0+([0-9])', '\\1'))"
    part = f"array_to_string(list_filter({tokens}, lambda t: t <> '' AND NOT list_contains({sql_list(V.ADDRESS_STOP_WORDS)}, t)), ' ')"
    return f"""
a1 AS (SELECT *, {a} AS ac FROM {source}),
a2 AS (SELECT *, list_filter(list_transform(string_split(ac, ','), lambda x: {part}), lambda p: p <> '') AS comps,
  list_filter(list_transform(regexp_extract_all(ac, '\\d+'), lambda n: regexp_replace(n, '^0+', '')), lambda n: n <> '') AS nums0 FROM a1),
a3 AS (SELECT * EXCLUDE (comps, nums0, ac), {distinct('comps')} AS addr_comp, {distinct('nums0')} AS addr_num FROM a2),
a4 AS (SELECT *, {split_again('addr_comp')} AS at0 FROM a3),
a5 AS (SELECT * EXCLUDE (at0), {distinct('at0')} AS addr_tok FROM a4),
normal AS (SELECT *, array_to_string(addr_tok, ' ') AS addr, len(addr_tok) = 0 AS addr_empty FROM a5)"""


RAW = f"""
raw AS ({fixture.sql()}),
kept AS (SELECT *, 'S' || src || '-' || id AS entity_id FROM raw)"""

#: normal (all records), rec_a, rec_b and truth.
REGISTERS = f"""{RAW},{names('kept')},{addresses('named')},
rec_a AS (SELECT * FROM normal WHERE src = 1), rec_b AS (SELECT * FROM normal WHERE src > 1),
truth AS (SELECT a.id AS a, b.id AS b FROM rec_a a JOIN rec_b b ON a.country = b.country AND a.same = b.same)"""

_BAG = "list_distinct(list_concat(core_tok, alt_tok))"

#: Keys of all records as keys(id, country, side, kt, key).
KEYS = f"""{REGISTERS},
nt AS (SELECT id, country, src = 1 AS side, unnest({_BAG}) AS t FROM normal),
nf AS (SELECT country, t, count(*) AS df FROM nt GROUP BY ALL),
nr AS (SELECT id, country, side, t, df, row_number() OVER (PARTITION BY id ORDER BY df, t) AS nth FROM nt JOIN nf USING (country, t)),
nc AS (SELECT id, country, side, t, row_number() OVER (PARTITION BY id ORDER BY df, t) AS nth FROM nt JOIN nf USING (country, t) WHERE df <= 5000),
pt AS (SELECT id, country, src = 1 AS side, unnest(list_distinct(addr_tok)) AS t FROM normal),
pf AS (SELECT country, t, count(*) AS df FROM pt GROUP BY ALL),
pr AS (SELECT * FROM (SELECT id, country, side, t, row_number() OVER (PARTITION BY id ORDER BY df, t) AS nth FROM pt JOIN pf USING (country, t) WHERE NOT regexp_matches(t, '^[0-9]+$')) WHERE nth <= 3),
nu AS (SELECT id, unnest(addr_num[1:2]) AS n FROM normal),
e0 AS (SELECT id, country, side, t FROM nr WHERE nth <= 2 AND length(t) >= 5),
keys AS (
  SELECT id, country, side, 't' AS kt, t AS key FROM nc WHERE nth <= 3
  UNION SELECT id, country, side, 'b', string_agg(t, ' ' ORDER BY t) FROM nr WHERE nth <= 2 GROUP BY ALL HAVING count(*) = 2
  UNION SELECT id, country, src = 1, 'c', compact FROM normal WHERE length(compact) >= 4
  UNION SELECT id, country, src = 1, 'p', substring(compact, 1, 6) FROM normal WHERE length(compact) >= 8
  UNION SELECT id, country, src = 1, 's', right(compact, 6) FROM normal WHERE length(compact) >= 8
  UNION SELECT id, country, side, 'a', n || '|' || t FROM pr JOIN nu USING (id)
  UNION SELECT x.id, x.country, x.side, 'd', x.t || ' ' || y.t FROM pr x JOIN pr y ON x.id = y.id AND x.t < y.t
  UNION SELECT n.id, n.country, n.side, 'x', n.t || '|' || p.t FROM nr n JOIN pr p ON n.id = p.id AND n.nth = 1 AND p.nth = 1
  UNION SELECT id, country, side, 'y', t || '|' || n FROM nr JOIN nu USING (id) WHERE nth <= 2
  UNION SELECT id, country, side, 'e', t FROM e0
  UNION SELECT id, country, side, 'e', substring(t, 1, k) || substring(t, k + 2) FROM e0, range(12) r(k) WHERE k < length(t))"""

_CAP = " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.PAIR_CAPS.items())
SIZES = """
sizes AS (SELECT country, kt, key, count(*) FILTER (side) AS na, count(*) FILTER (NOT side) AS nb FROM keys GROUP BY ALL HAVING na > 0 AND nb > 0)"""
_HITS = ", ".join(f"count(*) FILTER (x.kt = '{k}') AS k_{k}" for k in V.KEY_TYPES)
PAIRS = f"""{KEYS},{SIZES},
ok AS (SELECT country, kt, key FROM sizes WHERE na * nb <= CASE kt {_CAP} END),
pairs AS (
  SELECT x.country, x.id AS a, y.id AS b, {_HITS}
  FROM keys x JOIN ok USING (country, kt, key) JOIN keys y USING (country, kt, key) WHERE x.side AND NOT y.side GROUP BY ALL)"""


def _bags(name: str, column: str, width: int) -> str:
    """name_b(id, t, idf, df): the first tokens of each record with their weights over both sides."""
    return f"""
{name}_w AS (SELECT t, count(*) AS df, ln((SELECT count(*) FROM normal) / count(*)) AS idf FROM (SELECT id, unnest(list_distinct({column})) AS t FROM normal) GROUP BY t),
{name}_b AS (SELECT id, t, df, idf FROM (SELECT id, unnest(({distinct(column)})[1:{width}]) AS t FROM normal) JOIN {name}_w USING (t)),
{name}_s AS (SELECT id, sum(idf) AS s, count(*) AS n FROM {name}_b GROUP BY id),
{name}_i AS (SELECT a, b, sum(x.idf) AS i, count(*) AS n FROM pairs JOIN {name}_b x ON x.id = a JOIN {name}_b y ON y.id = b AND x.t = y.t GROUP BY a, b)"""


_OV = "CASE WHEN least({x}, {y}) > 0 THEN {i} / least({x}, {y}) ELSE 0 END"
_JAC = "CASE WHEN {x} + {y} - {i} > 0 THEN {i} / ({x} + {y} - {i}) ELSE 0 END"
WEIGHTS = f"""{PAIRS},
bagged AS (SELECT id, list_concat(core_tok, alt_tok) AS nts FROM normal),
{_bags('w1', 'nts', 8).strip().replace('FROM normal)', 'FROM bagged)').replace('FROM bagged) / count', 'FROM normal) / count')},{_bags('w2', 'addr_tok', 16)},{_bags('w3', 'addr_comp', 8)},
sums AS (
  SELECT p.*, coalesce(n.i, 0) AS ni, coalesce(n.n, 0) AS nn, coalesce(m.i, 0) AS ai, coalesce(m.n, 0) AS an, coalesce(c.i, 0) AS ci,
         coalesce(na.s, 0) AS na, coalesce(nb.s, 0) AS nb, coalesce(na.n, 0) AS nan, coalesce(nb.n, 0) AS nbn,
         coalesce(aa.s, 0) AS aa, coalesce(ab.s, 0) AS ab, coalesce(ca.s, 0) AS ca, coalesce(cb.s, 0) AS cb
  FROM pairs p LEFT JOIN w1_i n USING (a, b) LEFT JOIN w2_i m USING (a, b) LEFT JOIN w3_i c USING (a, b)
  LEFT JOIN w1_s na ON na.id = a LEFT JOIN w1_s nb ON nb.id = b LEFT JOIN w2_s aa ON aa.id = a LEFT JOIN w2_s ab ON ab.id = b
  LEFT JOIN w3_s ca ON ca.id = a LEFT JOIN w3_s cb ON cb.id = b),
ovl AS (
  SELECT *, {_OV.format(x='na', y='nb', i='ni')} AS n_ov, {_JAC.format(x='na', y='nb', i='ni')} AS n_jac,
         {_OV.format(x='aa', y='ab', i='ai')} AS a_ov, {_JAC.format(x='aa', y='ab', i='ai')} AS a_jac,
         {_OV.format(x='ca', y='cb', i='ci')} AS c_ov, {_JAC.format(x='ca', y='cb', i='ci')} AS c_jac FROM sums)"""

CHEAP = f"""{WEIGHTS},
cheap AS (
  SELECT o.*, round(greatest(0.5 * n_ov + 0.5 * n_jac, (x.compact = y.compact)::INT::DOUBLE)
    + 0.8 * CASE WHEN y.addr_empty THEN 0.6 ELSE a_jac + 0.2 * list_has_any(x.addr_num[1:6], y.addr_num[1:6])::INT END
    + 0.02 * least({' + '.join(f'k_{k}' for k in V.KEY_TYPES)}, 5), 9) AS cheap
  FROM ovl o JOIN normal x ON x.id = a JOIN normal y ON y.id = b)"""

RANKED = f"""{CHEAP},
pre AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cheap DESC, b) AS rank_a FROM cheap) WHERE rank_a <= 80),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY cheap DESC, a) AS rank_b FROM pre) WHERE rank_a <= 25 OR rank_b <= 5)"""

#: Scored pairs of suppliers (a) and parts (b) with labels, and all suppliers.
SCORED = """
scored AS (
  SELECT l_suppkey AS a, l_partkey AS b, max(((l_orderkey * 7919 + l_linenumber * 104729) % 1000) / 1000.0::DOUBLE) AS p,
         ((l_suppkey * 31 + l_partkey * 17) % 5 = 0)::INT AS y, 2 + l_partkey % 2 AS src
  FROM lineitem GROUP BY l_suppkey, l_partkey),
all_a AS (
  SELECT s_suppkey AS a, n_name AS country, s_acctbal < 0 AS addr_empty, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE coalesce(n, 0) END::BIGINT AS ntrue
  FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT a, sum(y) AS n FROM scored GROUP BY a) t ON t.a = s_suppkey),
labelled AS (SELECT s.* REPLACE (CASE WHEN s.a % 4 = 0 THEN 0 ELSE s.y END AS y) FROM scored s),
best AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY p DESC, a) AS nth FROM labelled) WHERE nth = 1)"""


def per_a(pred: str) -> str:
    """CTE ``per_a`` of the scores of a prediction."""
    return f"""
per_a AS (
  SELECT r.*, coalesce(npred, 0) AS npred, coalesce(tp, 0)::BIGINT AS tp,
         CASE WHEN ntrue = 0 THEN (coalesce(npred, 0) = 0)::INT::DOUBLE ELSE 1.25 * coalesce(tp, 0) / (0.25 * ntrue + coalesce(npred, 0)) END AS f05
  FROM all_a r LEFT JOIN (SELECT a, count(*) AS npred, sum(y) AS tp FROM {pred} GROUP BY a) USING (a))"""
