"""Business registers made from the driver's tables: whole tables, whole columns, in expressions that Spark and DuckDB read alike.

Parts are firms. The reference register (1) has each of them and every supplier; two
noisy registers (2 and 3) have each again under another spelling of name and address,
one in five and one in four under that of a firm that the reference hasn't, and
register 3 has all customers. Names come in native script, with digits for letters,
accents, legal forms and second names, addresses with abbreviations, null markers,
shifted numbers and cities under another name. ``same`` tells which records are one firm.
"""

from __future__ import annotations


def _pick(n: str, *values: str) -> str:
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _digit(k: str, of: int) -> str:
    return f"chr(98 + cast(floor({k} / {of}) AS INT) % 20)"


def _word(k: str) -> str:
    """A word of five letters for each of 8,000 numbers."""
    return f"{_digit(k, 1)} || 'a' || {_digit(k, 20)} || 'o' || {_digit(k, 400)}"


_COUNTRY = _pick("p_partkey", "'IN'", "'US'", "'FR'")
_STREETS = ("MG Road", "North Main Street", "Rue de la Paix", "Avenue Foch", "Industrial Estate", "Saint Mary Court", "Park Lane")
_SHORT = ("M.G. Rd", "N Main St", "R de la Paix", "Av. Foch", "Indl. Estate", "St Mary Ct", "Park Ln")
_CITIES = ("Bengaluru", "Springfield", "Paris", "Montréal", "Kraków")
_OTHER = ("Bengalooru", "Springfeild", "Paris", "Montreal", "Cracow")


def _firm(k: str) -> dict[str, str]:
    """Parts of the name and address of firm ``k``."""
    text = lambda values: _pick("p_partkey", *(f"'{v}'" for v in values))
    return {
        "word": _word(k),
        "number": f"(p_size * 100 + {k} % 89)",
        "street": text(_STREETS),
        "short": text(_SHORT),
        "city": text(_CITIES),
        "other": text(_OTHER),
        "code": f"(10000 + {k} % 9973)",
    }


def _part(register: int, k: str, names: list[str], addresses: list[str], nth: str) -> dict[str, str]:
    f = _firm(k)
    fill = lambda s: s.format(**{n: f"({v})" for n, v in f.items()})
    return {
        "table": "part",
        "id": f"cast({register - 1} AS BIGINT) * 1000000000 + p_partkey",
        "country": _COUNTRY,
        "business_name": _pick("p_partkey", *map(fill, names)),
        "business_address": _pick(nth, *map(fill, addresses)),
        "src": str(register),
        "same": f"'p' || ({k})",
    }


_FAMILY = "CASE WHEN p_partkey % 7 = 5 THEN 'Sharma ' ELSE '' END || "
RECORDS = [
    _part(
        1,
        "p_partkey",
        [
            _FAMILY + "{word} || ' ' || p_name || ' Pvt. Ltd.'",
            _FAMILY + "'M/s. ' || {word} || ' & ' || p_name || ' Sons'",
            _FAMILY + "{word} || ' ' || p_name || ' LLC'",
            _FAMILY + "'Société ' || {word} || ' ' || p_name",
            _FAMILY + "'www.' || {word} || '-' || replace(p_name, ' ', '-') || '.com'",
            _FAMILY + "{word} || ' ' || p_name || ' Große ' || p_type",
        ],
        ["{number} || ' ' || {street} || ', ' || p_brand || ', ' || {city} || ', ' || {code}"],
        "p_partkey",
    ),
    _part(
        2,
        "CASE WHEN p_partkey % 5 = 0 THEN p_partkey + 100003 ELSE p_partkey END",
        [
            "upper({word}) || ' ' || p_name || ' Private Limited'",
            "{word} || ' and ' || p_name || ' Sons'",
            "{word} || ' ' || p_name || ' L.L.C. dba ' || p_type",
            "'Societe ' || {word} || ' ' || p_name || ', Inc.'",
            "substr({word}, 1, 2) || substr({word}, 4) || ' ' || p_name",
            "'शर्मा ' || {word} || ' ' || p_name",
            "{word} || ' ' || replace(p_name, 'i', '1')",
        ],
        [
            "'<NULL>'",
            "'n/a'",
            "'No. ' || {number} || ', ' || {short} || ', ' || p_brand || ', ' || {other} || ', ' || {code}",
            "{number} + 10 || ' ' || {street} || ', ' || {other} || ', ' || {code}",
            "{number} || ' ' || {short} || ', ' || {other} || ', ' || {code}",
            "'Plot ' || {number} || ', ' || {street} || ', ' || {other}",
        ],
        "cast(floor(p_partkey / 7) AS INT)",
    ),
    _part(
        3,
        "CASE WHEN p_partkey % 4 = 0 THEN p_partkey + 200003 ELSE p_partkey END",
        ["p_name || ' ' || {word} || ' Co.'", "'The ' || {word} || ' ' || p_name || ' Company'", "{word} || ' ' || p_name", "'E.U.R.L. ' || {word} || ' ' || p_name", "{word} || 's ' || p_name || ' Ltd'"],
        ["''", "{street} || ' ' || {number} || ', ' || {city} || ', ' || {code}", "{number} || ', ' || {short} || ', ' || p_brand || ', ' || {city}", "'0' || {number} || ' ' || {short} || ', near school, ' || {city} || ', ' || {code}"],
        "cast(floor(p_partkey / 5) AS INT)",
    ),
    {
        "table": "supplier",
        "id": "cast(5000000000 AS BIGINT) + s_suppkey",
        "country": _pick("s_nationkey", "'IN'", "'US'", "'FR'"),
        "business_name": "s_name || ' Ltd'",
        "business_address": "s_suppkey % 90 || ' Harbour Road, Nation ' || s_nationkey",
        "src": "1",
        "same": "'s' || s_suppkey",
    },
    {
        "table": "customer",
        "id": "cast(6000000000 AS BIGINT) + c_custkey",
        "country": _pick("c_nationkey", "'IN'", "'US'", "'FR'"),
        "business_name": "c_name || ' Inc.'",
        "business_address": "c_mktsegment || ' House, ' || c_custkey % 900 || ' Market Street'",
        "src": "3",
        "same": "'c' || c_custkey",
    },
]
COLUMNS = ("id", "country", "business_name", "business_address", "src", "same")


def expressions(record: dict[str, str]) -> list[str]:
    return [f"{record[c]} AS {c}" for c in COLUMNS]


def sql() -> str:
    """All records, for DuckDB."""
    return " UNION ALL ".join(f"SELECT {', '.join(expressions(r))} FROM {r['table']}" for r in RECORDS)
