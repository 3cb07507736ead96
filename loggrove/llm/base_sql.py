"""DuckDB SQL for the fixed patterns of the personal data and secret scans: counts, and a digest of their places."""

from __future__ import annotations

DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
DIGIT = f"CAST(substr({DIGITS}, CAST(j AS INTEGER), 1) AS INTEGER)"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda j: CASE WHEN (length({DIGITS}) - j) % 2 = 0 THEN {DIGIT} WHEN {DIGIT} > 4 THEN 2 * {DIGIT} - 9 ELSE 2 * {DIGIT} END)) % 10 = 0"
NAME = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = rf"""({NAME})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

#: Kinds in order: pattern, and what makes a match x valid.
PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(right('0' || p, 4) AS INTEGER), 0) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 12 AND 19 AND {LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 9 AND 15"),
}
SECRETS = {
    "assign": (ASSIGN, f"length(regexp_extract(x, '{ASSIGN}', 2)) >= 8"),
    "access": ("AKIA[A-Z0-9]+", "length(x) >= 16"),
    "hex": ("[0-9a-f]+", "length(x) >= 32"),
}


def oracle(kinds: dict[str, tuple[str, str]], documents: str = "documents") -> str:
    """SQL for (doc_id, n_<kind>, ..., base_sha256). A match starts after the pieces between the matches and the matches before it."""
    each = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{name}' AS kind, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d" for k, (name, (pattern, _)) in enumerate(kinds.items()))
    valid = " ".join(f"WHEN {k} THEN {rule}" for k, (_, rule) in enumerate(kinds.values()))
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{name}') AS BIGINT) AS n_{name}" for name in kinds)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {documents}),
m AS ({each}),
e AS (SELECT doc_id, k, kind, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (SELECT doc_id, k, kind, ms[i] AS x, list_sum(list_transform(gs[1:i], lambda g: length(g))) + CASE WHEN i > 1 THEN list_sum(list_transform(ms[1:i - 1], lambda g: length(g))) ELSE 0 END AS b FROM e),
v AS (SELECT doc_id, k, kind, CAST(b AS BIGINT) AS b, CAST(b + length(x) AS BIGINT) AS z FROM s WHERE CASE k {valid} END)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || b || ':' || z, ',' ORDER BY b, k), '')) AS base_sha256
FROM d LEFT JOIN v ON d.doc_id = v.doc_id GROUP BY d.doc_id
"""
