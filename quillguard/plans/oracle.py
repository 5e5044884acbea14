"""SQL counterparts of detector stages, for engines with RE2: an independent check of the kernel."""

from __future__ import annotations

from ..functions.patterns import Detector


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def luhn(x: str) -> str:
    d = f"string_split(reverse(regexp_replace({x}, '[^0-9]', '', 'g')), '')"
    return f"(list_sum(list_transform({d}, lambda c, i: CASE WHEN i % 2 = 0 THEN (2 * CAST(c AS INT)) // 10 + (2 * CAST(c AS INT)) % 10 ELSE CAST(c AS INT) END)) % 10 = 0)"


def valid(name: str | None, x: str) -> str:
    if name == "card":
        return f"(len(regexp_replace({x}, '[^0-9]', '', 'g')) >= 13 AND {luhn(x)})"
    if name == "amka":
        return f"(CAST({x}[1:2] AS INT) BETWEEN 1 AND 31 AND CAST({x}[3:4] AS INT) BETWEEN 1 AND 12 AND {luhn(x)})"
    if name == "afm":
        total = " + ".join(f"CAST({x}[{i + 1}] AS INT) * {1 << (8 - i)}" for i in range(8))
        return f"({x} <> '000000000' AND ({total}) % 11 % 10 = CAST({x}[9] AS INT))"
    return "true"


def chain(source: str, keys: list[str], column: str, pack: list[Detector]) -> str:
    """CTEs ``s0 .. sN``; sN has the keys, t (the text after all stages) and k_<KIND> (values replaced by
    kind, in stage order). ``source`` is a table or a parenthesised query."""
    kinds = list(dict.fromkeys(d.kind for d in pack))
    cols = ", ".join(keys)
    ctes = [f"s0 AS MATERIALIZED (SELECT {cols}, {column} AS t, " + ", ".join(f"CAST([] AS VARCHAR[]) AS k_{k}" for k in kinds) + f" FROM {source})"]
    for i, d in enumerate(pack, 1):
        p = text(d.pattern)
        ctes.append(f"m{i} AS MATERIALIZED (SELECT *, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {d.group}) AS v, string_split_regex(t, {p}) AS p FROM s{i - 1})")
        ctes.append(f"n{i} AS MATERIALIZED (SELECT *, list_concat(k_{d.kind}, list_filter(v, lambda x: {valid(d.validator, 'x')})) AS w FROM m{i})")
        ctes.append(f"o{i} AS MATERIALIZED (SELECT *, list_filter(w, lambda x, i: list_position(w, x) = i) AS u FROM n{i})")
        piece = f"CASE WHEN i > len(m) THEN '' WHEN {valid(d.validator, 'v[i]')} THEN m[i][1:len(m[i]) - len(v[i])] || '[{d.kind}_' || CAST(list_position(u, v[i]) AS VARCHAR) || ']' ELSE m[i] END"
        rest = ", ".join(f"{'w' if k == d.kind else f'k_{k}'} AS k_{k}" for k in kinds)
        ctes.append(f"s{i} AS MATERIALIZED (SELECT {cols}, CASE WHEN len(m) = 0 THEN t ELSE array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || {piece}), '') END AS t, {rest} FROM o{i})")
    return ",\n".join(ctes)


def digest(pack: list[Detector]) -> str:
    """``kind=n`` of the kinds with values, sorted and comma-joined."""
    kinds = sorted({d.kind for d in pack})
    return "concat_ws(',', " + ", ".join(f"CASE WHEN len(k_{k}) > 0 THEN '{k}=' || CAST(len(k_{k}) AS VARCHAR) END" for k in kinds) + ")"


def redacted(source: str, keys: list[str], column: str, pack: list[Detector], into: str = "redacted") -> str:
    return f"WITH {chain(source, keys, column, pack)} SELECT {', '.join(keys)}, t AS {into}, {digest(pack)} AS counts FROM s{len(pack)}"


def by_kind(source: str, keys: list[str], column: str, pack: list[Detector]) -> str:
    kinds = list(dict.fromkeys(d.kind for d in pack))
    each = " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST(sum(len(k_{k})) AS BIGINT) AS n FROM s{len(pack)}" for k in kinds)
    return f"WITH {chain(source, keys, column, pack)} SELECT kind, n FROM ({each}) WHERE n > 0"
