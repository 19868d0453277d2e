"""The repair of conversations in DuckDB: a turn at a time, with the cheapest edits that lead to each grammar state."""

from __future__ import annotations


def _edit(x: str, cost: str, letter: str, line: str | None = None) -> str:
    body = f"list_append({x}.b, {line})" if line else f"{x}.b"
    return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'b': {body}}} END"


def _least(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"


def repair_sql() -> str:
    user, answer, own = "'user:' || text", "'assistant:' || text", "role || ':' || text"
    two = _least("x2", *(_edit(x, "2", "I", "'user:'") for x in ("x0", "x1", "x3")))
    three = _least("x3", _edit("x2", "2", "I", "'assistant:'"), _edit("y2", "2", "I", "'assistant:'"))
    keep = lambda x, initial: f"CASE WHEN NOT must AND initial = '{initial}' THEN {_edit(x, 'cut', 'K', own)} END"
    rename = lambda x, line: f"CASE WHEN NOT must THEN {_edit(x, '2 + cut', 'R', line)} END"
    drop = lambda x: _edit(x, "3", "D")
    z1 = _least(drop("x1"), keep("x0", "s"))
    z2 = _least(drop("y2"), *(f(x) for x in ("x0", "x1", "y3") for f in (lambda x: keep(x, "u"), lambda x: rename(x, user))))
    z3 = _least(drop("y3"), keep("y2", "a"), rename("y2", answer))
    after_system = f"({_edit('x1', '2', 'I', "'user:'")})"
    state = "STRUCT(c BIGINT, a VARCHAR, b VARCHAR[])"
    return f"""
    WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS tab FROM (
        SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
    keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    hashed AS (SELECT keyed.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(crc.tab[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS what FROM keyed, crc),
    damaged AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM hashed, LATERAL (SELECT unnest(range(CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) AS u(i)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, substr(role, 1, 1) AS initial FROM damaged),
    faults AS MATERIALIZED (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
        NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
    ids AS (SELECT DISTINCT conv_id FROM conversations),
    facts AS (SELECT ids.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
        count(*) FILTER (NOT blank AND NOT again AND open) AS truncated, count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(n) AS n
        FROM ids LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY 1),
    steps AS (
        SELECT conv_id, 0::BIGINT AS n, {{'c': 0, 'a': '', 'b': []::VARCHAR[]}}::{state} AS x0, NULL::{state} AS x1, NULL::{state} AS x2, NULL::{state} AS x3 FROM ids
        UNION ALL
        SELECT conv_id, n, {drop("x0")}, {z1}, {z2}, {z3} FROM (
            SELECT *, {three} AS y3 FROM (
                SELECT s.conv_id, f.n, s.x0, s.x1, s.x2, s.x3, {two} AS y2, f.role, f.text, f.initial, f.blank OR f.again AS must, f.open::INT AS cut
                FROM steps AS s JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n = s.n + 1))),
    ended AS (SELECT conv_id, {_least("x0", "x3", _edit("x2", "2", "I", "'assistant:'"), _edit(after_system, "2", "I", "'assistant:'"))} AS best, n FROM steps)
    SELECT f.conv_id, f.gaps, f.blank, f.duplicate, f.truncated, f.illegal, e.best.c AS cost, e.best.a AS audit, sha256(array_to_string(e.best.b, chr(10))) AS repaired_sha256
    FROM facts AS f JOIN ended AS e ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.n = f.n
    """


REPAIR_SQL = repair_sql()
