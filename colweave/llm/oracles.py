"""SQL (DuckDB) that gives the rows of those registered queries that it can express."""

from __future__ import annotations


def centroid_clustering(clusters: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """Rounds of assignment and floored means over whole-number vectors, one CTE for each step."""
    steps = [
        f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
), cells AS MATERIALIZED (
  SELECT r, i, v[i] AS x FROM kept, range(1, {size} + 1) t(i)
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS k, v
  FROM (SELECT vec_id, v FROM kept ORDER BY sha256('{seed}:' || vec_id), v LIMIT {clusters})
)"""
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (
  SELECT r, arg_min(k, d * 100 + k) AS k, min(d) AS d
  FROM (SELECT kept.r, c.k, list_sum(list_transform(range(1, {size} + 1), lambda i: (kept.v[i] - c.v[i]) * (kept.v[i] - c.v[i])))::BIGINT AS d FROM kept, c{n} c)
  GROUP BY r
)"""
        )
        if n < rounds:
            steps.append(
                f"""c{n + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.v, c.v) AS v
  FROM c{n} c LEFT JOIN (
    SELECT k, list(m ORDER BY i) AS v FROM (
      SELECT k, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m
      FROM (SELECT a.k, cells.i, sum(cells.x) AS s, count(*) AS n FROM a{n} a JOIN cells USING (r) GROUP BY a.k, cells.i)
    ) GROUP BY k
  ) m ON m.k = c.k
)"""
            )
    return (
        "WITH "
        + ", ".join(steps)
        + f"""
SELECT kept.vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (r) JOIN c{rounds} c ON c.k = a.k"""
    )


#: Grammar: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_MADE = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def conversation_repair() -> str:
    """The dynamic programme as a recursive query: a row of conversation and position holds the best repair of each state.

    A state is (cost, edits, text) or null; structs compare field by field, so the least one is the wanted one. Texts of
    equal cost and edits are equal.
    """

    def inserted(state: int, count: int) -> tuple[int, str]:
        text = ""
        for _ in range(count):
            text += ("" if state == 0 else "\\n") + f"{_MADE[state][0]}:"
            state = _MADE[state][1]
        return state, text

    def struct(before: int, count: int, cost: str, edit: str, text: str) -> str:
        return (
            f"CASE WHEN p.s{before} IS NOT NULL THEN {{'cost': p.s{before}.cost + {3 * count} + {cost}, "
            f"'edits': p.s{before}.edits || '{'I' * count + edit}', 'text': p.s{before}.text || {text}}} END"
        )

    options: dict[int, list[str]] = {s: [] for s in range(4)}
    for before in range(4):
        for count in range(3):
            state, added = inserted(before, count)
            quoted = "'" + added.replace("\\n", "' || chr(10) || '") + "'"
            options[state].append(struct(before, count, "4", "D", quoted))
            line = quoted + (" || chr(10) || " if state else " || ")
            for initial, after in _NEXT[state].items():
                kept = struct(before, count, "r.extra", "K", line + "r.role || ':' || r.text")
                options[after].append(f"CASE WHEN r.extra IS NOT NULL AND left(r.role, 1) = '{initial}' THEN {kept} END")
            name, after = _MADE[state]
            options[after].append(f"CASE WHEN r.extra IS NOT NULL THEN {struct(before, count, '3 + r.extra', 'R', line + f"'{name}:' || r.text")} END")
    least = ",\n    ".join(f"list_sort(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))[1] AS s{s}" for s, found in options.items())
    ends = []
    for before in range(4):
        for count in range(3):
            state, added = inserted(before, count)
            if state in (0, 3):
                quoted = "'" + added.replace("\\n", "' || chr(10) || '") + "'"
                ends.append(struct(before, count, "0", "", quoted))
    blank = "'[^ \\t\\n\\x0b\\x0c\\r]'"
    return f"""
WITH RECURSIVE crc_bytes AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b)) AS t
), shown AS (
  SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key,
    coalesce(role, ' ') AS role, coalesce(text, ' ') AS text
  FROM conversations
), hex AS (
  SELECT shown.*, xor(list_reduce(list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT),
    lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS fate
  FROM shown, crc_bytes
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hex WHERE fate <> 0
), ordered AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS n,
    lag(role) OVER w AS earlier, regexp_extract(text, '([^ \\t\\n\\x0b\\x0c\\r])[ \\t\\n\\x0b\\x0c\\r]*$', 1) AS last
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, {blank}) THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2 WHEN last IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault
  FROM ordered
), rows_of AS MATERIALIZED (
  SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 3 END AS extra FROM faults
), best AS (
  SELECT conv_id, 0::BIGINT AS n, {{'cost': 0, 'edits': '', 'text': ''}} AS s0, NULL::STRUCT(cost INTEGER, edits VARCHAR, text VARCHAR) AS s1,
    NULL::STRUCT(cost INTEGER, edits VARCHAR, text VARCHAR) AS s2, NULL::STRUCT(cost INTEGER, edits VARCHAR, text VARCHAR) AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT p.conv_id, r.n, {least}
  FROM best p JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.n + 1
), done AS (
  SELECT conv_id, list_sort(list_filter([{', '.join(ends)}], lambda x: x IS NOT NULL))[1] AS e
  FROM (SELECT * FROM best QUALIFY n = max(n) OVER (PARTITION BY conv_id)) p
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND left(earlier, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, d.e.cost::BIGINT AS cost, d.e.edits AS audit, sha256(d.e.text) AS repaired_sha256
FROM done d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id"""
