"""Longer check SQL, put together from repeated parts."""

from __future__ import annotations


def clusters(k: int = 40, rounds: int = 5) -> str:
    """Every round as a table of assignments and one of centroids, in whole numbers."""
    fine = "embedding IS NOT NULL AND len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64"
    steps = [f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {fine})",
             f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS cluster, v AS c FROM kept
QUALIFY row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) <= {k})"""]
    far = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, CAST(min(d) AS BIGINT) AS distance, arg_min(cluster, d * {k} + cluster) AS cluster
FROM (SELECT vec_id, v, cluster, {far} AS d FROM kept, c{i}) GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT cluster, list(q ORDER BY d) AS c FROM (SELECT cluster, d, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q
FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS d FROM a{i}) GROUP BY cluster, d) GROUP BY cluster)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""


def conversations() -> str:
    """The cheapest edits from the last row to the first: for each role left before a row, (cost, letters, turns) of the best rest."""
    due = {1: 3, 2: 3, 3: 4, 4: 3}  # states: nothing, system, user, assistant was left last
    role = {3: "user", 4: "assistant"}
    keeps = {(1, "s"): 2, (1, "u"): 3, (2, "u"): 3, (3, "a"): 4, (4, "u"): 3}

    def with_edit(of: str, cost: str, letter: str, line: str = "''") -> str:
        return f"{{'c': {of}.c + {cost}, 'a': '{letter}' || {of}.a, 'r': {line} || {of}.r}}"

    def least(options: list[str]) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def inserted(s: int) -> str:
        once = with_edit(f"b{due[s]}", "5", "I", f"'{role[due[s]]}:' || chr(10)")
        then = due[due[s]]
        twice = with_edit(f"b{then}", "10", "II", f"'{role[due[s]]}:' || chr(10) || '{role[then]}:' || chr(10)")
        return f"{least([f'b{s}', once, twice])} AS s{s}"

    def edited(s: int) -> str:
        line = "role || ':' || text || chr(10)"
        options = [with_edit(f"s{s}", "2", "D")]
        never = "{'c': 1000000000, 'a': '', 'r': ''}"
        stays = "fault NOT IN ('blank', 'duplicate')"
        late = "(CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END)"
        for (state, first), to in keeps.items():
            if state == s:
                options.append(f"CASE WHEN {stays} AND first = '{first}' THEN {with_edit(f's{to}', late, 'K', line)} ELSE {never} END")
        new = f"'{role[due[s]]}:' || text || chr(10)"
        options.append(f"CASE WHEN {stays} THEN {with_edit(f's{due[s]}', f'1 + {late}', 'R', new)} ELSE {never} END")
        return f"{least(options)} AS b{s}"

    end = ", ".join(f"{{'c': {0 if s in (1, 4) else 1000000000}, 'a': '', 'r': ''}} AS b{s}" for s in range(1, 5))
    closed = ", ".join(inserted(s) for s in range(1, 5))
    open_ = ", ".join(edited(s) for s in range(1, 5))
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
drawn AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::UBIGINT)),
lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 20 AS kind FROM given),
worn AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again
FROM drawn WHERE kind <> 0),
ranked AS (SELECT *, left(role, 1) AS first, rtrim(text, {white}) AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM worn),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS met FROM ranked),
faulty AS (SELECT *, first || lead(first) OVER (PARTITION BY conv_id ORDER BY i) AS pair,
CASE WHEN bare = '' THEN 'blank' WHEN met > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
FROM faulty GROUP BY conv_id),
walk AS (SELECT conv_id, n + 1 AS i, {closed} FROM (SELECT conv_id, n, {end} FROM counts)
UNION ALL SELECT conv_id, i, {closed} FROM (SELECT w.conv_id, f.i, {open_} FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i - 1))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
CAST(coalesce(w.s1.c, 0) AS BIGINT) AS cost, coalesce(w.s1.a, '') AS audit, sha256(coalesce(left(w.s1.r, length(w.s1.r) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.i = 1"""
