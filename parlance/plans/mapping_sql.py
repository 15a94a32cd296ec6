"""SQL of the mapping of speakers, with the tie rule of ``scoring.assignment``: one recursion step is one
column looked at, or one pair changed, of shortest augmenting paths. Ties of ``free`` columns
go to the first one that is open, or else to the last."""

# names of a meeting's two sides in order; rows are the smaller side; g: shared time of row and column
_GAINS = """names2 AS (
    SELECT meeting_id, coalesce(list_sort(list_distinct(list(label) FILTER (side = 'R'))), []) AS refs, coalesce(list_sort(list_distinct(list(label) FILTER (side = 'H'))), []) AS hyps FROM tracks GROUP BY 1
), sides AS (
    SELECT meeting_id, len(hyps) > len(refs) AS turned, CASE WHEN len(hyps) > len(refs) THEN refs ELSE hyps END AS a, CASE WHEN len(hyps) > len(refs) THEN hyps ELSE refs END AS b
    FROM names2 WHERE len(refs) > 0 AND len(hyps) > 0
), places AS (
    SELECT x.*, unnest(range(1, len(b) + 1)) AS c FROM (SELECT sides.*, unnest(range(1, len(a) + 1)) AS r FROM sides) x
), gained AS (
    SELECT p.meeting_id, r, list(coalesce(d, 0)::DOUBLE ORDER BY c) AS g FROM places p
    LEFT JOIN shared s ON s.meeting_id = p.meeting_id AND s.ref = CASE WHEN turned THEN a[r] ELSE b[c] END AND s.hyp = CASE WHEN turned THEN b[c] ELSE a[r] END GROUP BY 1, 2
), gains2 AS (SELECT meeting_id, list(g ORDER BY r) AS g, len(any_value(g)) AS m, count(*) AS n FROM gained GROUP BY 1)"""


def _each(what: str, first: int = 0, end: str = "m + 1") -> str:
    return f"list_transform(range({first}, {end}), lambda c: {what})"


_NONE = f"{_each('false')} AS used, {_each(chr(39) + 'infinity' + chr(39) + '::DOUBLE')} AS least"

# owner[c + 1]: the row of column c, 0 is the root; u, v: potentials of rows and columns
_WALK = f"""walk AS (
    SELECT meeting_id, g, n, m, 1::BIGINT AS i, 0::BIGINT AS j, {_each("0::DOUBLE", 0, "n + 1")} AS u, {_each("0::DOUBLE")} AS v,
           {_each("CASE WHEN c = 0 THEN 1 ELSE 0 END::BIGINT")} AS owner, {_each("0::BIGINT")} AS way, {_NONE}, false AS back FROM gains2
    UNION ALL (
    SELECT meeting_id, g, n, m, i, nearest, {_each("u[c + 1] + CASE WHEN list_contains(mine, c) THEN delta ELSE 0 END", 0, "n + 1")},
           {_each("v[c + 1] - CASE WHEN used[c + 1] THEN delta ELSE 0 END")}, owner, way, used,
           {_each("least[c + 1] - CASE WHEN used[c + 1] THEN 0 ELSE delta END")}, owner[nearest + 1] = 0
    FROM (SELECT *, coalesce(list_filter(ties, lambda c: owner[c + 1] = 0)[1], ties[-1]) AS nearest FROM (
        SELECT *, list_filter(free, lambda c: least[c + 1] = delta) AS ties FROM (
            SELECT *, list_min(list_transform(free, lambda c: least[c + 1])) AS delta FROM (
                SELECT * EXCLUDE (better, least, way), {_each("CASE WHEN list_contains(better, c) THEN spare[c] ELSE least[c + 1] END")} AS least,
                       {_each("CASE WHEN list_contains(better, c) THEN j ELSE way[c + 1] END")} AS way FROM (
                    SELECT *, list_filter(free, lambda c: spare[c] < least[c + 1]) AS better FROM (
                        SELECT *, list_filter(range(1, m + 1), lambda c: NOT used[c + 1]) AS free, list_transform(list_filter(range(0, m + 1), lambda c: used[c + 1]), lambda c: owner[c + 1]) AS mine FROM (
                            SELECT * EXCLUDE (used), {_each("used[c + 1] OR c = j")} AS used, {_each("-g[owner[j + 1]][c] - u[owner[j + 1] + 1] - v[c + 1]", 1)} AS spare FROM walk WHERE NOT back AND i <= n)))))))
    UNION ALL
    SELECT meeting_id, g, n, m, i + done, next, u, v, {_each("CASE WHEN c = j THEN owner[next + 1] WHEN c = 0 AND done = 1 THEN i + 1 ELSE owner[c + 1] END")}, way,
           {_each("used[c + 1] AND done = 0")}, {_each("CASE WHEN done = 1 THEN 'infinity'::DOUBLE ELSE least[c + 1] END")}, done = 0
    FROM (SELECT *, way[j + 1] AS next, CASE WHEN way[j + 1] = 0 THEN 1 ELSE 0 END AS done FROM walk WHERE back))
)"""

#: After ``tracks`` and ``shared`` (meeting_id, ref, hyp, d): mapping (meeting_id, ref, hyp, d) of the pairs with shared time.
MAPPING_SQL = f"""{_GAINS}, {_WALK}, pairs2 AS (
    SELECT meeting_id, unnest(range(1, m + 1)) AS c, unnest(owner[2:]) AS r FROM walk WHERE i > n
), mapping AS (
    SELECT s.meeting_id, s.ref, s.hyp, s.d FROM pairs2 p JOIN sides USING (meeting_id)
    JOIN shared s ON s.meeting_id = p.meeting_id AND s.ref = CASE WHEN turned THEN a[r] ELSE b[c] END AND s.hyp = CASE WHEN turned THEN b[c] ELSE a[r] END WHERE r > 0 AND s.d > 0
)"""
