"""DuckDB SQL of the queries of this subpackage whose SQL is built from parameters."""

from __future__ import annotations

from wordmine.llm import urlfilter


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit: a character comes in, then eight shifts."""
    bits = ", ".join(["-1::BIGINT"] * 8)
    ops = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii(substr({text}, i, 1))::BIGINT, {bits}]))"
    step = "CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {ops}), lambda a, b: {step}), 4294967295)"


PREFIX_TRIE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list([role, text] ORDER BY turn NULLS FIRST,
        sha256(length(role)::VARCHAR || ':' || role || text)) AS turns FROM t GROUP BY conv_id),
h AS (SELECT *, CAST({_crc32('conv_id::VARCHAR')} % 6 AS BIGINT) AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), coalesce(h.turns[h.h + 1:], [])) AS seq
      FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, seq[1:d] AS node, len(seq) = d AS ends
      FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM r)),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
        coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends,
        CASE WHEN d > 0 THEN (count(*) - 1) * length(node[d][2]) ELSE 0 END AS own,
        CASE WHEN d > 0 THEN node[1:d - 1] END AS parent
      FROM p GROUP BY node, d),
c AS (SELECT parent, count(*) AS k FROM n WHERE d > 0 GROUP BY parent),
k AS (SELECT n.*, coalesce(c.k, 0) AS n_children FROM n LEFT JOIN c ON c.parent = n.node),
s AS (SELECT a.node, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum(b.own) AS saved
      FROM k a JOIN k b ON b.d >= a.d AND b.node[1:a.d] = a.node GROUP BY a.node)
SELECT k.conv_id, k.d::BIGINT AS depth, u.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN s ON s.node = k.node LEFT JOIN n u ON u.node = k.parent"""


def _host_path(source: str, keep: str) -> str:
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    return f"""SELECT {keep}, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT *, {rest} AS rest FROM (SELECT * REPLACE (coalesce(url, '') AS url) FROM {source}))"""


def _buckets() -> str:
    """A row for each n-gram of a host and path, with its bucket."""
    def grams(column: str, sizes: tuple[int, ...], mark: str) -> list[str]:
        v = f"('^' || translate({column}, '123456789', '000000000') || '$')"
        return [f"CASE WHEN {column} = '' THEN [] ELSE list_transform(range(1, greatest(length({v}) - {n - 1}, 1) + 1), "
                f"lambda i: '{mark}{n}' || substr({v}, i, {n})) END" for n in sizes]
    lists = grams("host", urlfilter.HOST_GRAMS, "h") + grams("path", urlfilter.PATH_GRAMS, "p")
    digits = " + ".join(f"{16 ** (3 - i)} * (strpos('0123456789abcdef', substr(md5(g), {i + 1}, 1)) - 1)" for i in range(4))
    return f"SELECT id, ({digits}) % {urlfilter.N_BUCKETS} AS b FROM (SELECT id, unnest(flatten([{', '.join(lists)}])) AS g FROM {{}})"


def url_filter(rules: list[tuple[str, str, str]], labelled: list[tuple[str, int]]) -> str:
    table = ", ".join(f"({i}, {q(u)}, {y})" for i, (u, y) in enumerate(labelled))
    ruled = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = {q(h)} OR ends_with(host, {q('.' + h)})) AND starts_with(path, {q(p)}))" for _, h, p in ruled]
    rule = " ".join(f"WHEN {f} THEN {q(h + p)}" for f, (_, h, p) in zip(fits, ruled, strict=True))
    verdict = " ".join(f"WHEN {f} THEN {q(v)}" for f, (v, _, _) in zip(fits, ruled, strict=True))
    return f"""
WITH RECURSIVE labelled(id, url, y) AS (VALUES {table}),
l AS ({_host_path('labelled', 'id, y')}),
c AS (SELECT id, b, count(*) AS n FROM ({_buckets().format('l')}) GROUP BY id, b),
f AS (SELECT id, b, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS v FROM c UNION ALL SELECT id, -1, 1.0 FROM l),
s(step, b, w, m) AS (
  SELECT 0, b, 0.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT b FROM f)
  UNION ALL
  SELECT step + 1, b, w - {urlfilter.RATE} * next, next FROM (
    SELECT s.step, s.b, s.w, {urlfilter.MOMENTUM} * s.m + {urlfilter.DECAY} * s.w + g.g AS next
    FROM s JOIN (
      SELECT f.b, sum(e.e * f.v) AS g FROM f JOIN (
        SELECT f.id, 1 / (1 + exp(-sum(f.v * s.w))) - min(l.y) AS e FROM s JOIN f ON f.b = s.b JOIN l ON l.id = f.id GROUP BY f.id) e ON e.id = f.id
      GROUP BY f.b) g ON g.b = s.b)
  WHERE step < {urlfilter.STEPS}),
w AS (SELECT b, w FROM s WHERE step = {urlfilter.STEPS}),
p AS ({_host_path('pages', 'page_id, row_number() OVER () AS id')}),
pc AS (SELECT id, b, count(*) AS n FROM ({_buckets().format('p')}) GROUP BY id, b),
z AS (SELECT pc.id, sum(pc.n * coalesce(w.w, 0)) / sqrt(sum(pc.n * pc.n)) AS z FROM pc LEFT JOIN w ON w.b = pc.b GROUP BY pc.id)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN coalesce(z.z, 0) + (SELECT w FROM w WHERE b = -1) >= 0 THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN z ON z.id = p.id"""
