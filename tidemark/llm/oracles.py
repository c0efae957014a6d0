"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"

OP1 = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), heavy AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.keeper AS dropped FROM keyed k LEFT JOIN heavy h ON k.key = h.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


#: Kind, pattern, group that is judged and its least length: the three base kinds as the contract words them, then public token formats.
_SECRETS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"[A-Za-z0-9_-]*?eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
    ("forge", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
)


def _op2() -> str:
    parts = []
    for i, (kind, pattern, group, least) in enumerate(_SECRETS):
        p = pattern.replace("'", "''")
        judged = f"regexp_extract(m, '{p}', {group})" if group else "m"
        parts.append(f"""
  SELECT doc_id, {i} AS rank, '{kind}' AS kind, start, start + length(m) AS stop FROM (
    SELECT doc_id, m, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY pos) - length(m) AS BIGINT) AS start FROM (
      SELECT doc_id, generate_subscripts(ms, 1) AS pos, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap FROM (
        SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS ms, string_split_regex(text, '{p}') AS gaps FROM documents WHERE text IS NOT NULL) WHERE len(ms) > 0))
  WHERE length({judged}) >= {least}""")
    listed = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE {where}), '')"
    return f"""
WITH spans AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, CAST(count(*) FILTER (WHERE kind = 'assign') AS BIGINT) AS n_assign, CAST(count(*) FILTER (WHERE kind = 'access') AS BIGINT) AS n_access,
       CAST(count(*) FILTER (WHERE kind = 'hex') AS BIGINT) AS n_hex, sha256({listed("rank <= 2")}) AS base_sha256, {listed("rank >= 0")} AS spans
FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""


OP2 = _op2()

#: The targets of the sources and, for each document, the words that begin before its source's target.
MIX = rf"""
sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {_WORDS})), 0) AS BIGINT) AS size,
         coalesce(md5(CAST(doc_id AS VARCHAR)), md5(coalesce(text, ''))) AS key FROM DOCS
), ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank, count(*) OVER () AS sources FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST([5, 2, 1][CAST(rank % 3 + 1 AS INT)] AS BIGINT) AS weight FROM ranked
), cut AS (
  SELECT *, coalesce(sum(source_size) OVER before, 0) AS capped, coalesce(sum(weight) OVER before, 0) AS used, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lev AS (
  SELECT CAST(all_size * 3 - capped * 4 AS BIGINT) AS num, CAST((all_weight - used) * 2 AS BIGINT) AS den
  FROM cut WHERE (all_size * 3 - capped * 4) * weight <= source_size * 2 * (all_weight - used) * 2 ORDER BY source_size / weight, rank LIMIT 1
), plan AS (
  SELECT source, source_size, CASE WHEN sources > 1 THEN CAST(rank AS DOUBLE) / CAST(sources - 1 AS DOUBLE) - 0.5::DOUBLE ELSE 0::DOUBLE END AS slope,
         least(CAST(source_size * 2 AS DOUBLE), CAST(l.num * weight AS DOUBLE) / CAST(l.den AS DOUBLE)) AS target
  FROM cut LEFT JOIN lev l ON true
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS begins FROM sized
), mixed AS (
  SELECT p.doc_id, p.source, p.size, q.source_size, q.target, q.slope, p.begins,
         CASE WHEN begins < target THEN 1 ELSE 0 END + CASE WHEN begins + q.source_size < target THEN 1 ELSE 0 END AS copies,
         CAST(p.begins AS DOUBLE) / q.target AS demand
  FROM placed p JOIN plan q ON p.source IS NOT DISTINCT FROM q.source
)
"""

OP9 = f"""
WITH {MIX.replace("DOCS", "documents")}
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
       CASE WHEN copies > 0 THEN CASE WHEN abs(slope) < 1e-12 THEN demand ELSE 2 * demand / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * demand)) END END AS first_position
FROM mixed
"""

OP4 = """
WITH vectors AS (
  SELECT vec_id, max(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 GROUP BY vec_id
), whole AS (
  SELECT vec_id, list_transform(x, lambda v: floor(256 * v)) AS x FROM vectors
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

OP10 = """
WITH own AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, sha256(coalesce(html, '')) AS same FROM pages
), tops AS (
  SELECT *, max(page_id) OVER (PARTITION BY same) AS top FROM own
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM tops
"""


def _op11(k: int = 40, rounds: int = 5) -> str:
    """All rounds, one after another; whole numbers are doubles below 2^53, so that products and sums are exact."""
    parts = ["""
kept AS MATERIALIZED (
  SELECT vec_id, x, list_dot_product(x, x) AS xx FROM (
    SELECT vec_id, list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)
)""", f"""
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS c, x, xx FROM kept ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) LIMIT {k}
)"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT v.vec_id, v.x, n.c, v.xx - 2 * list_dot_product(v.x, n.x) + n.xx AS d FROM kept v, c{i} n QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY d, n.c) = 1
)""")
        if i < rounds:
            parts.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c, x, list_dot_product(x, x) AS xx FROM (
    SELECT o.c, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN (
      SELECT c, list(floor(s / n) ORDER BY pos) AS x FROM (SELECT c, pos, sum(e) AS s, count(*) AS n FROM (SELECT c, generate_subscripts(x, 1) AS pos, unnest(x) AS e FROM a{i}) GROUP BY c, pos) GROUP BY c) m ON o.c = m.c)
)""")
    return f"""
WITH {",".join(parts)}
SELECT a.vec_id, CAST(a.c AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(list_aggregate(list_transform(n.x, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} n ON a.c = n.c
"""


def _straw(name: str, weight: str) -> str:
    return f"-ln((CAST('0x' || substr(md5(key || '/' || {name}), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / {weight}::DOUBLE"


#: Four regions of two racks of five shards, each of weight 1. CRC-32 by its table of 256 remainders.
OP12 = f"""
WITH remainders AS (
  SELECT list(list_reduce(range(0, 8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS tab FROM range(0, 256) r(i)
), own AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS text_crc32
  FROM documents, remainders
), regions AS (
  SELECT *, {_straw("'region' || region", "10")} AS straw FROM own, (SELECT CAST(unnest(range(0, 4)) AS INT) AS region) QUALIFY row_number() OVER (PARTITION BY id ORDER BY straw, region) = 1
), racks AS (
  SELECT *, {_straw("'region' || region || '/' || rack", "5")} AS rack_straw FROM regions, (SELECT CAST(unnest(range(0, 2)) AS INT) AS rack) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rack_straw, rack) = 1
), shards AS (
  SELECT *, CAST(region * 10 + rack * 5 + leaf AS INT) AS shard FROM racks, (SELECT CAST(unnest(range(0, 5)) AS INT) AS leaf)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_straw("'region' || region || '/rack' || rack || '/' || (region * 10 + rack * 5 + leaf)", "1")}, leaf) = 1
)
SELECT doc_id, size, text_crc32, 'key' AS law, region, rack, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot,
       CASE WHEN {_straw("'shard40'", "1")} < straw THEN 40 ELSE shard END AS grown_shard
FROM shards
"""

ORACLES = {"op1_line_dedup": OP1, "op2_secret_scan": OP2, "op4_exact_top_k": OP4, "op9_source_mix": OP9, "op10_warc": OP10, "op11_drake_clusters": _op11(), "op12_hash_tree": OP12}
