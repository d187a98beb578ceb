"""DuckDB SQL for the queries that SQL can express."""

from tracelake.llm.sharding import DROPPED, HIGH, MULTIPLIER


def _jump(shards: int) -> str:
    """The jump hash of ``doc_id`` as a fold over at most ``shards`` steps."""
    step = f"(s.key * {MULTIPLIER}::hugeint + 1) % 18446744073709551616::hugeint"
    return f"""list_reduce(
        list_transform(range({shards} + 1), lambda i: {{'key': ((doc_id::hugeint + 18446744073709551616::hugeint) % 18446744073709551616::hugeint), 'at': -1::bigint, 'next': 0::bigint}}),
        lambda s, x: CASE WHEN s.next < {shards} THEN {{
            'key': {step},
            'at': s.next,
            'next': floor((s.next + 1)::double * ({HIGH}.0::double / ((({step}) // {DROPPED}::hugeint)::double + 1.0)))::bigint
        }} ELSE s END).at::int"""


def _crc_entry(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ 3988292384 * (byte & 1)
    return byte


_CRC_TABLE = str([_crc_entry(byte) for byte in range(256)])

SHARDS = f"""
WITH
  content AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes, hex(encode(coalesce(text, ''))) AS digits FROM documents),
  placed AS (
    SELECT doc_id, octet_length(bytes) + 1 AS size,
      xor(list_reduce([4294967295::bigint] || list_transform(range(octet_length(bytes)), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::bigint),
        lambda c, x: xor(c >> 8, ({_CRC_TABLE}::bigint[])[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32,
      {_jump(16)} AS shard, {_jump(17)} AS grown_shard
    FROM content),
  runs AS (SELECT greatest(1, floor(sqrt(count(*)))::bigint) AS n FROM documents)
SELECT doc_id, size::bigint AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY (doc_id % n + n) % n, doc_id) - 1 AS slot, grown_shard
FROM placed, runs
"""

_WORDS = r"[^\x20\x09-\x0D]+"

AUDIT = f"""
WITH
  content AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
  counted AS (
    SELECT *, regexp_extract_all(text, '{_WORDS}') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM content),
  known AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  failed AS (
    SELECT part, coalesce(good, false)::int AS good, coalesce(toxic, false)::int AS toxic,
      list_filter([
        CASE WHEN len(words) < 200 THEN 'A' END,
        CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
        CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' END,
        CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
        CASE WHEN doc_id > first_id THEN 'E' END], lambda f: f IS NOT NULL) AS fails
    FROM counted LEFT JOIN known USING (doc_id)),
  masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
  letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
  orders AS (
    SELECT [a.f, b.f, c.f, d.f, e.f] AS filters FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
  steps AS (
    SELECT part, array_to_string(filters, '') AS filter_order, step, filters[step] AS filter,
      sum(n) FILTER (len(list_intersect(fails, filters[1:step])) = 0) AS kept,
      sum(n) FILTER (list_contains(fails, filters[step]) AND len(list_intersect(fails, filters[1:step - 1])) = 0) AS removed,
      sum(n) FILTER (list_contains(fails, filters[step]) AND len(list_intersect(fails, filters[1:step - 1])) > 0) AS redundant,
      sum(n) FILTER (fails = [filters[step]]) AS unique_fails,
      sum(good) FILTER (list_contains(fails, filters[step]) AND len(list_intersect(fails, filters[1:step - 1])) = 0) AS good_lost,
      sum(toxic) FILTER (list_contains(fails, filters[step]) AND len(list_intersect(fails, filters[1:step - 1])) = 0) AS toxic_lost
    FROM masks, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
    GROUP BY part, filters, step)
SELECT part, filter_order, step::int AS step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed,
  coalesce(redundant, 0)::bigint AS redundant, coalesce(unique_fails, 0)::bigint AS unique_fails,
  coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::bigint AS shapley
FROM steps
"""

LINES = """
WITH
  content AS (SELECT doc_id, row_number() OVER () AS nr, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  exploded AS (SELECT doc_id, nr, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM content),
  keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM exploded),
  shared AS (
    SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
  judged AS (
    SELECT keyed.*, shared.key IS NOT NULL AND doc_id IS DISTINCT FROM largest AS dropped FROM keyed LEFT JOIN shared USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY nr
"""

_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

INFILL = f"""
WITH
  content AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::varchar, '')) AS digest FROM documents),
  counted AS (
    SELECT *, regexp_extract_all(text, '{_UNIT}') AS units,
      list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(digest, i, 8))::bigint) AS h
    FROM content),
  cut AS (
    SELECT *, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
        WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM counted),
  parts AS (
    SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
      coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
    FROM cut)
SELECT doc_id, len(units)::bigint AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::bigint AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::bigint AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

ORACLE = {
    "op8_jump_shards": SHARDS,
    "op11_filter_audit": AUDIT,
    "op12_line_dedup": LINES,
    "op13_infill": INFILL,
}
