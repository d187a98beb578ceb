"""SQL for DuckDB that gives the same results as the registered queries, written on its own terms."""

_PACKETS = """
WITH packets AS (
  SELECT 'trace-' || l_returnflag AS trace_file,
         CASE WHEN l_linestatus = 'F' THEN 6 ELSE 4 END AS ip_version,
         l_returnflag AS flag,
         CAST(l_linenumber AS BIGINT) AS header_len,
         CAST(l_quantity AS BIGINT) AS payload_len,
         CASE l_returnflag WHEN 'A' THEN l_suppkey WHEN 'N' THEN l_partkey END AS dst_port,
         l_orderkey, l_suppkey, l_linenumber
  FROM lineitem)
"""

_PORTS = (
    _PACKETS
    + """, ports AS (
  SELECT dst_port, CAST(sum(header_len + payload_len) AS BIGINT) AS bytes, count(*) AS packets
  FROM packets WHERE ip_version = 4 AND dst_port IS NOT NULL GROUP BY dst_port)
"""
)

_MESSAGES = """
WITH m AS (
  SELECT 't' || CAST(user_id % 4 AS VARCHAR) AS scope, event_id AS pos, epoch_us(ts) // 1000 AS ms,
         CASE event_type WHEN 'signup' THEN 'req' WHEN 'purchase' THEN 'rem' WHEN 'view' THEN 'data'
                         WHEN 'click' THEN 'ack' WHEN 'error' THEN 'close' END AS kind,
         'd' || CAST(user_id AS VARCHAR) AS d, 'a' || CAST(user_id AS VARCHAR) AS a,
         CASE WHEN event_type IN ('view', 'error') THEN 'd' || CAST(user_id AS VARCHAR)
              WHEN event_type IN ('click', 'purchase') THEN 'a' || CAST(user_id AS VARCHAR) END AS pipe,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS seq,
         length(props) AS props_len
  FROM events),
calls AS (
  SELECT *, lag(kind) OVER w AS before_kind, lag(pos) OVER w AS req_pos, lag(ms) OVER w AS req_ms
  FROM m WHERE kind IN ('req', 'rem') WINDOW w AS (PARTITION BY scope, a ORDER BY pos)),
h AS (
  SELECT scope, d AS data_pipe, a AS ack_pipe, req_pos, pos AS rem_pos, req_ms, ms AS rem_ms,
         row_number() OVER (PARTITION BY scope, d ORDER BY pos DESC) = 1 AS kept
  FROM calls WHERE kind = 'rem' AND before_kind = 'req'),
flows AS (SELECT * FROM h WHERE kept)
"""

_ROUTED = (
    _MESSAGES
    + """, to_data AS (
  SELECT m.*, h.data_pipe AS flow_d, h.rem_pos AS rem_d, h.kept AS kept_d
  FROM m ASOF LEFT JOIN h ON m.scope = h.scope AND m.pipe = h.data_pipe AND m.pos > h.rem_pos
  WHERE m.kind IN ('data', 'ack', 'close')),
both_sides AS (
  SELECT t.*, h.data_pipe AS flow_a, h.rem_pos AS rem_a, h.kept AS kept_a
  FROM to_data t ASOF LEFT JOIN h ON t.scope = h.scope AND t.pipe = h.ack_pipe AND t.pos > h.rem_pos),
sided AS (
  SELECT *, CASE WHEN kind IN ('data', 'close') AND rem_d IS NOT NULL THEN 'data'
                 WHEN kind IN ('ack', 'close') AND rem_a IS NOT NULL THEN 'ack' END AS side
  FROM both_sides),
assigned AS (
  SELECT s.scope, s.pos, s.kind, s.pipe, s.side, s.ms, s.seq, s.props_len,
         CASE s.side WHEN 'data' THEN flow_d WHEN 'ack' THEN flow_a END AS flow,
         CASE s.side WHEN 'data' THEN rem_d WHEN 'ack' THEN rem_a END AS flow_rem,
         coalesce(CASE s.side WHEN 'data' THEN kept_d WHEN 'ack' THEN kept_a END, false) AS kept,
         CASE WHEN s.side IS NULL THEN f.data_pipe END AS replay
  FROM sided s LEFT JOIN flows f ON s.scope = f.scope AND s.pipe = f.data_pipe AND s.pos < f.rem_pos)
"""
)


def _measured(tag: str, source: str) -> str:
    """Running counts over the applied messages of each flow in ``source``, ordered by ``n``."""
    return f""", {tag}_acks AS (
  SELECT scope, flow, n, what = 'ack' AND lag(what) OVER (PARTITION BY scope, flow, seq ORDER BY n) = 'tx' AS fresh
  FROM {source} WHERE what <> 'none'),
{tag} AS (
  SELECT s.*, coalesce(CAST(f.fresh AS INTEGER), 0) AS fresh,
         sum(CAST(s.what = 'tx' AS INTEGER)) OVER w AS sent_so_far,
         sum(coalesce(CAST(f.fresh AS INTEGER), 0)) OVER w AS acked_so_far,
         greatest(3, coalesce(max(CASE WHEN s.what = 'tx' THEN s.seq + 2 END) OVER w, 3)) AS expected,
         max(CASE WHEN s.side = 'data' THEN s.ms END) OVER w AS latest_ms
  FROM {source} s LEFT JOIN {tag}_acks f USING (scope, flow, n)
  WINDOW w AS (PARTITION BY s.scope, s.flow ORDER BY s.n))
"""


_PERFORMANCE = (
    _ROUTED
    + """, applied AS (
  SELECT scope, data_pipe AS flow, 0 AS phase, req_pos AS pos, 'data' AS side, 'none' AS what, req_ms AS ms,
         NULL AS seq, 0 AS size FROM flows
  UNION ALL
  SELECT scope, data_pipe, 1, rem_pos, 'ack', 'none', rem_ms, NULL, 0 FROM flows
  UNION ALL
  SELECT f.scope, f.data_pipe, 2, x.pos, 'data', CASE x.kind WHEN 'data' THEN 'tx' ELSE 'none' END, x.ms, x.seq,
         CASE x.kind WHEN 'data' THEN x.props_len ELSE 0 END
  FROM flows f JOIN assigned x ON x.scope = f.scope AND x.pipe = f.data_pipe AND x.side IS NULL AND x.pos < f.rem_pos
  UNION ALL
  SELECT f.scope, f.data_pipe, 3, x.pos, 'ack', CASE x.kind WHEN 'ack' THEN 'ack' ELSE 'none' END, x.ms, x.seq, 0
  FROM flows f JOIN assigned x ON x.scope = f.scope AND x.pipe = f.ack_pipe AND x.side IS NULL AND x.pos < f.rem_pos
  UNION ALL
  SELECT scope, flow, 4, pos, side,
         CASE WHEN side = 'data' AND kind = 'data' THEN 'tx' WHEN side = 'ack' AND kind = 'ack' THEN 'ack' ELSE 'none' END,
         ms, seq, CASE kind WHEN 'data' THEN props_len ELSE 0 END
  FROM assigned WHERE kept),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY scope, flow ORDER BY phase, pos) AS n FROM applied)
"""
    + _measured("first_pass", "numbered")
    + """, points AS (
  SELECT scope, flow, min(CASE WHEN sent_so_far >= expected THEN n END) AS data_at,
         min(CASE WHEN acked_so_far >= expected THEN n END) AS ack_at
  FROM first_pass GROUP BY scope, flow),
heard AS (
  SELECT x.* FROM numbered x JOIN points p USING (scope, flow)
  WHERE p.data_at IS NULL OR p.ack_at IS NULL OR x.n <= greatest(p.data_at, p.ack_at)
     OR (x.n - greatest(p.data_at, p.ack_at)) % 2 = 0)
"""
    + _measured("second_pass", "heard")
    + """, last_tx AS (
  SELECT scope, flow, seq, max(n) AS n FROM second_pass WHERE what = 'tx' GROUP BY scope, flow, seq),
segs AS (
  SELECT t.scope, t.flow, t.seq, any_value(x.latest_ms) AS sent_ms, max_by(k.ms, k.n) AS ack_ms
  FROM last_tx t JOIN second_pass x USING (scope, flow, n)
  LEFT JOIN second_pass k ON k.scope = t.scope AND k.flow = t.flow AND k.seq = t.seq AND k.what = 'ack' AND k.n > t.n
  GROUP BY t.scope, t.flow, t.seq),
stats AS (
  SELECT scope, flow, any_value(f.ack_pipe) AS ack_pipe, any_value(f.req_ms) AS req_ms, any_value(f.rem_ms) AS rem_ms,
         CAST(sum(CAST(what = 'tx' AS INTEGER)) AS BIGINT) AS blocks, CAST(sum(fresh) AS BIGINT) AS acks,
         CAST(max(expected) AS BIGINT) AS expected,
         min(CASE WHEN side = 'data' THEN ms END) AS start_ms, max(CASE WHEN side = 'data' THEN ms END) AS end_ms,
         CAST(sum(size) AS BIGINT) AS payload_bytes,
         any_value(p.data_at) IS NOT NULL AS data_complete, any_value(p.ack_at) IS NOT NULL AS ack_complete
  FROM second_pass JOIN points p USING (scope, flow) JOIN (SELECT scope, data_pipe AS flow, ack_pipe, req_ms, rem_ms FROM flows) f USING (scope, flow)
  GROUP BY scope, flow),
metrics AS (
  SELECT 'req' AS metric, req_ms // 1000 AS sec, count(*) AS value FROM flows GROUP BY 2
  UNION ALL SELECT 'rem', rem_ms // 1000, count(*) FROM flows GROUP BY 2
  UNION ALL SELECT 'arv', sent_ms // 1000, count(*) FROM segs GROUP BY 2
  UNION ALL SELECT 'rtt', ack_ms // 1000, ack_ms - sent_ms FROM segs WHERE ack_ms IS NOT NULL)
"""
)

_USER_SEGMENTS = (
    _MESSAGES
    + """, tx AS (
  SELECT a AS flow, pos, seq, max(ms) OVER (PARTITION BY a ORDER BY pos) AS sent_ms FROM m WHERE kind = 'data'),
newest AS (SELECT flow, seq, max(pos) AS pos, max_by(sent_ms, pos) AS sent_ms FROM tx GROUP BY flow, seq),
user_segs AS (
  SELECT n.flow, n.seq, any_value(n.sent_ms) AS sent_ms, max_by(k.ms, k.pos) AS ack_ms
  FROM newest n LEFT JOIN m k ON k.kind = 'ack' AND k.a = n.flow AND k.seq = n.seq AND k.pos > n.pos
  GROUP BY n.flow, n.seq),
samples AS (SELECT ack_ms // 1000 AS sec, ack_ms - sent_ms AS rtt_ms FROM user_segs WHERE ack_ms IS NOT NULL)
"""
)

_CAPTURED = """
WITH packets AS (
  SELECT l_returnflag AS flag, l_linestatus <> 'F' AS v4, CAST(l_quantity AS BIGINT) AS qty,
         CASE l_returnflag WHEN 'A' THEN l_suppkey % 65536 WHEN 'N' THEN l_partkey % 65536 END AS dst_port,
         CASE l_returnflag WHEN 'A' THEN 20 ELSE 8 END AS l4_header
  FROM lineitem)
"""

ORACLE = {
    "pcap_ingest": """
WITH p AS (
  SELECT l_returnflag AS flag, l_linestatus <> 'F' AS v4, CAST(l_quantity AS BIGINT) AS qty,
         CASE l_returnflag WHEN 'A' THEN 20 ELSE 8 END AS l4_header, l_orderkey, l_partkey, l_suppkey, l_linenumber
  FROM lineitem)
SELECT CASE WHEN v4 THEN 4 ELSE 6 END AS ip_version,
       CASE WHEN v4 THEN ((l_orderkey >> 24) & 255) || '.' || ((l_orderkey >> 16) & 255) || '.'
                         || ((l_orderkey >> 8) & 255) || '.' || (l_orderkey & 255) END AS ip_src,
       CASE WHEN v4 THEN 20 ELSE 40 END AS ip_header_len, CAST(l4_header + qty AS INTEGER) AS ip_payload_len,
       CAST(CASE WHEN v4 THEN 20 ELSE 40 END + l4_header + qty AS INTEGER) AS ip_total_len,
       CAST(14 + CASE WHEN v4 THEN 20 ELSE 40 END + l4_header + qty AS INTEGER) AS wire_len,
       CASE flag WHEN 'A' THEN 'tcp' WHEN 'N' THEN 'udp' END AS l4,
       CASE WHEN flag IN ('A', 'N') THEN l_linenumber END AS src_port,
       CAST(CASE flag WHEN 'A' THEN l_suppkey % 65536 WHEN 'N' THEN l_partkey % 65536 END AS INTEGER) AS dst_port,
       CASE flag WHEN 'A' THEN l_orderkey % 65536 END AS tcp_seq,
       CAST(CASE flag WHEN 'A' THEN qty END AS INTEGER) AS tcp_payload_len,
       CAST(1000 AS BIGINT) AS ts_ms
FROM p""",
    "capture_frame_count": "SELECT 'frameNum' AS label, count(*) AS frames FROM lineitem",
    "capture_payload_totals": _CAPTURED
    + """
SELECT 'wireLen' AS label, CAST(sum(14 + CASE WHEN v4 THEN 20 ELSE 40 END + 20 + qty) AS BIGINT) AS total
FROM packets WHERE flag = 'A'
UNION ALL SELECT 'payloadLen', CAST(sum(qty) AS BIGINT) FROM packets WHERE flag = 'A'""",
    "capture_port_traffic": _CAPTURED
    + """
SELECT CAST(dst_port AS INTEGER) AS dst_port, CAST(sum(20 + l4_header + qty) AS BIGINT) AS bytes, count(*) AS packets
FROM packets WHERE v4 AND dst_port IS NOT NULL GROUP BY dst_port ORDER BY dst_port""",
    "capture_ipv4_totals": _CAPTURED
    + "SELECT CAST(sum(20 + l4_header + qty) AS BIGINT) AS bytes, count(*) AS packets FROM packets WHERE v4",
    "reassembled_messages": "SELECT conv_id, turn, role, text FROM conversations",
    "capture_messages": _MESSAGES
    + """
SELECT kind, pipe AS pipe_id, CASE kind WHEN 'req' THEN a WHEN 'rem' THEN d END AS adv_pipe_id,
       ms AS first_ms, ms AS last_ms, CAST(CASE kind WHEN 'data' THEN props_len ELSE 0 END AS BIGINT) AS payload_bytes,
       CASE kind WHEN 'data' THEN CAST(seq AS VARCHAR) ELSE '' END AS seqs,
       CASE kind WHEN 'ack' THEN CAST(seq AS VARCHAR) ELSE '' END AS acks
FROM m""",
    "capture_metrics": _PERFORMANCE + "SELECT metric, sec, value FROM metrics",
    "frame_count": "SELECT 'frameNum' AS label, count(*) AS frames FROM events",
    "payload_totals": _PACKETS
    + """
SELECT 'wireLen' AS label, CAST(sum(header_len + payload_len) AS BIGINT) AS total FROM packets WHERE flag = 'A'
UNION ALL SELECT 'payloadLen', CAST(sum(payload_len) AS BIGINT) FROM packets WHERE flag = 'A'""",
    "port_traffic": _PORTS + "SELECT * FROM ports ORDER BY dst_port",
    "port_traffic_text": _PORTS
    + "SELECT CAST(dst_port AS VARCHAR) AS port, bytes || ' ' || packets AS value FROM ports ORDER BY port",
    "port_report": _PORTS + "SELECT * FROM ports",
    "word_count": r"""
SELECT word, count(*) AS n
FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM documents)
WHERE word <> '' GROUP BY word""",
    "ipv4_totals": _PACKETS
    + """
SELECT trace_file, CAST(sum(header_len + payload_len) AS BIGINT) AS bytes, count(*) AS packets
FROM packets WHERE ip_version = 4 GROUP BY trace_file""",
    "ipv4_cardinalities": _PACKETS
    + """, v4 AS (SELECT * FROM packets WHERE ip_version = 4)
SELECT 'addresses' AS measure, count(*) AS n FROM (SELECT l_orderkey FROM v4 UNION SELECT l_suppkey FROM v4)
UNION ALL SELECT 'sources', count(DISTINCT l_orderkey) FROM v4
UNION ALL SELECT 'destinations', count(DISTINCT l_suppkey) FROM v4
UNION ALL SELECT 'flows', count(*) FROM (
  SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber, dst_port, flag FROM v4 WHERE flag IN ('A', 'N'))
UNION ALL SELECT 'tcp_src_ports', count(DISTINCT l_linenumber) FROM v4 WHERE flag = 'A'
UNION ALL SELECT 'tcp_dst_ports', count(DISTINCT dst_port) FROM v4 WHERE flag = 'A'""",
    "running_totals": """
SELECT event_type AS trace_file, event_id + 1 AS frame_no,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER w AS BIGINT) AS bytes, count(*) OVER w AS packets
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""",
    "handshakes": _MESSAGES + "SELECT scope, data_pipe, ack_pipe, req_pos, rem_pos, req_ms, rem_ms FROM h",
    "orphan_requests": _MESSAGES
    + """
SELECT scope, a AS ack_pipe, pos AS req_pos, ms AS req_ms FROM m
WHERE kind = 'req' AND NOT EXISTS (SELECT 1 FROM h WHERE h.scope = m.scope AND h.req_pos = m.pos)""",
    "orphan_counts": _MESSAGES
    + """, lost AS (
  SELECT scope, pipe FROM m WHERE kind IN ('data', 'ack', 'close')
  AND NOT EXISTS (SELECT 1 FROM h WHERE h.scope = m.scope AND (h.data_pipe = m.pipe OR h.ack_pipe = m.pipe)))
SELECT 'requests' AS what, count(*) AS n FROM m
WHERE kind = 'req' AND NOT EXISTS (SELECT 1 FROM h WHERE h.scope = m.scope AND h.req_pos = m.pos)
UNION ALL SELECT 'messages', count(*) FROM lost
UNION ALL SELECT 'pipes', count(*) FROM (SELECT DISTINCT scope, pipe FROM lost)""",
    "assigned_messages": _ROUTED
    + "SELECT scope, pos, kind, pipe, side, flow, flow_rem, kept, replay FROM assigned",
    "requests_per_second": _MESSAGES + "SELECT req_ms // 1000 AS sec, count(*) AS n FROM flows GROUP BY 1",
    "responses_per_second": _MESSAGES + "SELECT rem_ms // 1000 AS sec, count(*) AS n FROM flows GROUP BY 1",
    "segments": _USER_SEGMENTS + "SELECT substr(flow, 2) AS flow, seq, sent_ms, ack_ms FROM user_segs",
    "arrivals_per_second": _USER_SEGMENTS + "SELECT sent_ms // 1000 AS sec, count(*) AS n FROM user_segs GROUP BY 1",
    "rtt_samples": _USER_SEGMENTS + "SELECT sec, rtt_ms FROM samples",
    "rtt_lists": _USER_SEGMENTS
    + """, placed AS (
  SELECT sec, rtt_ms, (row_number() OVER (PARTITION BY sec ORDER BY rtt_ms) - 1) // 1000 AS part FROM samples)
SELECT sec, part, '(' || count(*) || ')[' || string_agg(rtt_ms || ' ', '' ORDER BY rtt_ms) || ']' AS rtts
FROM placed GROUP BY sec, part""",
    "flow_segments": _PERFORMANCE + "SELECT scope, flow, seq, sent_ms, ack_ms FROM segs",
    "flow_stats": _PERFORMANCE
    + """
SELECT *, end_ms - start_ms AS transfer_ms,
       CASE WHEN end_ms <> start_ms THEN CAST(payload_bytes AS DOUBLE) / (end_ms - start_ms) END AS bytes_per_ms
FROM stats""",
    "flow_status": _PERFORMANCE
    + """
SELECT scope, flow, 'Data: ' || data_complete || ':' || blocks || chr(10) || 'Ack: ' || ack_complete || ':' || acks
       || chr(10) || 'ExpectedNumber: ' || expected AS status
FROM stats""",
    "flow_health": _PERFORMANCE
    + """
SELECT count(*) AS uncompleted_flows,
       CAST(coalesce(sum((SELECT count(*) FROM segs g WHERE g.scope = s.scope AND g.flow = s.flow AND g.ack_ms IS NULL)), 0) AS BIGINT)
         AS acks_expected
FROM stats s WHERE NOT (data_complete AND ack_complete)""",
    "metrics_merged": _PERFORMANCE + "SELECT metric, sec, value FROM metrics",
    "metric_sizes": _PERFORMANCE + "SELECT metric, count(DISTINCT sec) AS seconds FROM metrics GROUP BY metric",
    "metrics_rebased": _PERFORMANCE
    + "SELECT metric, sec - (SELECT min(sec) FROM metrics) AS sec, value FROM metrics",
    "metrics_rebased_each": _PERFORMANCE
    + "SELECT metric, sec - min(sec) OVER (PARTITION BY metric) AS sec, value FROM metrics",
    "metrics_partitioned": _PERFORMANCE + "SELECT metric, sec, value FROM metrics",
}

# The events with few openings and three block numbers, see ``event_messages(busy=True)``.
_BUSY_MESSAGES = (
    _MESSAGES.replace("FROM events)", "FROM busy)")
    .replace("CAST(json_extract_string(props, '$.k') AS INTEGER) AS seq", "k % 3 AS seq")
    .replace(
        "WITH m AS (",
        """WITH busy AS (
  SELECT * REPLACE (CASE WHEN event_type = 'signup' AND k >= 10 THEN 'view'
                         WHEN event_type = 'purchase' AND k >= 10 THEN 'click' ELSE event_type END AS event_type)
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
m AS (""",
    )
)


def _busy(name: str) -> str:
    return ORACLE[name].replace(_MESSAGES, _BUSY_MESSAGES)


ORACLE |= {
    "word_count_tab": ORACLE["word_count"],
    "words_by_key": f"SELECT n, word, substr(word, 1, 1) AS first FROM ({ORACLE['word_count']})",
    "flow_stats_completed": _busy("flow_stats"),
    "flow_segments_completed": _busy("flow_segments"),
    "flow_health_completed": _busy("flow_health"),
    "flow_status_completed": _busy("flow_status"),
    "metrics_completed": _busy("metrics_merged"),
    "running_totals_chunked": ORACLE["running_totals"],
    "handshakes_chunked": ORACLE["handshakes"],
    "assigned_messages_chunked": ORACLE["assigned_messages"],
    "flow_stats_chunked": _busy("flow_stats"),
    "flow_segments_chunked": _busy("flow_segments"),
    # A user's messages lie in one trace, so a flow over all traces is the same but for its scope.
    "flow_stats_global": ORACLE["flow_stats"].replace("SELECT *, end_ms", "SELECT * REPLACE ('' AS scope), end_ms"),
}

# Every handshake as a flow of its own: named by its data pipe and the place of its response.
_BEFORE, _AFTER = _PERFORMANCE.split(", applied AS (")
_ALL_FLOWS = _BEFORE + ", applied AS (" + (
    _AFTER.replace("FROM flows", "FROM h")
    .replace("SELECT scope, data_pipe AS flow, 0", "SELECT scope, data_pipe || '@' || rem_pos AS flow, 0")
    .replace("SELECT scope, data_pipe, 1", "SELECT scope, data_pipe || '@' || rem_pos, 1")
    .replace("SELECT f.scope, f.data_pipe,", "SELECT f.scope, f.data_pipe || '@' || f.rem_pos,")
    .replace("SELECT scope, flow, 4", "SELECT scope, flow || '@' || flow_rem, 4")
    .replace("FROM assigned WHERE kept", "FROM assigned WHERE side IS NOT NULL")
    .replace("SELECT scope, data_pipe AS flow, ack_pipe", "SELECT scope, data_pipe || '@' || rem_pos AS flow, ack_pipe")
)
_NAMED = "* REPLACE (split_part(flow, '@', 1) AS flow), CAST(split_part(flow, '@', 2) AS BIGINT) AS rem_pos"

ORACLE |= {
    "flow_stats_all": _ALL_FLOWS
    + f"""
SELECT {_NAMED}, end_ms - start_ms AS transfer_ms,
       CASE WHEN end_ms <> start_ms THEN CAST(payload_bytes AS DOUBLE) / (end_ms - start_ms) END AS bytes_per_ms
FROM stats""",
    "flow_segments_all": _ALL_FLOWS + f"SELECT {_NAMED} FROM segs",
    "rtt_lists_chunked": ORACLE["rtt_lists"],
}
ORACLE["flow_stats_all_chunked"] = ORACLE["flow_stats_all"].replace(_MESSAGES, _BUSY_MESSAGES)

_SENT = """
WITH sent AS (
  SELECT *, 4 + strlen(CAST(turn AS VARCHAR) || chr(9) || role || chr(9) || text) AS size, turn % 5 = 3 AS damaged FROM conversations)
"""

ORACLE |= {
    "pcap_ingest_split": ORACLE["pcap_ingest"],
    "pcap_losses": """
WITH records AS (
  SELECT 16 + 14 + CASE WHEN l_linestatus <> 'F' THEN 20 ELSE 40 END + CASE l_returnflag WHEN 'A' THEN 20 ELSE 8 END
           + CAST(l_quantity AS BIGINT) AS size,
         row_number() OVER (PARTITION BY l_orderkey // 1000 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) % 64 = 0 AS damaged
  FROM lineitem)
SELECT 'found' AS what, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes FROM records WHERE NOT damaged
UNION ALL SELECT 'damaged', NULL, CAST(sum(size) AS BIGINT) FROM records WHERE damaged HAVING count(*) > 0""",
    "reassembled_messages_chunked": ORACLE["reassembled_messages"],
    "resumed_messages": "SELECT conv_id, turn, role, text FROM conversations WHERE turn % 5 <> 3",
    "message_losses": _SENT
    + "SELECT CASE WHEN damaged THEN 'lost' ELSE 'found' END AS what, CAST(sum(size) AS BIGINT) AS bytes FROM sent GROUP BY 1",
}
ORACLE["pcap_losses_split"] = ORACLE["pcap_losses"]
ORACLE["message_losses_chunked"] = ORACLE["message_losses"]

ORACLE |= {
    "ipv4_cardinalities_sketched": f"SELECT measure, n, true AS near FROM ({ORACLE['ipv4_cardinalities']})",
    "metrics_replaced": "SELECT metric, sec, CASE WHEN metric IN ('arv', 'rtt') THEN value ELSE -1 END AS value "
    f"FROM ({ORACLE['metrics_merged']})",
    "series_in_order": f"SELECT metric, count(*) AS lines, CAST(0 AS BIGINT) AS disorder FROM ({ORACLE['metrics_merged']}) GROUP BY metric",
}
