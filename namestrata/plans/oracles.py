"""SQL that states what each query must return, over the same tables.

Wire work is checked as a round trip: the SQL selects the values the bytes were made from.
"""

from __future__ import annotations

from namestrata.plans.traffic import DNS_LOG_SQL

#: The log, the records made from it and their questions.
BASE = f"""
WITH dns_log AS ({DNS_LOG_SQL}),
res AS (
 SELECT *, seq AS e, QR = 1 AS response, CAST((seq * 31) % 65536 AS INT) AS id,
  CASE WHEN SrcIP = '2001:db8::0' THEN '2001:db8::' ELSE SrcIP END AS src,
  seq % 13 <> 5 AS has_q, seq % 13 <> 5 AND seq % 11 = 0 AS has_q2,
  CASE WHEN IPVersion = 6 THEN '2001:db8::' || CAST(seq % 3 + 35 AS VARCHAR) ELSE DstIP END AS dst,
  CASE WHEN Protocol = 'udp' THEN CASE WHEN QR = 1 THEN 53 ELSE 1024 + seq % 60000 END END AS src_port,
  CASE WHEN Protocol = 'udp' THEN CASE WHEN QR = 1 THEN 1024 + seq % 60000 ELSE 53 END END AS dst_port,
  epoch_us(PacketTime) * 1000 + seq % 1000 AS ts_ns,
  'host' || CAST(seq % 17 AS VARCHAR) || '.example.net.' AS target,
  strftime(PacketTime, '%Y-%m-%dT%H:%M:%S') AS second_text
 FROM dns_log),
q AS (
 SELECT *, 0 AS pos, Question AS name, Type AS qtype, Class AS qclass FROM res WHERE has_q
 UNION ALL
 SELECT *, 1 AS pos, 'alt.' || Question AS name, 1 AS qtype, 1 AS qclass FROM res WHERE has_q2)
"""


def _sql(body: str) -> str:
    return BASE + body


N_QUESTIONS = "CASE WHEN has_q2 THEN 2 WHEN has_q THEN 1 ELSE 0 END"
N_ANSWERS = "CASE WHEN response THEN 2 ELSE 0 END"
N_NS = "CASE WHEN response AND seq % 6 = 0 THEN 2 ELSE 0 END"
DOBIT = "CASE WHEN Edns0Present = 1 THEN DoBit ELSE 0 END"
IS_SKIP = (
    "(ends_with(lower({0}), 'example.com.') OR starts_with(lower({0}), 'view') "
    "OR lower({0}) = 'login1.sample.org.')"
)
IS_ALLOW = "(starts_with(lower({0}), 'purchase') OR ends_with(lower({0}), 'sample.org.'))"
SKIP, ALLOW = IS_SKIP.format("Question"), IS_ALLOW.format("Question")

ORACLES: dict[str, str] = {}

# --- rollups ---------------------------------------------------------------------------------

_GRAINS = {"ms": "millisecond", "second": "second", "minute": "minute", "day": "day"}
_ROLLUPS = {
    "R1_domain_count": ("t", "minute", "Question", "QR = 0", "count(*) AS c"),
    "R2_domain_unique": ("timestamp", "ms", "", "QR = 0", "count(DISTINCT Question) AS UniqueDnsCount"),
    "R3_protocol": ("timestamp", "minute", "Protocol", "true", "count(*) AS c"),
    "R4_general": ("timestamp", "ms", "", "true", "CAST(sum(Size) AS BIGINT) AS TotalSize, avg(Size) AS AverageSize"),
    "R5_edns": ("timestamp", "ms", "", "QR = 0",
                "CAST(sum(Edns0Present) AS BIGINT) AS EdnsCount, CAST(sum(DoBit) AS BIGINT) AS DoBitCount"),
    "R6_opcode": ("timestamp", "ms", "OpCode", "QR = 0", "count(*) AS c"),
    "R7_type": ("timestamp", "second", "Type", "QR = 0", "count(*) AS c"),
    "R8_class": ("timestamp", "second", "Class", "QR = 0", "count(*) AS c"),
    "R9_response": ("timestamp", "second", "ResponseCode", "QR = 1", "count(*) AS c"),
    "R10_srcip": ("timestamp", "second", "IPVersion, SrcIP", "true", "count(*) AS c"),
    "R11_dstip": ("timestamp", "second", "IPVersion, DstIP", "true", "count(*) AS c"),
}


def _rollup(name: str, grain: str | None = None) -> str:
    time_name, own, keys, where, measures = _ROLLUPS[name]
    keys = f", {keys}" if keys else ""
    cut = f"date_trunc('{_GRAINS[grain or own]}', PacketTime)"
    # date_trunc to days yields a date in some engines; the query keeps the time type.
    return _sql(
        f"SELECT CAST(PacketTime AS DATE) AS DnsDate, CAST({cut} AS TIMESTAMP) AS {time_name}, "
        f"Server{keys}, {measures} FROM dns_log WHERE {where} GROUP BY 1, 2, Server{keys}"
    )


for _name in _ROLLUPS:
    ORACLES[_name] = _rollup(_name)
    ORACLES[f"{_name}_by_day"] = _rollup(_name, "day")
for _name in ("R2_domain_unique", "R3_protocol", "R4_general", "R5_edns", "R6_opcode"):
    ORACLES[f"R12_stored_{_name}"] = _rollup(_name, "second")
ORACLES["R13_merge_states"] = _rollup("R4_general", "day")
ORACLES["R13_merge_counts"] = _rollup("R7_type", "day")
ORACLES["R13_merge_sketches"] = _sql(
    "SELECT CAST(PacketTime AS DATE) AS DnsDate, Server, count(DISTINCT Question) AS exact, "
    "true AS within_tenth FROM dns_log WHERE QR = 0 GROUP BY 1, 2"
)

# --- reports and filters ---------------------------------------------------------------------

_RECENT = "QR = 0 AND date_trunc('minute', PacketTime) > TIMESTAMP '2024-01-28 00:00:00'"
_BODIES = {
    "A1_request_timeline": "SELECT time_bucket(INTERVAL 5 MINUTE, PacketTime) AS t, count(*) AS c FROM dns_log GROUP BY 1",
    "A2_distinct_domains": f"SELECT DISTINCT Question FROM dns_log WHERE {_RECENT}",
    "A3_count_distinct_domains": f"SELECT count(DISTINCT Question) AS domains FROM dns_log WHERE {_RECENT}",
    "A4_top_domains": "SELECT Question, count(*) AS c FROM dns_log WHERE QR = 0 GROUP BY 1 ORDER BY c DESC, Question LIMIT 20",
    "J1_new_domains": """SELECT DISTINCT Question FROM dns_log
        WHERE date_trunc('day', PacketTime) > TIMESTAMP '2024-01-29' AND Question NOT IN (
         SELECT Question FROM dns_log WHERE date_trunc('day', PacketTime) < TIMESTAMP '2024-01-29'
          AND date_trunc('day', PacketTime) > TIMESTAMP '2024-01-21')""",
    "J2_type_names": """SELECT Type, CASE Type WHEN 28 THEN 'AAAA' WHEN 16 THEN 'TXT' WHEN 15 THEN 'MX'
        WHEN 1 THEN 'A' ELSE 'Invalid' END AS TypeName, count(*) AS c FROM dns_log GROUP BY 1, 2""",
    "J3_class_names": """SELECT Class, CASE Class WHEN 1 THEN 'Internet' WHEN 3 THEN 'CHAOS' ELSE 'Invalid' END
        AS ClassName, count(*) AS c FROM dns_log GROUP BY 1, 2""",
    "J4_opcode_names": """SELECT OpCode, CASE OpCode WHEN 0 THEN 'Query' WHEN 5 THEN 'Update' ELSE 'Invalid' END
        AS OpCodeName, count(*) AS c FROM dns_log GROUP BY 1, 2""",
    "J5_response_names": """SELECT ResponseCode, CASE ResponseCode WHEN 0 THEN 'NoErr' WHEN 3 THEN 'NXDomain'
        ELSE 'Invalid' END AS ResponseCodeName, count(*) AS c FROM dns_log GROUP BY 1, 2""",
    "S6_dictionary_rows": """SELECT DISTINCT CAST(Type AS BIGINT) AS Id, CASE Type WHEN 28 THEN 'AAAA'
        WHEN 16 THEN 'TXT' WHEN 15 THEN 'MX' WHEN 1 THEN 'A' END AS Name FROM dns_log""",
    "A5_counters": f"""SELECT count(*) AS dispatched, count(*) FILTER (WHERE NOT {SKIP}) AS sent,
        count(*) FILTER (WHERE {SKIP}) AS skipped FROM dns_log""",
    "A5_pipeline_counters": f""", twice AS (
          SELECT *, seq * 2 + again AS s FROM (SELECT *, unnest(CASE WHEN seq % 7 = 0 THEN [0, 1] ELSE [0] END) AS again FROM res)),
        marked AS (SELECT *, (s % 6 + 1) % 4 <= 1 AS kept FROM twice),
        alive AS (SELECT *, seq % 29 = 0 AS broken, seq % 29 <> 0 AND seq % 19 <> 0 AS here FROM marked WHERE kept AND again = 0),
        asked AS (SELECT {IS_SKIP.format('name')} AS skips, {IS_ALLOW.format('name')} AS allows
          FROM alive JOIN (SELECT seq, name FROM q) USING (seq) WHERE here AND seq % 23 <> 0)
        SELECT (SELECT count(*) FROM marked) AS packetsCaptured, (SELECT count(*) FROM marked WHERE NOT kept) AS packetsOverRatio,
          (SELECT count(*) FROM marked WHERE again = 1) AS packetsDuplicate,
          (SELECT count(*) FROM alive WHERE broken) AS decodingErrors,
          (SELECT count(*) FROM alive WHERE here AND seq % 23 = 0) AS unpackErrors,
          (SELECT count(*) FROM alive WHERE here AND seq % 23 <> 0) AS messagesDecoded,
          count(*) FILTER (WHERE NOT skips) AS "parquetSentToOutput", count(*) FILTER (WHERE skips) AS "parquetSkipped", 0 AS "parquetFailed",
          count(*) AS "logSentToOutput", 0 AS "logSkipped", 0 AS "logFailed",
          count(*) FILTER (WHERE allows) AS "syslogSentToOutput", count(*) FILTER (WHERE NOT allows) AS "syslogSkipped", 0 AS "syslogFailed",
          0 AS "unreachableSentToOutput", 0 AS "unreachableSkipped", count(*) FILTER (WHERE NOT skips) AS "unreachableFailed"
        FROM asked""",
    "A6_loss_percent": """SELECT Server, count(*) AS captured, count(*) FILTER (WHERE ResponseCode = 3) AS dropped,
        round(count(*) FILTER (WHERE ResponseCode = 3) * 100.0 / count(*), 6) AS loss_percent
        FROM dns_log GROUP BY Server""",
    "A7_metrics_text": f""", m AS (SELECT count(*) AS d, count(*) FILTER (WHERE NOT {SKIP}) AS s,
         count(*) FILTER (WHERE {SKIP}) AS k FROM dns_log)
        SELECT '{{"dispatched":' || d || ',"sent":' || s || ',"skipped":' || k || '}}' AS value FROM m
        UNION ALL SELECT 'dispatched=' || d || ' sent=' || s || ' skipped=' || k || ' ' FROM m""",
    "F7_output_all": "SELECT seq, Question FROM dns_log",
    "F7_output_none": "SELECT seq, Question FROM dns_log WHERE false",
    "F8_skip_list": f"SELECT seq, Question FROM dns_log WHERE NOT {SKIP}",
    "F9_allow_list": f"SELECT seq, Question FROM dns_log WHERE {ALLOW}",
    "F9_allow_empty_list": "SELECT seq, Question FROM dns_log WHERE false",
    "F10_skip_and_allow": f"SELECT seq, Question FROM dns_log WHERE NOT {SKIP} AND {ALLOW}",
    "F11_longest_match": """SELECT seq, Question FROM dns_log WHERE ends_with(lower(Question), '1.example.com.')
        OR (starts_with(Question, 'pur') AND NOT starts_with(Question, 'purchase1'))""",
    "F12_per_question": f"""SELECT seq, name FROM q WHERE NOT ({IS_SKIP.format('name')}
        OR starts_with(name, 'alt.'))""",
    "F13_per_message": f"""SELECT seq FROM res WHERE seq NOT IN (SELECT seq FROM q
        WHERE {IS_SKIP.format('name')} OR starts_with(name, 'alt.'))""",
    "F13_long_list": f"""SELECT seq // 2 AS seq, id, count(*) AS c FROM res WHERE seq NOT IN (SELECT seq FROM q
        WHERE {IS_SKIP.format('name')} OR starts_with(name, 'alt.')) GROUP BY 1, 2""",
    "F12_long_list": f"""SELECT seq // 2 AS seq, name FROM q WHERE NOT ({IS_SKIP.format('name')}
        OR starts_with(name, 'alt.'))""",
    "F14_event_output_unfiltered": "SELECT seq FROM res",
    "F15_bulk_output_unfiltered": "SELECT seq FROM res",
    "F16_with_questions": "SELECT seq FROM res WHERE has_q",
    "F18_queries_only": "SELECT Server, count(*) AS c FROM dns_log WHERE QR = 0 GROUP BY Server",
    "F19_retention": "SELECT seq FROM dns_log WHERE CAST(PacketTime AS DATE) >= DATE '2024-01-15'",
    "F20_partition_cleanup": """SELECT seq, CAST(PacketTime AS DATE) AS dns_date FROM dns_log
        WHERE CAST(PacketTime AS DATE) >= DATE '2024-01-15'""",
    "F21_key_sample": "SELECT seq, Type FROM dns_log WHERE Type % 3 < 1",
    "F22_last_day": "SELECT seq, PacketTime FROM dns_log WHERE PacketTime > TIMESTAMP '2024-01-19 00:00:00'",
    "suffix_search": "SELECT seq FROM dns_log WHERE ends_with(Question, 'sample.org.')",
    "F17_packet_limit": """SELECT seq, CAST(PacketTime AS DATE) AS flush FROM dns_log
        QUALIFY row_number() OVER (PARTITION BY CAST(PacketTime AS DATE) ORDER BY seq) <= 25""",
    "fnv1a64": "SELECT count(DISTINCT Question) AS names, count(DISTINCT Question) AS hashes FROM dns_log",
    "P33_question_hash": "SELECT count(DISTINCT Question) AS names, count(DISTINCT Question) AS hashes FROM dns_log",
}

_NUMBERED = "row_number() OVER (PARTITION BY Server ORDER BY seq) AS n FROM dns_log"
_KEPT = {
    "F4_sample_packets": "((n - 1) % 17 + 1) % 7 <= 2",
    "F5_sample_dnstap": "((n - 1) % 31 + 1) % 10 < 3",
    "F4_sample_exact": "(n - 1) % 10 < 1",
}
for _name, _keep in _KEPT.items():
    _BODIES[_name] = f"SELECT seq, Server FROM (SELECT seq, Server, {_NUMBERED}) WHERE {_keep}"

_COPIES = """, copies AS (SELECT seq, row_number() OVER (PARTITION BY seq % 2 ORDER BY seq) AS n, row_number() OVER (
  PARTITION BY seq % 2, CAST(PacketTime AS DATE), Type, Protocol, left(Question, 1) ORDER BY seq) AS copy FROM dns_log)
 SELECT seq FROM copies WHERE copy = 1"""
_BODIES["F6_drop_copies"] = _COPIES
_BODIES["F6_drop_copies_exact_hash"] = _COPIES
_BODIES["F6_sample_then_drop_copies"] = _COPIES + " AND ((n - 1) % 6 + 1) % 4 <= 1"

_PATTERNS = """, named AS (
  SELECT seq AS line_no, CASE WHEN seq % 35 = 0 THEN 'fqdn' WHEN seq % 15 = 0 THEN 'prefix'
    WHEN seq % 15 = 5 THEN 'suffix' ELSE 'fqdn' END AS role,
   lower(CASE WHEN seq % 15 = 0 THEN substr(Question, 1, CAST(seq % 5 + 10 AS INT))
    WHEN seq % 15 = 5 THEN substr(Question, CAST(seq % 3 + 3 AS INT)) ELSE Question END) AS pattern
  FROM dns_log WHERE seq % 5 = 0),
 entries AS (SELECT *, CASE WHEN role = 'suffix' THEN reverse(pattern) ELSE pattern END AS entry FROM named),
 kinds AS (SELECT entry, arg_max(role, line_no) AS kind FROM entries GROUP BY entry),
 patterns AS (SELECT DISTINCT role, pattern, kind = role AS active FROM entries JOIN kinds USING (entry)
  WHERE role <> 'fqdn' OR kind = role)
"""
_BODIES["S5_domain_list"] = _PATTERNS + "SELECT role, pattern, active FROM patterns"
_BODIES["J6_long_list"] = _PATTERNS + """, names AS (SELECT DISTINCT lower(Question) AS name FROM dns_log),
 hits AS (
  SELECT name FROM names JOIN patterns ON role = 'fqdn' AND pattern = name
  UNION SELECT name FROM (SELECT name, arg_max(active, length(pattern)) AS a FROM names
   JOIN patterns ON role = 'prefix' AND starts_with(name, pattern) GROUP BY name) WHERE a
  UNION SELECT name FROM (SELECT name, arg_max(active, length(pattern)) AS a FROM names
   JOIN patterns ON role = 'suffix' AND ends_with(name, pattern) GROUP BY name) WHERE a)
 SELECT seq, Question FROM dns_log WHERE lower(Question) NOT IN (SELECT name FROM hits)"""

# --- records ---------------------------------------------------------------------------------

_SRC_HEX = """CASE WHEN IPVersion = 6 THEN '20010DB8' || repeat('0', 16) || printf('%08X', CAST(split_part(SrcIP, '::', 2) AS INT))
  ELSE '00000000000000000000FFFF' || printf('%02X%02X%02X%02X', CAST(split_part(SrcIP, '.', 1) AS INT),
   CAST(split_part(SrcIP, '.', 2) AS INT), CAST(split_part(SrcIP, '.', 3) AS INT), CAST(split_part(SrcIP, '.', 4) AS INT)) END"""
_NUMBER = """CASE WHEN IPVersion = 6 THEN '2306139568115548160' ELSE CAST(
  CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536
  + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT) AS VARCHAR) END"""
_NET = "CASE WHEN IPVersion = 6 THEN '2001:db8::' ELSE regexp_replace({0}, '[0-9]+$', '0') END"
_FRACTION = "rtrim(lpad(CAST(ts_ns % 1000000000 AS VARCHAR), 9, '0'), '0')"
_STAMP = f"(second_text || CASE WHEN {_FRACTION} = '' THEN '' ELSE '.' || {_FRACTION} END || 'Z')"


def _bit(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


_FLAGS = {
    "response": ("response", 0x8000, "Response"),
    "authoritative": ("response AND seq % 2 = 1", 0x400, "Authoritative"),
    "truncated": ("seq % 61 = 0", 0x200, "Truncated"),
    "rd": ("seq % 8 <> 0", 0x100, "RecursionDesired"),
    "ra": ("response", 0x80, "RecursionAvailable"),
    "ad": ("seq % 9 = 0", 0x20, "AuthenticatedData"),
    "cd": ("seq % 12 = 0", 0x10, "CheckingDisabled"),
}
_BITS = " || ".join(f"CAST({_bit(c)} AS VARCHAR)" for c, _, _ in _FLAGS.values())
_FLAG_WORD = "OpCode * 2048 + ResponseCode + " + " + ".join(
    f"{mask} * {_bit(c)}" for c, mask, _ in _FLAGS.values()
)
_FLAG_NAMES = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, _, n in _FLAGS.values())
_FLAG_IDS = ", ".join(f"CASE WHEN {c} THEN '{i}' END" for i, (c, _, _) in enumerate(_FLAGS.values()))
_CSV = ", ".join(
    ["year(PacketTime)", "month(PacketTime)", "day(PacketTime)", "hour(PacketTime)",
     "minute(PacketTime)", "second(PacketTime)", "ts_ns % 1000000000", "'resolver'", "IPVersion",
     _NUMBER.format("SrcIP"), _NUMBER.format("dst"), "CASE WHEN Protocol = 'udp' THEN 17 ELSE 6 END",
     "QR", "OpCode", "Class", "Type", "ResponseCode", "Question", "Size", "Edns0Present", DOBIT, "id"]
)
_CSV_NAMES = (
    "Year,Month,Day,Hour,Minute,Second,Ns,Server,IPVersion,SrcIP,DstIP,Protocol,Qr,OpCode,Class,Type,"
    "ResponseCode,Question,Size,Edns0Present,DoBit,ID"
)
_SECOND_TYPE = "CASE seq % 4 WHEN 0 THEN 28 WHEN 1 THEN 15 WHEN 2 THEN 16 ELSE 1 END"
_V6 = "'2001:db8::' || lower(to_hex(seq % 4096 + 1))"
_SECOND_DATA = f"""CASE seq % 4 WHEN 0 THEN {_V6} WHEN 1 THEN CAST(seq % 90 AS VARCHAR) || ' ' || target
  WHEN 2 THEN '"v=spf1 id=' || seq || '" "second"' ELSE '203.0.113.' || (seq % 250) END"""


def _json_record(kind: str, size: str, body: str) -> str:
    return (
        f"""'{{"Hdr":{{"Name":"' || Question || '","Rrtype":{kind},"Class":1,"Ttl":' || (seq % 86400) """
        f"""|| ',"Rdlength":' || ({size}) || '}},' || {body} || '}}'"""
    )


_TARGET_SIZE = "length(target) + 1"
_JSON_ANSWERS = f"""CASE WHEN NOT response THEN 'null' ELSE '[' || {_json_record('5', _TARGET_SIZE, "'\"Target\":\"' || target || '\"'")}
 || ',' || CASE seq % 4
  WHEN 0 THEN {_json_record('28', '16', "'\"AAAA\":\"' || " + _V6 + " || '\"'")}
  WHEN 1 THEN {_json_record('15', _TARGET_SIZE + ' + 2', "'\"Preference\":' || (seq % 90) || ',\"Mx\":\"' || target || '\"'")}
  WHEN 2 THEN {_json_record('16', 'length(CAST(seq AS VARCHAR)) + 18', "'\"Txt\":[\"v=spf1 id=' || seq || '\",\"second\"]'")}
  ELSE {_json_record('1', '4', "'\"A\":\"203.0.113.' || (seq % 250) || '\"'")} END || ']' END"""
_JSON_NS = f"""CASE WHEN NOT (response AND seq % 6 = 0) THEN 'null' ELSE '[' ||
 {_json_record('6', _TARGET_SIZE + ' + 39', "'\"Ns\":\"' || target || '\",\"Mbox\":\"admin.example.net.\",\"Serial\":' || seq || ',\"Refresh\":7200,\"Retry\":3600,\"Expire\":1209600,\"Minttl\":300'")}
 || ',' || {_json_record('2', _TARGET_SIZE, "'\"Ns\":\"' || target || '\"'")} || ']' END"""
_JSON_QUESTIONS = """CASE WHEN NOT has_q THEN 'null' ELSE '[{"Name":"' || Question || '","Qtype":' || Type ||
 ',"Qclass":' || Class || '}' || CASE WHEN has_q2 THEN ',{"Name":"alt.' || Question || '","Qtype":1,"Qclass":1}' ELSE '' END || ']' END"""
_JSON_EXTRA = """CASE WHEN Edns0Present = 0 THEN 'null' ELSE '[{"Hdr":{"Name":".","Rrtype":41,"Class":1232,"Ttl":' ||
 CASE WHEN DoBit = 1 THEN 32768 ELSE 0 END || ',"Rdlength":0}}]' END"""


def _truth(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'true' ELSE 'false' END"


_JSON = (
    f"""'{{"Timestamp":"' || {_STAMP} || '","DNS":{{"Id":' || id || ',"Response":' || {_truth('response')}
 || ',"Opcode":' || OpCode || ',"Authoritative":' || {_truth(_FLAGS['authoritative'][0])}
 || ',"Truncated":' || {_truth(_FLAGS['truncated'][0])} || ',"RecursionDesired":' || {_truth(_FLAGS['rd'][0])}
 || ',"RecursionAvailable":' || {_truth('response')} || ',"Zero":false,"AuthenticatedData":' || {_truth(_FLAGS['ad'][0])}
 || ',"CheckingDisabled":' || {_truth(_FLAGS['cd'][0])} || ',"Rcode":' || ResponseCode
 || ',"Question":' || {_JSON_QUESTIONS} || ',"Answer":' || {_JSON_ANSWERS} || ',"Ns":' || {_JSON_NS}
 || ',"Extra":' || {_JSON_EXTRA} || '}},"IPVersion":' || IPVersion || ',"SrcIP":"' || src || '"'
 || coalesce(',"SrcPort":' || src_port, '') || ',"DstIP":"' || dst || '"' || coalesce(',"DstPort":' || dst_port, '')
 || ',"Protocol":"' || Protocol || '","PacketLength":' || Size || ',"Identity":"' || Server || '","Version":"v1"}}'"""
)
_JSON_OPTIONS = """CASE WHEN Edns0Present = 0 THEN 'null' ELSE '[{"Hdr":{"Name":".","Rrtype":41,"Class":1232,"Ttl":' ||
 CASE WHEN DoBit = 1 THEN 32768 ELSE 0 END || ',"Rdlength":' || (22 + CASE WHEN seq % 2 = 0 THEN 8 ELSE 0 END
  + CASE WHEN seq % 3 = 0 THEN 6 ELSE 0 END) || '},"Option":[{"Code":8,"Family":1,"SourceNetmask":16,"SourceScope":0,"Address":"10.'
 || (seq % 250) || '.0.0"},{"Code":10,"Cookie":"' || format('{:016x}', seq) || '"}'
 || CASE WHEN seq % 2 = 0 THEN ',{"Code":3,"Nsid":"6e732d31"}' ELSE '' END
 || CASE WHEN seq % 3 = 0 THEN ',{"Code":65001,"Data":"vu8="}' ELSE '' END || ']}]' END"""
_TYPE_TEXT = "CASE {0} WHEN 28 THEN 'AAAA' WHEN 16 THEN 'TXT' WHEN 15 THEN 'MX' WHEN 1 THEN 'A' WHEN 5 THEN 'CNAME' ELSE '' END"
_OP_TEXT = "CASE OpCode WHEN 0 THEN 'QUERY' ELSE 'UPDATE' END"
_CLASS_TEXT = "CASE Class WHEN 1 THEN 'IN' ELSE 'CH' END"
_QUOTED = ", ".join(f"""CASE WHEN {c} THEN '"{n}"' END""" for c, _, n in _FLAGS.values())
_QUOTED_FLAGS = f"'[' || concat_ws(',', {_QUOTED}) || ']'"
_LIST_IDS = f"'[' || concat_ws(',', {_FLAG_IDS}) || ']'"


def _ocsf_answer(kind: str, data: str) -> str:
    text = f"Question || '\\t' || (seq % 86400) || '\\tIN\\t' || {_TYPE_TEXT.format(kind)} || '\\t' || {data}"
    return (
        f"""'{{"class":"IN","flag_ids":' || {_LIST_IDS} || ',"flags":' || {_QUOTED_FLAGS} || ',"packet_uid":' || id
 || ',"rdata":"' || {text} || '","ttl":' || (seq % 86400) || ',"type":"' || {_TYPE_TEXT.format(kind)} || '"}}'"""
    )


_OCSF = f"""'{{"type_uid":4003,"category_uid":4,"class_uid":4003,"time":' || CAST(floor(ts_ns / 1000000000.0) AS BIGINT)
 || ',"activity_id":1,"severity_id":0' || CASE WHEN has_q THEN ',"query":{{"class":"' || {_CLASS_TEXT}
 || '","hostname":"' || Question || '","opcode":"' || {_OP_TEXT} || '","opcode_id":' || OpCode || ',"packet_uid":' || id
 || ',"type":"' || {_TYPE_TEXT.format('Type')} || '"}}' ELSE '' END
 || CASE WHEN response THEN ',"answers":[' || {_ocsf_answer('5', 'target')} || ',' ||
  {_ocsf_answer('(' + _SECOND_TYPE + ')', "replace(" + _SECOND_DATA + ", '\"', '\\\"')")} || ']' ELSE '' END
 || ',"rcode":"' || CASE ResponseCode WHEN 3 THEN 'NXDOMAIN","rcode_id":3' ELSE 'NOERROR"' END
 || ',"src_endpoint":{{"ip":"' || src || '"' || coalesce(',"port":' || src_port, '') || ',"protocol":"' || Protocol
 || '"}},"dst_endpoint":{{"ip":"' || dst || '"' || coalesce(',"port":' || dst_port, '') || ',"protocol":"' || Protocol
 || '"}},"metadata":{{"product":{{"name":"dns","vendor_name":"namestrata"}},"version":"1.0.0"}}}}'"""
_INFLUX = f"""'system,hostname=resolver DstIP="' || dst || '",SrcIP="' || src || '",class=' || qclass || 'u,dobit=' || {DOBIT}
 || 'u,edns=' || Edns0Present || 'u,id=' || id || 'u,ipversion=' || IPVersion || 'u,opCode=' || OpCode
 || 'i,protocol="' || Protocol || '",qr=' || {_truth('response')} || ',qtype=' || qtype || 'u,question="' || name
 || '",responseCode=' || ResponseCode || 'i,size=' || Size || 'u ' || ts_ns"""
_LOG_ROW = f"""SELECT PacketTime, 'resolver' AS Server, IPVersion, src AS SrcIP, dst AS DstIP, Protocol, QR, OpCode,
 qclass AS Class, qtype AS Type, Edns0Present, {DOBIT} AS DoBit, ResponseCode, name AS Question, Size FROM q"""
_BATCHED = """, numbered AS (SELECT *, (row_number() OVER (ORDER BY seq, pos) - 1) // {0} AS batch FROM q)
 SELECT batch, count(*) AS rows, {1} FROM numbered GROUP BY batch"""

_BODIES |= {
    "P1_explode_questions": "SELECT seq, name, qtype FROM q",
    "P2_dns_log_rows": _LOG_ROW,
    "P23_postgres_row": _LOG_ROW,
    "P3_server_identity": "SELECT Server, count(*) AS c FROM q GROUP BY Server",
    "P4_P5_flags": f"SELECT seq, Edns0Present AS edns, {DOBIT} AS do_bit, QR AS qr FROM res",
    "P6_mask": f"SELECT seq, {_NET.format('SrcIP')} AS net FROM res",
    "P7_mapped": f"SELECT seq, {_SRC_HEX} AS ip16 FROM res",
    "P8_ip_number": f"SELECT seq, {_NUMBER.format('SrcIP')} AS number FROM res",
    "ip_text_round_trip": "SELECT seq, src AS SrcIP FROM res",
    "P9_protocol_number": "SELECT CASE WHEN Protocol = 'udp' THEN 17 ELSE 6 END AS number, count(*) AS c FROM dns_log GROUP BY 1",
    "P10_P11_index_time_full_query": "SELECT id, name AS Question, true AS stamped FROM q",
    "P12_json": f"SELECT seq, {_JSON} AS value FROM res",
    "P12_edns_options": f"SELECT seq, {_JSON.replace(_JSON_EXTRA, _JSON_OPTIONS)} AS value FROM res",
    "P13_csv": f"SELECT seq, concat_ws(',', {_CSV}) AS value FROM res WHERE has_q",
    "P14_csv_header": f"""SELECT CAST(i - 1 AS INT) AS pos, string_split('{_CSV_NAMES}', ',')[i] AS name,
        (SELECT count(*) FROM res WHERE has_q) AS filled FROM range(1, 23) t(i)""",
    "P15_template": "SELECT seq, 'id=' || id || ' src=' || src || ' question=' || Question AS value FROM res WHERE has_q",
    "P16_ocsf": f"SELECT seq, {_OCSF} AS value FROM res",
    "P17_header_flags": f"""SELECT seq, concat_ws(',', {_FLAG_NAMES}) AS flags, concat_ws(',', {_FLAG_IDS}) AS ids
        FROM res""",
    "P18_protocol_names": f"""SELECT {_TYPE_TEXT.format('Type')} AS type, {_CLASS_TEXT} AS class, {_OP_TEXT} AS opcode,
        CASE ResponseCode WHEN 0 THEN 'NOERROR' ELSE 'NXDOMAIN' END AS rcode, count(*) AS c FROM dns_log GROUP BY 1, 2, 3, 4""",
    "P21_pack_header": f"""SELECT seq, printf('%04X%04X%04X%04X%04X%04X', id, {_FLAG_WORD}, {N_QUESTIONS}, {N_ANSWERS},
        {N_NS}, Edns0Present) AS header FROM res""",
    "D4_unpack_questions": "SELECT seq, name, qtype, qclass FROM q",
    "D4_unpack_answers": f"""SELECT seq, Question AS name, 5 AS rrtype, seq % 86400 AS ttl, target AS rdata FROM res WHERE response
        UNION ALL SELECT seq, Question, {_SECOND_TYPE}, seq % 86400, {_SECOND_DATA} FROM res WHERE response""",
    "D4_unpack_flags": f"""SELECT seq, id, OpCode AS opcode, ResponseCode AS rcode, {_BITS} AS bits, {N_NS} AS ns,
        Edns0Present AS edns, {DOBIT} AS do_bit FROM res""",
    "P19_packed_records": f"SELECT seq, id, {N_QUESTIONS} AS questions FROM res",
    "P22_parquet_row": f"""SELECT PacketTime AS timestamp, IPVersion AS ip_version, src AS src_ip, dst AS dst_ip,
        Protocol AS protocol, QR AS qr, OpCode AS opcode, qclass, qtype, Edns0Present AS edns, {DOBIT} AS do_bit,
        ResponseCode AS rcode, name AS query_name, Size AS packet_length, Server AS identity, 'v1' AS version FROM q""",
    "P24_influx_points": f"SELECT seq, {_INFLUX} AS value FROM q",
    "P25_elastic_documents": "SELECT seq, name, id FROM q",
    "P26_zinc_bulk": """SELECT seq, '{ "index" : { "_index" : "dnsx" } }' AS head, 3 AS lines, Size AS size FROM res""",
    "P27_splunk_events": """SELECT seq, name, CAST(floor(ts_ns / 1000000000.0) AS BIGINT) AS time, 'ix' AS index,
        IPVersion AS v FROM q""",
    "P28_sentinel_batches": _BATCHED.format(64, "CAST(count(*) AS INT) AS parsed, CAST(sum(Size) AS INT) AS size"),
    "P29_victoria_batches": _BATCHED.format(50, "CAST(count(*) AS INT) AS lines, arg_min(Question, seq * 2 + pos) AS first"),
    "P30_syslog_lines": "SELECT seq, name, '<9>resolver: ' AS head FROM q",
    "P31_kafka_records": "SELECT 32 AS key_size, count(*) AS c, CAST(sum(id) AS BIGINT) AS ids FROM res",
    "P32_storage_key": "SELECT seq, date_trunc('hour', PacketTime) AS hour, reverse(Question) AS rq FROM dns_log",
    "P34_formats": """, n AS (SELECT count(*) AS a, count(*) FILTER (WHERE has_q) AS b FROM res)
        SELECT f AS format, CASE WHEN starts_with(f, 'csv') THEN b ELSE a END AS records FROM n,
        unnest(['json', 'json-ocsf', 'csv', 'csv_no_header', 'gotemplate', 'gob']) t(f)""",
    "S8_ocsf_scan": """SELECT seq, CASE WHEN has_q THEN Question END AS name, CASE WHEN has_q THEN
        CASE WHEN Type = 4321 THEN 0 ELSE Type END END AS qtype, ResponseCode AS rcode,
        CASE WHEN response THEN target END AS first_answer FROM res""",
}

# --- packets ---------------------------------------------------------------------------------

_PORTS = """CASE WHEN seq % 19 = 0 THEN 8080 ELSE coalesce(src_port, 53) END AS src_port,
 CASE WHEN seq % 19 = 0 THEN 8081 ELSE coalesce(dst_port, 4000) END AS dst_port"""
_UDP_OK = "seq % 19 <> 0 AND seq % 23 <> 0"
_PIECES = """, pieces AS (SELECT *, seq * 4 + n AS frag_seq FROM res,
  (VALUES (0, 1), (1, 0), (2, 2), (3, 0)) t(n, piece)
  WHERE NOT (seq % 29 = 0 AND piece = 1) AND (n <> 3 OR seq % 31 = 0))
"""
_REBUILT = f"""SELECT seq AS event, IPVersion AS ip_version, src AS src_ip, 53 AS dst_port, id,
 {N_ANSWERS} AS answers FROM res WHERE seq % 29 <> 0 AND IPVersion = """
_BODIES |= {
    "D1_headers": f"SELECT seq, IPVersion AS ip_version, src AS src_ip, dst AS dst_ip, {_PORTS} FROM res",
    "D2_decapsulation": """SELECT IPVersion AS ip_version, 17 AS protocol_no, count(*) AS c FROM res GROUP BY 1""",
    "D3_raw_ip": "SELECT seq, IPVersion AS ip_version FROM res WHERE seq % 5 = 4",
    "D5_udp_records": f"""SELECT seq, IPVersion AS ip_version, {_NET.format('SrcIP')} AS src_ip, {_NET.format('dst')} AS dst_ip,
        coalesce(src_port, 53) AS src_port, coalesce(dst_port, 4000) AS dst_port, 'udp' AS protocol, id,
        {N_QUESTIONS} AS questions, {N_ANSWERS} AS answers FROM res WHERE {_UDP_OK}""",
    "D7_D9_fragment_detection": _PIECES + """SELECT IPVersion AS ip_version, true AS is_fragment, piece < 2 AS more_fragments,
        piece AS frag_offset, count(*) AS c FROM pieces GROUP BY 1, 3, 4""",
    "D8_reassemble_v4": _REBUILT + "4",
    "D10_reassemble_v6": _REBUILT + "6",
    "D11_fragment_limits": _PIECES + """SELECT frag_seq AS seq, piece + 8187 AS frag_offset FROM pieces
        WHERE piece < 2 OR (NOT has_q AND NOT response)""",
    "D12_D13_tcp_messages": "SELECT seq AS event, id, 3 AS messages FROM res",
    "D6_tcp_records": f"""SELECT seq AS event, IPVersion AS ip_version, {_NET.format('SrcIP')} AS src_ip,
        CAST(NULL AS INT) AS src_port, 'tcp' AS protocol, PacketTime AS ts, id FROM res, range(3)""",
    "D14_decoding_errors": """SELECT count(*) AS packetsCaptured, count(*) FILTER (WHERE seq % 29 = 0) AS decodingErrors,
        count(*) FILTER (WHERE seq % 23 = 0 AND seq % 29 <> 0) AS unpackErrors,
        100.0 * count(*) FILTER (WHERE seq % 29 = 0) / count(*) AS errorPercent FROM res""",
    "F1_port": "SELECT seq FROM res WHERE seq % 19 <> 0",
    "F2_default_traffic": _PIECES + "SELECT frag_seq AS seq, IPVersion AS ip_version FROM pieces",
    "F3_port_range": f"SELECT seq, src_port FROM (SELECT seq, {_PORTS} FROM res) WHERE src_port BETWEEN 1 AND 1024",
    "U1_all_paths": f"""SELECT 'udp' AS protocol, IPVersion AS ip_version, count(*) FILTER (WHERE {_UDP_OK})
         + count(*) FILTER (WHERE seq % 29 <> 0) AS c FROM res GROUP BY 2
        UNION ALL SELECT 'tcp', IPVersion, 3 * count(*) FROM res GROUP BY 2""",
    "S1_pcap": "SELECT seq, ts_ns, CASE WHEN seq % 5 = 4 THEN 101 ELSE 1 END AS link_type FROM res",
    "S2_pcapng": "SELECT seq, ts_ns, CASE WHEN seq % 5 = 4 THEN 101 ELSE 1 END AS link_type FROM res",
    "S1_capture_source": """, linked AS (SELECT seq, CASE WHEN seq % 5 = 4 THEN 101 ELSE 1 END AS link_type, seq // 500 AS f FROM res)
        SELECT seq, concat('file-', f, '-', link_type) AS file,
          row_number() OVER (PARTITION BY f, link_type ORDER BY seq) - 1 AS number, link_type FROM linked
        UNION ALL SELECT seq, concat('file-', f), row_number() OVER (PARTITION BY f ORDER BY seq) - 1, link_type FROM linked""",
    "S3_format_sniffing": """SELECT 'pcap' AS format, count(DISTINCT (seq // 500, seq % 5 = 4)) AS c FROM res
        UNION ALL SELECT 'pcapng', count(DISTINCT seq // 500) FROM res""",
    "S4_dnstap": f"""SELECT seq, PacketTime + CASE WHEN seq % 3 = 1 THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END AS ts,
        IPVersion AS ip_version, src AS src_ip, coalesce(src_port, 0) AS src_port, dst AS dst_ip, Protocol AS protocol,
        Server AS identity, 'v1' AS version, id, {N_QUESTIONS} AS questions FROM res WHERE seq % 23 <> 0""",
    "S4_dnstap_invalid": "SELECT seq FROM res WHERE seq % 23 = 0",
    "P20_S9_event_records": """SELECT seq, ts_ns, src AS src_ip, dst AS dst_ip, coalesce(src_port, 0) AS src_port,
        IPVersion AS ip_version, Protocol AS protocol, Size AS packet_length, Server AS identity,
        CASE WHEN has_q THEN Question ELSE '' END AS qname, CASE WHEN has_q THEN Type ELSE 0 END AS qtype,
        ResponseCode AS rcode, response AS is_response, id FROM res""",
    "K1_parquet_sink": "SELECT name AS query_name, qtype, count(*) AS c FROM q GROUP BY 1, 2",
    "K2_file_sink": """SELECT concat_ws('-', year(PacketTime), month(PacketTime), day(PacketTime)) AS day, count(*) AS c FROM q
        WHERE CAST(PacketTime AS DATE) >= (SELECT CAST(max(PacketTime) AS DATE) - 9 FROM res) GROUP BY 1""",
    "K3_S7_log_table": """SELECT Server, Type, count(*) AS c, CAST(sum(Size) AS BIGINT) AS size FROM dns_log
        WHERE CAST(PacketTime AS DATE) = DATE '2024-01-15' GROUP BY 1, 2""",
    "T2_storage_order": "SELECT seq FROM dns_log WHERE false",
    "K6_console_lines": "SELECT seq % 10 AS bucket, count(*) AS c FROM q GROUP BY 1",
    "W7_fan_out": f"""SELECT 'all' AS output, count(*) AS c FROM q UNION ALL
        SELECT 'kept', count(*) FROM q WHERE NOT {IS_SKIP.format('name')}""",
    "W1_dedup_stream": """SELECT CAST(PacketTime AS DATE) AS day, count(DISTINCT Type || '|' || Protocol || '|' || left(Question, 1)) AS c
        FROM dns_log GROUP BY 1""",
    "W2_fragment_stream": """SELECT IPVersion AS ip_version, count(*) AS c, CAST(sum(seq) AS BIGINT) AS events FROM res
        WHERE seq % 29 <> 0 GROUP BY 1""",
    "W3_tcp_stream": """SELECT IPVersion AS ip_version, 3 * count(*) AS c, CAST(3 * sum(seq) AS BIGINT) AS events
        FROM res GROUP BY 1""",
    "W4_rollup_tables": """SELECT CAST(PacketTime AS DATE) AS DnsDate, Server, Type, count(*) AS c FROM dns_log
        WHERE QR = 0 GROUP BY 1, 2, 3""",
    "W4_windowed_rollup": """SELECT CAST(PacketTime AS DATE) AS DnsDate, Server, OpCode, count(*) AS c FROM dns_log
        WHERE QR = 0 GROUP BY 1, 2, 3""",
    "W5_W6_batches": """SELECT Server, count(*) // 500 AS full, count(*) % 500 AS rest, count(*) AS lines,
        ceil(count(*) / 500.0)::BIGINT AS batches FROM dns_log GROUP BY Server""",
    "W9_stored_counters": """SELECT 'log.rows' AS name, count(*) AS value FROM dns_log UNION ALL
        SELECT 'log.responses', count(*) FILTER (WHERE QR = 1) FROM dns_log""",
    "W9_progress_counters": """SELECT count(*) AS rows, count(*) FILTER (WHERE QR = 1) AS responses, true AS rows_equal,
        true AS responses_equal FROM dns_log""",
}

ORACLES |= {name: _sql(body) for name, body in _BODIES.items()}
