"""DuckDB SQL for the registered queries, built from shared WITH clauses."""

from __future__ import annotations

import re

from dnsloom.functions.flags import HEADER_BITS, OPCODE_NAMES, RCODE_NAMES
from dnsloom.settings import ForwardSettings
from dnsloom.sources.suffix_rules import SEED_RULES
from dnsloom.workload import tables as t

S = t.SETTINGS
I = t.INTEL_SETTINGS
WINDOW_US = S.burst_window_us


def _values(rows) -> str:
    return ", ".join(rows)


def _code_case(column: str, names: dict[int, str]) -> str:
    arms = " ".join(f"WHEN {code} THEN '{name}'" for code, name in names.items())
    return f"CASE {column} {arms} ELSE concat('UNKNOWN(', {column}, ')') END"


def _rule_row(rule: str) -> str:
    kind = {"*": "wildcard", "!": "exception"}.get(rule[0], "normal")
    return f"('{rule.lstrip('*.!')}', '{kind}')"


def _fmt(expr: str, places: int) -> str:
    return f"printf('%.{places}f', {expr})"


CTES: dict[str, str] = {
    "dns_log": t.fill(t.DNS_LOG_SQL, "duckdb"),
    "rules": f"SELECT * FROM (VALUES {_values(_rule_row(r) for r in SEED_RULES)}) v(name, kind)",
    "feed_lines": t.fill(t.FEED_SQL, "duckdb"),
    "feed_hosts": """SELECT DISTINCT lower(regexp_extract(value, '^https?://([^/:?#]+)', 1)) AS host
        FROM feed_lines""",
    "all_names": "SELECT query AS name FROM dns_log UNION SELECT host FROM feed_hosts",
    "labels": """SELECT name, rtrim(name, '.') AS clean,
        string_split(rtrim(name, '.'), '.') AS ls FROM all_names""",
    "tails": """SELECT name, clean, ls, k, lower(array_to_string(ls[-k:], '.')) AS tail
        FROM labels, (SELECT unnest(range(1, 6)) AS k) WHERE k <= len(ls)""",
    "depths": """SELECT tails.name AS name, coalesce(
            max(CASE kind WHEN 'exception' THEN k - 1 END),
            max(CASE WHEN kind = 'normal' THEN k WHEN kind = 'wildcard' AND len(ls) > k THEN k + 1 END)
        ) AS d
        FROM tails JOIN rules ON tails.tail = rules.name GROUP BY tails.name""",
    "owned": """SELECT l.name, l.clean, CASE WHEN d IS NOT NULL AND len(ls) > d THEN d END AS d, ls
        FROM labels l LEFT JOIN depths USING (name)""",
    "parts": """SELECT name,
        CASE WHEN d IS NULL THEN '' ELSE array_to_string(ls[-(d + 1):], '.') END AS registrable_domain,
        CASE WHEN d IS NULL THEN '' ELSE array_to_string(ls[1:len(ls) - d - 1], '.') END AS subdomain,
        CASE WHEN d IS NULL THEN clean ELSE array_to_string(ls[1:len(ls) - d], '.') END AS scoring_label
        FROM owned""",
    "letter_counts": """SELECT name, list_sort(list_transform(list_distinct(string_split(scoring_label, '')),
            lambda c: (len(scoring_label) - len(replace(scoring_label, c, ''))) / len(scoring_label))) AS ps
        FROM parts""",
    "entropies": """SELECT name,
        coalesce(0 - list_sum(list_transform(ps, lambda p: p * log2(p))), 0.0) AS entropy
        FROM letter_counts""",
    "base": f"""SELECT seq, ts_us, source_ip, destination_ip, query, registrable_domain, subdomain,
            scoring_label, entropy, ts_us / 1000000 AS timestamp, qdcount, ancount, nscount, arcount,
            CASE WHEN qr = 1 THEN 'RESPONSE' ELSE 'QUERY' END AS flags_qr,
            {_code_case("opcode", OPCODE_NAMES)} AS flags_opcode,
            {", ".join(f"CASE WHEN {b} = 1 THEN 'TRUE' ELSE 'FALSE' END AS flags_{b}" for b in ("aa", "tc", "rd", "ra"))},
            {_code_case("rcode", RCODE_NAMES)} AS flags_rcode
        FROM dns_log JOIN parts ON query = parts.name JOIN entropies ON query = entropies.name""",
    "records": f"""SELECT *,
        CASE WHEN entropy > {S.entropy_threshold} THEN 'High entropy domain name - Possible DGA or DNS Tunneling'
             WHEN flags_rcode = 'REFUSED' THEN 'DNS query refused by the server'
             WHEN flags_qr = 'RESPONSE' AND flags_rcode <> 'NOERROR'
               THEN 'Unsuccessful DNS response - Possible misconfiguration or attack'
             ELSE 'Normal query' END AS base_remark
        FROM base""",
    "baselines": f"""SELECT source_ip, avg(entropy) AS mean, stddev_pop(entropy) AS stdev,
            count(*) AS sample_count
        FROM base WHERE flags_qr = 'QUERY' GROUP BY source_ip
        HAVING count(*) >= {S.min_baseline_samples}""",
    "bursts": f"""SELECT registrable_domain, ts_us // {WINDOW_US} AS bucket,
            count(DISTINCT subdomain) AS unique_count, count(*) AS query_count
        FROM base WHERE flags_qr = 'QUERY' AND registrable_domain <> '' AND subdomain <> ''
        GROUP BY ALL HAVING count(DISTINCT subdomain) >= {S.burst_unique_subdomain_threshold}""",
    "ratios": f"""SELECT destination_ip AS client,
            count(*) FILTER (flags_rcode = 'NXDOMAIN') / count(*) AS ratio, count(*) AS sample_count
        FROM base WHERE flags_qr = 'RESPONSE' GROUP BY destination_ip
        HAVING count(*) >= {S.min_nxdomain_samples}""",
    "batch_signals": f"""SELECT r.*,
            CASE WHEN flags_qr = 'QUERY' AND stdev <> 0 THEN (entropy - mean) / stdev END AS z,
            unique_count, ratio, ratios.sample_count AS responses
        FROM records r
        LEFT JOIN baselines b ON flags_qr = 'QUERY' AND r.source_ip = b.source_ip
        LEFT JOIN bursts u ON flags_qr = 'QUERY' AND subdomain <> ''
            AND r.registrable_domain = u.registrable_domain AND ts_us // {WINDOW_US} = bucket
        LEFT JOIN ratios ON flags_qr = 'RESPONSE' AND destination_ip = client""",
    "live_windows": f"""SELECT r.*,
            CASE WHEN flags_qr = 'QUERY' THEN count(*) OVER before END AS n,
            CASE WHEN flags_qr = 'QUERY' THEN avg(entropy) OVER before END AS mean,
            CASE WHEN flags_qr = 'QUERY' THEN stddev_pop(entropy) OVER before END AS sd,
            CASE WHEN flags_qr = 'RESPONSE' THEN count(*) OVER so_far END AS responses,
            CASE WHEN flags_qr = 'RESPONSE'
                 THEN count(*) FILTER (flags_rcode = 'NXDOMAIN') OVER so_far END AS nxdomains
        FROM records r
        WINDOW before AS (PARTITION BY flags_qr, CASE WHEN flags_qr = 'QUERY' THEN source_ip ELSE destination_ip END
                          ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               so_far AS (PARTITION BY flags_qr, CASE WHEN flags_qr = 'QUERY' THEN source_ip ELSE destination_ip END
                          ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "live_counts": f"""SELECT seq, registrable_domain, subdomain, ts_us,
            count(DISTINCT subdomain) OVER (PARTITION BY registrable_domain ORDER BY ts_us
                RANGE BETWEEN {WINDOW_US} PRECEDING AND CURRENT ROW) AS unique_count
        FROM base WHERE flags_qr = 'QUERY' AND registrable_domain <> '' AND subdomain <> ''""",
    "live_signals": f"""SELECT w.* EXCLUDE (n, mean, sd, responses, nxdomains),
            CASE WHEN n >= {S.min_baseline_samples} AND sd <> 0 THEN (entropy - mean) / sd END AS z,
            CASE WHEN unique_count >= {S.burst_unique_subdomain_threshold} THEN unique_count END AS unique_count,
            CASE WHEN responses >= {S.min_nxdomain_samples} THEN nxdomains / responses END AS ratio,
            responses
        FROM live_windows w LEFT JOIN (SELECT seq, unique_count FROM live_counts) USING (seq)""",
    "seen": """SELECT registrable_domain AS domain, min(seq) AS first_seq, min(ts_us) AS first_ts_us,
            count(*) AS record_count
        FROM base WHERE registrable_domain <> '' GROUP BY registrable_domain""",
    "feed": """SELECT DISTINCT coalesce(nullif(registrable_domain, ''), name) AS domain
        FROM parts WHERE name IN (SELECT host FROM feed_hosts)""",
    "host_responses": t.fill(t.HOST_RESPONSES_SQL, "duckdb"),
    "vendor_responses": t.fill(t.VENDOR_RESPONSES_SQL, "duckdb"),
    "cache": t.fill(t.CACHE_SQL, "duckdb"),
    "host_hits": """SELECT domain, concat(coalesce(json_extract_string(response, '$.url_count'), 'unknown'),
            ' malicious URL(s) on record') AS detail
        FROM host_responses
        WHERE error IS NULL AND json_extract_string(response, '$.query_status') = 'ok'""",
    "vendor_stats": """SELECT domain,
            coalesce(CAST(json_extract(response, '$.data.attributes.last_analysis_stats.malicious') AS BIGINT), 0) AS m,
            coalesce(CAST(json_extract(response, '$.data.attributes.last_analysis_stats.suspicious') AS BIGINT), 0) AS s
        FROM vendor_responses WHERE error IS NULL""",
    "vendor_hits": """SELECT domain, concat(m, ' malicious / ', s, ' suspicious vendor flags') AS detail
        FROM vendor_stats WHERE m > 0 OR s > 0""",
    "feed_hits": """SELECT domain, 'listed in the OpenPhish active feed' AS detail
        FROM seen WHERE domain IN (SELECT domain FROM feed)""",
    "valid_cache": f"""SELECT * FROM cache WHERE {t.NOW} - checked_at <= {I.verdict_ttl_seconds}""",
    "fresh": f"""SELECT s.domain,
            h.detail IS NOT NULL OR f.detail IS NOT NULL OR v.detail IS NOT NULL AS is_malicious,
            CASE WHEN h.detail IS NOT NULL THEN 'urlhaus' WHEN f.detail IS NOT NULL THEN 'openphish'
                 WHEN v.detail IS NOT NULL THEN 'virustotal' END AS source,
            coalesce(h.detail, f.detail, v.detail, 'no match in any enabled feed') AS detail,
            CAST({t.NOW} AS DOUBLE) AS checked_at
        FROM seen s LEFT JOIN host_hits h USING (domain) LEFT JOIN feed_hits f USING (domain)
        LEFT JOIN vendor_hits v USING (domain)""",
    "verdict_table": """SELECT domain, is_malicious, source, detail, checked_at FROM valid_cache
            WHERE domain IN (SELECT domain FROM seen)
        UNION ALL
        SELECT * FROM fresh WHERE domain NOT IN (SELECT domain FROM valid_cache)""",
    "unsettled": """SELECT * FROM seen WHERE domain NOT IN (SELECT domain FROM valid_cache)
        AND domain NOT IN (SELECT domain FROM host_hits) AND domain NOT IN (SELECT domain FROM feed)""",
}


def _remarked(signals: str, z_threshold: float = S.z_score_threshold) -> str:
    """Signal rows with the remark before enrichment."""
    return f"""SELECT *, concat(
            CASE WHEN base_remark LIKE 'High entropy%' THEN base_remark
                 WHEN z > {z_threshold} THEN concat('Entropy anomalous for this host (z=',
                      {_fmt("z", 2)}, ') - Possible DGA or DNS Tunneling')
                 ELSE base_remark END,
            CASE WHEN unique_count IS NOT NULL THEN concat(' | ', unique_count, ' unique subdomains under ',
                 registrable_domain, ' within {S.burst_window_seconds}s - possible DNS tunneling') ELSE '' END,
            CASE WHEN ratio >= {S.nxdomain_ratio_threshold} THEN concat(' | host ', destination_ip,
                 ' has a high NXDOMAIN ratio (', CAST(round_even(ratio * 100, 0) AS INT), '% of ', responses,
                 ' responses) - possible DGA client') ELSE '' END) AS remark
        FROM {signals}"""


def _severity(remark: str, malicious: str) -> str:
    return f"""CASE WHEN {malicious} THEN 'critical'
        WHEN regexp_matches(lower({remark}), 'dga|tunneling|nxdomain ratio') THEN 'high'
        WHEN regexp_matches(lower({remark}), 'refused|misconfiguration|attack') THEN 'medium'
        ELSE 'info' END"""


def _enriched(remarked: str) -> str:
    return f"""SELECT r.* EXCLUDE (remark), v.is_malicious, v.source, v.detail, v.checked_at,
            concat(remark, CASE WHEN v.is_malicious
                THEN concat(' | domain matches ', v.source, ' threat intel: ', v.detail) ELSE '' END) AS remark
        FROM {remarked} r LEFT JOIN verdict_table v ON r.registrable_domain = v.domain"""


def _graded(enriched: str) -> str:
    return f"""SELECT *, {_severity("remark", "coalesce(is_malicious, false)")} AS severity FROM {enriched}"""


CTES |= {
    "batch_remarked": _remarked("batch_signals"),
    "batch_plain": "SELECT *, NULL::BOOLEAN AS is_malicious, NULL::VARCHAR AS source, NULL::VARCHAR AS detail FROM batch_remarked",
    "detected": _graded("batch_plain"),
    "batch_enriched": _enriched("batch_remarked"),
    "analyzed": _graded("batch_enriched"),
    "live_remarked": _remarked("live_signals"),
    "live_plain": "SELECT *, NULL::BOOLEAN AS is_malicious, NULL::VARCHAR AS source, NULL::VARCHAR AS detail FROM live_remarked",
    "live_detected": _graded("live_plain"),
    "live_enriched": _enriched("live_remarked"),
    "live_analyzed": _graded("live_enriched"),
    "malicious_domains": """SELECT registrable_domain AS domain, min(seq) AS first_seq,
            arg_min(source, seq) AS source, arg_min(detail, seq) AS detail
        FROM analyzed WHERE is_malicious AND registrable_domain <> '' GROUP BY registrable_domain""",
}

_FLAGS = ", ".join(f"flags_{k}" for k in HEADER_BITS)

DETECTED_COLUMNS = f"""seq, source_ip, destination_ip, query, registrable_domain, subdomain,
    round(entropy, 9) AS entropy, round(z, 9) AS entropy_z_score, timestamp,
    qdcount, ancount, nscount, arcount, {_FLAGS},
    unique_count IS NOT NULL AS subdomain_burst, unique_count AS subdomain_burst_unique_count,
    round(ratio, 9) AS host_nxdomain_ratio, severity, remark"""
ANALYZED_COLUMNS = f"""{DETECTED_COLUMNS}, is_malicious AS threat_intel_is_malicious,
    source AS threat_intel_source, detail AS threat_intel_detail"""

_STAMP = "2027-01-15T08:00:00.000000Z"  # t.NOW as text


CTES["digests"] = """SELECT *, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(domain)) AS h,
        (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 AS variant
    FROM malicious_domains"""
CTES["indicators"] = f"""SELECT first_seq, 'indicator' AS type, '2.1' AS spec_version,
        concat('indicator--', substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',
               substr('89ab', variant + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS id,
        '{_STAMP}' AS created, '{_STAMP}' AS modified,
        concat('Malicious domain: ', domain) AS name,
        concat('Flagged by ', source, ': ', detail) AS description,
        ['malicious-activity'] AS indicator_types,
        concat('[domain-name:value = ''', domain, ''']') AS pattern,
        'stix' AS pattern_type, '{_STAMP}' AS valid_from
    FROM digests"""

_F = ForwardSettings()
_ESC = "replace(replace({0}, chr(92), chr(92) || chr(92)), '{1}', chr(92) || '{1}')"


def _cef(rows: str) -> str:
    header, extension = _ESC.format("remark", "|"), _ESC
    pairs = [
        ("src", "source_ip"),
        ("dst", "destination_ip"),
        ("request", "query"),
        ("msg", "remark"),
    ]
    text = ", ' ', ".join(f"'{k}=', {extension.format(c, '=')}" for k, c in pairs)
    return f"""SELECT seq, severity, concat(
            'CEF:0|{_F.vendor}|{_F.product}|{_F.version}|dns-anomaly|', substr({header}, 1, 200), '|',
            CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 4 ELSE 1 END, '|',
            {text}, ' cs1Label=registrableDomain',
            CASE WHEN registrable_domain <> '' THEN concat(' cs1=', registrable_domain) ELSE '' END,
            ' cn1Label=entropy cn1=', {_fmt("entropy", 4)}, ' cs2Label=severity cs2=', severity) AS line
        FROM {rows}"""


def _alerts(rows: str) -> str:
    return f"""SELECT seq, severity, message,
            CAST(to_json(struct_pack(text := message, content := message)) AS VARCHAR) AS payload
        FROM (SELECT seq, severity, concat('[', upper(severity), '] DNS anomaly: ', query, ' (source ',
                source_ip, ' -> ', destination_ip, ')', chr(10), remark) AS message
              FROM {rows} WHERE severity IN ('high', 'critical'))"""


_FLAG_LINES = ", chr(10), ".join(f"'  {k}: ', flags_{k}" for k in HEADER_BITS)

# Query name -> the final SELECT; the WITH clauses it needs are found by name.
FINAL: dict[str, str] = {
    "dns_log": "SELECT * FROM dns_log",
    "pcap_scan": "SELECT * EXCLUDE (seq), true AS in_order FROM dns_log",
    "skip_summary": """SELECT count(*) FILTER (seq % 13 <> 0) AS messages,
            count(*) FILTER (seq % 13 = 0) AS skipped,
            CAST(4 AS BIGINT) AS unread, CAST(4 * 26 AS BIGINT) AS unread_bytes
        FROM dns_log WHERE seq % 17 <> 0 AND seq % 19 <> 0""",
    "header_bits": """SELECT seq, CAST(qr * 32768 + opcode * 2048 + aa * 1024 + tc * 512 + rd * 256
            + ra * 128 + rcode AS INT) AS word, qr, opcode, aa, tc, rd, ra, rcode FROM dns_log""",
    "flags_decoded": f"SELECT seq, {_FLAGS}, concat({_FLAG_LINES}) AS flags_text FROM base",
    "entropy": "SELECT seq, scoring_label, round(entropy, 9) AS entropy FROM base",
    "domain_parts": "SELECT seq, query, registrable_domain, subdomain, scoring_label FROM base",
    "dns_records": f"""SELECT seq, source_ip, destination_ip, query, registrable_domain, subdomain,
            round(entropy, 9) AS entropy, timestamp, qdcount, ancount, nscount, arcount, {_FLAGS},
            base_remark AS remark FROM records""",
    "base_remark": "SELECT seq, base_remark AS remark FROM records",
    "host_baselines": """SELECT source_ip, round(mean, 9) AS mean, round(stdev, 9) AS stdev, sample_count
        FROM baselines""",
    "subdomain_bursts": "SELECT * FROM bursts",
    "nxdomain_ratios": "SELECT client, round(ratio, 9) AS ratio, sample_count FROM ratios",
    "entropy_zscores": """SELECT seq, source_ip, round(entropy, 9) AS entropy, round(z, 9) AS entropy_z_score
        FROM batch_signals""",
    "burst_records": """SELECT seq, unique_count IS NOT NULL AS subdomain_burst,
            unique_count AS subdomain_burst_unique_count FROM batch_signals""",
    "nxdomain_records": """SELECT seq, destination_ip, round(ratio, 9) AS host_nxdomain_ratio
        FROM batch_signals""",
    "detection_signals": f"SELECT {DETECTED_COLUMNS} FROM detected".replace("severity, remark", "remark"),
    "severity": "SELECT seq, severity, remark FROM detected",
    "analyze": f"SELECT {ANALYZED_COLUMNS} FROM analyzed",
    "live_baseline": """SELECT seq, round(entropy, 9) AS entropy, round(z, 9) AS entropy_z_score
        FROM live_signals WHERE flags_qr = 'QUERY'""",
    "live_burst": "SELECT seq, registrable_domain, subdomain, ts_us, unique_count FROM live_counts",
    "live_nxdomain": """SELECT seq, destination_ip, round(ratio, 9) AS host_nxdomain_ratio
        FROM live_signals WHERE flags_qr = 'RESPONSE'""",
    "live_detection": f"SELECT {DETECTED_COLUMNS} FROM live_detected",
    "stream_detection": f"SELECT {DETECTED_COLUMNS} FROM live_detected",
    "stream_enriched": f"SELECT {ANALYZED_COLUMNS} FROM live_analyzed",
    "stream_alerts": f"SELECT payload FROM ({_alerts('live_analyzed')})",
    "phish_feed_domains": "SELECT domain FROM feed",
    "phish_feed_hits": "SELECT * FROM feed_hits",
    "intel_urlhaus": "SELECT * FROM host_hits",
    "intel_vendor_report": "SELECT * FROM vendor_hits",
    "intel_verdicts": "SELECT * FROM fresh",
    "intel_cache": "SELECT * FROM verdict_table",
    "intel_annotated": """SELECT seq, registrable_domain, is_malicious, source, detail, checked_at, remark
        FROM batch_enriched""",
    "lookup_candidates": f"""SELECT domain, first_seq, first_ts_us FROM unsettled
        ORDER BY first_seq LIMIT {I.max_lookups}""",
    "alerts": _alerts("analyzed"),
    "cef_lines": _cef("analyzed"),
    "csv_flat": f"""SELECT * EXCLUDE (seq) FROM (SELECT {ANALYZED_COLUMNS} FROM analyzed)""",
    "cef_file": f"""SELECT line FROM ({_cef("analyzed")})""",
    "json_records": f"""SELECT {ANALYZED_COLUMNS}, checked_at AS threat_intel_checked_at FROM analyzed""",
    "report_blocks": f"""SELECT seq, concat('Query: ', query, chr(10), 'Source: ', source_ip, ' -> Destination: ',
            destination_ip, chr(10), 'Entropy: ', {_fmt("entropy", 4)}, ' (z-score: ',
            CASE WHEN z IS NULL THEN 'N/A' ELSE {_fmt("z", 2)} END, ')', chr(10), 'Flags:', chr(10),
            {_FLAG_LINES}, chr(10), 'Remark: ', remark, chr(10),
            '-------------------------------------------------') AS block FROM analyzed""",
    "stix_indicators": "SELECT * REPLACE (indicator_types[1] AS indicator_types) FROM indicators",
    "stix_bundle": f"""SELECT 0 AS part, CAST(0 AS BIGINT) AS first_seq,
            '{{"type":"bundle","id":"bundle--00000000-0000-4000-8000-000000000000","objects":[' AS line
        UNION ALL
        SELECT 1, first_seq, concat(CASE WHEN first_seq = (SELECT min(first_seq) FROM indicators) THEN '' ELSE ',' END,
            CAST(to_json(struct_pack(type := type, spec_version := spec_version, id := id, created := created,
                modified := modified, name := name, description := description,
                indicator_types := indicator_types, pattern := pattern, pattern_type := pattern_type,
                valid_from := valid_from)) AS VARCHAR)) FROM indicators
        UNION ALL SELECT 2, 0, ']}}'""",
}

FINAL["stix_file"] = f"SELECT line FROM ({FINAL['stix_bundle']})"
FINAL["report_file"] = f"""SELECT line, count(*) AS times
    FROM (SELECT unnest(string_split(block, chr(10))) AS line FROM ({FINAL["report_blocks"]}))
    GROUP BY line"""

# Greedy spacing needs the pick before: a recursive query, one step per lookup.
SCHEDULE = f"""WITH RECURSIVE {{ctes}},
picks AS (
    SELECT 1 AS lookup_no, min(first_ts_us) AS picked_us FROM unsettled
    UNION ALL
    SELECT lookup_no + 1, (SELECT min(first_ts_us) FROM unsettled
                           WHERE first_ts_us >= picked_us + {int(I.min_interval_seconds * 1_000_000)})
    FROM picks WHERE lookup_no < {I.max_lookups} AND picked_us IS NOT NULL)
{{final}}"""
LOOKED_UP = "FROM picks JOIN unsettled ON first_ts_us = picked_us"
BUDGETED = f"""SELECT domain, is_malicious AND NOT skipped AS is_malicious,
    CASE WHEN NOT skipped THEN source END AS source,
    CASE WHEN skipped THEN 'no match in any enabled feed' ELSE detail END AS detail, checked_at
FROM (SELECT *, coalesce(source = 'virustotal' AND domain IN (SELECT domain FROM unsettled)
          AND domain NOT IN (SELECT domain {LOOKED_UP}), false) AS skipped FROM verdict_table)"""


def _needs(text: str) -> set[str]:
    words = set(re.findall(r"[a-z_]+", text))
    return {name for name in CTES if name in words}


def _with(text: str) -> str:
    """The WITH clauses that `text` needs, in definition order."""
    wanted: set[str] = set()
    open_names = _needs(text)
    while open_names:
        wanted |= open_names
        open_names = set().union(*[_needs(CTES[n]) for n in open_names]) - wanted
    return ",\n".join(f"{name} AS ({body})" for name, body in CTES.items() if name in wanted)


def oracle_sql() -> dict[str, str]:
    sql = {name: f"WITH {_with(final)}\n{final}" for name, final in FINAL.items()}
    picked = "SELECT CAST(lookup_no AS INT) AS lookup_no, domain, first_seq, first_ts_us"
    finals = {"lookup_schedule": f"{picked} {LOOKED_UP}", "intel_budgeted": BUDGETED}
    for name, final in finals.items():
        sql[name] = SCHEDULE.replace("{ctes}", _with("unsettled verdict_table")).replace("{final}", final)
    return sql
