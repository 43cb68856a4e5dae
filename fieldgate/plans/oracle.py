"""DuckDB SQL for the registered queries: expected results from the keys' arithmetic, never from rendered text."""

from __future__ import annotations

from ..functions.scalars import DIRECTIONS, SUFFIXES, UNITS

#: Orders, lines as listed (with the planted copy), and what each version is expected to make of each packet.
_BASE = """
WITH o AS (SELECT o_orderkey AS k, o_custkey, o_orderdate::DATE AS day, 'PKT-' || lpad(o_orderkey::VARCHAR, 9, '0') AS packet_id FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS r,
    count(*) OVER (PARTITION BY l_orderkey) AS n, (floor(l_extendedprice + 0.5) * 100)::BIGINT AS b FROM lineitem),
x AS (SELECT k, packet_id, r, n, false AS is_copy, (100 + 10 * (r - 1)) || ' Quarry' || (l_partkey % 997) || ' Ave' AS address, lpad(((k * 31 + r * 37) % 100000)::VARCHAR, 5, '0') AS zip,
    CASE WHEN r = 1 AND k % 17 = 0 THEN (b // 100000) * 100000 ELSE b END AS listed, trunc(l_quantity)::BIGINT * 1000 AS contents, (l_partkey % 500) * 1000 AS bi,
    CASE k % 4 WHEN 0 THEN 'Frame' WHEN 1 THEN 'Joisted Masonry' WHEN 2 THEN 'Non-Combustible' ELSE 'Fire Resistive' END AS kind, CASE WHEN r = 1 AND k % 11 = 0 THEN NULL ELSE 1950 + l_suppkey % 70 END AS year
  FROM o JOIN l ON l_orderkey = k),
a AS (SELECT * FROM x UNION ALL SELECT k, packet_id, n + 1, n, true, address || 'nue', zip, listed, contents + CASE WHEN k % 10 = 0 THEN 5000 ELSE 0 END, bi, kind, 1999 FROM x WHERE r = 1 AND k % 5 = 0),
s AS (SELECT k, max(n) AS n, sum(CASE WHEN is_copy THEN 0 ELSE listed + contents + bi END)::BIGINT AS orig, sum(listed + contents + bi)::BIGINT AS every,
    sum(CASE WHEN r = 1 AND k % 17 = 0 THEN contents + bi ELSE listed + contents + bi END)::BIGINT AS strict FROM a GROUP BY k),
p AS (SELECT o.*, coalesce(n, 0) AS n, coalesce(orig, 0) AS orig, every, strict, n IS NOT NULL AND k % 5 = 0 AS copied, n IS NOT NULL AND k % 19 = 0 AS amended, n IS NOT NULL AND k % 11 = 0 AS blanked,
    n IS NOT NULL AND k % 17 = 0 AS shorted, k % 4 AS n_claims, CASE WHEN k % 4 > 0 THEN (k % 97) * 100 * ((k % 4) * (k % 4 + 1) // 2) + (k % 4) * (k % 13) * 50 END AS incurred,
    strftime(day, '%Y-%m-%d') AS received, CASE WHEN k % 31 = 0 THEN '2026-02-30' ELSE strftime(day + (k % 500)::INTEGER, '%Y-%m-%d') END AS effective, day + (k % 500)::INTEGER AS b FROM o LEFT JOIN s USING (k)),
t AS (SELECT *, orig + CASE WHEN amended THEN 1000000 ELSE 0 END AS truth, orig + CASE WHEN k % 13 = 0 THEN 50000 ELSE 0 END AS t_stated FROM p),
v AS (
  SELECT 'v1-regex' AS version_id, 40000000 AS ceiling, *, k % 29 = 0 AS no_name, CASE WHEN k % 23 > 0 THEN t_stated END AS stated, strict AS listed, strict AS computed, shorted::INT AS unreadable,
    false AS dup, false AS change, k % 7 = 0 AND n > 0 AS no_kind, blanked AS no_year, false AS guessed FROM t
  UNION ALL SELECT 'v2-heuristic', 50000000, *, false, t_stated, every, CASE WHEN n > 0 THEN truth END, 0, copied, amended, false, false, blanked FROM t
  UNION ALL SELECT 'v2.1-no-backfill', 50000000, *, false, t_stated, every, CASE WHEN n > 0 THEN truth END, 0, copied, amended, false, blanked, false FROM t),
c AS (SELECT *, n = 0 OR no_name OR unreadable > 0 AS unread,
    CASE WHEN computed IS NULL THEN 'not_evaluated' WHEN computed > ceiling THEN 'flag' ELSE 'pass' END AS gl1, CASE WHEN listed IS NULL THEN 'not_evaluated' WHEN listed > ceiling THEN 'flag' ELSE 'pass' END AS gl1_listed,
    CASE WHEN n = 0 OR no_name OR unreadable > 0 OR stated IS NULL OR no_kind OR no_year THEN 'flag' ELSE 'pass' END AS gl2,
    CASE WHEN k % 31 = 0 THEN 'not_evaluated' WHEN (year(b) - year(day)) * 12 + month(b) - month(day) + (day(b) - day(day)) / 30.44 > 12 THEN 'flag' ELSE 'pass' END AS gl3,
    CASE WHEN incurred IS NULL OR computed IS NULL OR computed <= 0 THEN 'not_evaluated' WHEN incurred / computed * 100 > 1.5 THEN 'flag' ELSE 'pass' END AS gl4,
    CASE WHEN incurred IS NULL OR listed IS NULL OR listed <= 0 THEN 'not_evaluated' WHEN incurred / listed * 100 > 1.5 THEN 'flag' ELSE 'pass' END AS gl4_listed,
    CASE WHEN dup THEN 'flag' ELSE 'pass' END AS gl5,
    coalesce(abs(computed - stated) > 1000 AND NOT (dup AND abs(listed - stated) <= 1000) AND NOT (change AND abs(computed - stated - 1000000) <= 1000), false) AS cf1,
    k % 37 = 0 AND n_claims > 0 AS cf2, dup AND k % 10 = 0 AS cf3, guessed AS cf4 FROM v),
r AS (SELECT *, (dup OR change) AND gl1 <> gl1_listed AS d1, (dup OR change) AND gl4 <> gl4_listed AS d2 FROM c),
run AS (SELECT *, CASE WHEN unread OR cf1 OR cf2 OR d1 OR d2 THEN 'referred' WHEN 'flag' IN (gl1, gl3, gl4) THEN 'decline' ELSE 'quote' END AS decision, unread OR cf1 OR cf2 OR d1 OR d2 AS abstained,
    concat_ws(',', CASE WHEN unread THEN 'NOT_READABLE' END, CASE WHEN cf1 THEN 'UNRECONCILED' END, CASE WHEN cf2 THEN 'UNRECONCILED' END, CASE WHEN d1 THEN 'ADJUSTMENT_DECISIVE' END, CASE WHEN d2 THEN 'ADJUSTMENT_DECISIVE' END) AS reasons,
    concat_ws(',', CASE WHEN gl1 = 'flag' THEN 'GL-001' END, CASE WHEN gl2 = 'flag' THEN 'GL-002' END, CASE WHEN gl3 = 'flag' THEN 'GL-003' END, CASE WHEN gl4 = 'flag' THEN 'GL-004' END, CASE WHEN gl5 = 'flag' THEN 'GL-005' END) AS flags,
    CASE WHEN n = 0 THEN 0.1 WHEN unreadable > 0 THEN 0.45 ELSE 0.94 END AS tiv_confidence FROM r),
wrong AS (
  SELECT version_id, packet_id, 'insuredName' AS key FROM run WHERE no_name
  UNION ALL SELECT version_id, packet_id, 'statedTiv' FROM run WHERE stated IS NULL
  UNION ALL SELECT version_id, packet_id, 'computedTiv' FROM run WHERE computed IS DISTINCT FROM CASE WHEN n > 0 THEN truth END
  UNION ALL SELECT version_id, packet_id, 'locationCount' FROM run WHERE copied AND NOT dup
  UNION ALL SELECT version_id, packet_id, 'L1.buildingValue' FROM run WHERE unreadable > 0 OR amended AND NOT change
  UNION ALL SELECT version_id, x.packet_id, 'L' || x.r || '.constructionType' FROM run JOIN x USING (k) WHERE no_kind
  UNION ALL SELECT version_id, packet_id, 'L1.yearBuilt' FROM run WHERE guessed),
mv AS (
  SELECT w.packet_id, w.key, 'improvement' AS kind FROM wrong w WHERE version_id = 'v1-regex' AND NOT EXISTS (FROM wrong z WHERE z.version_id = 'v2-heuristic' AND z.packet_id = w.packet_id AND z.key = w.key)
  UNION ALL SELECT w.packet_id, w.key, 'regression' FROM wrong w WHERE version_id = 'v2-heuristic' AND NOT EXISTS (FROM wrong z WHERE z.version_id = 'v1-regex' AND z.packet_id = w.packet_id AND z.key = w.key)),
tot AS (SELECT version_id, packet_id, 8 + 9 * n - coalesce(w, 0) AS correct, 8 + 9 * n AS total FROM run LEFT JOIN (SELECT version_id, packet_id, count(*) AS w FROM wrong GROUP BY ALL) USING (version_id, packet_id))
"""
_TWO = "version_id IN ('v1-regex', 'v2-heuristic')"
_V1, _V2 = "version_id = 'v1-regex'", "version_id = 'v2-heuristic'"
_SPELL = """WITH z AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT AS n, 1 + floor(l_extendedprice)::BIGINT % 999 AS k FROM lineitem),
y AS (SELECT *, CASE l_orderkey % 6 WHEN 0 THEN '$' || n WHEN 1 THEN '$' || k || 'K' WHEN 2 THEN n::VARCHAR WHEN 3 THEN ' $' || k || '.5k ' WHEN 4 THEN 'TBD' ELSE '$' || k || ',000' END AS raw FROM z)"""
_DUPLICATES = "SELECT packet_id, 0 AS keep_idx, n AS dup_idx, 'exact-normalized' AS basis FROM run WHERE"
_LINES = "SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS line_no FROM documents"


def _locations(v: str) -> str:
    strict = v == _V1
    building = "CASE WHEN a.r = 1 AND a.k % 17 = 0 THEN NULL ELSE a.listed END" if strict else "a.listed"
    blank = "a.r = 1 AND a.k % 11 = 0"
    return _BASE + f"""SELECT a.packet_id, 'L' || a.r AS loc_id, address, {building} AS buildingValue, contents AS contentsValue, bi AS biValue, {"CASE WHEN a.k % 7 > 0 THEN kind END" if strict else "kind"} AS constructionType,
      {"a.year" if strict else f"CASE WHEN {blank} THEN 2019 ELSE a.year END"} AS yearBuilt, {"CASE WHEN a.r = 1 AND a.k % 17 = 0 THEN 'currency-parse-fail' ELSE 'label:Building' END" if strict else "'label:Building'"} AS building_method,
      CASE WHEN {blank} THEN '{"explicit-blank" if strict else "context-backfill"}' ELSE 'label:Year Built' END AS year_method, CASE WHEN {blank} THEN {0.9 if strict else 0.5} ELSE 0.96 END::DOUBLE AS year_confidence FROM a"""


def _gate(a: str, b: str) -> str:
    lost = f"(SELECT count(*) FROM wrong w WHERE version_id = '{b}' AND NOT EXISTS (FROM wrong z WHERE z.version_id = '{a}' AND z.packet_id = w.packet_id AND z.key = w.key))"
    won = f"(SELECT count(*) FROM wrong w WHERE version_id = '{a}' AND NOT EXISTS (FROM wrong z WHERE z.version_id = '{b}' AND z.packet_id = w.packet_id AND z.key = w.key))"
    return f"SELECT '{a}' AS baseline, '{b}' AS candidate, {lost} AS regressions, {won} AS improvements, {won} - {lost} AS net, CASE WHEN {lost} = 0 THEN 'clean' ELSE 'regressed' END AS verdict"


def _drill(id: str, base: str, cand: str, blank: bool, fixed: int) -> str:
    """The first correct key of the first packet by binary order: packet, then key; decoys fix wrong keys in packet and item order."""
    items = """, items AS (
      SELECT packet_id, key, is_blank FROM (
        SELECT packet_id, 'insuredName' AS key, false AS is_blank FROM t UNION ALL SELECT packet_id, 'receivedDate', false FROM t UNION ALL SELECT packet_id, 'requestedEffectiveDate', false FROM t UNION ALL SELECT packet_id, 'statedTiv', false FROM t
        UNION ALL SELECT packet_id, 'computedTiv', n = 0 FROM t UNION ALL SELECT packet_id, 'lossRunTotalIncurred', incurred IS NULL FROM t UNION ALL SELECT packet_id, 'lossCount', false FROM t UNION ALL SELECT packet_id, 'locationCount', false FROM t
        UNION ALL SELECT packet_id, 'L' || r || '.' || f, f = 'yearBuilt' AND year IS NULL FROM x, unnest(['address', 'city', 'state', 'zip', 'buildingValue', 'contentsValue', 'biValue', 'constructionType', 'yearBuilt']) AS u(f)))"""
    chosen = f"(SELECT min(packet_id || '/' || key) FROM items i WHERE {'is_blank' if blank else 'true'} AND NOT EXISTS (FROM wrong w WHERE w.version_id = '{cand}' AND w.packet_id = i.packet_id AND w.key = i.key))"
    n_fixed = f"(SELECT least({fixed}, count(*)) FROM wrong WHERE version_id = '{cand}')"
    return _BASE + items + f"""SELECT '{id}' AS drill_id, split_part(c, '/', 1) AS packet_id, split_part(c, '/', 2) AS key, {n_fixed} AS fixed,
      CASE WHEN NOT named AND others = 0 THEN 'clean' ELSE 'regressed' END AS verdict, named OR others > 0 AS caught, named FROM (
        SELECT c, NOT EXISTS (FROM wrong w WHERE w.version_id = '{base}' AND w.packet_id || '/' || w.key = c) AS named,
          (SELECT count(*) FROM wrong w WHERE w.version_id = '{cand}' AND NOT EXISTS (FROM wrong z WHERE z.version_id = '{base}' AND z.packet_id = w.packet_id AND z.key = w.key)) AS others FROM (SELECT {chosen} AS c))"""


_CALIBRATION = """, low AS (
  SELECT version_id, sum(no_name::INT + (stated IS NULL)::INT + (n = 0 OR unreadable > 0)::INT + 2 * (n_claims = 0)::INT + unreadable + CASE WHEN no_kind THEN n ELSE 0 END + guessed::INT)::BIGINT AS n,
    sum((n = 0 OR unreadable > 0 AND computed = truth)::INT + 2 * (n_claims = 0)::INT)::BIGINT AS correct, sum(8 + 9 * n)::BIGINT AS every FROM run GROUP BY version_id),
  bad AS (SELECT version_id, count(*) AS w FROM wrong GROUP BY version_id)
SELECT version_id, band, CASE band WHEN 0 THEN n WHEN 3 THEN every - n ELSE 0 END AS n, CASE band WHEN 0 THEN correct WHEN 3 THEN every - coalesce(w, 0) - correct ELSE 0 END AS correct,
  CASE band WHEN 0 THEN round(correct / nullif(n, 0), 8) WHEN 3 THEN round((every - coalesce(w, 0) - correct) / nullif(every - n, 0), 8) END AS accuracy FROM low LEFT JOIN bad USING (version_id), range(4) AS g(band)"""


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _normal(c: str) -> str:
    """normalize_address in DuckDB: the same fixed word lists."""
    s = f"upper(coalesce({c}, ''))"
    s = f"trim(regexp_replace(regexp_replace(replace({s}, '#', ' UNIT '), '[.,;:''\"()\\-/\\\\]', ' ', 'g'), '\\s+', ' ', 'g'))"
    for unit in UNITS:
        s = f"regexp_replace({s}, '\\b{unit}\\b\\s*[A-Z0-9-]*', ' ', 'g')"
    table = SUFFIXES | DIRECTIONS
    words = f"list_filter(regexp_split_to_array({s}, ' +'), lambda w: w <> '')"
    return f"array_to_string(list_transform({words}, lambda w: coalesce(list_extract([{_quoted(table.values())}], nullif(list_position([{_quoted(table)}], w), 0)), w)), ' ')"


_ADDRESSES = """WITH a AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN (p_partkey % 900) || ' N ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' Ave, Suite ' || p_size
    WHEN 1 THEN (p_partkey % 900) || ' ' || p_name || ' St.' WHEN 2 THEN (p_partkey % 900) || ' ' || p_name || ' Blvd #' || p_size WHEN 3 THEN (p_partkey % 900) || '-' || p_size || ' SW ' || p_name || ' rd'
    WHEN 4 THEN '   ' ELSE (p_partkey % 900) || ' ' || p_name || ' Pkwy (rear)' END AS raw, lpad((p_partkey % 7)::VARCHAR, 5, '0') AS zip FROM part), b AS (SELECT *, """ + "{norm} AS norm FROM a)"


def sql() -> dict[str, str]:
    check = {name: _BASE + f"SELECT version_id, packet_id, {column} AS status FROM run WHERE {_TWO}" for name, column in (("check_appetite", "gl1"), ("check_completeness", "gl2"), ("check_window", "gl3"), ("check_loss_ratio", "gl4"), ("check_duplicates", "gl5"))}
    kinds = "CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'decline' ELSE 'needs-info' END"
    return check | {
        "doc_line_index": f"""WITH z AS ({_LINES})
          SELECT doc_id, line_no, (coalesce(sum(length(line) + 1) OVER w, 0))::BIGINT AS start, (coalesce(sum(length(line) + 1) OVER w, 0) + length(line))::BIGINT AS "end", sha256(line) AS line_sha256 FROM z
          WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        "span_lookup": """SELECT doc_id, "at", length(left(text, "at")) - length(replace(left(text, "at"), chr(10), '')) + 1 AS line_no, substring(text, "at" + 1, 12) AS snippet, substring(text, "at" + 1, 12) AS marked
          FROM (SELECT doc_id, text, doc_id * 7919 % length(text) AS "at" FROM documents WHERE length(text) > 0)""",
        "corpus_index": "SELECT source, count(*) AS documents, sum(length(text))::BIGINT AS chars, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents GROUP BY source",
        "record_cells": _BASE + """, f AS (SELECT *, regexp_replace(CASE WHEN is_copy OR r > 1 OR k % 17 > 0 THEN '$' || format('{:,}', listed) ELSE '$' || printf('%.1f', listed / 1e6) || 'M' END, '^$', '') AS bt FROM a),
          g AS (SELECT packet_id, r, [ 'LOC', 'L' || r, address, 'Alton, NY ' || zip, 'Building: ' || bt, 'Contents: $' || format('{:,}', contents), 'BI: $' || format('{:,}', bi),
            CASE WHEN k % 7 = 0 THEN 'Constr: ' ELSE 'Construction: ' END || kind, 'Year Built:' || coalesce(' ' || year, '')] AS cells FROM f),
          h AS (SELECT *, sum(list_sum(list_transform(cells, lambda c: length(c))) + 8 * 3 + 1) OVER (PARTITION BY packet_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
          i AS (SELECT packet_id, r + 2 AS line_no, cells, 20 + coalesce(before, 0) AS base, unnest(range(9)) AS pos FROM h)
          SELECT packet_id, line_no, pos, (base + coalesce(list_sum(list_transform(cells[1:pos], lambda c: length(c) + 3)), 0))::BIGINT AS start,
            (base + coalesce(list_sum(list_transform(cells[1:pos], lambda c: length(c) + 3)), 0) + length(cells[pos + 1]))::BIGINT AS "end", cells[pos + 1] AS text FROM i""",
        "parse_currency": _SPELL + """ SELECT raw, CASE l_orderkey % 6 WHEN 0 THEN CASE WHEN n < 1000 THEN n END WHEN 5 THEN k * 1000 END AS strict_value,
          CASE l_orderkey % 6 WHEN 0 THEN n WHEN 1 THEN k * 1000 WHEN 2 THEN n WHEN 3 THEN k * 1000 + 500 WHEN 5 THEN k * 1000 END AS loose_value FROM y""",
        "format_usd": _SPELL + """ SELECT l_orderkey, l_linenumber, m AS n, CASE WHEN m IS NULL THEN '--' WHEN m < 0 THEN '-$' || format('{:,}', -m) ELSE '$' || format('{:,}', m) END AS usd
          FROM (SELECT *, CASE WHEN l_orderkey % 50 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN -n ELSE n * 1000 END AS m FROM y)""",
        "parse_iso_date": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '2026-02-30' WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE ' ' || strftime(o_orderdate, '%Y-%m-%d') END AS raw,
          CASE WHEN o_orderkey % 5 > 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
        "date_gaps": """SELECT o_orderkey, (b - a)::BIGINT AS days, round((year(b) - year(a)) * 12 + month(b) - month(a) + (day(b) - day(a)) / 30.44::DOUBLE, 6) AS months
          FROM (SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 500 - 50)::INTEGER AS b FROM orders)""",
        "normalize_address": _ADDRESSES.replace("{norm}", _normal("raw")) + f""" SELECT p_partkey, raw, norm, nullif(list_reduce(list_prepend('', list_filter(string_split(norm, ' '), lambda w: length(w) >= 4 AND NOT regexp_matches(w, '^[0-9]') AND NOT list_contains([{_quoted(sorted({*SUFFIXES, *SUFFIXES.values(), *DIRECTIONS, *DIRECTIONS.values()}))}], w))),
          lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END), '') AS token, norm || '|' || zip AS key FROM b""",
        "address_similarity": _ADDRESSES.replace("{norm}", _normal("raw")) + """, c AS (SELECT x.p_partkey, x.norm AS p, y.norm AS q, x.zip = y.zip AS same, trim(upper(x.raw)) AS rp, trim(upper(y.raw)) AS rq, levenshtein(x.norm, y.norm) AS distance, greatest(length(x.norm), length(y.norm)) AS longest FROM b x JOIN b y ON y.p_partkey = x.p_partkey + 42),
          d AS (SELECT *, CASE WHEN longest = 0 THEN 1.0 ELSE 1 - distance / longest END::DOUBLE AS s FROM c)
          SELECT p_partkey, distance, round(s, 6) AS similarity, rp <> '' AND rp = rq AND same OR p <> '' AND q <> '' AND same AND (p = q OR s >= 0.92) AS match,
            CASE WHEN rp <> '' AND rp = rq AND same THEN 'exact-raw' WHEN p = '' OR q = '' OR NOT same THEN 'none' WHEN p = q THEN 'exact-normalized' WHEN s >= 0.92 THEN 'fuzzy' ELSE 'none' END AS basis FROM d""",
        "city_state_zip": _BASE + "SELECT 'Alton' AS city, 'NY' AS state, left(zip, 2) AS zip2, 0.98::DOUBLE AS confidence, count(*) AS n FROM a GROUP BY ALL",
        "extract_locations_v1": _locations(_V1),
        "extract_locations_v2": _locations(_V2),
        "null_taxonomy": _BASE + """, i AS (SELECT u.f AS field, CASE WHEN f = 'address' THEN 'sov-row' WHEN f IN ('city', 'state', 'zip') THEN 'city-state-zip' WHEN f = 'buildingValue' THEN CASE WHEN r = 1 AND k % 17 = 0 THEN 'currency-parse-fail' ELSE 'label:Building' END
            WHEN f = 'contentsValue' THEN 'label:Contents' WHEN f = 'biValue' THEN 'label:BI' WHEN f = 'constructionType' THEN CASE WHEN k % 7 = 0 THEN 'label-miss' ELSE 'label:Construction' END ELSE CASE WHEN r = 1 AND k % 11 = 0 THEN 'explicit-blank' ELSE 'label:Year Built' END END AS method
          FROM a, unnest(['address', 'city', 'state', 'zip', 'buildingValue', 'contentsValue', 'biValue', 'constructionType', 'yearBuilt']) AS u(f))
          SELECT field, method, CASE WHEN method = 'currency-parse-fail' THEN 0.25 WHEN method = 'label-miss' THEN 0.2 WHEN method = 'explicit-blank' THEN 0.9 WHEN field = 'address' THEN 0.97 WHEN field IN ('state', 'zip') THEN 0.98 WHEN field = 'constructionType' THEN 0.95 ELSE 0.96 END::DOUBLE AS confidence, count(*) AS n FROM i GROUP BY ALL""",
        "extract_application": _BASE + f"""SELECT packet_id, CASE WHEN NOT no_name THEN 'Customer ' || o_custkey END AS insuredName, CASE WHEN no_name THEN 'label-miss' ELSE 'label:Named Insured' END AS insuredName_method, received AS receivedDate, 'label:Date Received' AS receivedDate_method,
          effective AS requestedEffectiveDate, 'label:Proposed Effective Date' AS requestedEffectiveDate_method, stated AS statedTiv, CASE WHEN stated IS NULL THEN 'label-miss' ELSE 'label:Total Insured Value' END AS statedTiv_method FROM run WHERE {_V1}""",
        "extract_losses": _BASE + f"""SELECT packet_id, 'loss_run-claim-' || j AS loss_id, strftime(CASE WHEN j = 1 AND k % 37 = 0 THEN day + 10 ELSE day - (30 * j)::INTEGER END, '%Y-%m-%d') AS loss_date, 'Water' AS cause, (k % 97) * 100 * j AS paid, (k % 13) * 50 AS reserved, 'Closed' AS status
          FROM run, range(1, 4) AS g(j) WHERE {_V1} AND j <= n_claims""",
        "loss_totals": _BASE + f"SELECT packet_id, incurred, CASE WHEN n_claims > 0 THEN 0.95 ELSE 0.2 END::DOUBLE AS confidence, n_claims AS n, CASE WHEN n_claims > 0 THEN 0.97 ELSE 0.4 END::DOUBLE AS n_confidence FROM run WHERE {_V1}",
        "backfill_inferred": _BASE + f"SELECT packet_id, 'L1' AS loc_id, 2019 AS year, 0.5::DOUBLE AS confidence FROM run WHERE guessed AND {_V2}",
        "dedupe_exact": _BASE + f"{_DUPLICATES} dup AND {_V1}",
        "dedupe_normalized": _BASE + f"{_DUPLICATES} dup AND {_V2}",
        "apply_amendments": _BASE + f"SELECT run.packet_id, 'end-1' AS amendment_id, 'L1' AS loc_id, 'buildingValue' AS target_field, x.listed AS from_value, x.listed + 1000000 AS to_value, received AS amendment_date FROM run JOIN x ON x.k = run.k AND x.r = 1 WHERE change AND {_V2}",
        "foot_tiv": _BASE + f"SELECT version_id, packet_id, listed AS listed_tiv, computed AS computed_tiv, unreadable, tiv_confidence::DOUBLE AS confidence FROM run WHERE {_TWO}",
        "conflicts_all": _BASE + f"""SELECT version_id, packet_id, row_number() OVER (PARTITION BY version_id, packet_id ORDER BY id) - 1 AS ord, id AS conflict_id, severity FROM (
          SELECT version_id, packet_id, 'CF-001' AS id, 'high' AS severity FROM run WHERE cf1 UNION ALL SELECT version_id, packet_id, 'CF-002', 'medium' FROM run WHERE cf2 UNION ALL SELECT version_id, packet_id, 'CF-003', 'low' FROM run WHERE cf3
          UNION ALL SELECT version_id, packet_id, 'CF-004', 'low' FROM run WHERE cf4) WHERE {_TWO}""",
        "route_packets": _BASE + f"SELECT version_id, packet_id, decision, abstained, reasons, CASE WHEN n = 0 THEN 0.1 WHEN no_name THEN 0.2 ELSE tiv_confidence END::DOUBLE AS confidence, flags FROM run WHERE {_TWO}",
        "score_fields": _BASE + f"SELECT version_id, packet_id, correct, total, coalesce(wrong, '') AS wrong FROM tot LEFT JOIN (SELECT version_id, packet_id, string_agg(key, ',' ORDER BY key COLLATE C) AS wrong FROM wrong GROUP BY ALL) USING (version_id, packet_id) WHERE {_TWO}".replace(" COLLATE C", ""),
        "suite_summary": _BASE + f"""SELECT version_id, count(*) AS packets, sum(correct)::BIGINT AS correct, sum(total)::BIGINT AS total, sum(abstained::INT)::BIGINT AS abstained, count(*) FILTER (decision = 'quote') AS n_quote, count(*) FILTER (decision = 'decline') AS n_decline,
          count(*) FILTER (decision = 'referred') AS n_referred, round(sum(correct) / sum(total), 8) AS accuracy, round(sum(abstained::INT) / count(*), 8) AS abstention_rate FROM run JOIN tot USING (version_id, packet_id) WHERE {_TWO} GROUP BY version_id""",
        "version_movements": _BASE + "SELECT * FROM mv",
        "release_gate": _BASE + " UNION ALL ".join(_gate(a, b) for a, b in (("v1-regex", "v2-heuristic"), ("v2-heuristic", "v2.1-no-backfill"), ("v1-regex", "v2.1-no-backfill"))),
        "compare_packets": _BASE + """, q AS (SELECT packet_id, count(*) FILTER (kind = 'regression') AS regressions, count(*) FILTER (kind = 'improvement') AS improvements FROM mv GROUP BY packet_id),
          d AS (SELECT a.packet_id, a.decision AS b, c.decision AS c, string_split(a.flags, ',') AS fa, string_split(c.flags, ',') AS fc FROM run a JOIN run c USING (packet_id) WHERE a.version_id = 'v1-regex' AND c.version_id = 'v2-heuristic')
          SELECT packet_id, b AS baseline_decision, c AS candidate_decision, b <> c AS routing_changed, array_to_string(list_filter(fc, lambda f: f <> '' AND NOT list_contains(fa, f)), ',') AS flags_added, array_to_string(list_filter(fa, lambda f: f <> '' AND NOT list_contains(fc, f)), ',') AS flags_removed,
            coalesce(regressions, 0) AS regressions, coalesce(improvements, 0) AS improvements, coalesce(improvements, 0) - coalesce(regressions, 0) AS net FROM d LEFT JOIN q USING (packet_id)""",
        "movement_slices": _BASE + """, tags AS (SELECT packet_id, unnest(CASE WHEN len(g) = 0 THEN ['none'] ELSE g END) AS slice FROM (SELECT packet_id, list_filter([CASE WHEN blanked THEN 'MISSING_FIELD' END, CASE WHEN copied THEN 'DUPLICATE_LOCATION' END, CASE WHEN amended THEN 'LATE_ENDORSEMENT' END,
            CASE WHEN k % 13 = 0 AND n > 0 THEN 'CONFLICTING_LIMITS' END, CASE WHEN k % 31 = 0 AND n > 0 THEN 'INCONSISTENT_DATES' END], lambda z: z IS NOT NULL) AS g FROM t))
          SELECT slice, count(DISTINCT packet_id) AS packets, count(*) FILTER (kind = 'regression') AS regressions, count(*) FILTER (kind = 'improvement') AS improvements, count(*) FILTER (kind = 'improvement') - count(*) FILTER (kind = 'regression') AS net FROM mv JOIN tags USING (packet_id) GROUP BY slice""",
        "calibration_bands": _BASE + _CALIBRATION,
        "drill_single": _drill("single-field", "v2-heuristic", "v2.1-no-backfill", False, 0),
        "drill_blank": _drill("blank-fill", "v2-heuristic", "v2.1-no-backfill", True, 0),
        "drill_decoy": _drill("decoy-gains", "v1-regex", "v1-regex", False, 5),
        "whatif_ceiling": _BASE + f""", w AS (SELECT *, CASE WHEN computed > 30000000 THEN 'flag' WHEN computed IS NULL THEN 'not_evaluated' ELSE 'pass' END AS h1, CASE WHEN listed > 30000000 THEN 'flag' WHEN listed IS NULL THEN 'not_evaluated' ELSE 'pass' END AS h1_listed FROM run WHERE {_V2}),
          y AS (SELECT *, unread OR cf1 OR cf2 OR d2 OR (dup OR change) AND h1 <> h1_listed AS h_abstained FROM w), z AS (SELECT *, CASE WHEN h_abstained THEN 'referred' WHEN 'flag' IN (h1, gl3, gl4) THEN 'decline' ELSE 'quote' END AS h_decision,
            concat_ws(',', CASE WHEN h1 = 'flag' THEN 'GL-001' END, CASE WHEN gl2 = 'flag' THEN 'GL-002' END, CASE WHEN gl3 = 'flag' THEN 'GL-003' END, CASE WHEN gl4 = 'flag' THEN 'GL-004' END, CASE WHEN gl5 = 'flag' THEN 'GL-005' END) AS h_flags FROM y)
          SELECT packet_id, decision AS baseline_decision, h_decision AS decision, h_flags AS flags FROM z WHERE decision <> h_decision OR abstained <> h_abstained OR flags <> h_flags""",
        "corpus_manifest": """WITH h AS (SELECT source, sha256(concat_ws(chr(31), source, doc_id::VARCHAR, text)) AS h FROM documents), p AS (SELECT sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY source), b AS (SELECT sha256(string_agg(h, '' ORDER BY h)) AS h FROM p GROUP BY left(h, 4))
          SELECT sha256(string_agg(h, '' ORDER BY h)) AS corpus_hash FROM b""",
        "pdf_layout_noise": f"""WITH z AS ({_LINES}),
          y AS (SELECT doc_id, line_no, CASE WHEN (line_no - 1) % 40 = 0 THEN 'Form ACORD · Page ' || ((line_no - 1) // 40 + 1) || chr(10) ELSE '' END || line || CASE WHEN NOT regexp_matches(line, '\\S') THEN chr(10) ELSE '' END || CASE WHEN line_no % 40 = 0 THEN chr(10) || '— continued —' ELSE '' END AS part FROM z)
          SELECT doc_id, sha256(string_agg(part, chr(10) ORDER BY line_no)) AS sha256 FROM y GROUP BY doc_id""",
        "latest_review": f"SELECT 'v' || (event_id % 2 + 1) AS versionId, user_id::VARCHAR AS packetId, arg_max({kinds}, event_id) AS decision, max(event_id) AS seq FROM events GROUP BY ALL",
        "review_history": f"SELECT event_id AS seq, 'v' || (event_id % 2 + 1) AS versionId, {kinds} AS decision FROM events WHERE user_id = 7 ORDER BY seq",
        "review_queue": _BASE + f""", g AS (SELECT 'PKT-' || lpad(user_id::VARCHAR, 9, '0') AS packet_id, arg_max({kinds}, event_id) AS review_decision FROM events GROUP BY ALL)
          SELECT packet_id, reasons, concat_ws(',', CASE WHEN gl1 <> 'pass' THEN 'GL-001' END, CASE WHEN gl2 <> 'pass' THEN 'GL-002' END, CASE WHEN gl3 <> 'pass' THEN 'GL-003' END, CASE WHEN gl4 <> 'pass' THEN 'GL-004' END, CASE WHEN gl5 <> 'pass' THEN 'GL-005' END) AS open_checks,
            cf1::INT + cf2::INT + cf3::INT + cf4::INT AS conflicts, listed AS listed_tiv, computed AS computed_tiv, review_decision, coalesce(review_decision IN ('approve', 'decline'), false) AS cleared FROM run LEFT JOIN g USING (packet_id) WHERE {_V1} AND abstained""",
        "low_confidence": _BASE + f"""SELECT packet_id, version_id, 'computedTiv' AS key, 0.1::DOUBLE AS confidence, 'sum:locations' AS method FROM run WHERE {_V2} AND n = 0
          UNION ALL SELECT packet_id, version_id, 'lossRunTotalIncurred', 0.2, 'no-loss-rows' FROM run WHERE {_V2} AND n_claims = 0 UNION ALL SELECT packet_id, version_id, 'lossCount', 0.4, 'count:claim-rows' FROM run WHERE {_V2} AND n_claims = 0
          UNION ALL SELECT packet_id, version_id, 'L1.yearBuilt', 0.5, 'context-backfill' FROM run WHERE {_V2} AND guessed""",
        "simulated_cost": "SELECT doc_id, ceil(length(text) / 4)::BIGINT AS input_tokens, round(floor((ceil(length(text) / 4) * 2 / 1000 * 0.003::DOUBLE) * 1e6 + 0.5) / 1e6, 6) AS usd FROM documents",
    }
