"""The queries of gatewright.plans.queries as SQL for DuckDB, written on their own."""

from __future__ import annotations

#: Aligned events: effective date in New York, then the session one after the first on or after it.
FILINGS = """
f AS (
  SELECT event_id::VARCHAR AS accession, user_id::VARCHAR AS ticker, ts AT TIME ZONE 'UTC' AS acc, ts::DATE - 45 AS period_end,
         (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny FROM events
), cal AS (
  SELECT d, row_number() OVER (ORDER BY d) AS n FROM (
    SELECT unnest(generate_series((SELECT min(ts)::DATE - 10 FROM events), (SELECT max(ts)::DATE + 10 FROM events), INTERVAL 1 DAY))::DATE AS d) WHERE isodow(d) < 6
), e AS (
  SELECT *, ny::DATE + CASE WHEN hour(ny) >= 16 THEN 1 ELSE 0 END AS effective FROM f
), first AS (SELECT eff, min(n) AS n FROM (SELECT DISTINCT effective AS eff FROM e) JOIN cal ON d >= eff GROUP BY eff
), aligned AS (
  SELECT e.*, c.d AS signal_date FROM e LEFT JOIN first ON eff = effective LEFT JOIN cal c ON c.n = first.n + 1
)"""
GAP = "(epoch_us((signal_date + INTERVAL 16 HOURS) AT TIME ZONE 'America/New_York') - epoch_us(acc)) / 86400000000.0"

#: Documents as sections: what fails, and why.
REASON = """
CASE WHEN doc_id % 11 = 0 THEN 'no ''Item 7'' heading in item_7' WHEN length(body) < 1000 THEN 'item_7 has ' || length(body) || ' characters, fewer than 1000' ELSE '' END"""
TERMS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM documents"
COUNTS = f"counts AS (SELECT doc_id, term, count(*)::BIGINT AS n FROM ({TERMS}) GROUP BY ALL)"
DOC_PAIRS = "pairs AS (SELECT doc_id AS a, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents QUALIFY b IS NOT NULL)"
COSINES = """
norm AS (SELECT doc_id, sum(n * n)::BIGINT AS q FROM counts GROUP BY 1),
dots AS (SELECT a, b, sum(x.n * y.n)::BIGINT AS dot FROM pairs JOIN counts x ON x.doc_id = a JOIN counts y ON y.doc_id = b AND y.term = x.term GROUP BY ALL),
scored AS (
  SELECT p.a, p.b, round(coalesce(dot, 0) / (sqrt(na.q) * sqrt(nb.q)), 9) AS score
  FROM pairs p LEFT JOIN dots d ON d.a = p.a AND d.b = p.b LEFT JOIN norm na ON na.doc_id = p.a LEFT JOIN norm nb ON nb.doc_id = p.b
)"""

LAZY = f"""
idx AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS o FROM documents),
rows AS (
  SELECT source AS ticker, doc_id AS accession, 1000000000 + ((o * 300) % 9000) * 86400 + o AS s, length(text) < 1000 AS failed FROM idx
), laid AS (
  SELECT *, lag(accession) OVER w AS prev_accession, lag(failed) OVER w AS prev_failed, lag(s) OVER w AS prev_s
  FROM rows WINDOW w AS (PARTITION BY ticker ORDER BY s, accession)
), pairs AS (SELECT accession AS a, prev_accession AS b FROM laid WHERE NOT failed AND NOT prev_failed), {COUNTS}, {COSINES},
cal AS (
  SELECT d, row_number() OVER (ORDER BY d) AS n FROM (
    SELECT unnest(generate_series((SELECT make_timestamp(min(s) * 1000000)::DATE - 10 FROM rows), (SELECT make_timestamp(max(s) * 1000000)::DATE + 10 FROM rows), INTERVAL 1 DAY))::DATE AS d)
  WHERE isodow(d) < 6
), timed AS (
  SELECT *, make_timestamp(s * 1000000) AS moment, (make_timestamp(s * 1000000) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny FROM laid
), eff AS (SELECT *, ny::DATE + CASE WHEN hour(ny) >= 16 THEN 1 ELSE 0 END AS effective FROM timed
), first AS (SELECT effective AS e, min(n) AS n FROM (SELECT DISTINCT effective FROM eff) JOIN cal ON d >= effective GROUP BY 1
), built AS (
  SELECT ticker, accession, prev_accession, moment::DATE - 45 AS period_end, c.d AS signal_date, score,
         failed AS section_failed, failed OR coalesce(prev_failed, TRUE) OR score IS NULL AS extraction_failed, CASE WHEN failed THEN 'short' ELSE '' END AS failure_reason,
         floor((s - prev_s) / 86400.0)::BIGINT AS gap_days, coalesce(floor((s - prev_s) / 86400.0) BETWEEN 250 AND 550, FALSE) AS gap_ok
  FROM eff LEFT JOIN scored ON a = accession AND b = prev_accession AND NOT failed AND NOT prev_failed
  LEFT JOIN first ON e = effective LEFT JOIN cal c ON c.n = first.n + 1
)"""

WEEKLY = """
weekly AS (
  SELECT l_suppkey::VARCHAR AS symbol, date_trunc('week', l_shipdate)::DATE AS date, avg(l_extendedprice / l_quantity) AS px, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents
  FROM lineitem GROUP BY ALL
)"""
MEMBERSHIP = """
membership AS (
  SELECT o_custkey::VARCHAR AS symbol, CASE WHEN o_custkey % 4 = 0 THEN 'other' ELSE 'sp500' END AS index_name, min(o_orderdate)::DATE AS valid_from,
         CASE WHEN max(o_orderdate)::DATE <= DATE '2001-01-01' THEN max(o_orderdate)::DATE END AS valid_to
  FROM orders GROUP BY o_custkey
)"""
KINDS = """
kinds AS (
  SELECT s_suppkey::VARCHAR AS symbol, r_name AS sector, CASE WHEN s_acctbal > 0 THEN 'EQUITY' ELSE 'ETF' END AS quoteType
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
DAILY = """
a AS (SELECT o_orderdate::DATE AS date, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*) / 1e8 AS mkt_rf FROM orders GROUP BY 1),
b AS (SELECT l_shipdate::DATE AS date, sum(round(l_discount * 100)::BIGINT)::DOUBLE / count(*) AS mom, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(*) / 1e8 AS ret FROM lineitem GROUP BY 1)"""
MONTHLY = """
grouped AS (
  SELECT l_suppkey::VARCHAR AS symbol, date_trunc('month', l_shipdate)::DATE AS month, avg(l_extendedprice / l_quantity) AS px, sum(l_extendedprice) AS dollars, sum(l_quantity) AS volume, avg(l_discount) AS discount
  FROM lineitem GROUP BY ALL
), monthly AS (
  SELECT *, px / lag(px) OVER w - 1 AS ret, lag(dollars) OVER w AS score FROM grouped WINDOW w AS (PARTITION BY symbol ORDER BY month)
)"""
SPREAD = """
ranked AS (SELECT month, symbol, ntile(10) OVER (PARTITION BY month ORDER BY score, symbol) AS decile FROM scores),
legs AS (
  SELECT r.month, decile, avg(ret) AS ew, sum(ret * dollars) / sum(dollars) AS vw
  FROM ranked r JOIN monthly m ON m.month = r.month AND m.symbol = r.symbol AND ret IS NOT NULL WHERE decile IN (1, 10) GROUP BY ALL
), spread AS (
  SELECT month, max(ew) FILTER (WHERE decile = 10) - max(ew) FILTER (WHERE decile = 1) AS ew, max(vw) FILTER (WHERE decile = 10) - max(vw) FILTER (WHERE decile = 1) AS vw
  FROM legs GROUP BY month
)"""
RAW = f"{MONTHLY}, scores AS (SELECT month, symbol, round(score, 4) AS score FROM monthly WHERE score IS NOT NULL), {SPREAD}"
NEUTRAL = f"""{MONTHLY}, {KINDS}, scores AS (
  SELECT month, m.symbol, round(round(score - avg(score) OVER (PARTITION BY month, sector), 4), 4) AS score FROM monthly m JOIN kinds k ON k.symbol = m.symbol WHERE score IS NOT NULL
), {SPREAD}"""
STEPS = """
numbered AS (SELECT *, n % 7 AS ordinal, user_id || '-' || (n // 7) AS trial FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)),
steps AS (
  SELECT trial, ordinal::INTEGER AS ordinal, (['pit', 'integrity', 'raw', 'orthogonalize', 'costs', 'dsr', 'pbo'])[ordinal + 1] AS gate,
         CASE WHEN ordinal >= 2 THEN value END AS sharpe, event_type <> 'error' AS passed
  FROM numbered
)"""

CHAIN = """
WITH e AS (SELECT user_id, event_id, event_id::VARCHAR || ':' || event_type AS c FROM events),
linked AS (
  SELECT user_id, event_id, row_number() OVER w - 1 AS i, coalesce(lag(sha256(c)) OVER w, repeat('0', 64)) AS prev, sha256(c) AS hash, CASE WHEN event_id % 499 = 57 THEN 'forged' ELSE c END AS c
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), checked AS (
  SELECT user_id, i, prev = coalesce(lag(hash) OVER (PARTITION BY user_id ORDER BY i), repeat('0', 64)) AND hash = sha256(c) AS good FROM linked
)
SELECT user_id, count(*)::BIGINT AS n, min(i) FILTER (WHERE NOT good)::BIGINT AS broken_at FROM checked GROUP BY user_id"""

HTML = r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<head[ >].*?</head>|<head>.*?</head>', '', 'g'), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<![^>]*>', '', 'g') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(x, '(?i)</?(p|div|br|tr|li|h[1-6]|table|thead|tbody|section|article|hr|ul|ol)(\s[^>]*)?/?>', chr(10), 'g') AS x FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)</(td|th)>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&') AS x FROM c),
e AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n+', chr(10), 'g') AS x FROM d)
SELECT page_id, trim(x, chr(10) || ' ') AS text, NULL::VARCHAR AS error FROM e"""

SECTIONS = r"""
WITH filed AS (
  SELECT doc_id, 'Item 1A. 3' || chr(10) || 'Item 1B. 9' || chr(10) || 'Item 7. 12' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'Item 7A. 20' || chr(10) ELSE '' END || 'Item 8. 30' || chr(10)
    || CASE WHEN doc_id % 7 <> 0 THEN 'Item 1A: Risk Factors' || chr(10) ELSE 'About risk' || chr(10) END || text || chr(10) || ' ITEM 1B - Comments' || chr(10) || 'none' || chr(10)
    || 'item 7. Discussion' || chr(10) || 'see Item 7A below. ' || text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Item 7A. Market risk' || chr(10) ELSE chr(10) END || 'Item 8. Statements' || chr(10) AS x
  FROM documents
), lines AS (
  SELECT doc_id, unnest(string_split(x, chr(10))) AS l, unnest(range(len(string_split(x, chr(10))))) AS i FROM filed
), placed AS (
  SELECT *, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM lines
), heads AS (
  SELECT doc_id, off, label, off + length(regexp_extract(l, '(?i)^[ \t]*item[ \t\x{a0}]*' || label || '[ \t]*[.:\-–—]?[ \t]*')) AS after
  FROM placed, (SELECT unnest(['1A', '1B', '1C', '2', '7A', '7', '8']) AS label) WHERE regexp_matches(l, '(?i)^[ \t]*item[ \t\x{a0}]*' || label)
), wanted AS (SELECT * FROM (VALUES ('item_1a', '1A', ['1B', '1C', '2']), ('item_7', '7', ['7A', '8'])) t(name, label, followers)
), chosen AS (
  SELECT doc_id, name, min(list_position(followers, h.label)) AS k FROM heads h JOIN wanted w ON list_contains(w.followers, h.label) GROUP BY ALL
), ends AS (
  SELECT h.doc_id, c.name, h.off AS e FROM chosen c JOIN wanted w ON w.name = c.name JOIN heads h ON h.doc_id = c.doc_id AND h.label = w.followers[c.k]
), spans AS (
  SELECT e.doc_id, e.name, e.e, max(h.after) AS s FROM ends e JOIN wanted w ON w.name = e.name JOIN heads h ON h.doc_id = e.doc_id AND h.label = w.label AND h.after < e.e GROUP BY ALL
), best AS (SELECT doc_id, name, arg_max(s, (e - s) * 100000000 - e) AS s, max(e - s) AS n FROM spans GROUP BY ALL
), bodies AS (
  SELECT f.doc_id, b.name, regexp_replace(regexp_replace(substr(x, (s + 1)::BIGINT, n::BIGINT), '^\s+', ''), '\s+$', '') AS body FROM filed f JOIN best b ON b.doc_id = f.doc_id
), folded AS (
  SELECT f.doc_id, coalesce(string_agg(body, chr(10) || chr(10) ORDER BY name) FILTER (WHERE length(body) >= 1000), '') AS body,
         count(*) FILTER (WHERE length(body) >= 1000) AS good, count(*) FILTER (WHERE name = 'item_1a' AND length(body) >= 1000) AS good_1a
  FROM filed f LEFT JOIN bodies b ON b.doc_id = f.doc_id GROUP BY f.doc_id
)
SELECT doc_id, length(body)::BIGINT AS n_body, sha256(body) AS body_sha256, good < 2 AS section_failed, good_1a = 0 AS names_1a FROM folded"""

TFIDF = f"""
WITH {COUNTS}, {DOC_PAIRS}, yr AS (SELECT doc_id, (2012 + doc_id % 10)::INTEGER AS year FROM documents),
years AS (SELECT DISTINCT year FROM yr), sizes AS (SELECT y.year, count(*) AS n FROM years y JOIN yr d ON d.year < y.year GROUP BY 1 HAVING count(*) >= 50),
base AS (SELECT term, year, count(*) AS c FROM counts JOIN yr USING (doc_id) GROUP BY ALL),
idf AS (
  SELECT s.year, term, ln((1 + any_value(s.n)) / (1 + sum(c))) + 1 AS idf FROM sizes s JOIN base b ON b.year < s.year GROUP BY ALL HAVING sum(c) >= 5
), sides AS (
  SELECT a, b, year, term, max(CASE WHEN doc_id = a THEN n * idf END) AS wa, max(CASE WHEN doc_id = b THEN n * idf END) AS wb
  FROM (SELECT p.a, p.b, (2012 + a % 10)::INTEGER AS year, unnest([a, b]) AS doc_id FROM pairs p) JOIN counts USING (doc_id) JOIN idf USING (year, term) GROUP BY ALL
), sums AS (SELECT a, b, sum(wa * wb) AS dot, sum(wa * wa) AS qa, sum(wb * wb) AS qb FROM sides GROUP BY ALL)
SELECT p.a, p.b, (2012 + p.a % 10)::INTEGER AS year, round(CASE WHEN qa > 0 AND qb > 0 THEN coalesce(dot, 0) / (sqrt(qa) * sqrt(qb)) END, 6) AS score
FROM pairs p LEFT JOIN sums s ON s.a = p.a AND s.b = p.b"""

#: The cosines of a signal by the terms' weights in strictly earlier years, in place of those by counts.
WEIGHED = """
yr AS (SELECT accession AS doc_id, year(make_timestamp(s * 1000000)) AS year, NOT failed AS fits FROM rows),
sizes AS (SELECT y.year, count(*) AS n FROM (SELECT DISTINCT year FROM yr) y JOIN yr d ON d.year < y.year AND d.fits GROUP BY 1 HAVING count(*) >= 50),
base AS (SELECT term, year, count(*) AS c FROM counts JOIN yr USING (doc_id) WHERE fits GROUP BY ALL),
idf AS (SELECT s.year, term, ln((1 + any_value(s.n)) / (1 + sum(c))) + 1 AS idf FROM sizes s JOIN base b ON b.year < s.year GROUP BY ALL HAVING sum(c) >= 5),
sides AS (
  SELECT a, b, year, term, max(CASE WHEN doc_id = a THEN n * idf END) AS wa, max(CASE WHEN doc_id = b THEN n * idf END) AS wb
  FROM (SELECT p.a, p.b, y.year, unnest([a, b]) AS doc_id FROM pairs p JOIN yr y ON y.doc_id = p.a) JOIN counts USING (doc_id) JOIN idf USING (year, term) GROUP BY ALL
), sums AS (SELECT a, b, sum(wa * wb) AS dot, sum(wa * wa) AS qa, sum(wb * wb) AS qb FROM sides GROUP BY ALL),
scored AS (SELECT p.a, p.b, round(CASE WHEN qa > 0 AND qb > 0 THEN coalesce(dot, 0) / (sqrt(qa) * sqrt(qb)) END, 6) AS score FROM pairs p LEFT JOIN sums s ON s.a = p.a AND s.b = p.b)"""

CHARACTERISTICS = f"""{MONTHLY}, numbered AS (SELECT *, year(month) * 12 + month(month) AS k FROM monthly),
moved AS (
  SELECT month, symbol, px * volume AS cap, ret AS str, lead(ret) OVER r AS next, discount, 1 - volume / lag(volume) OVER r AS restraint,
         CASE WHEN count(ret) OVER w >= 8 THEN exp(sum(ln(1 + ret)) OVER w) - 1 END AS mom
  FROM numbered WINDOW r AS (PARTITION BY symbol ORDER BY month), w AS (PARTITION BY symbol ORDER BY k RANGE BETWEEN 11 PRECEDING AND 1 PRECEDING)
), traits AS (
  SELECT m.*, ln(cap) AS size, CASE WHEN s_acctbal > 0 AND month >= DATE '1995-01-01' THEN ln(s_acctbal / cap) END AS value FROM moved m JOIN supplier ON s_suppkey::VARCHAR = symbol
)"""


def leg(name: str, trait: str) -> str:
    """A factor from a double sort on cap and a trait: the upper three tenths less the lower, each the mean of two halves by cap."""
    return f"""
{name}_sorted AS (SELECT *, ntile(2) OVER (PARTITION BY month ORDER BY cap, symbol) AS half, ntile(10) OVER (PARTITION BY month ORDER BY {trait}, symbol) AS part FROM traits WHERE {trait} IS NOT NULL AND next IS NOT NULL),
{name}_corners AS (SELECT month, half, part >= 8 AS high, sum(cap * next) / sum(cap) AS r FROM {name}_sorted WHERE part <= 3 OR part >= 8 GROUP BY ALL),
{name}_leg AS (SELECT month, avg(r) FILTER (WHERE high) - avg(r) FILTER (WHERE NOT high) AS {name} FROM {name}_corners GROUP BY month)"""


FACTOR_NAMES = ("mkt", "smb", "hml", "rmw", "cma", "mom", "str")
FACTORS = CHARACTERISTICS + "," + ",".join(leg(f"f_{n}", t) for n, t in (("hml", "value"), ("rmw", "discount"), ("cma", "restraint"), ("mom", "mom"), ("str", "str"))) + """,
smb_cells AS (SELECT month, half, CASE WHEN part <= 3 THEN 0 WHEN part <= 7 THEN 1 ELSE 2 END AS third, sum(cap * next) / sum(cap) AS r FROM f_hml_sorted GROUP BY ALL),
f_smb_leg AS (SELECT month, avg(r) FILTER (WHERE half = 1) - avg(r) FILTER (WHERE half = 2) AS f_smb FROM smb_cells GROUP BY month),
f_mkt_leg AS (SELECT month, sum(cap * next) / sum(cap) AS f_mkt FROM traits WHERE next IS NOT NULL GROUP BY month),
factors AS (
  SELECT month, f_mkt AS mkt, f_smb AS smb, f_hml AS hml, f_rmw AS rmw, f_cma AS cma, f_mom AS mom, f_str AS str
  FROM f_mkt_leg LEFT JOIN f_smb_leg USING (month) LEFT JOIN f_hml_leg USING (month) LEFT JOIN f_rmw_leg USING (month) LEFT JOIN f_cma_leg USING (month) LEFT JOIN f_mom_leg USING (month) LEFT JOIN f_str_leg USING (month)
)"""


def orthogonal(start: str, xs: tuple[str, ...], others: tuple[str, ...], keys: str, over: str) -> str:
    """CTEs that take each of xs out of all that follow it, one at a time (Gram and Schmidt); the last is `done`."""
    steps, now = [], start
    for i, x in enumerate(xs):
        left = [*xs[i + 1 :], *others]
        name = "done" if i == len(xs) - 1 else f"without_{x}"
        steps.append(f"{name} AS (SELECT {keys}, {', '.join(f'{c} - {x} * (sum({c} * {x}) OVER ({over}) / nullif(sum({x} * {x}) OVER ({over}), 0)) AS {c}' for c in left)} FROM {now})")
        now = name
    return ",\n".join(steps)


def forest_sql(cells: str, features: tuple[str, ...], key: tuple[str, ...], trees: int = 50, sample: int = 256, cap: int = 8, seed: int = 11) -> str:
    """CTEs that draw rows for trees, grow these level by level and send all rows of `cells` (key, features) down each; the last is `anomalies` (key, anomaly)."""
    keys, each = ", ".join(key), list(enumerate(features))
    uniform = lambda h, start: f"('0x' || substr({h}, {start}, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    at_feature = "CASE f " + " ".join(f"WHEN {i} THEN {c}" for i, c in each) + " END"
    path = lambda n: f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} <= 2 THEN 1.0 ELSE 2 * (ln({n} - 1) + 0.5772156649) - 2 * ({n} - 1) / {n}::DOUBLE END"
    ctes = [
        f"hashed AS (SELECT *, md5(concat_ws(':', '{seed}', {', '.join(f'{k}::VARCHAR' for k in key)})) AS h FROM {cells})",
        f"placed AS (SELECT *, {uniform('h', 1)} AS place FROM hashed)",
        f"turned AS (SELECT p.*, t::INTEGER AS tree, CASE WHEN place - t / {trees}.0::DOUBLE < 0 THEN place - t / {trees}.0::DOUBLE + 1 ELSE place - t / {trees}.0::DOUBLE END AS behind FROM placed p, range({trees}) r(t))",
        f"drawn AS (SELECT * FROM turned QUALIFY row_number() OVER (PARTITION BY tree ORDER BY behind, h) <= {sample})",
        f"middle AS (SELECT {', '.join(f'coalesce(median({c}), 0) AS m{i}' for i, c in each)} FROM drawn)",
        f"filled AS (SELECT {keys}, {', '.join(f'coalesce({c}, m{i}) AS {c}' for i, c in each)} FROM placed, middle)",
        f"level0 AS (SELECT d.tree, 1 AS node, {', '.join(f'coalesce({c}, m{i}) AS {c}' for i, c in each)} FROM drawn d, middle)",
    ]
    for d in range(cap + 1):
        varied = f"list_filter([{', '.join(f'CASE WHEN max({c}) > min({c}) THEN {i} END' for i, c in each)}], lambda v: v IS NOT NULL)"
        ctes.append(f"nodes{d} AS (SELECT tree, node, count(*) AS n, md5(tree || ':' || node) AS h, {varied} AS varied, {', '.join(f'min({c}) AS a{i}, max({c}) AS b{i}' for i, c in each)} FROM level{d} GROUP BY tree, node)")
        ctes.append(f"picked{d} AS (SELECT *, CASE WHEN {d} < {cap} AND n > 1 AND len(varied) > 0 THEN varied[floor({uniform('h', 1)} * len(varied))::INTEGER + 1] END AS f FROM nodes{d})")
        low, wide = ("CASE f " + " ".join(f"WHEN {i} THEN {e}" for i, e in ((i, e.format(i=i)) for i, _ in each)) + " END" for e in ("a{i}", "b{i} - a{i}"))
        ctes.append(f"splits{d} AS (SELECT tree, node, f, {low} + {uniform('h', 14)} * ({wide}) AS at_value, CASE WHEN f IS NULL THEN {d} + {path('n')} END AS value FROM picked{d})")
        if d < cap:
            ctes.append(f"level{d + 1} AS (SELECT l.tree, l.node * 2 + ({at_feature} >= at_value)::INTEGER AS node, {', '.join(features)} FROM level{d} l JOIN splits{d} s ON s.tree = l.tree AND s.node = l.node WHERE f IS NOT NULL)")
    ctes.append("grown AS (" + " UNION ALL ".join(f"SELECT * FROM splits{d}" for d in range(cap + 1)) + ")")
    ctes.append(f"sent0 AS (SELECT t.tree, 1 AS node, {keys}, {', '.join(features)} FROM filled, (SELECT DISTINCT tree FROM grown) t)")
    for d in range(cap):
        ctes.append(f"sent{d + 1} AS (SELECT p.tree, CASE WHEN f IS NULL THEN p.node ELSE p.node * 2 + ({at_feature} >= at_value)::INTEGER END AS node, {keys}, {', '.join(features)} FROM sent{d} p JOIN grown s ON s.tree = p.tree AND s.node = p.node)")
    ctes.append("largest AS (SELECT max(c) AS n FROM (SELECT count(*) AS c FROM drawn GROUP BY tree))")
    ctes.append(f"anomalies AS (SELECT {keys}, 2.0 ** (-avg(value) / any_value({path('greatest(2, largest.n)')})) AS anomaly FROM sent{cap} p JOIN grown s ON s.tree = p.tree AND s.node = p.node, largest GROUP BY {keys})")
    return ",\n".join(ctes)


TRAIT_NAMES = ("size", "value", "mom", "str")

ORACLES: dict[str, str] = {
    "pit_audit_twin": f"""
WITH {FILINGS}, both_ AS (
  SELECT 'acceptance' AS alignment, acc, signal_date FROM aligned UNION ALL SELECT 'period_end', acc, period_end FROM aligned
), g AS (SELECT alignment, {GAP} AS gap FROM both_ WHERE signal_date IS NOT NULL)
SELECT alignment, count(*)::BIGINT AS n, count(*) FILTER (WHERE gap < 0)::BIGINT AS n_impossible, count(*) FILTER (WHERE gap < 1)::BIGINT AS n_lookahead,
       round(count(*) FILTER (WHERE gap < 1) * 100.0::DOUBLE / count(*), 6) AS pct_lookahead, round(median(gap), 6) AS median_gap_days, round(min(gap), 6) AS min_gap_days
FROM g GROUP BY alignment""",
    "align_acceptance": f"WITH {FILINGS} SELECT accession, ticker, signal_date FROM aligned",
    "pit_gap_rows": f"WITH {FILINGS} SELECT accession, round({GAP}, 6) AS gap FROM aligned",
    "filing_index_summary": """
SELECT count(*)::BIGINT AS n_rows, count(DISTINCT event_id)::BIGINT AS n_documents, count(DISTINCT user_id)::BIGINT AS n_tickers, min(ts)::DATE AS first_date, max(ts)::DATE AS last_date
FROM events WHERE ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'""",
    "annual_gap_flags": """
WITH w AS (SELECT o_orderkey, o_orderdate, lag(o_orderkey) OVER p AS prev_o_orderkey, lag(o_orderdate) OVER p AS prev FROM orders WINDOW p AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, prev_o_orderkey, datesub('day', prev, o_orderdate)::BIGINT AS gap_days, coalesce(datesub('day', prev, o_orderdate) BETWEEN 250 AND 550, FALSE) AS gap_ok FROM w""",
    "tokenize_counts": f"WITH {COUNTS} SELECT * FROM counts",
    "doc_norms": f"WITH {COUNTS} SELECT doc_id, sum(n * n)::BIGINT AS norm2 FROM counts GROUP BY doc_id",
    "lazy_cosine": f"WITH {COUNTS}, {DOC_PAIRS}, {COSINES} SELECT a, b, score FROM scored",
    "lazy_build": f"WITH {LAZY} SELECT ticker, accession, prev_accession, period_end, signal_date, score, extraction_failed, failure_reason, gap_days, gap_ok FROM built",
    "signal_build": "WITH " + LAZY.replace("length(text) < 1000 AS failed FROM idx", f"{REASON} AS reason, reason <> '' AS failed FROM (SELECT *, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS body FROM idx)")
    .replace("CASE WHEN failed THEN 'short' ELSE '' END AS failure_reason", "reason AS failure_reason")
    + "SELECT ticker, accession, prev_accession, period_end, signal_date, score, extraction_failed, failure_reason, gap_days, gap_ok FROM built",
    "tfidf_build": "WITH " + LAZY.replace(COSINES, WEIGHED).replace("length(text) < 1000 AS failed", "length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) < 1000 AS failed")
    + " SELECT ticker, accession, prev_accession, signal_date, score, extraction_failed, gap_ok FROM built",
    "lazy_usable": f"WITH {LAZY} SELECT ticker, accession, signal_date, score FROM built WHERE NOT extraction_failed AND gap_ok",
    "signal_diagnostics": f"""
WITH {LAZY} SELECT count(*)::BIGINT AS n_filings, count(DISTINCT accession)::BIGINT AS n_documents, count(*) FILTER (WHERE prev_accession IS NULL)::BIGINT AS n_first_filing_no_prior,
  round(avg(section_failed::INTEGER), 6) AS section_failure_rate, round(avg(extraction_failed::INTEGER), 6) AS pair_failure_rate, count(*) FILTER (WHERE NOT gap_ok)::BIGINT AS gap_rejected,
  count(*) FILTER (WHERE NOT extraction_failed AND gap_ok)::BIGINT AS n_usable, round(avg(score), 6) AS score_mean, round(stddev_samp(score), 6) AS score_std FROM built""",
    "tfidf_expanding": TFIDF,
    "html_visible_text": HTML,
    "section_extract": SECTIONS,
    "archive_url": """
SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || lpad(o_custkey::VARCHAR, 10, '0') || strftime(o_orderdate, '%y') || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') || '/doc.htm' AS url FROM orders""",
    "parallel_arrays_inline": """
SELECT lpad(o_custkey::VARCHAR, 10, '0') AS cik, o_custkey::VARCHAR AS ticker, o_orderstatus AS form, o_orderkey::VARCHAR AS accession,
       o_orderdate::DATE AS period_end, o_orderdate::DATE AS filing_date, 'doc.htm' AS primary_document
FROM orders WHERE o_orderstatus IN ('F', 'O') AND NOT starts_with(o_orderpriority, '5')""",
    "dedup_first": "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, sha256(text) AS text_sha256 FROM documents GROUP BY text",
    "panel_returns": f"""
WITH {WEEKLY}, p AS (SELECT * FROM weekly WHERE date BETWEEN DATE '1995-12-22' AND DATE '1997-12-31'),
grid AS (SELECT d.date, s.symbol FROM (SELECT DISTINCT date FROM p) d, (SELECT DISTINCT symbol FROM p) s),
filled AS (SELECT g.date, g.symbol, last_value(px IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS px FROM grid g LEFT JOIN p ON p.date = g.date AND p.symbol = g.symbol),
r AS (SELECT date, symbol, round(px / lag(px) OVER (PARTITION BY symbol ORDER BY date) - 1, 6) AS ret FROM filled)
SELECT * FROM r WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""",
    "dollar_adv_21": f"WITH {WEEKLY} SELECT date, symbol, avg(cents) OVER (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING) AS value FROM weekly",
    "coverage": f"""
WITH {WEEKLY} SELECT symbol, round(count(DISTINCT date) / (SELECT count(DISTINCT date) FROM weekly), 6) AS coverage FROM weekly
GROUP BY symbol HAVING count(DISTINCT date) / (SELECT count(DISTINCT date) FROM weekly) > 0.5""",
    "members_on": f"""
WITH {MEMBERSHIP} SELECT DISTINCT symbol FROM membership WHERE index_name = 'sp500' AND valid_from <= DATE '1995-06-01' AND (valid_to IS NULL OR valid_to >= DATE '1995-06-01')""",
    "members_by_date": f"""
WITH {MEMBERSHIP}, dates AS (SELECT unnest(generate_series(DATE '1995-03-01', DATE '1996-03-01', INTERVAL 3 MONTHS))::DATE AS date)
SELECT DISTINCT date, symbol FROM dates JOIN membership ON index_name = 'sp500' AND valid_from <= date AND (valid_to IS NULL OR valid_to >= date)""",
    "membership_overlap": f"""
WITH {MEMBERSHIP} SELECT DISTINCT symbol FROM membership WHERE index_name = 'sp500' AND valid_from <= DATE '1995-04-01' AND (valid_to IS NULL OR valid_to >= DATE '1995-01-01')""",
    "liquid_universe": f"""
WITH {WEEKLY}, {KINDS}, adv AS (SELECT date, symbol, avg(cents) OVER (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING) AS value FROM weekly),
win AS (SELECT * FROM weekly WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'),
cov AS (SELECT symbol FROM win GROUP BY symbol HAVING count(DISTINCT date) / (SELECT count(DISTINCT date) FROM win) > 0.5)
SELECT symbol, median(value) AS median_adv FROM adv
WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND symbol::BIGINT % 10 <> 3 AND symbol IN (SELECT symbol FROM kinds WHERE quoteType = 'EQUITY') AND symbol IN (SELECT symbol FROM cov)
GROUP BY symbol ORDER BY median(value) DESC, symbol LIMIT 20""",
    "universe_at_dates": f"""
WITH {WEEKLY}, {KINDS}, dates AS (SELECT unnest([DATE '1996-06-28', DATE '1998-06-26']) AS asked),
adv AS (SELECT date, symbol, avg(cents) OVER (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING) AS value FROM weekly),
members AS (
  SELECT asked, s_suppkey::VARCHAR AS symbol FROM supplier, dates
  WHERE (s_suppkey % 7 <> 1 OR asked >= DATE '1997-01-01') AND (s_suppkey % 10 <> 3 OR asked <= DATE '1997-01-01') AND s_suppkey::VARCHAR IN (SELECT symbol FROM kinds WHERE quoteType = 'EQUITY')
), win AS (SELECT asked, a.* FROM adv a JOIN dates ON date BETWEEN asked - 364 AND asked
), cov AS (
  SELECT w.asked, symbol FROM win w JOIN (SELECT asked, count(DISTINCT date) AS n FROM win GROUP BY asked) d ON d.asked = w.asked GROUP BY w.asked, symbol HAVING count(DISTINCT date) > 0.5 * any_value(n)
), med AS (SELECT w.asked, w.symbol, median(value) AS median_adv FROM win w JOIN members m ON m.asked = w.asked AND m.symbol = w.symbol JOIN cov c ON c.asked = w.asked AND c.symbol = w.symbol GROUP BY ALL)
SELECT asked AS date, symbol, median_adv, (row_number() OVER (PARTITION BY asked ORDER BY median_adv DESC, symbol))::INTEGER AS place FROM med QUALIFY place <= 20""",
    "realised_costs": f"""
WITH {RAW}, own AS (
  SELECT r.month, r.symbol, ret, dollars, (CASE WHEN decile = 10 THEN 1.0 ELSE -1.0 END)::DOUBLE * dollars / sum(dollars) OVER (PARTITION BY r.month, decile) AS w
  FROM ranked r JOIN monthly m ON m.month = r.month AND m.symbol = r.symbol AND ret IS NOT NULL AND dollars > 0 WHERE decile IN (1, 10)
), e AS (SELECT month, sum(w * ret) AS r FROM own GROUP BY month
), drifted AS (SELECT (o.month + INTERVAL 1 MONTH)::DATE AS month, symbol, w * (1 + ret) / (1 + r) AS b FROM own o JOIN e ON e.month = o.month WHERE r > -1
), t AS (
  SELECT coalesce(o.month, d.month) AS month, coalesce(o.symbol, d.symbol) AS symbol, abs(coalesce(w, 0) - coalesce(b, 0)) AS traded FROM own o FULL JOIN drifted d ON d.month = o.month AND d.symbol = o.symbol
), p AS (
  SELECT t.month, traded, CASE WHEN dollars >= 250000 THEN 5.0 WHEN dollars >= 100000 THEN 10.0 ELSE 25.0 END::DOUBLE AS low, CASE WHEN dollars >= 250000 THEN 15.0 WHEN dollars >= 100000 THEN 30.0 ELSE 100.0 END::DOUBLE AS high
  FROM t LEFT JOIN monthly m ON m.month = t.month AND m.symbol = t.symbol AND ret IS NOT NULL WHERE t.month IN (SELECT month FROM own) AND t.month IN (SELECT month FROM drifted)
), q AS (SELECT month, sum(traded) / 2 AS turned, sum(traded * low) / sum(traded) AS low, sum(traded * high) / sum(traded) AS high FROM p GROUP BY month)
SELECT round(avg(r), 6) AS mean_gross, round(avg(turned), 6) AS mean_turnover, round(avg(r) / (2 * avg(turned)) * 10000, 6) AS breakeven_bps, round(avg(low), 6) AS low_bps, round(avg(high), 6) AS high_bps
FROM q JOIN e ON e.month = q.month""",
    "scores_by_month": """
WITH s AS (SELECT o_custkey::VARCHAR AS symbol, o_orderdate::DATE AS signal_date, o_totalprice AS score FROM orders WHERE o_orderstatus <> 'P'),
months AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(signal_date)) FROM s), (SELECT max(signal_date) + INTERVAL 16 MONTHS FROM s), INTERVAL 1 MONTH))::DATE AS month)
SELECT month, symbol, score, signal_date FROM months JOIN s ON signal_date <= last_day(month) AND last_day(month) <= signal_date + INTERVAL 15 MONTHS
QUALIFY row_number() OVER (PARTITION BY symbol, month ORDER BY signal_date DESC, score DESC) = 1""",
    "former_tickers": f"""
WITH {MEMBERSHIP} SELECT c_custkey::VARCHAR AS ticker, DATE '1995-09-01' AS date, 'cik' || symbol AS cik FROM customer
LEFT JOIN membership ON symbol = c_custkey::VARCHAR AND valid_from <= DATE '1995-09-01' AND (valid_to IS NULL OR valid_to >= DATE '1995-09-01')""",
    "names_by_date": """
WITH asked AS (SELECT c_custkey, unnest([DATE '1995-09-01', DATE '1999-02-28']) AS date FROM customer),
n AS (SELECT o_custkey, o_orderkey::VARCHAR AS cik, o_orderdate::DATE AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE + 400 END AS b FROM orders)
SELECT c_custkey::VARCHAR AS ticker, date, arg_max(cik, (a, cik)) AS cik FROM asked LEFT JOIN n ON o_custkey = c_custkey AND a <= date AND (b IS NULL OR b >= date) GROUP BY ALL""",
    "text_distance": TFIDF[: TFIDF.index(", sides AS (")] + f""",
vecs AS (
  SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 256 AS entry, sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1.0 ELSE -1.0 END::DOUBLE * n * idf) AS v FROM counts JOIN yr USING (doc_id) JOIN idf USING (year, term) GROUP BY ALL
), q AS (SELECT doc_id, sqrt(sum(v * v)) AS q FROM vecs GROUP BY doc_id),
d AS (SELECT a, b, sum(x.v * y.v) AS dot FROM pairs JOIN vecs x ON x.doc_id = a JOIN vecs y ON y.doc_id = b AND y.entry = x.entry GROUP BY ALL)
SELECT p.a, p.b, round(1 - coalesce(dot, 0) / nullif(x.q * y.q, 0), 6) AS distance FROM pairs p LEFT JOIN d ON d.a = p.a AND d.b = p.b LEFT JOIN q x ON x.doc_id = p.a LEFT JOIN q y ON y.doc_id = p.b""",
    "wide_to_long": "SELECT l_shipdate::DATE AS date, l_returnflag AS symbol, sum(l_quantity) AS value FROM lineitem GROUP BY ALL",
    "momentum_lines": """
SELECT o_orderdate::DATE AS date, CASE WHEN o_orderkey % 50 <> 7 THEN (o_orderkey % 1000) / 100.0::DOUBLE END AS mom FROM orders WHERE o_orderkey % 10 NOT IN (3, 4)""",
    "sector_map": f"WITH {KINDS} SELECT symbol, sector FROM kinds",
    "factor_join": f"WITH {DAILY} SELECT date, mkt_rf, mom, ret FROM a JOIN b USING (date)",
    "missing_symbols": "SELECT DISTINCT c_custkey::VARCHAR AS symbol FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "ledger_chain_verify": CHAIN,
    "ledger_n_variance": """
WITH t AS (
  SELECT 'family' || ((event_id // 3) % 700) AS family, event_id % 3 = 2 AS done, event_id - event_id % 3 AS base, event_id, CASE WHEN event_id % 3 = 2 AND event_type <> 'error' THEN value END AS sharpe FROM events
)
SELECT family, count(*) FILTER (WHERE NOT done)::BIGINT AS n_trials, count(sharpe)::BIGINT AS n_with_sharpe, round(CASE WHEN count(sharpe) >= 2 THEN var_samp(sharpe) END, 6) AS sharpe_variance
FROM t GROUP BY family""",
    "verdict_fold": f"""
WITH {STEPS} SELECT trial, bool_and(passed) AS survives, arg_min(gate, ordinal) FILTER (WHERE NOT passed) AS died_at,
  max(sharpe) FILTER (WHERE gate = 'raw') AS headline_sharpe, arg_max(sharpe, ordinal) FILTER (WHERE passed AND sharpe IS NOT NULL) AS surviving_sharpe FROM steps GROUP BY trial""",
    "verdict_give_up": f"""
WITH {STEPS} SELECT trial, ordinal, round(sharpe - last_value(CASE WHEN passed THEN sharpe END IGNORE NULLS) OVER
  (PARTITION BY trial ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS give_up FROM steps""",
    "raw_deciles": f"WITH {RAW} SELECT month, round(ew, 6) AS ew, round(vw, 6) AS vw FROM spread",
    "raw_sharpe": f"WITH {RAW} SELECT round(avg(vw) / stddev_samp(vw) * sqrt(12), 6) AS sharpe FROM spread",
    "sector_neutral": f"WITH {NEUTRAL} SELECT month, round(ew, 5) AS ew, round(vw, 5) AS vw FROM spread",
    "breakeven_cost": f"""
WITH {RAW}, w AS (SELECT month, symbol, (CASE WHEN decile = 10 THEN 1.0 ELSE -1.0 END)::DOUBLE / count(*) OVER (PARTITION BY month, decile) AS weight FROM ranked WHERE decile IN (1, 10)),
later AS (SELECT (month + INTERVAL 1 MONTH)::DATE AS month, symbol, weight AS before FROM w),
change AS (SELECT coalesce(w.month, l.month) AS month, abs(coalesce(weight, 0) - coalesce(before, 0)) AS c FROM w FULL JOIN later l ON l.month = w.month AND l.symbol = w.symbol),
turned AS (SELECT month, sum(c) / 2 AS t FROM change WHERE month IN (SELECT month FROM w) AND month IN (SELECT month FROM later) GROUP BY month)
SELECT round((SELECT avg(ew) FROM spread), 5) AS mean_gross, round(avg(t), 5) AS mean_turnover, round((SELECT avg(ew) FROM spread) / (2 * avg(t)) * 10000, 5) AS breakeven_bps FROM turned""",
    "dsr_moments": f"""
WITH {RAW}, m AS (SELECT avg(vw) AS mu FROM spread)
SELECT count(vw)::BIGINT AS n, round(avg(vw) / stddev_samp(vw), 5) AS ratio, round(avg((vw - mu) ** 3) / pow(var_pop(vw), 1.5), 5) AS skew, round(avg((vw - mu) ** 4) / pow(var_pop(vw), 2), 5) AS kurtosis
FROM spread, m""",
    "stock_traits_by_month": f"WITH {CHARACTERISTICS} SELECT month, symbol, round(size, 5) AS size, round(value, 5) AS value, round(mom, 5) AS mom, round(str, 5) AS str FROM traits",
    "factor_legs": f"WITH {FACTORS} SELECT month, {', '.join(f'round({n}, 6) AS {n}' for n in FACTOR_NAMES)} FROM factors",
    "seven_factor_alpha": f"""
WITH {FACTORS}, {SPREAD.replace("legs AS", "spread_legs AS").replace("FROM legs", "FROM spread_legs").replace("ranked AS", "scores AS (SELECT month, symbol, round(score, 4) AS score FROM monthly WHERE score IS NOT NULL), ranked AS", 1)},
series AS (
  SELECT row_number() OVER (ORDER BY s.month) AS i, vw AS y, 1.0::DOUBLE AS z, {', '.join(FACTOR_NAMES)} FROM spread s JOIN factors f ON (f.month + INTERVAL 1 MONTH)::DATE = s.month
  WHERE vw IS NOT NULL AND {' AND '.join(f'{n} IS NOT NULL' for n in FACTOR_NAMES)}
), {orthogonal("series", FACTOR_NAMES, ("z", "y"), "i", "")},
fit AS (SELECT sum(z * y) / sum(z * z) AS alpha, sum(z * z) AS zz FROM done),
u AS (SELECT i, z * (y - alpha * z) AS u FROM done, fit),
v AS (SELECT sum(p.u * q.u * (1 - abs(p.i - q.i) / 6.0::DOUBLE)) AS s FROM u p JOIN u q ON abs(p.i - q.i) <= 5)
SELECT round(alpha, 5) AS alpha, round(sqrt(s) / zz, 5) AS error, round(alpha / (sqrt(s) / zz), 5) AS t FROM fit, v""",
    "four_trait_neutral": f"""
WITH {CHARACTERISTICS}, given AS (
  SELECT t.month, t.symbol, ln(m.score) AS y, size, value, mom, str FROM traits t JOIN monthly m ON m.month = t.month AND m.symbol = t.symbol
  WHERE m.score IS NOT NULL AND size IS NOT NULL AND value IS NOT NULL AND mom IS NOT NULL AND str IS NOT NULL
), centred AS (
  SELECT month, symbol, count(*) OVER (PARTITION BY month) AS n, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY month) AS {c}' for c in ("y", *TRAIT_NAMES))} FROM given
), {orthogonal("centred", TRAIT_NAMES, ("y",), "month, symbol, n", "PARTITION BY month")}
SELECT month, symbol, CASE WHEN n <= 5 THEN 0.0 ELSE round(y, 4) + 0.0 END AS score FROM done""",
    "isolation_scores": f"""
WITH {MONTHLY}, vols AS (
  SELECT symbol, month, ret, volume, px, stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY month ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING) AS vol, volume / nullif(lag(volume) OVER (PARTITION BY symbol ORDER BY month), 0) - 1 AS share_change FROM monthly
), cells AS (SELECT symbol, month, round(ret, 9) AS ret, round(volume, 9) AS volume, round(abs(ret) / nullif(vol, 0), 9) AS move, round(px, 9) AS px, round(share_change, 9) AS share_change FROM vols),
{forest_sql("cells", ("ret", "volume", "move", "px", "share_change"), ("symbol", "month"))}
SELECT symbol, month, round(anomaly, 6) AS anomaly FROM anomalies""",
    "hac_alpha": f"""
WITH {DAILY}, t AS (SELECT date, mkt_rf AS x, ret AS y, row_number() OVER (ORDER BY date) AS i FROM a JOIN b USING (date)),
s AS (SELECT count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM t),
u AS (SELECT i, y - intercept - slope * x AS u0, (y - intercept - slope * x) * x AS u1 FROM t, s),
g AS (
  SELECT sum(k * p.u0 * q.u0) AS m00, sum(k * (p.u0 * q.u1 + p.u1 * q.u0) / 2) AS m01, sum(k * p.u1 * q.u1) AS m11
  FROM u p JOIN u q ON abs(p.i - q.i) <= 5, LATERAL (SELECT 1 - abs(p.i - q.i) / 6.0::DOUBLE AS k)
), v AS (
  SELECT intercept, slope, sxx / d AS i00, -sx / d AS i01, n / d AS i11, m00, m01, m11 FROM (SELECT *, n * sxx - sx * sx AS d FROM s), g
), e AS (
  SELECT intercept, slope, sqrt(i00 * i00 * m00 + 2 * i00 * i01 * m01 + i01 * i01 * m11) AS e0, sqrt(i01 * i01 * m00 + 2 * i01 * i11 * m01 + i11 * i11 * m11) AS e1 FROM v
)
SELECT 'alpha' AS name, round(intercept, 6) AS coefficient, round(e0, 6) AS error, round(intercept / e0, 6) AS t FROM e
UNION ALL SELECT 'mkt_rf', round(slope, 6), round(e1, 6), round(slope / e1, 6) FROM e""",
    "pbo_cscv": """
WITH r AS (SELECT event_id % 10 AS config, (event_id // 10) % 16 AS block, value / 100 - 1.5 + (event_id % 10) / 50.0::DOUBLE AS ret FROM events),
b AS (SELECT config, block, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM r GROUP BY ALL),
masks AS (SELECT m FROM range(65536) t(m) WHERE bit_count(m) = 8),
sums AS (
  SELECT m, config, (m >> block) & 1 AS side, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM masks, b GROUP BY ALL
), rated AS (
  SELECT m, config, max(CASE WHEN side = 1 THEN ratio END) AS inside, max(CASE WHEN side = 0 THEN ratio END) AS outside
  FROM (SELECT *, (s / n) / nullif(sqrt(greatest((q - s * s / n) / (n - 1), 0)), 0) AS ratio FROM sums) GROUP BY ALL
), ranked AS (SELECT *, percent_rank() OVER (PARTITION BY m ORDER BY outside NULLS FIRST) AS oos FROM rated
), best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY m ORDER BY inside DESC NULLS LAST, config DESC) = 1)
SELECT count(*)::BIGINT AS n_splits, round(avg((oos < 0.5)::INTEGER), 4) AS pbo FROM best""",
    "integrity_rules": f"""
WITH {MONTHLY}, c AS (SELECT symbol, month AS date, round(px / 400) AS px, CASE WHEN volume > 60 THEN volume ELSE 0.0 END AS volume FROM grouped),
r AS (SELECT *, px / nullif(lag(px) OVER w, 0) AS ratio, coalesce((px <> lag(px) OVER w)::INTEGER, 1) AS moved FROM c WINDOW w AS (PARTITION BY symbol ORDER BY date)),
runs AS (SELECT *, ratio - 1 AS ret, sum(moved) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT symbol, date, round(ret, 6) AS ret, round(stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING), 6) AS trailing_vol,
  coalesce(list_bool_or(list_transform([0.1, 0.2, 0.25, 1 / 3, 0.5, 2.0, 3.0, 4.0, 5.0, 10.0]::DOUBLE[], lambda s: abs(ratio / s - 1) < 0.01)), FALSE) AS split_tick,
  count(*) OVER (PARTITION BY symbol, run) >= 3 AS stale, coalesce(volume = 0 AND ret <> 0, FALSE) AS odd_volume FROM runs""",
    "neutral_residuals": f"""
WITH {MONTHLY}, t AS (SELECT month, symbol, ln(score) AS y, ln(volume) AS a, px AS b FROM monthly WHERE score IS NOT NULL AND ret IS NOT NULL),
s AS (
  SELECT month, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS caa, covar_pop(a, b) AS cab, covar_pop(b, b) AS cbb, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby FROM t GROUP BY month
), f AS (SELECT *, (cbb * cay - cab * cby) / (caa * cbb - cab * cab) AS fa, (caa * cby - cab * cay) / (caa * cbb - cab * cab) AS fb FROM s)
SELECT month, symbol, CASE WHEN n <= 3 THEN 0.0 ELSE round(y - my - fa * (a - ma) - fb * (b - mb), 5) + 0.0 END AS score FROM t JOIN f USING (month)""",
    "tone_rate": f"""
WITH {COUNTS}, h AS (SELECT doc_id, sum(n)::BIGINT AS n_terms, coalesce(sum(n) FILTER (WHERE term IN ('not', 'the', 'nicht', 'les', 'erla', 'thion')), 0)::BIGINT AS n_hits FROM counts GROUP BY 1)
SELECT d.doc_id, coalesce(n_terms, 0) AS n_terms, coalesce(n_hits, 0) AS n_hits, round(n_hits / n_terms, 6) AS rate FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id""",
    "novel_share": r"""
WITH t AS (SELECT conv_id * 1000 + turn AS id, lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, text FROM conversations),
s AS (SELECT DISTINCT id, x FROM (SELECT id, trim(regexp_replace(lower(unnest(regexp_split_to_array(text, '[.!?\n]+'))), '\s+', ' ', 'g')) AS x FROM t) WHERE x <> ''),
n AS (SELECT t.id, t.prev, count(s.x) AS n, count(s.x) FILTER (WHERE o.x IS NULL) AS new FROM t LEFT JOIN s ON s.id = t.id LEFT JOIN s o ON o.id = t.prev AND o.x = s.x WHERE prev IS NOT NULL GROUP BY ALL)
SELECT id AS a, prev AS b, n::BIGINT AS n_sentences, new::BIGINT AS n_new, round(new / nullif(n, 0), 6) AS novel_share FROM n""",
    "embedding_distance": """
WITH e AS (SELECT vec_id, lag(vec_id) OVER w AS prev_vec_id, embedding::DOUBLE[] AS a, lag(embedding) OVER w::DOUBLE[] AS b FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id, prev_vec_id, round(1 - list_cosine_similarity(a, b), 5) AS distance FROM e""",
}
