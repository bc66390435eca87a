"""The registered queries as plain SQL for a second engine."""

from __future__ import annotations

from sessionlake.sources.pricing import RATES
from sessionlake.sources.tables import EVENT_PRICES

ORACLES: dict[str, str] = {}


def _number(value) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else f"CAST({value!r} AS DOUBLE)"


_PRICE_ROWS = ", ".join("('" + row[0] + "', " + ", ".join(_number(value) for value in row[1:]) + ")" for row in EVENT_PRICES)
_PRICES = f"prices(pmodel, {', '.join('r_' + name for name in RATES)}) AS (VALUES {_PRICE_ROWS})"

_REQUESTS = """
requests AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, ts, k, event_type,
    (k % 7 = 0) AS is_sidechain, CASE WHEN k % 3 = 0 THEN 'fast' ELSE '' END AS speed,
    CAST(round(value * 1000) AS BIGINT) AS input, k * 10 AS output, k * 100 AS write_5m, k % 5 AS write_1h,
    k * 1000 AS cache_read
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""

_NAMED = """
named AS (
  SELECT name, arg_min(pmodel, rank) AS pricing_model FROM (
    SELECT pmodel AS name, 0 AS rank, pmodel FROM prices
    UNION ALL SELECT substr(pmodel, 11), 1, pmodel FROM prices WHERE starts_with(pmodel, 'anthropic.')
    UNION ALL SELECT substr(pmodel, 11), 2, pmodel FROM prices WHERE starts_with(pmodel, 'anthropic/')
    UNION ALL SELECT substr(pmodel, 8), 3, pmodel FROM prices WHERE starts_with(pmodel, 'openai/')
  ) GROUP BY name
)"""


def _tier(tokens: str, base: str, low: str, high: str, factor: str = "") -> str:
    above = f"coalesce({low}, {high}){factor}"
    threshold = f"(CASE WHEN {low} IS NOT NULL THEN 200000 ELSE 272000 END)"
    return (
        f"(CASE WHEN {above} IS NULL OR {tokens} <= {threshold} THEN {tokens} * ({base}) "
        f"ELSE {threshold} * ({base}) + ({tokens} - {threshold}) * {above} END)"
    )


_COST = (
    "("
    + " + ".join(
        [
            _tier("input", "r_input", "r_input_200k", "r_input_272k"),
            _tier("output", "r_output", "r_output_200k", "r_output_272k"),
            _tier("write_5m", "coalesce(r_cache_write, r_input * 1.25)", "r_cache_write_200k", "r_cache_write_272k"),
            _tier("cache_read", "coalesce(r_cache_read, r_input * 0.1)", "r_cache_read_200k", "r_cache_read_272k"),
            _tier("write_1h", "r_input * 2", "r_input_200k", "r_input_272k", " * 2"),
        ]
    )
    + ") * (CASE WHEN speed = 'fast' AND coalesce(r_fast, 0) <> 0 THEN r_fast ELSE 1.0 END)"
)


def _priced(source: str) -> str:
    return f"""
priced AS (
  SELECT q.*, q.event_type AS model, p.*, p.pmodel AS pricing_model, p.pmodel IS NOT NULL AS priced,
    CASE WHEN p.pmodel IS NULL THEN 0.0 ELSE {_COST} END AS usd
  FROM {source} q
  LEFT JOIN named f ON f.name = (CASE WHEN q.speed = 'fast' THEN q.event_type || '-fast' END)
  LEFT JOIN named o ON o.name = q.event_type
  LEFT JOIN prices p ON p.pmodel = coalesce(f.pricing_model, o.pricing_model)
)"""


_DEDUP = """
ledger AS (
  SELECT * EXCLUDE (pick) FROM (
    SELECT *, min(event_id) OVER (PARTITION BY user_id, k, event_type) AS first_event_id,
      row_number() OVER (PARTITION BY user_id, k, event_type
        ORDER BY is_sidechain, input + output + write_5m + write_1h + cache_read DESC, event_id) AS pick
    FROM requests) WHERE pick = 1
)"""

_OWNED = """
starts AS (SELECT CAST(user_id AS VARCHAR) AS user_id, min(ts) AS started_at FROM events GROUP BY 1),
owned AS (
  SELECT p.*, first_value(p.user_id) OVER (PARTITION BY k, event_type ORDER BY s.started_at, p.user_id) AS owner_id
  FROM priced p JOIN starts s ON s.user_id = p.user_id
)"""

_WITH_PRICED = f"WITH {_PRICES}, {_REQUESTS}, {_NAMED}, {_priced('requests')}"
_WITH_LEDGER = f"WITH {_PRICES}, {_REQUESTS}, {_NAMED}, {_DEDUP}, {_priced('ledger')}"
_WITH_OWNED = f"{_WITH_LEDGER}, {_OWNED}"

ORACLES["price_requests"] = f"""{_WITH_PRICED}
SELECT event_id, model, speed, pricing_model, priced, NOT priced AS missing, round(usd, 8) AS usd FROM priced"""


def _bucket_rows(columns: str) -> str:
    factor = "(CASE WHEN speed = 'fast' AND coalesce(r_fast, 0) <> 0 THEN r_fast ELSE 1.0 END)"
    cells = [
        ("input", "input", "r_input", "r_input_200k", "r_input_272k", ""),
        ("output", "output", "r_output", "r_output_200k", "r_output_272k", ""),
        ("cache_write", "write_5m", "coalesce(r_cache_write, r_input * 1.25)", "r_cache_write_200k", "r_cache_write_272k", ""),
        ("cache_write", "write_1h", "r_input * 2", "r_input_200k", "r_input_272k", " * 2"),
        ("cache_read", "cache_read", "coalesce(r_cache_read, r_input * 0.1)", "r_cache_read_200k", "r_cache_read_272k", ""),
    ]
    parts = []
    for category, tokens, base, low, high, twice in cells:
        threshold = f"(CASE WHEN {low} IS NOT NULL THEN 200000 ELSE 272000 END)"
        split = f"(coalesce({low}, {high}) IS NOT NULL AND {tokens} > {threshold})"
        parts.append(
            f"SELECT {columns}, '{category}' AS category, ({base}) * {factor} AS rate, "
            f"CASE WHEN {split} THEN {threshold} ELSE {tokens} END AS tokens, false AS above FROM priced WHERE priced AND {tokens} > 0"
        )
        parts.append(
            f"SELECT {columns}, '{category}', coalesce({low}, {high}){twice} * {factor}, {tokens} - {threshold}, true "
            f"FROM priced WHERE priced AND {split}"
        )
    return " UNION ALL ".join(parts)


ORACLES["cost_buckets"] = f"""{_WITH_PRICED}
SELECT model, category, round(rate, 12) AS rate, CAST(sum(tokens) AS BIGINT) AS tokens, bool_and(above) AS above
FROM ({_bucket_rows('model')}) GROUP BY model, category, rate"""

ORACLES["cost_buckets_by_node"] = f"""{_WITH_PRICED}
SELECT node_id, category, round(sum(rate * tokens), 8) AS usd, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS buckets
FROM (SELECT node_id, model, category, rate, sum(tokens) AS tokens
      FROM ({_bucket_rows('user_id AS node_id, model')}) GROUP BY ALL) GROUP BY node_id, category"""

_OVERLAY = """
overlaid AS (
  SELECT * FROM prices WHERE pmodel NOT IN ('gpt-5-view', 'openai/gpt-5-click', 'click')
  UNION ALL BY NAME
  SELECT * FROM (VALUES ('gpt-5-view', 7e-6::DOUBLE, 21e-6::DOUBLE), ('openai/gpt-5-click', 1e-6, 3e-6), ('click', 9e-6, 9e-6)) v(pmodel, r_input, r_output)
),
lookup AS (
  SELECT pmodel AS name, pmodel, 0 AS rank FROM overlaid
  UNION ALL SELECT substr(pmodel, 11), pmodel, 1 FROM overlaid WHERE starts_with(pmodel, 'anthropic.')
  UNION ALL SELECT substr(pmodel, 11), pmodel, 2 FROM overlaid WHERE starts_with(pmodel, 'anthropic/')
  UNION ALL SELECT substr(pmodel, 8), pmodel, 3 FROM overlaid WHERE starts_with(pmodel, 'openai/')
),
asked AS (
  SELECT event_id, input, output, cache_read, 0 AS write_5m, 0 AS write_1h, '' AS speed,
    CASE WHEN event_type IN ('view', 'click') THEN 'gpt-5-' || event_type ||
      (CASE event_id % 4 WHEN 0 THEN '-sol' WHEN 1 THEN '-terra' WHEN 2 THEN '-luna' ELSE '' END) ELSE event_type END AS model
  FROM requests
),
chosen AS (
  SELECT model, arg_min(pmodel, pos) AS pmodel, min(pos) < 10 AS exact FROM (
    SELECT a.model, l.pmodel, l.rank AS pos FROM (SELECT DISTINCT model FROM asked) a JOIN lookup l ON l.name = a.model
    UNION ALL
    SELECT a.model, l.pmodel, 10 + l.rank FROM (SELECT DISTINCT model FROM asked) a
      JOIN lookup l ON l.name = regexp_replace(a.model, '-(sol|terra|luna)$', '') AND starts_with(a.model, 'gpt-5') AND l.name <> a.model
    UNION ALL SELECT a.model, l.pmodel, 20 + l.rank FROM (SELECT DISTINCT model FROM asked) a JOIN lookup l ON l.name = 'purchase'
  ) GROUP BY model
)"""

ORACLES["standin_prices"] = f"""WITH {_PRICES}, {_REQUESTS}, {_OVERLAY}
SELECT event_id, model, pmodel AS pricing_model, exact, NOT exact AS estimated, round({_COST}, 8) AS usd
FROM (SELECT a.* EXCLUDE (input), greatest(0, a.input - a.cache_read) AS input, c.exact, o.*
      FROM asked a JOIN chosen c USING (model) JOIN overlaid o ON o.pmodel = c.pmodel)"""

ORACLES["dedup_requests"] = f"""WITH {_REQUESTS}, {_DEDUP}
SELECT user_id, CAST(k AS VARCHAR) AS message_id, event_type AS request_id, event_id, input, is_sidechain, first_event_id FROM ledger"""

ORACLES["owned_cost"] = f"""{_WITH_OWNED}
SELECT user_id, round(sum(usd), 8) AS gross_usd, round(sum(CASE WHEN owner_id = user_id THEN usd ELSE 0.0 END), 8) AS owned_usd,
  count(*) FILTER (WHERE owner_id <> user_id) AS replayed,
  CAST(sum(CASE WHEN owner_id = user_id THEN input ELSE 0 END) AS BIGINT) AS owned_input
FROM owned GROUP BY user_id"""

ORACLES["replay_report"] = f"""{_WITH_OWNED}
SELECT user_id, owner_id, round(sum(usd), 8) AS usd, count(*) AS requests FROM owned WHERE owner_id <> user_id GROUP BY 1, 2"""

ORACLES["usage_by_model"] = f"""{_WITH_OWNED}
SELECT user_id, model, CAST(sum(input) AS BIGINT) AS uncached_input, CAST(sum(output) AS BIGINT) AS output,
  CAST(sum(write_5m) AS BIGINT) AS write_5m, CAST(sum(write_1h) AS BIGINT) AS write_1h, CAST(sum(cache_read) AS BIGINT) AS cache_read,
  CAST(sum(input + output + write_5m + write_1h + cache_read) AS BIGINT) AS total, count(*) AS requests,
  round(sum(usd), 8) AS usd, round(sum(CASE WHEN owner_id <> user_id THEN usd ELSE 0.0 END), 8) AS replayed_usd,
  round(greatest(0.0, sum(usd) - sum(CASE WHEN owner_id <> user_id THEN usd ELSE 0.0 END)), 8) AS owned_usd
FROM owned GROUP BY user_id, model"""

ORACLES["costliest_model"] = f"""{_WITH_LEDGER},
costs AS (SELECT user_id, model, sum(usd) AS usd, min(first_event_id) AS first_at, NOT bool_and(priced) AS missing, count(*) OVER (PARTITION BY user_id) AS models
          FROM priced GROUP BY user_id, model),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY usd DESC, first_at) AS n FROM costs)
SELECT user_id, model, models, round(usd, 8) AS usd,
  model || (CASE WHEN models > 1 THEN ' +' || (models - 1) ELSE '' END) || (CASE WHEN missing THEN '!' ELSE '' END) AS label
FROM ranked WHERE n = 1"""

_USERS = f"""{_WITH_OWNED},
users AS (
  SELECT e.user_id, u, started_at, updated_at, messages, coalesce(usd, 0.0) AS usd, coalesce(tokens, 0) AS tokens,
    coalesce(missing, '') AS missing, 'p' || (u % 4) AS project
  FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, user_id AS u, min(ts) AS started_at, max(ts) AS updated_at, count(*) AS messages FROM events GROUP BY ALL) e
  LEFT JOIN (SELECT user_id, sum(usd) AS usd, CAST(sum(input + output + write_5m + write_1h + cache_read) AS BIGINT) AS tokens,
      string_agg(DISTINCT CASE WHEN NOT priced THEN model END, ',') AS missing
    FROM owned WHERE owner_id = user_id GROUP BY user_id) o USING (user_id)
)"""

ORACLES["list_sessions"] = f"""{_USERS}
SELECT user_id AS session_id, project, messages, tokens, round(usd, 8) AS usd FROM users
WHERE u % 4 = 1 ORDER BY tokens DESC, user_id LIMIT 20 OFFSET 5"""

ORACLES["list_page_info"] = f"""{_USERS}
SELECT 3 AS "offset", 10 AS "limit", least(10, greatest(0, n - 3)) AS returned, n AS total, least(10, greatest(0, n - 3)) + 3 < n AS has_more,
  least(10, greatest(0, n - 3)) + 3 AS next_offset
FROM (SELECT count(*) AS n FROM users WHERE project = 'p2' AND updated_at >= TIMESTAMP '2024-01-29 12:00:00')"""

ORACLES["list_fuzzy"] = """
SELECT c_custkey, c_mktsegment AS project, c_name AS title FROM customer
WHERE regexp_matches(lower('claude ' || c_mktsegment || ' ' || c_name), 'm.*a.*c.*h.* .*0.*1', 's')"""

ORACLES["sort_display"] = f"""{_USERS}
SELECT row_number() OVER (ORDER BY project DESC, user_id) AS rank, project, user_id AS path, messages FROM users"""

ORACLES["corpus_summary"] = f"""{_USERS}
SELECT count(*) AS sessions, count(DISTINCT project) AS projects, round(sum(usd), 8) AS usd, false AS estimated,
  max(missing) AS missing_pricing FROM users"""

_PLACES = """
RECURSIVE place AS (
  SELECT 'r' || r_regionkey AS node_id, CAST(NULL AS VARCHAR) AS parent, r_name AS title, false AS is_group FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, true FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, false FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, false FROM supplier
),
own AS (
  SELECT 'c' || o_custkey AS node_id, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n,
    bool_or(o_orderpriority = '1-URGENT') AS urgent, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at
  FROM orders GROUP BY 1
),
walk AS (
  SELECT node_id AS ancestor, node_id AS descendant, 0 AS depth FROM place
  UNION ALL
  SELECT w.ancestor, p.node_id, w.depth + 1 FROM walk w JOIN place p ON p.parent = w.descendant
)"""

ORACLES["tree_closure"] = f"WITH {_PLACES} SELECT ancestor, descendant, depth FROM walk WHERE depth > 0"

_ROLLED = f"""WITH {_PLACES},
gaps AS (SELECT DISTINCT 'c' || o_custkey AS node_id, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'P'),
rolled AS (
  SELECT w.ancestor AS node_id, sum(coalesce(o.cents, 0)) AS cents, sum(coalesce(o.n, 0)) AS n,
    sum(CASE WHEN depth > 0 THEN coalesce(o.cents, 0) ELSE 0 END) AS below_cents, sum(CASE WHEN depth > 0 THEN coalesce(o.n, 0) ELSE 0 END) AS below_n,
    count(*) FILTER (WHERE depth > 0 AND NOT p.is_group) AS subagents, coalesce(bool_or(o.urgent), false) AS urgent, max(o.last_at) AS updated_at
  FROM walk w JOIN place p ON p.node_id = w.descendant LEFT JOIN own o ON o.node_id = w.descendant GROUP BY 1
)"""

ORACLES["tree_rollup"] = f"""{_ROLLED}
SELECT r.node_id, CAST(cents - below_cents + n - below_n AS BIGINT) AS self_total, CAST(below_cents + below_n AS BIGINT) AS desc_total,
  CAST(cents + n AS BIGINT) AS total_total, round(cents / 100.0, 2) AS total_usd, round(below_cents / 100.0, 2) AS desc_usd, subagents,
  urgent AS total_estimated, coalesce(m.missing, '') AS missing, updated_at
FROM rolled r LEFT JOIN (SELECT ancestor AS node_id, string_agg(p, ',' ORDER BY p) AS missing
  FROM (SELECT DISTINCT w.ancestor, g.p FROM walk w JOIN gaps g ON g.node_id = w.descendant) GROUP BY 1) m USING (node_id)"""

ORACLES["tree_preorder"] = f"""WITH {_PLACES},
line AS (
  SELECT node_id, node_id AS root_id, 0 AS depth, node_id AS sort_path FROM place WHERE parent IS NULL
  UNION ALL
  SELECT p.node_id, l.root_id, l.depth + 1, l.sort_path || '/' || p.node_id FROM line l JOIN place p ON p.parent = l.node_id
)
SELECT node_id, root_id, depth, sort_path FROM line"""

ORACLES["cost_tree"] = f"""{_ROLLED}
SELECT r.node_id, w.depth, p.title, CAST(cents - below_cents AS BIGINT) AS self_uncached_input, CAST(cents AS BIGINT) AS total_uncached_input,
  round((cents - below_cents) / 100.0, 2) AS own_usd, round(cents / 100.0, 2) AS total_usd
FROM rolled r JOIN walk w ON w.descendant = r.node_id AND w.ancestor = 'r1' JOIN place p ON p.node_id = r.node_id"""


def _refs(session_id: str, escaped: str) -> str:
    return f"""WITH {_PLACES},
named AS (SELECT *, {session_id} AS session_id FROM place),
line AS (
  SELECT node_id, node_id AS root_id, 0 AS depth, session_id, 'claude:' || {escaped} AS ref FROM named WHERE parent IS NULL
  UNION ALL
  SELECT p.node_id, l.root_id, l.depth + 1, p.session_id, l.ref || (CASE WHEN l.depth = 0 THEN '#' ELSE '/' END) || {escaped.replace('session_id', 'p.session_id')}
  FROM line l JOIN named p ON p.parent = l.node_id
)"""


_ESCAPED = "replace(replace(replace(replace(session_id, '#', '%23'), ' ', '%20'), '*', '%2A'), '/', '%2F')"

ORACLES["canonical_ref"] = f"""{_refs("replace(title, '#', ' ~*&/')", _ESCAPED)}
SELECT node_id, root_id, depth, ref FROM line"""

ORACLES["addressable"] = f"""{_refs("CASE WHEN node_id LIKE 'c%' THEN 'c' || (CAST(substr(node_id, 2) AS BIGINT) % 997) ELSE node_id END", _ESCAPED)}
SELECT DISTINCT '/lake/' || root_id || '.jsonl' AS path, 'unaddressable_session' AS code, 'two nodes of this tree share one reference' AS message
FROM line WHERE ref IN (SELECT ref FROM line GROUP BY ref HAVING count(*) > 1)"""

ORACLES["resolve_selector"] = f"""{_refs("title", _ESCAPED)},
asked AS (
  SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN substr(c_name, 1, 17) WHEN 2 THEN '/lake/c' || c_custkey || '.jsonl' ELSE 'no-' || c_name END AS selector
  FROM customer
),
found AS (
  SELECT a.selector, l.ref, CASE WHEN l.ref = a.selector THEN 1 WHEN '/lake/' || l.node_id || '.jsonl' = a.selector THEN 2 WHEN l.session_id = a.selector THEN 3 ELSE 4 END AS p
  FROM asked a JOIN line l ON l.ref = a.selector OR '/lake/' || l.node_id || '.jsonl' = a.selector OR starts_with(l.session_id, a.selector)
),
best AS (SELECT * FROM found QUALIFY p = min(p) OVER (PARTITION BY selector))
SELECT a.selector, CASE WHEN count(b.ref) = 0 THEN 'not_found' WHEN count(b.ref) > 1 THEN 'ambiguous_ref' ELSE 'ok' END AS status,
  count(b.ref) AS candidates, min(b.ref) AS first_ref
FROM asked a LEFT JOIN best b ON b.selector = a.selector GROUP BY a.selector"""

ORACLES["subagent_refs"] = f"""{_refs("node_id", _ESCAPED)}
SELECT u.ref, l.ref AS child_ref FROM line l JOIN place p ON p.node_id = l.node_id JOIN line u ON u.node_id = p.parent"""

ORACLES["sibling_titles"] = """
WITH lines AS (
  SELECT c_custkey, c_nationkey, 0 AS pos, c_mktsegment AS line FROM customer
  UNION ALL SELECT c_custkey, c_nationkey, 1, 'balance ' || CAST(floor(c_acctbal / 10) AS BIGINT) FROM customer
  UNION ALL SELECT c_custkey, c_nationkey, 2, c_name FROM customer
),
counted AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, line) AS uses FROM lines)
SELECT 'c' || c_custkey AS node_id, CASE WHEN max(CASE WHEN pos = 0 THEN uses END) = 1 THEN arg_min(line, pos) ELSE arg_min(line, pos) FILTER (WHERE uses = 1) END AS title
FROM counted GROUP BY c_custkey"""

_EVENT_ROWS = """
rows AS (
  SELECT user_id, event_id, epoch_us(ts) AS seq, ts, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CAST(round(value * 1000) AS BIGINT) AS tokens FROM events
)"""

ORACLES["pair_tool_result"] = f"""WITH {_EVENT_ROWS},
seen AS (
  SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS click_id,
    last_value(CASE WHEN event_type = 'click' THEN tokens END IGNORE NULLS) OVER w AS click_tokens
  FROM rows WINDOW w AS (PARTITION BY user_id, k % 2 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT event_id, click_id, click_tokens FROM seen WHERE event_type = 'purchase'"""

ORACLES["prompt_context"] = f"""WITH {_EVENT_ROWS},
runs AS (SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS run FROM rows)
SELECT event_id, coalesce(context, 0) AS context FROM (
  SELECT event_id, event_type, first_value(CASE WHEN event_type IN ('click', 'purchase') THEN tokens END IGNORE NULLS)
    OVER (PARTITION BY user_id, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS context FROM runs
) WHERE event_type = 'view'"""

ORACLES["request_target"] = f"""WITH {_EVENT_ROWS},
segments AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rows)
SELECT user_id, max(CASE WHEN event_type = 'signup' THEN seq END) AS seq, min(CASE WHEN event_type IN ('click', 'purchase') THEN seq END) AS target
FROM segments GROUP BY user_id, coalesce(before, 0) HAVING max(CASE WHEN event_type = 'signup' THEN seq END) IS NOT NULL"""

ORACLES["event_index"] = f"""WITH {_EVENT_ROWS}
SELECT event_id, n - 1 AS event_index FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n FROM rows)"""

ORACLES["mirror_dedup"] = f"""WITH RECURSIVE {_EVENT_ROWS},
marked AS (
  SELECT user_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n, k % 2 = 0 AS billed,
    CASE WHEN event_type = 'signup' THEN 'token' WHEN event_type IN ('click', 'purchase') THEN 'target' ELSE 'other' END AS role,
    CASE WHEN event_type IN ('click', 'view') THEN event_type || '-' || (k % 9) ELSE '' END AS key
  FROM rows
),
fold AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS slot, CAST([] AS VARCHAR[]) AS keys, CAST([] AS BIGINT[]) AS seqs, false AS candidate
  FROM (SELECT DISTINCT user_id FROM rows)
  UNION ALL
  SELECT user_id, n, seq, CASE WHEN hit > 0 THEN seqs[hit] ELSE seq END,
    CASE WHEN keeps THEN list_slice(list_prepend(key, keys), 1, 16) ELSE keys END,
    CASE WHEN keeps THEN list_slice(list_prepend(seq, seqs), 1, 16) ELSE seqs END,
    CASE WHEN role = 'token' THEN false ELSE candidate OR (keeps AND role = 'target') END
  FROM (
    SELECT *, CASE WHEN role = 'token' THEN billed AND NOT candidate ELSE hit = 0 END AS keeps FROM (
      SELECT m.*, f.keys, f.seqs, f.candidate, CASE WHEN m.role = 'token' OR m.key = '' THEN 0 ELSE coalesce(list_position(f.keys, m.key), 0) END AS hit
      FROM fold f JOIN marked m ON m.user_id = f.user_id AND m.n = f.n + 1
    )
  )
)
SELECT user_id, seq, slot FROM fold WHERE n > 0"""

ORACLES["replay_prefix"] = f"""WITH {_EVENT_ROWS},
tokens AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS second, event_type, k FROM rows),
clicks AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM tokens WHERE event_type = 'click'),
replayed AS (SELECT user_id, min(second) AS replay_second FROM clicks WHERE n <= 2 GROUP BY user_id HAVING count(*) = 2 AND min(second) = max(second)),
ended AS (SELECT user_id, replay_second, min(event_id) FILTER (WHERE second > replay_second) AS replay_end FROM tokens JOIN replayed USING (user_id) GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS user_id, replay_second, replay_end,
  max(event_id) FILTER (WHERE second = replay_second AND k % 4 <> 0 AND (replay_end IS NULL OR event_id < replay_end)) AS baseline
FROM tokens JOIN ended USING (user_id) GROUP BY ALL"""

_SPOKEN = "spoken AS (SELECT * FROM requests WHERE event_type IN ('click', 'signup', 'error'))"
_SPOKEN_LEDGER = _DEDUP.replace("FROM requests", "FROM spoken")

ORACLES["transcript_ledger"] = f"""WITH {_PRICES}, {_REQUESTS}, {_NAMED}, {_SPOKEN}, {_SPOKEN_LEDGER}, {_priced('ledger')}
SELECT user_id, CAST(k AS VARCHAR) AS message_id, event_type AS request_id, event_id, input, output, write_5m, write_1h, cache_read, round(usd, 8) AS usd FROM priced"""

ORACLES["transcript_models"] = f"""WITH {_REQUESTS}, {_SPOKEN}
SELECT user_id, string_agg(event_type, ',' ORDER BY pos) AS models FROM (SELECT user_id, event_type, min(event_id) AS pos FROM spoken GROUP BY ALL) GROUP BY 1"""

ORACLES["transcript_summary"] = f"""WITH {_EVENT_ROWS}
SELECT CAST(user_id AS VARCHAR) AS session_id, coalesce('Prompt ' || arg_min(k, event_id) FILTER (WHERE event_type = 'view'), '') AS title, 'u' || user_id AS project,
  count(*) FILTER (WHERE event_type IN ('view', 'signup', 'error')) AS messages, bool_or(event_type = 'error') AS has_error,
  strftime(arg_min(ts, event_id), '%Y-%m-%dT%H:%M:%S.%fZ') AS started_raw, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS updated_raw
FROM rows GROUP BY user_id"""

ORACLES["transcript_events"] = f"""WITH {_EVENT_ROWS},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS event_index,
    last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS call_id,
    last_value(CASE WHEN event_type = 'click' THEN ts END IGNORE NULLS) OVER w AS call_ts,
    tokens + k * 10 + k * 1000 + k * 100 + k % 5 AS total
  FROM rows WINDOW w AS (PARTITION BY user_id, k ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
shown AS (
  SELECT *, CASE event_type WHEN 'view' THEN 'Prompt ' || k WHEN 'signup' THEN 'Reply ' || k WHEN 'error' THEN 'Failed ' || k WHEN 'click' THEN ''
      ELSE CASE WHEN call_id IS NOT NULL AND k % 2 = 0 THEN 'exit ' || (CASE WHEN k % 3 = 0 THEN k ELSE 0 END)
        WHEN k % 3 = 0 THEN 'Exit code ' || k ELSE 'fine ' || k END END AS text
  FROM placed
),
answers AS (
  SELECT call_id AS event_id, arg_max(text, event_id) AS summary, arg_max((epoch_us(ts) - epoch_us(call_ts)) // 1000, event_id) AS duration_ms
  FROM shown WHERE event_type = 'purchase' AND call_id IS NOT NULL GROUP BY 1
),
heads AS (
  SELECT min(event_id) AS event_id, arg_max(tokens, total * 1000000 - event_id) AS usage_input, max(k * 10) AS usage_output
  FROM placed WHERE event_type IN ('click', 'signup', 'error') GROUP BY user_id, k, event_type
)
SELECT CAST(user_id AS VARCHAR) AS user_id, event_index,
  CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'tool-call' WHEN 'purchase' THEN 'tool-result' ELSE 'assistant-text' END AS kind, text,
  CASE WHEN event_type <> 'click' THEN '' WHEN k % 2 = 0 THEN 'run ' || k ELSE '{{"command":"run ' || k || '"}}' END AS tool_input,
  coalesce(summary, '') AS summary, coalesce(duration_ms, 0) AS duration_ms, usage_input, usage_output
FROM shown LEFT JOIN answers USING (event_id) LEFT JOIN heads USING (event_id)"""

_ROLLOUTS = f"""{_EVENT_ROWS},
stated AS (
  SELECT *, least(k, tokens) AS cached, event_type = 'click' AS is_token, user_id % 3 AS third,
    coalesce(last_value(CASE WHEN event_type = 'view' AND k % 10 <> 0 THEN 'model-' || (k % 3) END IGNORE NULLS) OVER w, '') AS model,
    coalesce(last_value(CASE WHEN event_type = 'view' THEN CASE WHEN k % 10 = 0 THEN '' ELSE 'model-' || (k % 3) END END IGNORE NULLS) OVER w, '') AS line_model,
    sum(CASE WHEN event_type = 'click' AND k % 5 <> 0 THEN tokens ELSE 0 END) OVER w AS sum_inp,
    sum(CASE WHEN event_type = 'click' AND k % 5 <> 0 THEN least(k, tokens) ELSE 0 END) OVER w AS sum_cached,
    sum(CASE WHEN event_type = 'click' AND k % 5 <> 0 THEN k ELSE 0 END) OVER w AS sum_out
  FROM rows WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
clicks AS (
  SELECT *, CASE WHEN third = 2 THEN false ELSE
      sum_inp + (CASE WHEN third = 1 THEN 1000 ELSE 0 END) > coalesce(lag(sum_inp) OVER p + (CASE WHEN third = 1 THEN 1000 ELSE 0 END), 0)
      OR sum_cached > coalesce(lag(sum_cached) OVER p, 0) OR sum_out > coalesce(lag(sum_out) OVER p, 0) END AS advances
  FROM stated WHERE is_token WINDOW p AS (PARTITION BY user_id ORDER BY event_id)
),
accepted AS (SELECT * FROM clicks WHERE third = 2 OR advances),
ledgers AS (
  SELECT user_id, false AS is_aggregate, model, event_id, tokens AS input, cached AS cache_read, k AS output FROM accepted WHERE third = 0
  UNION ALL
  SELECT user_id, true, arg_max(model, event_id), NULL, max(sum_inp) + (CASE WHEN third = 1 THEN 1000 ELSE 0 END), max(sum_cached), max(sum_out)
  FROM clicks WHERE third = 1 OR (third = 0 AND user_id NOT IN (SELECT user_id FROM accepted)) GROUP BY user_id, third
  UNION ALL
  SELECT user_id, true, model, NULL, sum(tokens), sum(cached), sum(k) FROM accepted WHERE third = 2 GROUP BY user_id, model
)"""

ORACLES["rollout_ledger"] = f"""WITH {_ROLLOUTS}
SELECT CAST(user_id AS VARCHAR) AS user_id, is_aggregate, model, CAST(input AS BIGINT) AS input, CAST(cache_read AS BIGINT) AS cache_read, CAST(output AS BIGINT) AS output FROM ledgers"""

ORACLES["current_model"] = f"""WITH {_ROLLOUTS} SELECT event_id, model, line_model, advances FROM clicks"""

ORACLES["rollout_events"] = f"""WITH {_ROLLOUTS},
segments AS (SELECT *, coalesce(sum(CASE WHEN is_token THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM stated),
spent AS (
  SELECT s.user_id, s.event_id, s.tokens, t.target FROM segments s JOIN accepted a USING (event_id)
  LEFT JOIN (SELECT user_id, segment, min(event_id) AS target FROM segments WHERE event_type IN ('signup', 'error') GROUP BY ALL) t ON t.user_id = s.user_id AND t.segment = s.segment
  WHERE s.third = 0
),
shown AS (
  SELECT s.user_id, s.event_id AS pos, CASE event_type WHEN 'purchase' THEN 'user' WHEN 'signup' THEN 'assistant-text' ELSE 'tool-call' END AS kind,
    CASE event_type WHEN 'purchase' THEN 'ask ' || s.event_id WHEN 'signup' THEN 'answer ' || s.event_id ELSE '' END AS text, false AS usage_aggregate, p.tokens AS usage_input
  FROM stated s LEFT JOIN spent p ON p.target = s.event_id WHERE event_type IN ('purchase', 'signup', 'error')
  UNION ALL SELECT user_id, event_id, 'usage', 'unattributed usage', false, tokens FROM spent WHERE target IS NULL
  UNION ALL SELECT l.user_id, 1000000000000 + coalesce(f.first_at, 0), 'usage', 'session usage', true, l.input FROM ledgers l
    LEFT JOIN (SELECT user_id, model, min(event_id) AS first_at FROM accepted WHERE third = 2 GROUP BY ALL) f ON f.user_id = l.user_id AND f.model = l.model
    WHERE is_aggregate
)
SELECT CAST(user_id AS VARCHAR) AS user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS event_index, kind, text, usage_aggregate, CAST(usage_input AS BIGINT) AS usage_input FROM shown"""

ORACLES["skip_malformed"] = "SELECT doc_id, 'malformed_line' AS code FROM documents WHERE doc_id % 3 = 0"

ORACLES["manifest_diff"] = """
SELECT '/lake/p' || p_partkey || '.jsonl' AS path,
  CASE WHEN p_partkey % 7 = 0 THEN 'created' WHEN p_partkey % 11 = 0 THEN 'removed' ELSE 'changed' END AS change
FROM part WHERE NOT (p_partkey % 7 = 0 AND p_partkey % 11 = 0) AND (p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR p_partkey % 5 = 0)"""

ORACLES["removed_sessions"] = """
SELECT DISTINCT user_id AS node_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)"""

ORACLES["usage_per_window"] = f"""WITH {_EVENT_ROWS}
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS model, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS input, CAST(sum(k) AS BIGINT) AS output
FROM rows GROUP BY ALL"""

_TURNS = """
turns AS (
  SELECT conv_id, turn AS event_index, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant-text' ELSE 'tool-call' END AS kind, 'claude:' || conv_id AS ref,
    role = 'system' AS is_tool, text AS body, text AS head FROM conversations
),
fields AS (
  SELECT *, 0 AS field_rank, 'text' AS field, CASE WHEN NOT is_tool THEN body WHEN head = '' THEN 'Note' ELSE 'Note(' || head || ')' END AS text FROM turns
  UNION ALL SELECT *, 1, 'tool.input', body FROM turns WHERE is_tool
)"""


def _hits(start: str, length: str, count: str, around: int, where: str) -> str:
    return f"""WITH {_TURNS},
found AS (SELECT *, {start} AS range_start, {start} + {length} AS range_end, {count} AS matches, length(text) AS size FROM fields WHERE text <> '' AND {where})
SELECT ref, event_index, kind, field, CAST(range_start AS BIGINT) AS range_start, CAST(range_end AS BIGINT) AS range_end, CAST(matches AS BIGINT) AS matches,
  (CASE WHEN range_start > {around} THEN '…' ELSE '' END) ||
  substr(text, CAST(greatest(0, range_start - {around}) + 1 AS BIGINT), CAST(least(size, range_end + {around}) - greatest(0, range_start - {around}) AS BIGINT)) ||
  (CASE WHEN range_end + {around} < size THEN '…' ELSE '' END) AS snippet
FROM found"""


def _literal(text: str, word: str) -> tuple[str, str, str, str]:
    return (
        f"(strpos({text}, '{word}') - 1)", str(len(word)),
        f"((length({text}) - length(replace({text}, '{word}', ''))) // {len(word)})", f"contains({text}, '{word}')",
    )


def _literal_hits(text: str, word: str, around: int, extra: str = "true") -> str:
    start, size, count, where = _literal(text, word)
    return _hits(start, size, count, around, f"{where} AND {extra}")


ORACLES["search_literal"] = _literal_hits("lower(text)", "the", 20)
ORACLES["search_literal_cs"] = _literal_hits("text", "The", 10, "kind IN ('user', 'tool-call')")
ORACLES["search_regex"] = _hits(
    "length(regexp_extract(text, '(?is)^(.*?)(?:[a-z]+ing|err?)', 1))", "length(regexp_extract(text, '(?i)[a-z]+ing|err?'))",
    "len(regexp_extract_all(text, '(?i)[a-z]+ing|err?'))", 12, "conv_id % 5 = 2 AND regexp_matches(text, '(?i)[a-z]+ing|err?')",
)
ORACLES["search_page"] = f"""WITH {_TURNS}
SELECT ref, event_index, field, CAST(strpos(lower(text), 'on') - 1 AS BIGINT) AS range_start,
  CAST((length(lower(text)) - length(replace(lower(text), 'on', ''))) // 2 AS BIGINT) AS matches
FROM fields WHERE contains(lower(text), 'on') ORDER BY conv_id % 13 DESC, ref, event_index, field_rank LIMIT 15 OFFSET 10"""
ORACLES["search_counts"] = f"""WITH {_TURNS}
SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions_scanned, count(DISTINCT ref) AS sessions_matched, count(*) AS total, true AS complete
FROM fields WHERE contains(lower(text), 'would')"""
ORACLES["search_documents"] = r"""
SELECT doc_id, length(pre) AS range_start, length(pre) + 6 AS range_end, len(regexp_extract_all(text, '(?i)\b[a-z]{3}ing\b')) AS matches
FROM (SELECT doc_id, text, regexp_extract(text, '(?is)^(.*?)\b[a-z]{3}ing\b', 1) AS pre FROM documents WHERE regexp_matches(text, '(?i)\b[a-z]{3}ing\b'))"""

ORACLES["byte_budget_page"] = """
SELECT conv_id, turn FROM (
  SELECT conv_id, turn, sum(strlen(text)) OVER (ORDER BY conv_id, turn) AS total, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations
) WHERE total <= 60000 OR n = 1"""


def _bounded(text: str, limit: int) -> str:
    head = (limit - 1) // 2
    return f"CASE WHEN length({text}) > {limit} THEN left({text}, {head}) || '…' || right({text}, {limit - 1 - head}) ELSE {text} END"


ORACLES["event_rows"] = f"""WITH {_TURNS},
shown AS (SELECT *, CASE WHEN NOT is_tool THEN body WHEN head = '' THEN 'Note' ELSE 'Note(' || head || ')' END AS text, CASE WHEN is_tool THEN body ELSE '' END AS input FROM turns)
SELECT CAST(conv_id AS VARCHAR) AS node_id, event_index, {_bounded('text', 60)} AS text, {_bounded('input', 60)} AS input, length(text) > 60 AS cut FROM shown"""

ORACLES["token_scan"] = r"""
WITH names AS (SELECT trim(unnest(regexp_extract_all(text, '[A-Za-z]+ [A-Za-z]+ [A-Za-z]+'))) AS token FROM benchmark),
tokens AS (SELECT DISTINCT token FROM names WHERE token <> '' AND length(token) >= 5),
texts AS (SELECT 'document ' || doc_id AS text_id, text FROM documents UNION ALL SELECT 'page ' || page_id, html FROM pages)
SELECT text_id, token FROM texts JOIN tokens ON contains(lower(text), lower(token))"""

_WS = r"\t\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '\A[\n{_WS}]+', ''), '[\n{_WS}]+\z', '')"


ORACLES["clean_text"] = rf"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '\n\n\n+', E'\n\n', 'g'), '\A\n+', ''), '\n+\z', '')) AS digest FROM (
  SELECT doc_id, regexp_replace(regexp_replace(t, '[{_WS}]+\n', E'\n', 'g'), '[{_WS}]+\z', '') AS t FROM (
    SELECT doc_id, replace(text, '. ', E'.  \n\n\n') || (CASE WHEN doc_id % 2 = 0 THEN E'\nx ' ELSE E'\n' END) AS t FROM documents))"""


def _title(line: str) -> str:
    cleaned = (
        rf"regexp_replace(regexp_replace(regexp_replace({_strip(line)}, '\A(<[^>]*>[{_WS}]*)+', ''), '</[^>]*>', '', 'g'), '\A[{_WS}#>*-]+', '')"
    )
    return f"(CASE WHEN length({cleaned}) > 96 THEN left({cleaned}, 95) || '…' ELSE {_strip(cleaned)} END)"


_FIRST = "string_split(text, chr(10))[1]"
ORACLES["clean_title"] = f"SELECT doc_id, {_title(f'''('## <b>' || {_FIRST})''')} AS title FROM documents"

ORACLES["elide_encrypted"] = """
SELECT doc_id, md5(replace(text, ' the ', ' ' || token || ' ') || ' x' || bare || ' ' || token) AS digest FROM (
  SELECT doc_id, text, bare, CASE WHEN length(bare) >= 64 THEN '<encrypted ' || length(bare) || ' chars>' ELSE bare END AS token
  FROM (SELECT *, 'gAAAA' || repeat('xY', doc_id % 90) || '==' AS bare FROM documents))"""

ORACLES["bounded_text"] = f"SELECT doc_id, {_bounded('text', 101)} AS bounded, length(text) > 101 AS cut FROM documents"

ORACLES["terminal_safe"] = rf"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '[\p{{Cc}}\p{{Cf}}]', ' ', 'g'), '[\n{_WS}]+', ' ', 'g'), ' ')) AS digest FROM pages"""

ORACLES["basename"] = r"""
SELECT page_id, CASE WHEN url = '' THEN '.' WHEN t = '' THEN '/' ELSE regexp_extract(t, '[^/]*$') END AS name
FROM (SELECT *, regexp_replace(url, '/+$', '') AS t FROM pages)"""

ORACLES["short_model"] = """
SELECT p_partkey, replace(lower(p_name), ' ', '-') || (CASE WHEN p_size % 2 = 0 THEN '-4.8' ELSE '' END) AS model FROM part"""

_BOILER = (
    "(lower(t) IN ('', 'task', 'requirements', 'available plugins') OR regexp_matches(lower(t), '^(agents.md instructions|you are an autonomous implementation agent"
    "|you are an independent, cross-model reviewer|deliver the complete implementation|work from the task below|you receive no conversation history"
    "|the orchestrator accepts or rejects|here is a list of plugins|before the first substantive task)'))"
)
_WORDS = rf"(CASE WHEN starts_with({_strip('line')}, '#') AND {_strip(f'''ltrim({_strip('line')}, '#')''')} <> '' THEN {_strip(f'''ltrim({_strip('line')}, '#')''')} ELSE line END)"

ORACLES["prompt_texts"] = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
titled AS (SELECT doc_id, pos, {_title(_WORDS)} AS t FROM lines),
firsts AS (SELECT doc_id, arg_min(t, pos) FILTER (WHERE NOT {_BOILER}) AS title, arg_min(t, pos) FILTER (WHERE pos = 1) AS head FROM titled GROUP BY doc_id)
SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN {_strip('text')} WHEN 1 THEN {_strip('''('# Task' || chr(10) || '## Brief - ' || text)''')} WHEN 2 THEN ''
    ELSE {_strip('''('Requirements' || chr(10) || chr(10) || text)''')} END) AS task_digest,
  coalesce(CASE doc_id % 4 WHEN 1 THEN coalesce(nullif({_title(_FIRST)}, ''), 'Brief -') WHEN 2 THEN '' ELSE title END, '') AS title
FROM documents LEFT JOIN firsts USING (doc_id)"""

ORACLES["patch_counts"] = """
SELECT p_partkey, CAST(p_size AS BIGINT) AS added, p_partkey % 9 AS removed, p_brand || '.py,' || p_type AS files FROM part"""

ORACLES["nested_tool"] = """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS calls, CASE WHEN p_size % 3 <> 0 THEN replace(p_name, ' ', '_') END AS tool FROM part"""

ORACLES["result_summary"] = """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN o_orderstatus ELSE o_orderpriority END AS body,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 5 AS VARCHAR) END AS code, CASE WHEN o_orderkey % 3 = 0 THEN 'exit ' || (o_orderkey % 5) END AS summary
FROM orders"""

ORACLES["filter_scope"] = f"""WITH {_PLACES} SELECT descendant AS node_id, 'claude:r1#n1' AS root_ref FROM walk WHERE ancestor = 'n1' AND EXISTS (SELECT 1 FROM place WHERE node_id = 'n1' AND parent = 'r1')"""

ORACLES["link_spawn"] = """
WITH RECURSIVE kids AS (
  SELECT c_nationkey AS nation, list({'kid': c_custkey, 'title': lower(c_mktsegment), 'grp': c_custkey % 3 = 0} ORDER BY c_name) AS children,
         min(c_custkey) AS low, min(c_custkey) FILTER (c_custkey % 3 = 0) AS third
  FROM customer GROUP BY c_nationkey
), moves AS (
  SELECT s_nationkey AS nation, s_suppkey * 2 AS seq, s_suppkey AS call, 'call' AS what,
         CASE WHEN s_suppkey % 4 < 2 THEN ['none'] ELSE ['none', (['automobile', 'building', 'furniture', 'nobody', 'machinery'])[s_suppkey % 5 + 1]] END AS names FROM supplier WHERE s_suppkey % 4 <> 0
  UNION ALL
  SELECT s_nationkey, s_suppkey * 2 + 61, s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'group' ELSE 'plain' END, NULL FROM supplier WHERE s_suppkey % 3 = 1 OR s_suppkey % 4 = 0
), numbered AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY seq) AS n FROM moves),
steps AS (
  SELECT nation, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken, CAST([] AS STRUCT(call BIGINT, kid BIGINT)[]) AS held FROM kids
  UNION ALL
  SELECT nation, n, CASE WHEN kid IS NULL THEN taken WHEN what = 'call' THEN list_append(taken, kid)
                         ELSE list_append(list_filter(taken, lambda x: x IS DISTINCT FROM old AND x <> kid), kid) END,
         CASE WHEN kid IS NULL THEN held ELSE list_append(list_filter(held, lambda h: h.call <> call), {'call': call, 'kid': kid}) END
  FROM (
    SELECT s.nation, m.n, s.taken, s.held, CAST(m.call AS BIGINT) AS call, m.what, (list_filter(s.held, lambda h: h.call = m.call))[1].kid AS old,
           CAST(CASE m.what
             WHEN 'call' THEN coalesce((list_filter(k.children, lambda c: list_contains(m.names, c.title) AND NOT list_contains(s.taken, c.kid)))[1].kid,
                                       (list_filter(k.children, lambda c: NOT c.grp AND NOT list_contains(s.taken, c.kid)))[1].kid)
             WHEN 'group' THEN k.third ELSE k.low END AS BIGINT) AS kid
    FROM steps s JOIN numbered m ON m.nation = s.nation AND m.n = s.n + 1 JOIN kids k ON k.nation = s.nation
  )
), ends AS (SELECT nation, unnest(arg_max(held, n)) AS h FROM steps GROUP BY nation)
SELECT 'n' || nation AS node_id, CAST(h.call AS BIGINT) AS s_suppkey, 'c' || h.kid AS child FROM ends"""

_PART_FILES = """
WITH parts AS (SELECT p_partkey % 5 AS kind, '/lake/p' || (p_partkey - p_partkey % 5) AS owner, p_partkey FROM part),
files AS (
  SELECT *, CASE kind WHEN 0 THEN owner || '.jsonl' WHEN 1 THEN owner || '/subagents/x' || p_partkey || '.jsonl'
    WHEN 2 THEN owner || '/subagents/flow/w1/agent-' || p_partkey || '.jsonl' WHEN 3 THEN owner || '/subagents/flow/w1/journal-' || p_partkey || '.jsonl'
    ELSE '/lake/agent-' || p_partkey || '.jsonl' END AS path FROM parts
)"""

ORACLES["unreadable_scope"] = f"""{_PART_FILES}
SELECT o.path, f.path AS failed FROM files o JOIN files f ON starts_with(f.path, replace(o.path, '.jsonl', '') || '/')
WHERE NOT contains(o.path, 'agent-') AND f.p_partkey % 7 = 0"""

ORACLES["session_graph"] = f"""{_PART_FILES}
SELECT owner || '.jsonl' AS parent, path AS child FROM files WHERE kind IN (1, 4)
UNION ALL SELECT owner || '/subagents/flow/w1', path FROM files WHERE kind = 2
UNION ALL SELECT owner || '.jsonl', owner || '/subagents/flow/w1' FROM files WHERE kind = 2"""

ORACLES["top_level_only"] = "SELECT 'r' || r_regionkey AS node_id, r_name AS title FROM region"

ORACLES["group_models"] = """
SELECT 'c' || c_custkey AS node_id, c_mktsegment AS models FROM customer
UNION ALL SELECT 'n' || c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer GROUP BY c_nationkey"""

ORACLES["cost_valid"] = """
SELECT c_custkey, CASE WHEN c_custkey % 7 < 3 OR c_acctbal < 0 THEN 0 ELSE c_acctbal END AS usd FROM customer"""

ORACLES["classify_path"] = f"""{_PART_FILES}
SELECT path, CASE kind WHEN 0 THEN 'root' WHEN 1 THEN 'child' WHEN 2 THEN 'member' WHEN 3 THEN 'ignored' ELSE 'legacy' END AS role,
  CASE WHEN kind IN (1, 2) THEN owner || '.jsonl' END AS parent_path, CASE WHEN kind = 2 THEN owner || '/subagents/flow/w1' END AS group_dir FROM files"""

ORACLES["affected_roots"] = f"""{_PART_FILES} SELECT path, CASE WHEN kind < 4 THEN owner || '.jsonl' ELSE path END AS root_path FROM files"""

ORACLES["token_totals"] = f"""WITH {_REQUESTS}
SELECT event_id, u AS uncached_input, input + output + write_5m + write_1h + c AS total, u + output + write_5m + write_1h AS flow, input + c + write_5m + write_1h AS context
FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN greatest(0, input - cache_read) ELSE input END AS u, CASE WHEN event_id % 2 = 0 THEN 0 ELSE cache_read END AS c FROM requests)"""

_TALK = """
rows AS (
  SELECT conv_id, turn, (conv_id + turn) % 9 AS form, md5(coalesce(text, '')) AS d, 'call-' || conv_id || '-' || turn AS id FROM conversations
)"""

ORACLES["talk_events"] = f"""WITH {_TALK},
answers AS (SELECT conv_id, turn - 1 AS turn, d AS answer FROM rows WHERE form = 6),
parts AS (
  SELECT conv_id, turn, form, d, unnest(CASE WHEN form = 7 THEN [0, 1] ELSE [0] END) AS part FROM rows
), events AS (
  SELECT p.conv_id, p.turn, p.part, p.form, p.d, answer FROM parts p LEFT JOIN answers a ON a.conv_id = p.conv_id AND a.turn = p.turn AND p.form IN (3, 4, 5)
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) - 1 AS event_index,
  CASE WHEN form < 3 THEN 'user' WHEN form < 6 THEN 'tool-call' WHEN form = 6 THEN 'tool-result' WHEN form = 7 AND part = 0 THEN 'advisor' ELSE 'assistant-text' END AS kind,
  CASE form WHEN 0 THEN 'Ask ' || d WHEN 1 THEN 'Meta ' || d WHEN 2 THEN 'Hook ' || d WHEN 6 THEN '[{{"text":"part ' || d || '","type":"text"}},{{"type":"image"}},{{"text":"end","type":"text"}}]' WHEN 7 THEN CASE WHEN part = 1 THEN 'Reply ' || d ELSE '' END WHEN 8 THEN 'Reply ' || d ELSE '' END AS text,
  CASE form WHEN 3 THEN '/w/' || d || '.py · +1 −2' WHEN 4 THEN '{{"file_path":"/w/' || d || '.py","edits":[{{"old_string":"x","new_string":"y\\nz"}},{{"old_string":"q","new_string":"' || d || '"}}]}}'
    WHEN 5 THEN '/w/' || d || '.py' ELSE '' END AS tool_input,
  CASE WHEN form = 5 THEN '/w/' || d || '.py · offset ' || turn || ' · limit 5' ELSE '' END AS detail_input,
  CASE form WHEN 3 THEN E'-a\\n-b\\n+' || d WHEN 4 THEN E'-x\\n+y\\n+z\\n\\n-q\\n+' || d ELSE '' END AS detail_diff,
  CASE WHEN answer IS NOT NULL THEN 'part ' || answer || E'\\nend' ELSE '' END AS detail_output,
  form IN (1, 2) AS harness, CASE WHEN form IN (3, 4, 5, 8) OR part = 1 THEN 'oak-1' WHEN form = 7 THEN 'adv-1' ELSE '' END AS model,
  CASE WHEN form IN (3, 4, 5, 8) THEN turn + 10 WHEN form = 7 AND part = 0 THEN turn + 1 END AS usage_input
FROM events"""

ORACLES["talk_requests"] = f"""WITH {_TALK}
SELECT conv_id, id AS message_id, 'oak-1' AS model, turn + 10 AS input, CAST(2 AS BIGINT) AS output FROM rows WHERE form IN (3, 4, 5, 7, 8)
UNION ALL SELECT conv_id, id || '/advisor/' || n, 'adv-' || (n + 1), turn + 1 + 2 * n, 3 FROM rows, (SELECT unnest([0, 1]) AS n) WHERE form = 7"""

ORACLES["scan_records"] = """
SELECT doc_id, CAST(octet_length(encode('{"id":' || doc_id || ',"digest":"' || md5(coalesce(text, '')) || '","pad":"' || repeat('é', CAST(doc_id % 50 AS INTEGER)) || '"}')) AS INTEGER) AS byte_length,
  'ok' AS status, md5(coalesce(text, '')) AS digest FROM documents"""

ORACLES["wire_rows"] = """
SELECT md5('{"schema_version":1,"command":"list","conv_id":' || conv_id || ',"turn":' || turn || ',"tags":' || (CASE WHEN turn % 2 = 0 THEN '["' || role || '"]' ELSE '[]' END)
  || ',"maybe":' || (CASE WHEN turn % 3 = 0 THEN '"' || role || '"' ELSE 'null' END) || '}') AS digest, conv_id, CAST(turn AS BIGINT) AS turn FROM conversations"""

ORACLES["reattribute"] = f"""WITH {_EVENT_ROWS},
starts AS (SELECT user_id, min(ts) AS started FROM rows GROUP BY user_id),
keys AS (SELECT DISTINCT k, event_type, user_id, started FROM rows JOIN starts USING (user_id)),
owned AS (SELECT *, first_value(CAST(user_id AS VARCHAR)) OVER (PARTITION BY k, event_type ORDER BY started, CAST(user_id AS VARCHAR)) AS owner FROM keys)
SELECT CAST(k AS VARCHAR) AS message_id, event_type AS request_id, CAST(user_id AS VARCHAR) AS session_id, owner <> CAST(user_id AS VARCHAR) AS is_duplicate, owner FROM owned"""

ORACLES["both_ledgers"] = f"""
SELECT 'claude' AS agent, CAST(user_id AS VARCHAR) AS user_id, count(*) AS requests, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output
FROM ({ORACLES["transcript_ledger"]}) GROUP BY 2
UNION ALL
SELECT 'codex', CAST(user_id AS VARCHAR), count(*), CAST(sum(input) AS BIGINT), CAST(sum(output) AS BIGINT) FROM ({ORACLES["rollout_ledger"]}) GROUP BY 2"""

ORACLES["tree_standins"] = """
WITH own AS (SELECT DISTINCT o_custkey AS cust, o_orderpriority || '>' || left(o_orderpriority, 1) AS rate FROM orders WHERE o_orderstatus = 'P'),
placed AS (
  SELECT 'c' || c_custkey AS node_id, rate FROM customer LEFT JOIN own ON cust = c_custkey
  UNION SELECT 'n' || n_nationkey, rate FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN own ON cust = c_custkey
  UNION SELECT 'r' || n_regionkey, rate FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN own ON cust = c_custkey
  UNION SELECT 's' || s_suppkey, NULL FROM supplier
  UNION SELECT 'r' || r_regionkey, NULL FROM region
)
SELECT node_id, coalesce(string_agg(rate, ',' ORDER BY rate), '') AS rates FROM placed GROUP BY node_id"""
