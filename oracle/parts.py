"""Building blocks of the SQL checks: common table expressions and expressions."""

from __future__ import annotations

from signalbook import fixed_values as fv

AS_OF = "TIMESTAMP '2000-01-01 00:00:00'"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def rnd(expr: str, places: int) -> str:
    """Half away from zero on the decimal value."""
    return f"CAST(round(CAST(({expr}) AS DECIMAL(28,10)), {places}) AS DOUBLE)"


def fixed(expr: str, places: int) -> str:
    """Text with a fixed count of decimals."""
    return f"CAST(CAST(round(CAST(({expr}) AS DECIMAL(28,10)), {places}) AS DECIMAL(28,{places})) AS VARCHAR)"


def even_text(expr: str) -> str:
    """Whole number as text, ties to even."""
    return f"CAST(CAST(round_even(({expr}), 0) AS BIGINT) AS VARCHAR)"


def grouped_text(expr: str) -> str:
    return f"format('{{:,}}', CAST(round_even(({expr}), 0) AS BIGINT))"


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def word(seed: str, start: int = 1) -> str:
    w = f"translate(substr(md5({seed}), {start}, 8), '0123456789', 'ghijklmnop')"
    return f"(upper(substr({w}, 1, 1)) || substr({w}, 2))"


def sid(*parts: str) -> str:
    """Id of a business key: every part with its length, a null as a dash."""
    marked = ", ".join(f"coalesce(length(CAST({p} AS VARCHAR)) || ':' || CAST({p} AS VARCHAR), '-')" for p in parts)
    return f"md5(concat_ws('|', {marked}))"


def pick(options, key: str) -> str:
    return f"({sql_list(options)})[CAST(({key}) % {len(options)} AS INTEGER) + 1]"


def joined(lst: str, by: str = " ; ") -> str:
    return f"coalesce(array_to_string({lst}, {q(by)}), '')"


def hits(text: str, patterns) -> str:
    """Number of patterns contained in the lower-cased text."""
    return f"len(list_filter({sql_list(dict.fromkeys(patterns))}, lambda p: contains(lower({text}), p)))"


def case_map(table, expr: str, default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def severity_norm(expr: str) -> str:
    table = {lv: lv for lv in fv.SEVERITY_LEVELS} | fv.SEVERITY_SYNONYMS
    return case_map(table, f"trim(lower({expr}))", "'medium'")


URGENCY = "split_part(o_orderpriority, '-', 2)"
TARGET = f"CASE {URGENCY} WHEN 'URGENT' THEN 24 WHEN 'HIGH' THEN 36 WHEN 'MEDIUM' THEN 42 ELSE 48 END"
LINE_ID = sid(
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    *[f"CAST({c} AS DECIMAL(14,2))" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
    "l_returnflag", "l_linestatus", "strftime(l_shipdate, '%Y-%m-%d')",
)

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


def with_(names: list[str], body: str) -> str:
    """Prepend the named expressions and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in CTES[name][0]:
            visit(n)
        order.append(name)

    for name in names:
        visit(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


cte("dim_customer", [], f"""
    SELECT c_custkey AS customer_id, 'CUST_' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS canonical_id,
           c_name AS name, {word('CAST(c_custkey AS VARCHAR)')} || ' ' || {word('CAST(c_custkey AS VARCHAR)', 9)} AS company,
           c_mktsegment AS industry, r_name AS region, n_name AS country,
           CASE WHEN c_acctbal >= 7500 THEN 'enterprise' WHEN c_acctbal >= 2500 THEN 'business' ELSE 'standard' END AS tier,
           c_acctbal >= 0 AS is_active, v.contract_value, v.since
    FROM customer
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS contract_value, min(o_orderdate) AS since
               FROM orders GROUP BY o_custkey) v ON v.o_custkey = c_custkey""")

cte("fact_ticket", [], f"""
    SELECT {LINE_ID} AS ticket_id, 'TK-' || l_orderkey || '-' || l_linenumber AS ticket_number,
           o_custkey AS customer_id, l_suppkey AS service_id, l_partkey AS product_id, o_orderdate AS created_at,
           {severity_norm(URGENCY)} AS severity,
           CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'in_progress' END AS status,
           l_quantity AS resolution_hours, CAST({TARGET} AS DOUBLE) AS sla_hours, l_quantity > {TARGET} AS sla_breached,
           CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'neutral' ELSE 'positive' END AS sentiment,
           CAST(CASE l_returnflag WHEN 'R' THEN 0.2 WHEN 'A' THEN 0.5 ELSE 0.8 END AS DECIMAL(10,4)) AS sentiment_score
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")

cte("fact_incident", [], f"""
    SELECT {LINE_ID} AS incident_id, 'INC-' || l_orderkey || '-' || l_linenumber AS incident_number,
           o_custkey AS customer_id, l_suppkey AS service_id, l_partkey AS product_id,
           CASE WHEN l_quantity > 40 THEN 'P1' WHEN l_quantity > 25 THEN 'P2' WHEN l_quantity > 10 THEN 'P3' ELSE 'P4' END AS severity,
           CASE WHEN l_shipdate >= TIMESTAMP '2001-06-01' THEN 'open' ELSE 'resolved' END AS status,
           l_shipdate AS occurred_at,
           CASE WHEN l_shipdate < TIMESTAMP '2001-06-01' THEN l_shipdate + to_minutes(CAST(l_quantity AS BIGINT)) END AS resolved_at,
           l_quantity AS downtime_minutes,
           CASE WHEN l_shipdate < TIMESTAMP '2001-06-01' THEN l_quantity / 60 END AS resolution_time_hours,
           l_quantity > 36 AS sla_breached, l_linenumber * 100 AS affected_users_count,
           p_type AS category, p_brand AS subcategory, p_name AS root_cause
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag = 'R' AND l_linestatus = 'F'""")


def metrics_sql(at: str) -> str:
    w = "INTERVAL 365 DAY"
    return f"""
    SELECT c.customer_id, c.canonical_id, c.name,
           coalesce(t.n, 0) AS ticket_count, coalesce(t.prev, 0) AS ticket_count_prev,
           coalesce(i.n, 0) AS incident_count, coalesce(t.breaches, 0) AS sla_breach_count,
           coalesce(CAST(t.hours AS DOUBLE) / t.n, 0.0) AS avg_resolution_hours,
           coalesce(t.neg * 100.0 / t.n, 0.0) AS negative_pct,
           coalesce(CAST(c.contract_value AS DOUBLE), 0.0) AS contract_value
    FROM dim_customer c
    LEFT JOIN (SELECT customer_id, count(*) FILTER (created_at >= {at} - {w}) AS cur_n,
                      nullif(count(*) FILTER (created_at >= {at} - {w}), 0) AS n,
                      count(*) FILTER (created_at < {at} - {w}) AS prev,
                      count(*) FILTER (created_at >= {at} - {w} AND sla_breached) AS breaches,
                      count(*) FILTER (created_at >= {at} - {w} AND sentiment = 'negative') AS neg,
                      sum(CAST(resolution_hours AS DECIMAL(18,2))) FILTER (created_at >= {at} - {w}) AS hours
               FROM fact_ticket WHERE created_at >= {at} - INTERVAL 730 DAY AND created_at < {at} GROUP BY customer_id) t USING (customer_id)
    LEFT JOIN (SELECT customer_id, count(*) AS n FROM fact_incident
               WHERE occurred_at >= {at} - {w} AND occurred_at < {at} GROUP BY customer_id) i USING (customer_id)"""


def health_sql(source: str) -> str:
    return f"""
    SELECT *, {rnd('greatest(0.0, least(100.0, .25*tk + .25*se + .20*sl + .15*re + .10*ic + .05*70.0))', 1)} AS health_score
    FROM (SELECT *,
            greatest(0.0, greatest(0.0, 100.0 - 8 * greatest(0.0, ticket_count - 2)) - greatest(0.0, .3 * chg)) AS tk,
            greatest(0.0, 100.0 - 1.2 * negative_pct) AS se,
            greatest(0.0, 100.0 - 15 * sla_breach_count) AS sl,
            CASE WHEN avg_resolution_hours = 0 THEN 80.0 WHEN avg_resolution_hours <= 4 THEN 100.0
                 WHEN avg_resolution_hours <= 24 THEN 100 - (avg_resolution_hours - 4) * 3.3
                 ELSE greatest(0.0, 100 - 2 * avg_resolution_hours) END AS re,
            greatest(0.0, 100.0 - 10 * incident_count) AS ic
          FROM (SELECT *, CASE WHEN ticket_count_prev > 0 THEN (ticket_count - ticket_count_prev) * 100.0 / ticket_count_prev ELSE 0.0 END AS chg
                FROM {source}))"""


def level_sql(source: str) -> str:
    loss = rnd("contract_value * (100 - health_score) / 100 * 0.8", 2)
    return f"""
    SELECT *, CASE WHEN health_score >= 75 THEN 'LOW' WHEN health_score >= 55 THEN 'MEDIUM' WHEN health_score >= 35 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
           CASE WHEN chg > 20 OR negative_pct > 40 THEN 'DETERIORATING' WHEN chg < -10 THEN 'IMPROVING' ELSE 'STABLE' END AS trend,
           {rnd('chg', 1)} AS ticket_change_pct,
           CASE WHEN contract_value > 0 AND {loss} > 0 THEN {loss} END AS revenue_at_risk,
           {rnd('1 - health_score / 100', 4)} AS churn_risk_score
    FROM {source}"""


cte("metrics", ["dim_customer", "fact_ticket", "fact_incident"], metrics_sql(AS_OF))
cte("raw_health", ["metrics"], health_sql("metrics"))
cte("health", ["raw_health"], level_sql("raw_health"))
cte("metrics_old", ["dim_customer", "fact_ticket", "fact_incident"], metrics_sql("TIMESTAMP '1999-01-01 00:00:00'"))
cte("raw_health_old", ["metrics_old"], health_sql("metrics_old"))
cte("health_old", ["raw_health_old"], level_sql("raw_health_old"))


def shares(prefix: str = "") -> str:
    return ", ".join(
        f"{rnd(f'{p}_count * 100.0 / total_records', 2)} AS {p}_pct" for p in ("positive", "neutral", "negative")
    )


MOODS = ", ".join(f"count(*) FILTER (sentiment = '{m}') AS {m}_count" for m in ("positive", "neutral", "negative"))

cte("rollup", ["fact_ticket"], f"""
    SELECT *, {shares()}, {rnd('CAST(score AS DOUBLE) / total_records', 4)} AS avg_sentiment_score FROM (
      SELECT date_trunc('month', created_at) AS period_start,
             CASE grouping_id(customer_id, service_id, product_id, category) WHEN 7 THEN 'customer_id' WHEN 11 THEN 'service_id'
                  WHEN 13 THEN 'product_id' WHEN 14 THEN 'category' ELSE 'all' END AS scope,
             customer_id, service_id, product_id, category, count(*) AS total_records, {MOODS}, sum(sentiment_score) AS score
      FROM (SELECT f.*, p_type AS category FROM fact_ticket f LEFT JOIN part ON product_id = p_partkey) x
      GROUP BY GROUPING SETS ((period_start), (period_start, customer_id), (period_start, service_id), (period_start, product_id), (period_start, category)))""")

cte("monthly", ["fact_ticket"], f"""
    SELECT *, {shares()} FROM (SELECT date_trunc('month', created_at) AS period_start, count(*) AS total_records, {MOODS}
    FROM fact_ticket GROUP BY ALL)""")

cte("hourly", [], """
    SELECT event_type, date_trunc('hour', ts) AS t, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value, count(*) AS n_events
    FROM events GROUP BY 1, 2""")

cte("zscores", ["hourly"], f"""
    SELECT event_type, t, value, n_events, {rnd('m', 2)} AS expected, {rnd('abs(value - m) / sd', 2)} AS z_score,
           {rnd('CASE WHEN m <> 0 THEN (value - m) / abs(m) * 100 ELSE 0 END', 1)} AS deviation_pct, 'zscore' AS method,
           CASE WHEN abs(value - m) / sd > 3.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
    FROM hourly JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n FROM hourly GROUP BY 1) USING (event_type)
    WHERE n >= 5 AND sd > 0 AND abs(value - m) / sd >= 2.5""")

cte("mentions", [], """
    SELECT event_type || ':' || json_extract_string(props, '$.k') AS topic, ts AS created_at FROM events""")

cte("topic_counts", ["mentions"], """
    SELECT * FROM (SELECT topic, count(*) FILTER (created_at >= TIMESTAMP '2024-01-24') AS current_count,
      count(*) FILTER (created_at < TIMESTAMP '2024-01-24' AND created_at >= TIMESTAMP '2024-01-17') AS previous_count
    FROM mentions GROUP BY topic) WHERE current_count > 0 OR previous_count > 0""")

cte("emerging", ["topic_counts"], f"""
    SELECT topic, current_count, previous_count, {rnd('pct', 1)} AS pct_change, previous_count = 0 AS is_new_topic,
           CASE WHEN pct > 300 THEN 'CRITICAL' WHEN pct > 150 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
    FROM (SELECT *, CASE WHEN previous_count = 0 THEN 100.0 ELSE (current_count - previous_count) * 100.0 / previous_count END AS pct FROM topic_counts)
    WHERE current_count >= 5 AND pct >= 100""")


def causes_sql(where: str) -> str:
    base = "least(0.90, 0.5 + n * 0.05)"
    return f"""
    SELECT g.category, n AS incident_count, CASE WHEN top_n >= 2 THEN cause ELSE {q(fv.ROOT_CAUSE_TEXT['undetermined'])} END AS potential_root_cause,
           coalesce(top_n, 0) AS rc_occurrence_count, {rnd('coalesce(top_n, 0) * 100.0 / n', 1)} AS rc_pct,
           CASE WHEN dated >= 3 AND day_n >= dated * 0.4 THEN 'Clustering on ' || ({sql_list(fv.WEEKDAYS)})[CAST(day AS INTEGER) + 1] || 's' END AS temporal_pattern,
           {rnd(f'CASE WHEN top_n >= n * 0.5 THEN least(0.90, {base} + 0.15) ELSE {base} END', 2)} AS confidence,
           coalesce(top_n, 0) >= 2 AS has_hypothesis, true AS is_hypothesis
    FROM (SELECT category || '/' || subcategory AS category, count(*) AS n, count(occurred_at) AS dated FROM fact_incident {where} GROUP BY 1 HAVING count(*) >= 3) g
    LEFT JOIN (SELECT * FROM (SELECT category || '/' || subcategory AS category, root_cause AS cause, count(*) AS top_n FROM fact_incident {where} GROUP BY 1, 2)
               QUALIFY row_number() OVER (PARTITION BY category ORDER BY top_n DESC, cause) = 1) c ON c.category = g.category
    LEFT JOIN (SELECT * FROM (SELECT category || '/' || subcategory AS category, isodow(occurred_at) - 1 AS day, count(*) AS day_n FROM fact_incident {where} GROUP BY 1, 2)
               QUALIFY row_number() OVER (PARTITION BY category ORDER BY day_n DESC, day) = 1) d ON d.category = g.category"""


cte("causes", ["fact_incident"], causes_sql(""))


# --- priority ----------------------------------------------------------------------------

def priority(severity: str, confidence: str, kind: str, people: str, money: str) -> str:
    weight = case_map(fv.SEVERITY_WEIGHTS, severity, "0.5")
    urgency = case_map(fv.INSIGHT_URGENCY, kind, "0.5")
    reach = f"least(1.0, ln(greatest(coalesce({people}, 1), 1) + 1) / 10)"
    bonus = f"CASE WHEN {money} > 10000 THEN least(0.2, {money} / 500000.0) ELSE 0.0 END"
    raw = f"CAST({weight} AS DOUBLE) * ({confidence}) * CAST({urgency} AS DOUBLE) * (0.5 + {reach} * 0.5) + {bonus}"
    return rnd(f"least(1.0, {raw})", 4)


# --- texts ---------------------------------------------------------------------------------

def _texts() -> str:
    from signalbook.sources import texts as tx  # the wording only

    first = word("CAST(o_custkey AS VARCHAR)")
    novel = word("'n' || (o_custkey % 40)")
    name = (
        f"CASE o_orderkey % 6 WHEN 1 THEN upper({first}) WHEN 2 THEN substr({first}, 1, 3) || substr({first}, 5, 4) "
        f"WHEN 3 THEN 'Novel' || lower({novel}) ELSE {first} END"
    )
    date = (
        "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') "
        "WHEN 2 THEN strftime(o_orderdate, '%b %-d, %Y') ELSE strftime(o_orderdate, '%-m-%-d-%y') END"
    )
    cents = "CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR)"
    amount = f"CASE o_orderkey % 3 WHEN 0 THEN '$' || {cents} WHEN 1 THEN 'EUR ' || {cents} ELSE split_part({cents}, '.', 1) || ' USD' END"
    outage = "(o_orderkey % 50 + 1) || CASE WHEN o_orderkey % 5 = 0 THEN ' hours of outage' ELSE ' minutes of downtime' END"
    return f"""
    SELECT 'TXT-' || lpad(CAST(k AS VARCHAR), 9, '0') AS document_id, domain, arrived_at,
           CASE k % 3
             WHEN 0 THEN 'Ticket: TK-' || num || nl || who || 'opened ' || day || '.' || nl || issue || '. Contact ' || addr || '. Amount ' || amount || '.' || nl || mood
             WHEN 1 THEN 'Incident #INC-' || num || ' ' || level || nl || who || issue || ' on ' || day || ' after ' || outage || '.' || nl || 'Major Incident Team informed. ' || mood
             ELSE 'Contract CN-' || num || '/A signed ' || day || '.' || nl || who || 'Service Level Agreement worth ' || amount || '.' || nl || issue || '. ' || mood
           END AS text
    FROM (SELECT o_orderkey AS k, {pick(tx.DOMAINS, 'o_orderkey')} AS domain, o_orderdate AS arrived_at, chr(10) AS nl, CAST(o_orderkey % 9000 AS VARCHAR) AS num,
                 CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE 'Customer: ' || {name} || ', ' END AS who, {date} AS day, {amount} AS amount, {outage} AS outage,
                 lower({first}) || '.desk@example.' || {pick(['com', 'org'], 'o_orderkey')} AS addr,
                 {pick(tx.ISSUES, 'o_orderkey')} AS issue, {pick(tx.MOODS, 'o_orderkey')} AS mood, {pick(tx.LEVELS, 'o_orderkey')} AS level
          FROM orders)"""


cte("texts", [], _texts())


def sentiment_cols(text: str, positive, negative) -> tuple[str, str, str]:
    """Label, confidence and score over columns good and bad computed beforehand."""
    p = "(good * 1.0 / nullif(good + bad, 0))"
    label = f"CASE WHEN {p} > 0.6 THEN 'positive' WHEN {p} < 0.4 THEN 'negative' ELSE 'neutral' END"
    conf = rnd(
        f"CASE WHEN {p} IS NULL THEN 0.5 WHEN {p} > 0.6 THEN least(0.95, 0.6 + {p} * 0.35) "
        f"WHEN {p} < 0.4 THEN least(0.95, 0.6 + (1 - {p}) * 0.35) ELSE 0.65 END", 2)
    return label, conf, rnd(f"coalesce({p}, 0.5)", 3)


def severity_level(text: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {hits(text, ks)} > 0 THEN '{lv}'" for lv, ks in fv.SEVERITY_KEYWORDS.items()) + " END"


def topic_list(text: str, patterns=fv.TOPIC_PATTERNS) -> str:
    items = ", ".join(f"CASE WHEN {hits(text, ps)} > 0 THEN {q(n)} END" for n, ps in patterns.items())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def issue_struct(text: str) -> str:
    """Struct of hits, rank, category, subcategory of the best class."""
    rows, rank = [], 0
    for c, subs in fv.ISSUE_TAXONOMY.items():
        for s, ps in subs.items():
            rows.append(f"{{'h': {hits(text, ps)}, 'r': {-rank}, 'c': {q(c)}, 's': {q(s)}}}")
            rank += 1
    return f"list_max([{', '.join(rows)}])"


def extract_all(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, 0)"


def distinct_list(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def customer_expr(text: str) -> str:
    parts = []
    for pattern, group in zip(fv.CUSTOMER_PATTERNS, (2, 1)):
        n = f"rtrim(trim(regexp_extract({text}, {q(pattern)}, {group}), ' ' || chr(9) || chr(10) || chr(13)), '.,')"
        parts.append(f"CASE WHEN length({n}) BETWEEN 3 AND 99 THEN {n} END")
    return f"coalesce({', '.join(parts)})"


def first(text: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({text}, {q(pattern)}, {group}), '')"


def dates_expr(text: str) -> str:
    lists = " || ".join(extract_all(text, p) for p in fv.TEXT_DATE_PATTERNS)
    return lists


def downtime_expr(text: str) -> str:
    return (
        f"try_cast(regexp_extract({text}, {q(fv.DOWNTIME_PATTERN)}, 1) AS BIGINT) * "
        f"CASE WHEN contains(lower(regexp_extract({text}, {q(fv.DOWNTIME_PATTERN)}, 0)), 'hour') THEN 60 ELSE 1 END"
    )


_label, _conf, _score = sentiment_cols("text", None, None)

cte("read_texts", ["texts"], f"""
    SELECT *, {_label} AS sentiment, {_conf} AS s_conf, {_score} AS sentiment_score,
           coalesce(lv, 'medium') AS severity, CASE WHEN lv IS NULL THEN 0.55 ELSE 0.82 END AS v_conf,
           CASE WHEN issue.h > 0 THEN issue.c ELSE 'GENERAL' END AS category, CASE WHEN issue.h > 0 THEN issue.s ELSE 'OTHER' END AS subcategory,
           list_filter(ds, lambda x, i: list_position(ds, x) = i) AS dates
    FROM (SELECT *, {hits('text', fv.POSITIVE_WORDS)} AS good, {hits('text', fv.NEGATIVE_WORDS)} AS bad, {severity_level('text')} AS lv,
                 {topic_list('text')} AS topics, {issue_struct('text')} AS issue, {customer_expr('text')} AS customer_name,
                 {dates_expr('text')} AS ds, {extract_all('text', fv.MONEY_PATTERN)} AS money,
                 {extract_all('text', fv.KEY_PHRASE_PATTERN)} AS kp
          FROM texts)""")

cte("text_fields", ["read_texts"], f"""
    SELECT document_id, unnest(list_filter([
      {{'o': 1, 'f': 'sentiment', 'v': sentiment, 'c': CAST(s_conf AS DOUBLE), 'n': 200}},
      {{'o': 2, 'f': 'severity', 'v': severity, 'c': CAST(v_conf AS DOUBLE), 'n': 200}},
      {{'o': 3, 'f': 'topics', 'v': CAST(to_json(topics) AS VARCHAR), 'c': CAST(CASE WHEN len(topics) > 0 THEN 0.75 ELSE 0.3 END AS DOUBLE), 'n': 200}},
      CASE WHEN domain = 'customer_intelligence' THEN {{'o': 4, 'f': 'ticket_number', 'v': {first('text', fv.TICKET_PATTERN, 1)}, 'c': CAST(0.95 AS DOUBLE), 'n': 100}} END,
      CASE WHEN domain = 'customer_intelligence' THEN {{'o': 5, 'f': 'customer_email', 'v': {first('text', fv.EMAIL_PATTERN, 0)}, 'c': CAST(0.98 AS DOUBLE), 'n': 100}} END,
      CASE WHEN domain = 'it_operations' THEN {{'o': 6, 'f': 'incident_number', 'v': {first('text', fv.INCIDENT_PATTERN, 1)}, 'c': CAST(0.95 AS DOUBLE), 'n': 100}} END,
      CASE WHEN domain = 'it_operations' THEN {{'o': 7, 'f': 'downtime_minutes', 'v': CAST({downtime_expr('text')} AS VARCHAR), 'c': CAST(0.88 AS DOUBLE), 'n': 100}} END,
      CASE WHEN domain = 'document_contract' THEN {{'o': 8, 'f': 'contract_number', 'v': {first('text', fv.CONTRACT_PATTERN, 1)}, 'c': CAST(0.93 AS DOUBLE), 'n': 100}} END
    ], lambda x: x IS NOT NULL AND x.v IS NOT NULL)) AS f FROM read_texts""")

cte("text_conf", ["text_fields"], f"""
    SELECT document_id, {rnd('sum(CAST(f.c AS DECIMAL(10,4))) * 1.0 / count(*)', 2)} AS overall_confidence, count(*) AS n_fields,
           string_agg(f.f || '=' || f.v || '=' || CAST(f.c AS VARCHAR), ' ; ' ORDER BY f.o) AS fields,
           max(CASE WHEN f.f = 'ticket_number' THEN f.v END) AS ticket_number, max(CASE WHEN f.f = 'incident_number' THEN f.v END) AS incident_number,
           max(CASE WHEN f.f = 'contract_number' THEN f.v END) AS contract_number, max(CASE WHEN f.f = 'downtime_minutes' THEN f.v END) AS downtime
    FROM text_fields GROUP BY document_id""")

SUMMARY = (
    "replace(trim(substr(text, 1, 300), ' ' || chr(9) || chr(10) || chr(13)), chr(10), ' ') || CASE WHEN length(text) > 300 THEN '...' ELSE '' END"
)

cte("extracted", ["read_texts", "text_conf"], f"""
    SELECT r.*, c.* EXCLUDE (document_id), {SUMMARY} AS summary,
           list_filter(kp, lambda x, i: list_position(kp, x) = i) AS key_phrases,
           len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word_count
    FROM read_texts r JOIN text_conf c USING (document_id)""")


# --- names -------------------------------------------------------------------------------------

def name_norm(expr: str) -> str:
    """Normalised name of ASCII text."""
    a = f"regexp_replace(lower({expr}), {q(fv.NAME_PUNCTUATION)}, ' ', 'g')"
    pattern = "\\b(?:" + "|".join(fv.LEGAL_SUFFIXES) + ")\\b"
    b = f"regexp_replace({a}, {q(pattern)}, '', 'g')"
    return f"trim(regexp_replace({b}, '\\s+', ' ', 'g'))"


def tok_sort(expr: str) -> str:
    return f"array_to_string(list_sort(string_split({expr}, ' ')), ' ')"


def resolution(prefix: str, names: str, registry: str, needs_names: list[str], needs_registry: list[str]) -> None:
    """The cascade over names (entity_type, raw_value, first_seen) and a registry, by brute force."""
    p = prefix
    cte(f"{p}known", needs_registry, f"""
    SELECT DISTINCT entity_type, canonical_id, name AS canonical_name, {name_norm('nm')} AS known
    FROM (SELECT *, name AS nm FROM {registry} UNION ALL SELECT *, alias AS nm FROM {registry})""")
    cte(f"{p}exact", needs_names + needs_registry, f"""
    SELECT n.entity_type, raw_value, min(canonical_id) AS canonical_id, min_by(r.name, canonical_id) AS canonical_name
    FROM {names} n JOIN {registry} r ON n.entity_type = r.entity_type AND lower(raw_value) = lower(r.name) GROUP BY 1, 2""")
    cte(f"{p}same", [f"{p}exact", f"{p}known"] + needs_names, f"""
    SELECT n.entity_type, raw_value, min(canonical_id) AS canonical_id, min_by(canonical_name, canonical_id) AS canonical_name
    FROM (SELECT *, {name_norm('raw_value')} AS norm FROM {names}) n JOIN {p}known k ON n.entity_type = k.entity_type AND norm = known
    WHERE raw_value NOT IN (SELECT raw_value FROM {p}exact) GROUP BY 1, 2""")
    cte(f"{p}rest", [f"{p}same"] + needs_names, f"""
    SELECT *, {name_norm('raw_value')} AS norm FROM {names}
    WHERE raw_value NOT IN (SELECT raw_value FROM {p}exact) AND raw_value NOT IN (SELECT raw_value FROM {p}same)""")
    cte(f"{p}fuzzy", [f"{p}rest"], fuzzy_sql(f"{p}rest", f"{p}known"))
    new_id = f"{case_map(fv.ENTITY_PREFIXES, 'entity_type', q('ENT'))} || '_' || upper({sid('entity_type', "CASE WHEN norm <> '' THEN norm ELSE lower(raw_value) END")})"
    bands = fv.FUZZY_BANDS
    part = lambda i: "CASE " + " ".join(
        f"WHEN score >= {b[0]} THEN {q(b[i]) if isinstance(b[i], str) else str(b[i]).lower()}" for b in bands) + " END"
    cte(f"{p}new", [f"{p}fuzzy"], f"""
    SELECT entity_type, raw_value, {new_id} AS canonical_id,
           first_value(raw_value) OVER (PARTITION BY entity_type, {new_id} ORDER BY first_seen, raw_value) AS canonical_name
    FROM {p}rest r WHERE NOT EXISTS (SELECT 1 FROM {p}fuzzy f WHERE f.entity_type = r.entity_type AND f.norm = r.norm)""")
    cte(f"{p}decisions", [f"{p}new"], f"""
    SELECT entity_type, raw_value, canonical_id, canonical_name, 'exact' AS resolution_method, CAST(1.0 AS DOUBLE) AS confidence, false AS is_new_entity, false AS requires_review, CAST(0.0 AS DOUBLE) AS score FROM {p}exact
    UNION ALL SELECT entity_type, raw_value, canonical_id, canonical_name, 'normalized', 0.95, false, false, 0.0 FROM {p}same
    UNION ALL SELECT r.entity_type, raw_value, canonical_id, canonical_name, {part(2)}, {part(1)}, false, {part(3)}, score FROM {p}rest r JOIN {p}fuzzy f ON f.entity_type = r.entity_type AND f.norm = r.norm
    UNION ALL SELECT entity_type, raw_value, canonical_id, canonical_name, 'new_entity', 0.5, true, false, 0.0 FROM {p}new""")


def fuzzy_sql(norms: str, known: str, method: str = "indel") -> str:
    """Best partner of every name."""
    return f"""
    SELECT entity_type, norm, arg_min(canonical_id, (-score, canonical_id)) AS canonical_id, arg_min(canonical_name, (-score, canonical_id)) AS canonical_name, max(score) AS score
    FROM ({alike_sql(norms, known, method)}) WHERE score >= 60 GROUP BY 1, 2"""


def alike_sql(norms: str, known: str, method: str = "indel") -> str:
    """Score of every name with every known name.  The common subsequence is counted in the bits of one integer: each
    letter of b clears at most one bit of the row, in the places where a has it."""
    masks = "map_from_entries(list_transform(list_distinct(string_split(a, '')), lambda c: {'k': c, 'v': list_sum(list_transform(range(length(a)), lambda i: CASE WHEN a[i + 1] = c THEN 1::HUGEINT << i::INT ELSE 0 END))::HUGEINT}))"
    everything = "((1::HUGEINT << length(a)::INT) - 1)"
    row = f"""list_reduce(list_transform(string_split(b, ''), lambda c: coalesce(masks[c], 0::HUGEINT)),
        lambda r, m: ((r + (r & m)) | (r - (r & m))) & {everything}, {everything})"""
    if method == "levenshtein":
        score = rnd("100.0 * (1 - levenshtein(a, b) * 1.0 / greatest(length(a), length(b)))", 6)
    else:
        score = rnd(f"200.0 * (length(a) - bit_count({row})) / (length(a) + length(b))", 6)
    return f"""
    SELECT n.entity_type, n.norm, k.known, k.canonical_id, k.canonical_name, {score} AS score
    FROM (SELECT *, {masks} AS masks FROM (SELECT DISTINCT entity_type, norm, {tok_sort('norm')} AS a FROM {norms} WHERE norm <> '')) n
    JOIN (SELECT *, {tok_sort('known')} AS b FROM {known} WHERE known <> '') k ON n.entity_type = k.entity_type"""


cte("service_registry", [], f"""
    SELECT 'service' AS entity_type, 'SVC_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS canonical_id,
           {word("'s' || s_suppkey")} || ' ' || {word("'s' || s_suppkey", 9)} AS name, {word("'s' || s_suppkey")} AS alias FROM supplier""")
cte("service_mentions", [], f"""
    SELECT l_orderkey, CASE l_partkey % 10 WHEN 0 THEN upper(fl) WHEN 1 THEN fl || ', Ltd.' WHEN 2 THEN one WHEN 3 THEN two || ' ' || one
           WHEN 4 THEN substr(fl, 1, 2) || substr(fl, 4, 20) WHEN 5 THEN 'xyz' || substr(fl, 4, 20) WHEN 6 THEN 'vwxyzu' || substr(fl, 7, 20)
           WHEN 7 THEN one || ' zzz' WHEN 8 THEN 'Fresh ' || {word("'f' || (l_suppkey % 20)")} ELSE fl END AS raw_value
    FROM (SELECT *, {word("'s' || l_suppkey")} AS one, {word("'s' || l_suppkey", 9)} AS two, {word("'s' || l_suppkey")} || ' ' || {word("'s' || l_suppkey", 9)} AS fl FROM lineitem)""")
cte("service_names", ["service_mentions"], "SELECT 'service' AS entity_type, raw_value, min(l_orderkey) AS first_seen, count(*) AS n_mentions FROM service_mentions GROUP BY raw_value")
cte("customer_registry", [], f"""
    SELECT 'customer' AS entity_type, 'CUST_' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS canonical_id,
           {word('CAST(c_custkey AS VARCHAR)')} || ' ' || {word('CAST(c_custkey AS VARCHAR)', 9)} AS name, {word('CAST(c_custkey AS VARCHAR)')} AS alias FROM customer""")
cte("text_mentions", ["extracted"], """
    SELECT document_id, 'customer' AS entity_type, customer_name AS raw_value, arrived_at FROM extracted WHERE customer_name IS NOT NULL""")
cte("text_names", ["text_mentions"], """
    SELECT entity_type, raw_value, min((arrived_at, document_id)) AS first_seen, count(*) AS n_mentions FROM text_mentions GROUP BY 1, 2""")
resolution("s_", "service_names", "service_registry", ["service_names"], ["service_registry"])
resolution("t_", "text_names", "customer_registry", ["text_names"], ["customer_registry"])

# The registry after a run over the first half of the orders, and after another over the rest.
_half = "(SELECT max(o_orderkey) / 2.0 FROM orders)"
for _run, _side, _known in (("r1_", "<=", "service_registry"), ("r2_", ">", "registry_1")):
    cte(f"{_run}names", ["service_mentions"], f"""
    SELECT 'service' AS entity_type, raw_value, min(l_orderkey) AS first_seen FROM service_mentions WHERE l_orderkey {_side} {_half} GROUP BY raw_value""")
    resolution(_run, f"{_run}names", _known, [f"{_run}names"], [_known])
    cte("registry_1" if _run == "r1_" else "registry_2", [f"{_run}decisions", _known], f"""
    SELECT entity_type, canonical_id, name, alias FROM {_known}
    UNION SELECT entity_type, canonical_id, canonical_name, NULL FROM {_run}decisions WHERE is_new_entity
    UNION SELECT entity_type, canonical_id, canonical_name, raw_value FROM {_run}decisions WHERE raw_value <> canonical_name""")

# New names that are alike, directly or over others.
cte("c_fresh", ["s_new", "s_rest"], """
    SELECT n.entity_type, n.raw_value, norm, first_seen, canonical_id AS form FROM s_new n JOIN s_rest USING (entity_type, raw_value)""")
cte("c_forms", ["c_fresh"], "SELECT DISTINCT entity_type, norm, norm AS known, form AS canonical_id, form AS canonical_name FROM c_fresh WHERE norm <> ''")
cte("c_links", ["c_forms"], f"""
    SELECT f.canonical_id AS a, p.canonical_id AS b, score FROM ({alike_sql('c_forms', 'c_forms')}) p JOIN c_forms f USING (entity_type, norm)
    WHERE score >= 70 AND a <> b""")
cte("c_reach", ["c_links"], "SELECT a AS node, b AS other FROM c_links UNION SELECT node, b FROM c_reach JOIN c_links ON a = other")
cte("c_named", ["c_reach", "c_fresh"], """
    SELECT f.*, first_value(f.raw_value) OVER w AS canonical_name, first_value(f.form) OVER w AS canonical_id
    FROM (SELECT f.*, coalesce(least(f.form, (SELECT min(other) FROM c_reach WHERE node = f.form)), f.form) AS root FROM c_fresh f) f
    WINDOW w AS (PARTITION BY entity_type, root ORDER BY first_seen, raw_value)""")

cte("with_customer", ["extracted", "t_decisions"], """
    SELECT e.*, d.canonical_id AS customer_code FROM extracted e LEFT JOIN t_decisions d ON d.raw_value = e.customer_name""")

cte("dirty", [], """
    SELECT 'R-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS row_id,
      CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'TK-' || (o_orderkey % 9000) END AS ticket_number,
      CASE WHEN o_orderkey % 13 <> 0 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS customer_name,
      CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'P3' ELSE lower(split_part(o_orderpriority, '-', 2)) END AS priority,
      CASE WHEN o_custkey % 2 = 0 THEN 'open' ELSE 'closed' END AS status,
      CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS created_date,
      CASE WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate + to_days(CAST(o_orderkey % 9 - 2 AS INTEGER)), '%Y-%m-%d') END AS resolved_date,
      CASE WHEN o_orderkey % 5 = 0 THEN 'no-at-sign.example' ELSE 'c' || o_custkey || '@example.com' END AS customer_email,
      CASE WHEN o_orderkey % 8 = 0 THEN 'about 100' ELSE '$' || CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) END AS amount_currency,
      CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS updated_at
    FROM orders""")
