"""SQL checks by query name, for DuckDB over the same tables."""

from __future__ import annotations

from oracle.parts import *  # noqa: F403
from oracle.parts import _texts  # noqa: F401
from signalbook import fixed_values as fv
from signalbook.plans import catalog as _catalog
from signalbook.sources import texts as _wording

ORACLE: dict[str, str] = {}


def add(name: str, body: str, needs: list[str] | None = None) -> None:
    ORACLE[name] = with_(needs, body) if needs else body


# --- sources and profiles -------------------------------------------------------


def _profile(columns: dict[str, str], source: str, dtype: bool) -> str:
    parts = []
    for name, expr in columns.items():
        parts.append(f"""
        SELECT '{name}' AS column_name, {"'string' AS dtype," if dtype else ''} count(v) AS non_null_count, count(*) - count(v) AS null_count,
               {rnd('(count(*) - count(v)) * 100.0 / count(*)', 2)} AS null_pct, count(DISTINCT v) AS unique_count,
               coalesce((SELECT string_agg(v, ' ; ' ORDER BY k) FROM (SELECT o_orderkey AS k, CAST({expr} AS VARCHAR) AS v FROM {source} WHERE {expr} IS NOT NULL ORDER BY k LIMIT 3)), '') AS sample_values
        FROM (SELECT CAST({expr} AS VARCHAR) AS v FROM {source})""")
    return " UNION ALL ".join(parts)


add("scan_csv_profile", _profile({
    "o_orderkey": "o_orderkey",
    "o_orderstatus": "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END",
    "o_orderpriority": "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END",
    "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d')",
    "o_custkey": "o_custkey",
    "o_totalprice": "CAST(o_totalprice AS DECIMAL(14,2))",
}, "orders", True))
add("column_profile", _profile({
    "o_orderkey": "o_orderkey", "o_custkey": "o_custkey",
    "o_orderstatus": "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END",
    "o_orderpriority": "o_orderpriority", "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d')",
    "o_totalprice": "CAST(o_totalprice AS DECIMAL(14,2))",
}, "orders", False))
add("scan_by_format", " UNION ALL ".join(f"""
    SELECT '{k}' AS format, count(*) AS n_rows, count(text) AS n_texts, count(DISTINCT lang) AS n_langs, sum(length(text)) AS n_chars,
        count(DISTINCT doc_id) AS n_ids, count(DISTINCT source) AS n_sources, CAST(sum(n_chars) AS BIGINT) AS stated_chars FROM documents"""
    for k in ("csv", "json", "parquet")))
add("text_pages", r"""
    SELECT doc_id, len(lines) AS line_count, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS word_count,
           CAST(ceil(len(lines) / 5.0) AS BIGINT) AS total_pages, CAST(p + 1 AS BIGINT) AS page_number,
           array_to_string(lines[p * 5 + 1 : p * 5 + 5], chr(10)) AS page_text
    FROM (SELECT doc_id, text, lines, unnest(range(CAST(ceil(len(lines) / 5.0) AS BIGINT))) AS p
          FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents))""")
add("rows_to_text", """
    SELECT document_id, (n - 1) // 50 + 1 AS page_number, count(*) AS n_rows, string_agg(line, chr(10) ORDER BY n) AS page_text
    FROM (SELECT strftime(o_orderdate, '%Y-%m') AS document_id,
                 row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS n,
                 concat_ws(' | ', 'o_orderkey: ' || o_orderkey, 'o_custkey: ' || o_custkey,
                   CASE WHEN o_orderkey % 5 > 0 THEN 'o_orderstatus: ' || o_orderstatus END,
                   CASE WHEN o_orderkey % 6 > 0 THEN 'o_orderpriority: ' || o_orderpriority END,
                   'o_totalprice: ' || CAST(o_totalprice AS DECIMAL(14,2)), 'o_orderdate: ' || strftime(o_orderdate, '%Y-%m-%d')) AS line FROM orders)
    GROUP BY 1, 2""")
add("duplicate_rows", """
    WITH every AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 3 = 0)
    SELECT CAST((SELECT count(*) FROM every) AS BIGINT) AS row_count, 11 AS column_count,
           'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' AS columns,
           CAST((SELECT count(*) FROM every) - (SELECT count(*) FROM (SELECT DISTINCT * FROM every)) AS BIGINT) AS duplicate_rows""")
add("raw_records", """
    SELECT strftime(o_orderdate, '%Y-%m') AS document_id,
           row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS row_number,
           CAST(to_json({'o_orderkey': CAST(o_orderkey AS VARCHAR), 'o_custkey': CAST(o_custkey AS VARCHAR), 'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority,
               'o_totalprice': CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR), 'o_orderdate': strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')}) AS VARCHAR) AS raw_data
    FROM orders""")
add("dedup_by_hash", """
    SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
add("stream_intake", f"""
    SELECT content_hash, arg_min(doc_id, (came, doc_id)) AS document_id, {stamp('min(came)')} AS arrived_at, count(*) - 1 AS copies
    FROM (SELECT sha256(text) AS content_hash, doc_id,
          TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) - CASE WHEN doc_id % 3 = 0 THEN INTERVAL 36 HOUR ELSE INTERVAL 0 HOUR END AS came FROM documents)
    GROUP BY content_hash""")
add("stream_dedup_by_hash", "SELECT DISTINCT sha256(text) AS content_hash FROM documents")
add("parse_model_json", f"""
    WITH r AS (SELECT doc_id, text, lang, source, regexp_extract(text, '[a-z]{{4,}}', 0) AS span,
                      NOT (doc_id % 5 = 3 OR doc_id % 10 = 4) AS ok FROM documents),
    f AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'sentiment|positive|0.83|null|null' WHEN doc_id % 3 = 1 THEN 'sentiment|neutral|0.7|null|null' END AS mood,
                 'topic|' || span || '|0.9|' || CASE WHEN span = '' THEN 'null|null' ELSE (strpos(text, span) - 1) || '|' || (strpos(text, span) - 1 + length(span)) END AS topic,
                 CASE WHEN doc_id % 2 = 0 THEN 'unknown|7|0.4|-1|null' END AS third,
                 CAST(0.9 + 0.7 + CASE WHEN doc_id % 2 = 0 THEN 0.4 ELSE 0 END + CASE doc_id % 3 WHEN 0 THEN 0.83 WHEN 1 THEN 0.7 ELSE 0 END AS DECIMAL(10,4)) AS total,
                 2 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 < 2 THEN 1 ELSE 0 END AS n FROM r)
    SELECT doc_id, ok AS parsed, CASE WHEN ok THEN concat_ws(' ; ', topic, 'lang|' || lang || '|0.7|null|null', third, mood) ELSE '' END AS fields,
           CASE WHEN ok THEN 'source|' || source || '|0.7' ELSE '' END AS entities,
           CASE WHEN ok THEN {rnd('CAST(total AS DOUBLE) / n', 2)} ELSE 0.7 END AS overall_confidence FROM f""")

cte("replied", [], f"""
    SELECT *, CASE WHEN listed THEN [{{'f': 'ticket_number', 'v': number, 'c': sure}}, {{'f': 'severity', 'v': level, 'c': firm}}] ELSE [] END
              || CASE WHEN ok THEN [{{'f': 'sentiment', 'v': mood, 'c': coalesce(score, 0.7)}}] ELSE [] END AS fields
    FROM (SELECT 'DOC-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS document_id, doc_id % 13 <> 7 AS ok, doc_id % 13 <> 7 AND doc_id % 11 <> 5 AS listed,
                 'TK-' || (doc_id % 700) AS number, ([0.7, 0.95, 0.7, 0.45])[doc_id % 4 + 1] AS sure, {pick(['P1', 'low', 'odd'], 'doc_id')} AS level,
                 CASE WHEN doc_id % 5 = 0 THEN 0.6 ELSE 0.8 END AS firm, {pick(['negative', 'neutral'], 'doc_id')} AS mood,
                 CASE WHEN doc_id % 9 <> 4 THEN 0.25 END AS score, CASE WHEN doc_id % 7 = 3 THEN '' ELSE 'b ; 7 ; t' || (doc_id % 5) END AS tags, doc_id FROM documents)""")
add("reply_facts", f"""
    SELECT * EXCLUDE (place) FROM (
      SELECT CASE WHEN listed THEN number ELSE 'TK-AUTO-' || upper(md5(document_id)) END AS ticket_number, document_id,
             CASE WHEN listed THEN CASE level WHEN 'P1' THEN 'critical' WHEN 'low' THEN 'low' ELSE 'medium' END ELSE 'medium' END AS severity,
             CASE WHEN ok THEN mood END AS sentiment, CASE WHEN ok THEN CAST(score AS DOUBLE) END AS sentiment_score, CASE WHEN ok THEN tags ELSE '' END AS tags,
             CASE WHEN len(fields) > 0 THEN {rnd('list_sum(list_transform(fields, lambda x: CAST(x.c AS DECIMAL(10,4)))) / len(fields)', 2)} ELSE 0.7 END AS extraction_confidence,
             row_number() OVER (PARTITION BY CASE WHEN listed THEN number ELSE document_id END ORDER BY doc_id) AS place FROM replied) WHERE place = 1""", ["replied"])
add("reply_reviews", f"""
    SELECT {sid("'low_confidence_extraction'", 'document_id', "'Low-confidence extraction: ' || x.f")} AS item_id, document_id, 'Low-confidence extraction: ' || x.f AS title,
           'Field ' || chr(39) || x.f || chr(39) || ' extracted with ' || CAST(CAST(x.c * 100 AS INTEGER) AS VARCHAR) || '% confidence' AS description, x.v AS current_value,
           CAST(x.c AS DOUBLE) AS confidence, CASE WHEN x.c < 0.5 THEN 'high' ELSE 'medium' END AS priority, 'pending' AS status
    FROM (SELECT document_id, unnest(fields) AS x FROM replied) WHERE x.c < 0.65""", ["replied"])
add("upload_intake", f"""
    WITH u AS (SELECT 'DOC-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS document_id, 'up/' || doc_id || {pick(['.txt', '.json', '.PDF', '', '.tar.exe', '.csv'], 'doc_id')} AS filename,
                      {pick(['txt', 'json', 'pdf', '', 'exe', 'csv'], 'doc_id')} AS file_type, strlen(coalesce(text, '')) AS file_size_bytes, sha256(coalesce(text, '')) AS h, doc_id FROM documents),
    r AS (SELECT *, CASE WHEN file_type IN ('', 'exe') THEN 'file type not allowed' WHEN file_size_bytes > {_catalog.UPLOAD_BYTES} THEN 'file too large' END AS reason FROM u),
    k AS (SELECT *, first_value(document_id) OVER (PARTITION BY reason IS NULL, h ORDER BY doc_id % 2, doc_id) AS kept FROM r)
    SELECT document_id, filename, file_type, file_size_bytes, CASE WHEN reason IS NULL THEN h END AS file_hash,
           CASE WHEN reason IS NOT NULL THEN 'refused' WHEN kept = document_id THEN 'uploaded' ELSE 'duplicate' END AS status, CASE WHEN reason IS NULL THEN kept END AS stored_as, reason FROM k""")

# --- lists --------------------------------------------------------------------------

add("customer_search", "SELECT canonical_id, name, risk_level, health_score FROM health WHERE risk_level = 'HIGH' AND name ILIKE '%mer#0000__1%'", ["health"])
add("customer_list", """
    SELECT canonical_id, name, company, region, tier, is_active, CAST(contract_value AS DOUBLE) AS contract_value, (SELECT count(*) FROM dim_customer) AS total
    FROM dim_customer ORDER BY contract_value DESC NULLS LAST, canonical_id LIMIT 20""", ["dim_customer"])
add("incident_list", f"""
    SELECT incident_id, incident_number, severity, status, category, subcategory, {stamp('occurred_at')} AS occurred_at, downtime_minutes, sla_breached, root_cause,
           count(*) OVER () AS total FROM fact_incident i WHERE severity = 'P1' AND sla_breached ORDER BY i.occurred_at DESC, incident_id LIMIT 20 OFFSET 20""", ["fact_incident"])
add("document_list", f"""
    SELECT 'DOC-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS document_id, source || '-' || doc_id || '.txt' AS filename, 'txt' AS file_type, strlen(text) AS file_size_bytes,
           'completed' AS status, {stamp("TIMESTAMP '2024-01-01' + to_minutes(doc_id)")} AS created_at, count(*) OVER () AS total
    FROM documents WHERE lang = 'en' AND doc_id % 4 < 2 ORDER BY doc_id DESC LIMIT 20""")
add("job_list", f"""
    SELECT {sid("'job'", "'DOC-' || lpad(CAST(doc_id AS VARCHAR), 9, '0')")} AS job_id, 'DOC-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS document_id, 'failed' AS status,
           {stamp("TIMESTAMP '2024-01-01' + to_minutes(doc_id)")} AS created_at, count(*) OVER () AS total
    FROM documents WHERE doc_id % 4 = 3 ORDER BY doc_id DESC LIMIT 20 OFFSET 40""")
cte("weak", ["text_fields"], f"""
    SELECT 'low_confidence_extraction' AS item_type, document_id, 'Low-confidence extraction: ' || f.f AS title,
           'Field ''' || f.f || ''' extracted with ' || CAST(CAST(round(CAST(f.c AS DECIMAL(10,4)) * 100, 0) AS INTEGER) AS VARCHAR) || '% confidence' AS description,
           f.v AS current_value, CAST(NULL AS VARCHAR) AS suggested_value, f.c AS confidence, CASE WHEN f.c < 0.5 THEN 'high' ELSE 'medium' END AS priority
    FROM text_fields WHERE f.c < 0.65""")
cte("weak_items", ["weak"], f"SELECT {sid('item_type', 'document_id', 'title')} AS item_id, *, 'pending' AS status FROM weak")
add("review_list", """
    SELECT item_id, item_type, title, description, confidence, priority, count(*) OVER () AS total FROM weak_items ORDER BY priority, confidence, item_id LIMIT 20""", ["weak_items"])
add("anomaly_list", f"""
    SELECT event_type AS metric_name, {stamp('t')} AS detected_at, value, expected, deviation_pct, severity, count(*) OVER () AS total
    FROM zscores ORDER BY t DESC, event_type LIMIT 20""", ["zscores"])

# --- KPIs and rollups ------------------------------------------------------------------

add("kpi_overview", """
    SELECT (SELECT count(*) FROM health) AS total_customers, (SELECT count(*) FROM health WHERE risk_level IN ('HIGH', 'CRITICAL')) AS high_risk_customers,
           (SELECT count(*) FROM fact_ticket) AS total_tickets, (SELECT count(*) FROM fact_ticket WHERE status = 'open') AS open_tickets,
           (SELECT count(*) FROM fact_incident) AS total_incidents, (SELECT count(*) FROM fact_incident WHERE status = 'open') AS open_incidents,
           (SELECT count(*) FROM fact_incident WHERE sla_breached) AS sla_breaches,
           (SELECT count(*) FROM health WHERE risk_level = 'CRITICAL') AS critical_insights""", ["health"])
add("ask_overview", """
    SELECT (SELECT count(*) FROM dim_customer) AS customers, (SELECT count(*) FROM fact_ticket) AS tickets, (SELECT count(*) FROM fact_incident) AS incidents,
           (SELECT count(*) FROM health WHERE risk_level <> 'LOW' OR trend = 'DETERIORATING') AS active_insights""", ["health"])
add("health_distribution", """
    SELECT coalesce(CASE WHEN contract_value > 0 THEN risk_level END, 'UNKNOWN') AS risk_level, count(*) AS count FROM health GROUP BY 1""", ["health"])
add("kpi_total_customers", "SELECT count(DISTINCT c_custkey) AS total_customers FROM customer")
add("kpi_avg_health", f"SELECT {rnd('CAST(sum(CAST(health_score AS DECIMAL(18,1))) AS DOUBLE) / count(*)', 2)} AS avg_health_score FROM health", ["health"])
add("customer_risk", "SELECT risk_level, count(DISTINCT customer_id) AS customers FROM health GROUP BY 1", ["health"])
add("sla_breach_matrix", """
    SELECT severity, count(DISTINCT CASE WHEN sla_breached THEN incident_id END) AS breached, count(DISTINCT CASE WHEN NOT sla_breached THEN incident_id END) AS not_breached
    FROM fact_incident GROUP BY 1""", ["fact_incident"])
add("churn_matrix", f"""
    SELECT name, risk_level, CAST(sum(CAST(contract_value AS DECIMAL(18,2))) AS DOUBLE) AS contract_value,
           {rnd('CAST(sum(CAST(contract_value AS DECIMAL(18,2))) AS DOUBLE) / 1000', 4)} AS contract_value_k,
           {rnd('avg(health_score)', 4)} AS avg_health, {rnd('avg(churn_risk_score)', 4)} AS avg_churn_risk FROM health GROUP BY 1, 2""", ["health"])
_rollup_cols = "scope, customer_id, service_id, product_id, category, total_records, positive_count, neutral_count, negative_count, positive_pct, neutral_pct, negative_pct, avg_sentiment_score"
add("sentiment_rollup", f"""
    SELECT {stamp('period_start')} AS period_start, {stamp('period_start + INTERVAL 1 MONTH')} AS period_end, 'monthly' AS period_type, {_rollup_cols} FROM rollup""", ["rollup"])
add("bi_sentiment", f"""
    SELECT strftime(period_start, '%Y-%m-%d') AS period_start, strftime(period_start + INTERVAL 1 MONTH, '%Y-%m-%d') AS period_end, 'monthly' AS period_type, {_rollup_cols} FROM rollup""", ["rollup"])
add("sentiment_long", """
    SELECT strftime(period_start, '%Y-%m-%d') AS month, 'positive_pct' AS measure, positive_pct AS value FROM monthly
    UNION ALL SELECT strftime(period_start, '%Y-%m-%d'), 'negative_pct', negative_pct FROM monthly""", ["monthly"])
add("sentiment_trend_12", """
    SELECT strftime(period_start, '%Y-%m') AS period, positive_pct, neutral_pct, negative_pct, total_records FROM monthly ORDER BY period_start DESC LIMIT 12""", ["monthly"])
add("sentiment_top_topics", f"""
    SELECT {stamp('m')} AS period_start, topic, mentions, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY m ORDER BY mentions DESC, topic) AS rank FROM (
        SELECT m, topic, count(*) AS mentions FROM (SELECT date_trunc('month', arrived_at) AS m, unnest(topics) AS topic FROM read_texts) GROUP BY 1, 2))
    WHERE rank <= 3""", ["read_texts"])
_tops = """
    SELECT *, row_number() OVER (PARTITION BY m, scope, domain, category ORDER BY mentions DESC, topic) AS rank FROM (
      SELECT m, CASE WHEN grouping(domain) = 0 THEN 'domain' WHEN grouping(category) = 0 THEN 'category' ELSE 'all' END AS scope, domain, category, topic, count(*) AS mentions
      FROM (SELECT date_trunc('month', arrived_at) AS m, domain, category, unnest(topics) AS topic FROM extracted) GROUP BY GROUPING SETS ((m, topic), (m, domain, topic), (m, category, topic)))
    QUALIFY rank <= 3"""
add("topics_by_scope", f"SELECT {stamp('m')} AS period_start, * EXCLUDE (m) FROM ({_tops})", ["extracted"])
add("rollup_with_topics", f"""
    SELECT {stamp('r.m')} AS period_start, r.* EXCLUDE (m), coalesce(top_topics, '') AS top_topics FROM (
      SELECT m, CASE WHEN grouping(domain) = 0 THEN 'domain' WHEN grouping(category) = 0 THEN 'category' ELSE 'all' END AS scope, domain, category, count(*) AS total_records,
             count(*) FILTER (sentiment = 'positive') AS positive_count, count(*) FILTER (sentiment = 'neutral') AS neutral_count, count(*) FILTER (sentiment = 'negative') AS negative_count,
             {rnd("count(*) FILTER (sentiment = 'positive') * 100.0 / count(*)", 2)} AS positive_pct, {rnd("count(*) FILTER (sentiment = 'neutral') * 100.0 / count(*)", 2)} AS neutral_pct,
             {rnd("count(*) FILTER (sentiment = 'negative') * 100.0 / count(*)", 2)} AS negative_pct,
             {rnd('CAST(sum(CAST(sentiment_score AS DECIMAL(10,4))) AS DOUBLE) / count(*)', 4)} AS avg_sentiment_score
      FROM (SELECT *, date_trunc('month', arrived_at) AS m FROM extracted) GROUP BY GROUPING SETS ((m), (m, domain), (m, category))) r
    LEFT JOIN (SELECT m, scope, domain, category, string_agg(topic, ' ; ' ORDER BY rank) AS top_topics FROM ({_tops}) GROUP BY ALL) t
    ON t.m = r.m AND t.scope = r.scope AND t.domain IS NOT DISTINCT FROM r.domain AND t.category IS NOT DISTINCT FROM r.category""", ["extracted"])
add("deep_page", """
    SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderpriority, (SELECT count(*) FROM orders) AS total
    FROM orders ORDER BY o_orderpriority, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 580""")
add("customer_metrics", f"SELECT * REPLACE ({rnd('avg_resolution_hours', 6)} AS avg_resolution_hours, {rnd('negative_pct', 6)} AS negative_pct) FROM metrics", ["metrics"])
add("service_metrics", f"""
    SELECT s_suppkey AS service_id, s_name AS name, coalesce(i.n, 0) AS incident_count, {rnd('CAST(t.hours AS DOUBLE) / t.n', 4)} AS avg_resolution_hours,
           {rnd('t.kept * 100.0 / t.n', 2)} AS sla_compliance_pct, {rnd('100 - coalesce(CAST(i.down AS DOUBLE), 0) * 100.0 / 525600', 4)} AS availability_pct, coalesce(c.top, '') AS top_root_causes
    FROM supplier
    LEFT JOIN (SELECT service_id, count(*) AS n, count(*) FILTER (NOT sla_breached) AS kept, sum(CAST(resolution_hours AS DECIMAL(18,2))) AS hours FROM fact_ticket
               WHERE created_at >= {AS_OF} - INTERVAL 365 DAY AND created_at < {AS_OF} GROUP BY 1) t ON t.service_id = s_suppkey
    LEFT JOIN (SELECT service_id, count(*) AS n, sum(CAST(downtime_minutes AS DECIMAL(18,2))) AS down FROM fact_incident
               WHERE occurred_at >= {AS_OF} - INTERVAL 365 DAY AND occurred_at < {AS_OF} GROUP BY 1) i ON i.service_id = s_suppkey
    LEFT JOIN (SELECT service_id, string_agg(root_cause, ' ; ' ORDER BY r) AS top FROM (
                 SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY n DESC, root_cause) AS r FROM (
                   SELECT service_id, root_cause, count(*) AS n FROM fact_incident WHERE occurred_at >= {AS_OF} - INTERVAL 365 DAY AND occurred_at < {AS_OF} GROUP BY 1, 2))
               WHERE r <= 3 GROUP BY 1) c ON c.service_id = s_suppkey""", ["fact_ticket", "fact_incident"])
add("document_status", """
    SELECT count(*) FILTER (doc_id % 4 < 2) AS completed, count(*) FILTER (doc_id % 4 = 2) AS processing, count(*) FILTER (doc_id % 4 = 3) AS failed FROM documents""")
add("complete_rows", """
    SELECT count(*) AS rows, count(*) FILTER (contract_value IS NOT NULL AND health_score IS NOT NULL AND churn_risk_score IS NOT NULL AND risk_level <> 'LOW' AND revenue_at_risk IS NOT NULL) AS complete_rows FROM health""", ["health"])

# --- canned questions -----------------------------------------------------------------------

add("top_risk_customers", """
    SELECT canonical_id, name, risk_level, health_score, churn_risk_score, revenue_at_risk FROM health WHERE risk_level IN ('HIGH', 'CRITICAL')
    ORDER BY health_score, canonical_id LIMIT 10""", ["health"])
add("recent_incidents", "SELECT severity, count(*) AS count FROM fact_incident WHERE occurred_at >= TIMESTAMP '2001-10-05' GROUP BY 1", ["fact_incident"])
add("ask_recent_incidents", "SELECT severity, count(*) AS count FROM fact_incident WHERE occurred_at >= TIMESTAMP '2001-10-05' GROUP BY 1", ["fact_incident"])
add("negative_services", f"""
    SELECT service_id, {stamp('period_start')} AS period_start, negative_pct, total_records FROM rollup WHERE scope = 'service_id'
    ORDER BY negative_pct DESC, service_id, rollup.period_start LIMIT 10""", ["rollup"])
add("sla_and_sentiment", """
    SELECT * FROM (SELECT customer_id, count(*) FILTER (sla_breached) AS breaches, count(*) FILTER (sentiment = 'negative') AS negative_tickets, count(*) AS tickets
    FROM fact_ticket GROUP BY 1) WHERE breaches > 0 AND negative_tickets > 0""", ["fact_ticket"])
_intents = " ".join(f"WHEN regexp_matches(lower(question), {q(p)}) THEN {q(i)}" for p, i in fv.QUESTION_INTENTS)
add("tag_questions", f"""
    SELECT question_id, CASE {_intents} ELSE 'unknown' END AS intent FROM (
      SELECT conv_id || '-' || turn AS question_id, {pick(_wording.QUESTIONS, 'conv_id + turn')} || ' ' || text AS question FROM conversations)""")

# --- joins, extracts and updates ---------------------------------------------------------------

add("bi_customers", f"""
    SELECT c.* REPLACE (CAST(c.contract_value AS DOUBLE) AS contract_value), h.health_score, h.risk_level, h.trend, h.ticket_count, h.incident_count, h.sla_breach_count,
           '2000-01-01 00:00:00' AS snapshot_date FROM dim_customer c LEFT JOIN health h USING (customer_id)""", ["health"])
add("bi_sla_events", f"""
    SELECT incident_id, incident_number, customer_id, c_name AS customer_name, severity, status, category, subcategory, sla_breached, {stamp('occurred_at')} AS occurred_at,
           {stamp('resolved_at')} AS resolved_at, downtime_minutes, {rnd('resolution_time_hours', 4)} AS resolution_time_hours, root_cause, affected_users_count
    FROM fact_incident LEFT JOIN customer ON customer_id = c_custkey""", ["fact_incident"])
add("star_tickets", """
    SELECT region, tier, p_type AS product_category, severity, count(*) AS tickets, count(*) FILTER (sla_breached) AS breaches,
           CAST(sum(CAST(resolution_hours AS DECIMAL(12,2))) AS DOUBLE) AS hours, count(DISTINCT s_name) AS services
    FROM fact_ticket LEFT JOIN dim_customer USING (customer_id) LEFT JOIN supplier ON service_id = s_suppkey LEFT JOIN part ON product_id = p_partkey GROUP BY ALL""",
    ["fact_ticket", "dim_customer"])
add("star_incidents", """
    SELECT region, s_name AS service_name, severity, count(*) AS incidents, CAST(sum(CAST(downtime_minutes AS DECIMAL(12,2))) AS DOUBLE) AS downtime_minutes, count(DISTINCT name) AS customers
    FROM fact_incident LEFT JOIN dim_customer USING (customer_id) LEFT JOIN supplier ON service_id = s_suppkey GROUP BY ALL""", ["fact_incident", "dim_customer"])
add("upsert_new_tickets", f"""
    SELECT ticket_number, ticket_id, customer_id, {stamp('created_at')} AS created_at, severity FROM (
      SELECT *, row_number() OVER (PARTITION BY ticket_number ORDER BY created_at, ticket_id) AS r FROM fact_ticket
      WHERE created_at >= TIMESTAMP '1998-01-01' AND ticket_number NOT IN (SELECT ticket_number FROM fact_ticket WHERE created_at < TIMESTAMP '1998-01-01')) WHERE r = 1""", ["fact_ticket"])
add("upsert_new_customers", "SELECT DISTINCT entity_type, canonical_id, canonical_name, confidence FROM t_decisions WHERE is_new_entity", ["t_decisions"])
cte("actions", ["weak_items"], """
    SELECT item_id, CASE WHEN d < '4' THEN 'approved' WHEN d < '8' THEN 'rejected' WHEN d < 'a' THEN 'ignored' ELSE 'vanished' END AS action,
           TIMESTAMP '2024-02-01 08:00:00' AS acted_at, 'ana' AS reviewer, 'note ' || d AS note, CAST(NULL AS VARCHAR) AS edited_value
    FROM (SELECT item_id, substr(item_id, 1, 1) AS d FROM weak_items) WHERE d < 'c'
    UNION ALL SELECT item_id, 'edited', TIMESTAMP '2024-02-02 08:00:00', 'ben', NULL, 'value ' || substr(item_id, 2, 1) FROM weak_items WHERE substr(item_id, 2, 1) < '3'""")
add("apply_review_actions", f"""
    SELECT i.item_id, coalesce(a.action, i.status) AS status, {stamp('acted_at')} AS reviewed_at, reviewer AS reviewed_by, note AS resolution_note, edited_value
    FROM weak_items i LEFT JOIN (SELECT * FROM actions WHERE action <> 'vanished' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY acted_at DESC) = 1) a USING (item_id)""", ["actions"])
add("rejected_review_actions", "SELECT item_id, action, 'invalid action' AS reason FROM actions WHERE action = 'vanished'", ["actions"])
add("ack_insights", f"""
    SELECT insight_id, entity_id, CASE WHEN substr(insight_id, 1, 1) < '8' THEN 'acknowledged' ELSE 'active' END AS status,
           CASE WHEN substr(insight_id, 1, 1) < '8' THEN '2000-01-02 09:00:00' END AS acknowledged_at, CASE WHEN substr(insight_id, 1, 1) < '8' THEN 'ana' END AS acknowledged_by
    FROM (SELECT {sid("'risk'", 'customer_id')} AS insight_id, CAST(customer_id AS VARCHAR) AS entity_id FROM health WHERE risk_level <> 'LOW' OR trend = 'DETERIORATING')""", ["health"])

# --- text functions ---------------------------------------------------------------------------------

# The accented letters of the corpus and their combining marks.
_MARKS = {"é": ("e", 769), "ó": ("o", 769), "í": ("i", 769), "É": ("E", 769), "Ó": ("O", 769), "Í": ("I", 769), "è": ("e", 768), "È": ("E", 768),
          "ê": ("e", 770), "Ê": ("E", 770), "ñ": ("n", 771), "Ñ": ("N", 771), "ü": ("u", 776), "ä": ("a", 776), "ö": ("o", 776),
          "Ü": ("U", 776), "Ä": ("A", 776), "Ö": ("O", 776), "ç": ("c", 807), "Ç": ("C", 807)}


def _decomposed(expr: str) -> str:
    for letter, (base, mark) in _MARKS.items():
        expr = f"replace({expr}, '{letter}', '{base}' || chr({mark}))"
    return expr


_messy = r"replace(replace(text, chr(10), chr(13) || chr(10) || chr(13) || chr(10) || ' ' || chr(9) || chr(13)), ', ', ',' || chr(9) || ' ')"
_clean = rf"regexp_replace(regexp_replace(regexp_replace({_decomposed(_messy)}, '[ \t]+', ' ', 'g'), '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
add("normalize_text", rf"SELECT doc_id, regexp_replace(regexp_replace({_clean}, '^\s+', ''), '\s+$', '') AS text FROM documents")
_ascii = f"regexp_replace({_decomposed('raw')}, '[^\\x00-\\x7F]', '', 'g')"
add("normalize_name", f"SELECT doc_id, {name_norm(_ascii)} AS name FROM (SELECT doc_id, text || ' Co., LTD. ' || source || ' (Inc)' AS raw FROM documents)")
_shapes = ["%Y-%m-%d", "%-d/%-m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%-m-%-d-%Y", "%B %-d, %Y", "%b %-d, %Y", "%-d %B %Y", "%d %b %Y", "%Y/%m/%d"]
_written = "CASE o_orderkey % 11 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{s}')" for i, s in enumerate(_shapes)) + " ELSE 'soon' END"
_parse = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%Y/%m/%d"]
add("normalize_date", f"SELECT o_orderkey, raw, strftime(try_strptime(raw, {sql_list(_parse)}), '%Y-%m-%d') AS iso FROM (SELECT o_orderkey, {_written} AS raw FROM orders)")
add("normalize_currency", """
    WITH w AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '$' || c WHEN 1 THEN '€ ' || c WHEN 2 THEN c || ' gbp' WHEN 3 THEN '£1,' || right(c, 6) WHEN 4 THEN 'CAD $' || c WHEN 5 THEN 'n.a.' ELSE c END AS raw
               FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) AS c FROM orders))
    SELECT o_orderkey, try_cast(regexp_replace(raw, '[^0-9.]', '', 'g') AS DOUBLE) AS amount,
           CASE WHEN try_cast(regexp_replace(raw, '[^0-9.]', '', 'g') AS DOUBLE) IS NULL THEN NULL ELSE CASE o_orderkey % 7 WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'GBP' WHEN 4 THEN 'CAD' ELSE 'USD' END END AS currency FROM w""")
_sev_words = ["P1", " sev2 ", "Priority 3", "trivial", "URGENT", "High", "whatever", "normal", "blocker", "minor"]
add("normalize_severity", f"""
    SELECT raw, {severity_norm('raw')} AS level, own AS own_level, count(*) AS orders FROM (SELECT {pick(_sev_words, 'o_orderkey')} AS raw, {severity_norm(URGENCY)} AS own FROM orders) GROUP BY ALL""")
_abbr = f"array_to_string(list_transform(string_split(raw, ' '), lambda w: {case_map(fv.ABBREVIATIONS, 'lower(w)', 'w')}), ' ')"
add("expand_abbreviations", f"""
    SELECT doc_id, md5({_abbr}) AS text_hash, length({_abbr}) AS n_chars FROM (SELECT doc_id, 'the Db mgr of ' || source || ' dept uses VPN and Api for ' || text || ' inc' AS raw FROM documents)""")
add("classify_issue", f"""
    SELECT document_id, CASE WHEN b.h > 0 THEN b.c ELSE 'GENERAL' END AS category, CASE WHEN b.h > 0 THEN b.s ELSE 'OTHER' END AS subcategory,
           CASE WHEN b.h > 0 THEN {rnd('least(0.95, 0.65 + b.h * 0.1)', 2)} ELSE 0.4 END AS confidence FROM (SELECT document_id, {issue_struct('text')} AS b FROM texts)""", ["texts"])
_l, _c, _s = sentiment_cols("text", None, None)
add("sentiment", f"SELECT document_id, {_l} AS label, {_c} AS confidence, {_s} AS score FROM (SELECT document_id, {hits('text', fv.POSITIVE_WORDS)} AS good, {hits('text', fv.NEGATIVE_WORDS)} AS bad FROM texts)", ["texts"])
add("sentiment_documents", f"SELECT doc_id, {_l} AS label, {_c} AS confidence, {_s} AS score FROM (SELECT doc_id, {hits('text', _catalog.CORPUS_POSITIVE)} AS good, {hits('text', _catalog.CORPUS_NEGATIVE)} AS bad FROM documents)")
add("detect_severity", f"SELECT document_id, coalesce(lv, 'medium') AS level, CASE WHEN lv IS NULL THEN 0.55 ELSE 0.82 END AS confidence FROM (SELECT document_id, {severity_level('text')} AS lv FROM texts)", ["texts"])
add("topics_of_text", f"SELECT document_id, {joined(topic_list('text'), ',')} AS topics FROM texts", ["texts"])
_ct = topic_list("text", _catalog.CORPUS_TOPICS)
add("topics_of_documents", f"SELECT doc_id, {joined('tp', ',')} AS topics, coalesce(tp[1], 'general') AS category FROM (SELECT doc_id, {_ct} AS tp FROM documents)")
add("classify_document", f"SELECT document_id, coalesce(({topic_list('text')})[1], 'general') AS category, 0.78 AS confidence, coalesce({severity_level('text')}, 'medium') AS severity FROM texts", ["texts"])
add("extract_customer", f"SELECT document_id, {customer_expr('text')} AS customer_name FROM texts", ["texts"])
add("extract_dates", f"SELECT document_id, {joined('dates')} AS dates FROM read_texts", ["read_texts"])
add("extract_money", f"SELECT document_id, {joined(extract_all('text', fv.MONEY_PATTERN))} AS money, {joined(extract_all('text', fv.STRICT_MONEY_PATTERN))} AS money_strict FROM texts", ["texts"])
add("extract_contact", f"SELECT document_id, {first('text', fv.TICKET_PATTERN, 1)} AS ticket_number, {first('text', fv.EMAIL_PATTERN, 0)} AS email FROM texts", ["texts"])
add("extract_email_documents", r"SELECT doc_id, nullif(regexp_extract(text, '[\p{L}\p{M}\p{N}_.+-]+@[\p{L}\p{M}\p{N}_-]+\.[a-zA-Z]{2,}', 0), '') AS email FROM documents")
add("extract_ops", f"SELECT document_id, {first('text', fv.INCIDENT_PATTERN, 1)} AS incident_number, {downtime_expr('text')} AS downtime_minutes FROM texts", ["texts"])
add("extract_contract", f"SELECT document_id, {first('text', fv.CONTRACT_PATTERN, 1)} AS contract_number FROM texts", ["texts"])
add("key_phrases", f"SELECT document_id, {joined('key_phrases')} AS key_phrases FROM extracted", ["extracted"])
add("extract_summary", rf"SELECT doc_id, {SUMMARY} AS summary, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words FROM documents")
add("insight_narrative", f"""
    SELECT customer_id, name || ' shows ticket volume change. The ticket count has ' || CASE WHEN ticket_change_pct > 0 THEN 'increased' ELSE 'decreased' END || ' by ' || {fixed('abs(ticket_change_pct)', 1)} || '% based on analysis of available records.' AS narrative FROM health""", ["health"])

# --- staging and facts ------------------------------------------------------------------------------------

_ents = ("concat_ws(' ; ', 'customer=' || customer_name, nullif(array_to_string(list_transform(dates, lambda d: 'date=' || d), ' ; '), ''), "
         "nullif(array_to_string(list_transform(money, lambda m: 'monetary_value=' || m), ' ; '), ''))")
add("extract_fields", f"SELECT document_id, fields, {_ents} AS entities, overall_confidence, summary FROM extracted", ["extracted"])
cte("staged", ["text_fields", "extracted"], """
    SELECT document_id, domain, 'field' AS origin, f.f AS entity_type, f.v AS raw_value, f.c AS confidence, 1 AS source_page, substr(text, 1, f.n) AS source_text_span,
           CASE WHEN f.n = 200 THEN 0 END AS char_start, CASE WHEN f.n = 200 THEN least(200, length(text)) END AS char_end,
           CASE WHEN f.c >= 0.75 THEN 'auto_accepted' ELSE 'pending_review' END AS review_status FROM text_fields JOIN extracted USING (document_id)
    UNION ALL SELECT document_id, domain, 'entity', e.t, e.v, e.c, NULL, NULL, NULL, NULL, 'auto_accepted' FROM (SELECT document_id, domain,
      unnest(list_concat(list_filter([{'t': 'customer', 'v': customer_name, 'c': CAST(0.81 AS DOUBLE)}], lambda x: x.v IS NOT NULL),
        list_transform(dates, lambda d: {'t': 'date', 'v': d, 'c': CAST(0.9 AS DOUBLE)}), list_transform(money, lambda m: {'t': 'monetary_value', 'v': m, 'c': CAST(0.85 AS DOUBLE)}))) AS e FROM extracted)""")
add("staged_entities", "SELECT * FROM staged", ["staged"])
cte("ambiguous", ["text_mentions", "t_decisions"], """
    SELECT 'entity_resolution' AS item_type, document_id, 'Ambiguous entity: ''' || raw_value || '''' AS title,
           'May match ''' || canonical_name || ''' (confidence: ' || CAST(CAST(round(CAST(confidence AS DECIMAL(10,4)) * 100, 0) AS INTEGER) AS VARCHAR) || '%)' AS description,
           raw_value AS current_value, canonical_id AS suggested_value, confidence, 'medium' AS priority
    FROM text_mentions JOIN t_decisions USING (entity_type, raw_value) WHERE requires_review""")
add("review_items", f"""
    SELECT {sid('item_type', 'document_id', 'title')} AS item_id, *, 'pending' AS status FROM (SELECT * FROM weak UNION ALL SELECT * FROM ambiguous)""", ["weak", "ambiguous"])
add("ticket_facts", f"""
    SELECT ticket_number, document_id, {stamp('arrived_at')} AS arrived_at, customer_code, document_id AS title, severity AS priority, severity, 'open' AS status, category, subcategory,
           sentiment, sentiment_score, {joined('topics', ',')} AS tags, subcategory AS root_cause_category, overall_confidence AS extraction_confidence
    FROM (SELECT * REPLACE (coalesce(ticket_number, 'TK-AUTO-' || upper(md5(document_id))) AS ticket_number) FROM with_customer WHERE domain = 'customer_intelligence') w
    QUALIFY row_number() OVER (PARTITION BY ticket_number ORDER BY w.arrived_at, document_id) = 1""", ["with_customer"])
_incidents = f"""
    SELECT incident_number, document_id, {stamp('arrived_at')} AS arrived_at, document_id AS title, severity, 'open' AS status, category, subcategory,
           nullif(CAST(downtime AS DOUBLE), 0) AS downtime_minutes, subcategory AS root_cause_category, false AS sla_breached, overall_confidence AS extraction_confidence
    FROM (SELECT * REPLACE (coalesce(incident_number, 'INC-AUTO-' || upper(md5(document_id))) AS incident_number) FROM extracted WHERE domain = 'it_operations') w
    QUALIFY row_number() OVER (PARTITION BY incident_number ORDER BY w.arrived_at, document_id) = 1"""
cte("text_incidents", ["extracted"], _incidents)
add("incident_facts", "SELECT * FROM text_incidents", ["text_incidents"])
add("stream_incident_facts", "SELECT * FROM text_incidents", ["text_incidents"])
add("contract_facts", f"""
    SELECT contract_number, document_id, {stamp('arrived_at')} AS arrived_at, customer_code, 'active' AS status, overall_confidence AS extraction_confidence
    FROM with_customer w WHERE domain = 'document_contract' AND contract_number IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY contract_number ORDER BY w.arrived_at, document_id) = 1""", ["with_customer"])
add("feedback_facts", f"""
    SELECT {sid("'feedback'", 'document_id')} AS feedback_id, document_id, customer_code, domain AS feedback_type, text AS raw_text, sentiment, sentiment_score,
           {joined('topics', ',')} AS topics, {joined('key_phrases', ',')} AS key_phrases, overall_confidence AS extraction_confidence FROM with_customer""", ["with_customer"])
add("labelled_feedback", """
    SELECT source AS feedback_type, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment, count(*) AS records, sum(length(text)) AS n_chars
    FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2""")
add("run_summary", f"""
    SELECT domain, sentiment, count(*) AS documents, count(*) AS pages, sum(word_count) AS words,
           sum(n_fields + len(dates) + len(money) + CASE WHEN customer_name IS NULL THEN 0 ELSE 1 END) AS entities_extracted, count(*) FILTER (len(topics) > 0) AS with_topics,
           {rnd('CAST(sum(CAST(overall_confidence AS DECIMAL(10,2))) AS DOUBLE) / count(*)', 2)} AS confidence FROM extracted GROUP BY 1, 2""", ["extracted"])
add("provenance_links", f"""
    SELECT {sid("'fact_incident'", 'incident_number', 'entity_type')} AS link_id, document_id, 'fact_incident' AS target_table, incident_number AS target_id, entity_type AS field_name,
           source_page, char_start, char_end, confidence FROM text_incidents JOIN staged USING (document_id) WHERE origin = 'field'""", ["text_incidents", "staged"])

# --- entity resolution -----------------------------------------------------------------------------------------

add("resolve_exact", "SELECT * FROM s_exact", ["s_exact"])
add("resolve_normalized", "SELECT * FROM s_same", ["s_same"])
cte("s_norms", ["service_names"], f"SELECT entity_type, {name_norm('raw_value')} AS norm FROM service_names")
add("resolve_fuzzy_lev", fuzzy_sql("s_norms", "s_known", "levenshtein"), ["s_norms", "s_known"])
add("resolve_fuzzy", fuzzy_sql("s_norms", "s_known"), ["s_norms", "s_known"])
add("resolve_new", "SELECT DISTINCT entity_type, canonical_id, canonical_name, confidence FROM s_decisions WHERE is_new_entity", ["s_decisions"])
add("resolve_all", "SELECT * FROM s_decisions", ["s_decisions"])
add("registry_after_run", """
    SELECT entity_type, canonical_id, min(name) AS name, coalesce(string_agg(DISTINCT alias, '|' ORDER BY alias) FILTER (alias <> name), '') AS aliases
    FROM registry_2 GROUP BY 1, 2""", ["registry_2"])
_by_link = lambda i: "CASE " + " ".join(f"WHEN score >= {b[0]} THEN {repr(b[i]) if isinstance(b[i], str) else str(b[i]).lower()}" for b in fv.FUZZY_BANDS) + " END"
add("resolve_components", f"""
    SELECT * FROM s_decisions WHERE NOT is_new_entity
    UNION ALL SELECT entity_type, raw_value, canonical_id, canonical_name, 'new_entity', 0.5, true, false, 0.0 FROM c_named WHERE form = canonical_id
    UNION ALL SELECT entity_type, raw_value, canonical_id, canonical_name, {_by_link(2)}, {_by_link(1)}, false, {_by_link(3)}, score
    FROM (SELECT *, (SELECT max(score) FROM c_links WHERE a = form) AS score FROM c_named WHERE form <> canonical_id)""", ["s_decisions", "c_named", "c_links"])
add("resolution_log", """
    SELECT document_id, entity_type, raw_value, canonical_id, canonical_name, resolution_method, confidence, is_new_entity, requires_review, score
    FROM text_mentions JOIN t_decisions USING (entity_type, raw_value)""", ["text_mentions", "t_decisions"])
add("customer_aliases", "SELECT DISTINCT entity_type, canonical_id, raw_value AS alias FROM t_decisions WHERE raw_value <> canonical_name", ["t_decisions"])

# --- scoring ------------------------------------------------------------------------------------------------------


def _trend(source: str, key: str) -> str:
    return f"""
    SELECT {key}, n AS points, CASE WHEN abs(pct) < 5 THEN 'STABLE' WHEN slope > 0 THEN 'INCREASING' ELSE 'DECREASING' END AS direction, {rnd('slope', 4)} AS slope, {rnd('r2', 3)} AS r_squared,
           {rnd('pct', 1)} AS pct_change, f AS first_value, l AS last_value, {rnd('least(0.95, 0.5 + abs(r2) * 0.45)', 6)} AS confidence
    FROM (SELECT *, CASE WHEN f <> 0 THEN (l - f) / abs(f) * 100 ELSE 0 END AS pct FROM (
      SELECT {key}, count(*) AS n, CASE WHEN min(value) = max(value) THEN 0 ELSE regr_slope(value, p) END AS slope, CASE WHEN min(value) = max(value) THEN 0 ELSE regr_r2(value, p) END AS r2,
             arg_min(value, t) AS f, arg_max(value, t) AS l
      FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY t) - 1 AS p FROM {source}) GROUP BY 1)) WHERE n >= 3"""


add("trend", _trend("hourly", "event_type"), ["hourly"])
cte("service_months", ["fact_ticket"], """
    SELECT service_id, date_trunc('month', created_at) AS t, CAST(sum(CAST(resolution_hours AS DECIMAL(18,4))) AS DOUBLE) AS value FROM fact_ticket GROUP BY 1, 2""")
add("trend_services", _trend("service_months", "service_id"), ["service_months"])
add("anomaly_zscore", f"SELECT * REPLACE ({stamp('t')} AS t) FROM zscores", ["zscores"])
add("stream_learnt_moments", f"""
    SELECT event_type, count(*) AS hours, {rnd('avg(value)', 4)} AS mean, {rnd('stddev_samp(value)', 4)} AS deviation
    FROM hourly WHERE t + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY event_type""", ["hourly"])
add("stream_metric_anomalies", f"""
    SELECT * REPLACE ({stamp('t')} AS t) FROM zscores WHERE t + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""", ["zscores"])


def _iqr(source: str, key: str, k: float, columns: str) -> str:
    return f"""
    SELECT {columns}, {rnd('med', 2)} AS expected, {rnd('lo', 2)} AS lower_bound, {rnd('hi', 2)} AS upper_bound,
           {rnd('CASE WHEN med <> 0 THEN (value - med) / abs(med) * 100 ELSE 0 END', 1)} AS deviation_pct, 'iqr' AS method,
           CASE WHEN value > hi * 2 OR value < lo / 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
    FROM {source} s JOIN (SELECT k, n, q1 - {k} * (q3 - q1) AS lo, q3 + {k} * (q3 - q1) AS hi, med FROM (
      SELECT k, any_value(n) AS n, max(CASE WHEN r = n // 4 THEN value END) AS q1, max(CASE WHEN r = 3 * n // 4 THEN value END) AS q3, median(value) AS med
      FROM (SELECT {key} AS k, value, row_number() OVER (PARTITION BY {key} ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY {key}) AS n FROM {source}) GROUP BY 1)) f ON f.k = s.{key}
    WHERE n >= 5 AND (value < lo OR value > hi)"""


add("anomaly_iqr", f"SELECT * REPLACE ({stamp('t')} AS t) FROM ({_iqr('hourly', 'event_type', 1.5, 'event_type, t, value, n_events')})", ["hourly"])
cte("prices", [], "SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS value FROM lineitem")
add("anomaly_iqr_prices", _iqr("prices", "l_returnflag", 0.5, "l_returnflag, l_orderkey, l_linenumber, l_partkey, value"), ["prices"])
add("anomaly_rolling", f"""
    SELECT event_type, {stamp('t')} AS t, value, n_events, {rnd('m', 2)} AS expected, {rnd('(value - m) / abs(m) * 100', 1)} AS deviation_pct, 'rolling_average' AS method
    FROM (SELECT *, avg(value) OVER w AS m, count(value) OVER w AS n FROM hourly WINDOW w AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
    WHERE n = 24 AND m <> 0 AND abs({rnd('(value - m) / abs(m) * 100', 6)}) >= 50""", ["hourly"])
add("customer_health", f"""
    SELECT customer_id, health_score, risk_level, trend, {rnd('tk', 1)} AS ticket_frequency, {rnd('se', 1)} AS sentiment, {rnd('sl', 1)} AS sla_compliance, {rnd('re', 1)} AS resolution_time,
           {rnd('ic', 1)} AS incident_frequency, 70.0 AS customer_rating, ticket_change_pct, revenue_at_risk FROM health""", ["health"])
add("topic_counts", "SELECT * FROM topic_counts", ["topic_counts"])
add("topic_counts_unbounded", """
    SELECT topic, count(*) FILTER (created_at >= TIMESTAMP '2024-01-24') AS current_count, count(*) FILTER (created_at < TIMESTAMP '2024-01-24') AS previous_count FROM mentions GROUP BY topic""", ["mentions"])
add("emerging_topics", "SELECT * FROM emerging", ["emerging"])
add("emerging_topics_joined", "SELECT * FROM emerging", ["emerging"])
add("root_causes", "SELECT * FROM causes", ["causes"])
add("root_causes_recent", causes_sql(f"WHERE occurred_at >= {AS_OF} - INTERVAL 90 DAY"), ["fact_incident"])
add("downtime_impact", f"""
    SELECT incident_id, {rnd('downtime_minutes / 60', 2)} AS downtime_hours, rate AS revenue_per_hour, {rnd('downtime_minutes / 60 * rate * (affected_users_count / 1000.0)', 2)} AS estimated_revenue_loss
    FROM (SELECT *, CAST(CASE WHEN customer_id % 3 = 0 THEN 20000 ELSE 15000 END AS DOUBLE) AS rate FROM fact_incident)""", ["fact_incident"])
add("sla_penalty", f"""
    SELECT customer_id, breach_count, {rnd('breach_count * 5000.0', 2)} AS direct_penalty_estimate, {rnd('CASE WHEN v <> 0 THEN v * 0.6 END', 2)} AS churn_risk_value,
           {rnd('breach_count * 5000.0 + coalesce(v * 0.6, 0)', 2)} AS total_exposure
    FROM (SELECT customer_id, count(*) FILTER (sla_breached) AS breach_count FROM fact_ticket GROUP BY 1) JOIN (SELECT customer_id, CAST(contract_value AS DOUBLE) AS v FROM dim_customer) USING (customer_id)""", ["fact_ticket", "dim_customer"])
_kinds = ["risk", "anomaly", "sla_risk", "emerging_issue", "customer_issue", "root_cause", "trend", "data_quality", "opportunity", "recommendation", "other"]
add("insight_priority", f"""
    SELECT customer_id, kind AS insight_type, {priority('risk_level', 'churn_risk_score', 'kind', 'ticket_count', 'revenue_at_risk')} AS priority_score
    FROM (SELECT *, {pick(_kinds, 'customer_id')} AS kind FROM health)""", ["health"])

# --- insights ---------------------------------------------------------------------------------------------------------

_COLUMNS = ("insight_id, insight_type, title, description, what_happened, why_it_matters, recommended_action, severity, confidence, entity_type, entity_id, entity_name, metric_name, "
            "current_value, baseline_value, change_pct, evidence, contributing_factors, financial_impact_estimate, affected_population, ")
_TAIL = "'insight_engine' AS generated_by, false AS is_cross_domain, 'active' AS status, "
_PRIORITY = priority("severity", "confidence", "insight_type", "affected_population", "financial_impact_estimate")
_NO = "CAST(NULL AS DOUBLE)"
_none = "CAST(NULL AS VARCHAR)"

_why = fv.HEALTH_TEXT
cte("i_health", ["health"], f"""
    SELECT {_COLUMNS} {_PRIORITY} AS priority_score, {_TAIL} '2000-01-01 00:00:00' AS created_at FROM (
    SELECT {sid("'risk'", 'customer_id')} AS insight_id, 'risk' AS insight_type, 'Customer Health Deterioration: ' || name AS title,
           name || ' shows a health score of ' || health_score || '/100 — ' || risk_level || ' risk.' AS description,
           name || ' has a health score of ' || health_score || '/100 with a ''' || risk_level || ''' risk level. The account is ' || lower(trend) || '.' AS what_happened,
           {q(_why['why_start'])} || CASE WHEN revenue_at_risk > 0 THEN 'Estimated $' || {grouped_text('revenue_at_risk')} || ' in contract value is at risk. ' ELSE '' END || {q(_why['why_end'])} AS why_it_matters,
           'Schedule an urgent account review for ' || name || '. Address top factors: ' || CASE WHEN len(fs) > 0 THEN array_to_string(fs[1:3], ', ') ELSE 'review all metrics' END
             || '. Assign a dedicated customer success manager if not already in place.' AS recommended_action,
           risk_level AS severity, CAST(0.82 AS DOUBLE) AS confidence, 'customer' AS entity_type, CAST(customer_id AS VARCHAR) AS entity_id, name AS entity_name, 'customer_health_score' AS metric_name,
           health_score AS current_value, 100.0 AS baseline_value, {rnd('health_score - 100', 1)} AS change_pct,
           concat_ws(' ; ', CASE WHEN abs(ticket_change_pct) > 10 THEN 'Ticket volume change=' || CASE WHEN ticket_change_pct >= 0 THEN '+' ELSE '' END || {fixed('ticket_change_pct', 1)} || '%=ticket' END,
             CASE WHEN revenue_at_risk > 0 THEN 'Estimated revenue at risk (ESTIMATED)=$' || {grouped_text('revenue_at_risk')} || '=analytics' END) AS evidence,
           {joined('fs')} AS contributing_factors, revenue_at_risk AS financial_impact_estimate, 1 AS affected_population
    FROM (SELECT *, list_filter([CASE WHEN {rnd('tk', 1)} < 50 THEN 'High ticket volume' END, CASE WHEN {rnd('se', 1)} < 50 THEN 'Negative sentiment trend' END, CASE WHEN {rnd('sl', 1)} < 70 THEN 'SLA breaches' END,
            CASE WHEN {rnd('re', 1)} < 50 THEN 'Slow resolution times' END, CASE WHEN {rnd('ic', 1)} < 50 THEN 'Elevated incident frequency' END], lambda x: x IS NOT NULL) AS fs
          FROM health WHERE risk_level <> 'LOW' OR trend = 'DETERIORATING'))""")
_pct = even_text("pct_change")
_topic = r"array_to_string(list_transform(regexp_extract_all(replace(topic, '_', ' '), '\p{L}+|\P{L}+'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"


def _emerging(source: str, created: str) -> str:
    return f"""
    SELECT {_COLUMNS} {_PRIORITY} AS priority_score, {_TAIL} '{created}' AS created_at FROM (
    SELECT {sid("'emerging_issue'", 'topic')} AS insight_id, 'emerging_issue' AS insight_type, 'Emerging Issue: ' || {_topic} || ' Complaints Spike' AS title,
           {_topic} || ' complaints have increased by ' || {_pct} || '% compared to the previous period.' AS description,
           'Reports mentioning ''' || {_topic} || ''' increased from ' || previous_count || ' to ' || current_count || ' records — a ' || {_pct} || '% ' || CASE WHEN pct_change > 100 THEN 'surge' ELSE 'increase' END || '.' AS what_happened,
           replace({q(fv.EMERGING_TEXT['why_it_matters'])}, '%s', {_topic}) AS why_it_matters, replace({q(fv.EMERGING_TEXT['action'])}, '%s', {_topic}) AS recommended_action,
           severity, CAST(0.78 AS DOUBLE) AS confidence, 'issue_category' AS entity_type, {_none} AS entity_id, {_topic} AS entity_name, {_topic} || '_complaint_count' AS metric_name,
           CAST(current_count AS DOUBLE) AS current_value, CAST(previous_count AS DOUBLE) AS baseline_value, pct_change AS change_pct,
           'Current period count=' || current_count || '=ticket ; Previous period count=' || previous_count || '=ticket ; Change=+' || {_pct} || '%=analytics' AS evidence,
           'Spike in ' || {_topic} || '-related reports' AS contributing_factors, {_NO} AS financial_impact_estimate, current_count AS affected_population FROM {source})"""


cte("i_emerging", ["emerging"], _emerging("emerging", "2024-01-31 00:00:00"))
cte("i_emerging_5", ["emerging"], _emerging("(SELECT * FROM emerging ORDER BY pct_change DESC, topic LIMIT 5)", "2000-01-01 00:00:00"))


def _root(source: str) -> str:
    return f"""
    SELECT {_COLUMNS} {_PRIORITY} AS priority_score, {_TAIL} '2000-01-01 00:00:00' AS created_at FROM (
    SELECT {sid("'root_cause'", 'category')} AS insight_id, 'root_cause' AS insight_type, 'Recurring Pattern: ' || category AS title,
           incident_count || ' incidents in category ' || category || ' with potential root cause: ' || potential_root_cause AS description,
           incident_count || ' incidents have occurred in the ''' || category || ''' category.' AS what_happened, {q(fv.ROOT_CAUSE_TEXT['why_it_matters'])} AS why_it_matters,
           'Conduct a root cause analysis session for ' || category || CASE WHEN has_hypothesis THEN '. Potential hypothesis: ' || potential_root_cause ELSE '. Insufficient evidence for hypothesis — gather more data.' END AS recommended_action,
           CASE WHEN incident_count >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, confidence, 'incident_category' AS entity_type, {_none} AS entity_id, category AS entity_name, 'incident_count' AS metric_name,
           CAST(incident_count AS DOUBLE) AS current_value, {_NO} AS baseline_value, {_NO} AS change_pct,
           'Total incidents=' || incident_count || '=incident ; Potential root cause=' || potential_root_cause || ' (' || rc_pct || '% of incidents) [HYPOTHESIS]=analytics' AS evidence,
           potential_root_cause AS contributing_factors, {_NO} AS financial_impact_estimate, incident_count AS affected_population FROM {source} WHERE confidence > 0.6)"""


cte("i_root", ["causes"], _root("causes"))
cte("i_root_3", ["causes"], _root("(SELECT * FROM causes ORDER BY incident_count DESC, category LIMIT 3)"))
_left = fixed("greatest(0.0, sla_hours - resolution_hours)", 1)
_spent = fixed("resolution_hours", 1)
_allowed = even_text("sla_hours")
cte("i_sla", ["fact_ticket", "dim_customer"], f"""
    SELECT {_COLUMNS} {_PRIORITY} AS priority_score, {_TAIL} '2000-01-01 00:00:00' AS created_at FROM (
    SELECT {sid("'sla_risk'", 'ticket_id')} AS insight_id, 'sla_risk' AS insight_type, 'SLA Breach Risk: Ticket ' || ticket_number AS title,
           'Ticket ' || ticket_number || ' for ' || name || ' has ' || {even_text('p * 100')} || '% probability of SLA breach.' AS description,
           'Ticket ' || ticket_number || ' (Priority: ' || t.severity || ') has been open for ' || {_spent} || ' hours. SLA target is ' || {_allowed} || ' hours, leaving ' || {_left} || ' hours.' AS what_happened,
           'An SLA breach for a ' || t.severity || ' ticket from ' || name || ' could trigger contract penalties and damage the customer relationship.' AS why_it_matters,
           'Immediately escalate ticket ' || ticket_number || ' to a senior engineer. Notify ' || name || ' proactively and provide an ETA.' AS recommended_action,
           CASE WHEN p > 0.85 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, {rnd('p', 6)} AS confidence, 'ticket' AS entity_type, ticket_id AS entity_id, ticket_number AS entity_name, 'sla_breach_probability' AS metric_name,
           {rnd('p * 100', 4)} AS current_value, 0.0 AS baseline_value, {rnd('p * 100', 4)} AS change_pct,
           'Elapsed time=' || {_spent} || 'h=ticket ; SLA target=' || {_allowed} || 'h=ticket ; Time remaining=' || {_left} || 'h=analytics' AS evidence,
           'Extended open time ; ' || t.severity || ' priority' AS contributing_factors, {_NO} AS financial_impact_estimate, 1 AS affected_population
    FROM (SELECT *, least(1.0, resolution_hours / sla_hours) AS p FROM fact_ticket WHERE status = 'open') t LEFT JOIN dim_customer USING (customer_id) WHERE p >= 0.5)""")
add("insights_health", "SELECT * FROM i_health", ["i_health"])
add("insights_emerging", "SELECT * FROM i_emerging", ["i_emerging"])
add("insights_root_cause", "SELECT * FROM i_root", ["i_root"])
add("insights_sla_risk", "SELECT * FROM i_sla", ["i_sla"])
add("insights_full", "SELECT * FROM i_health UNION ALL SELECT * FROM i_emerging_5 UNION ALL SELECT * FROM i_root_3", ["i_health", "i_emerging_5", "i_root_3"])
add("insight_list", """
    SELECT insight_id, title, severity, priority_score, current_value, count(*) OVER () AS total FROM i_health WHERE severity = 'HIGH' ORDER BY priority_score DESC, insight_id LIMIT 20""", ["i_health"])

# --- data quality --------------------------------------------------------------------------------------------------------

_crit = fv.CRITICAL_FIELDS["ticket"]
add("dq_completeness", " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER (coalesce({f}, '') = '') AS affected_records, {rnd(f'''count(*) FILTER (coalesce({f}, '') = '') * 100.0 / count(*)''', 1)} AS pct FROM dirty" for f in _crit), )
ORACLE["dq_completeness"] = with_(["dirty"], ORACLE["dq_completeness"])
_bad = {"priority": "priority", "created_date": "date", "resolved_date": "date", "customer_email": "email", "amount_currency": "currency", "updated_at": "date"}
_wrong = {c: f"({c} IS NOT NULL AND NOT regexp_matches({c}, {q('(?i)^(?:' + fv.VALIDITY_RULES[r][0] + ')')}))" for c, r in _bad.items()}
_nbad = " + ".join(f"CAST({w} AS INTEGER)" for w in _wrong.values())
_order = "coalesce(nullif(created_date, '') > nullif(resolved_date, ''), false)"
_age_text = "substr(coalesce(nullif(created_date, ''), nullif(updated_at, '')), 1, 19)"
_stale = f"coalesce(date_diff('second', coalesce(try_strptime({_age_text}, '%Y-%m-%d'), try_strptime({_age_text}, '%Y-%m-%dT%H:%M:%S')), {AS_OF}) // 86400 > 730, false)"
_key = "concat_ws('|', nullif(ticket_number, ''), nullif(customer_name, ''), nullif(priority, ''))"
add("dq_validity", f"SELECT count(*) AS total_records, sum(b) AS invalid_values, count(*) FILTER (b > 0) AS invalid_records FROM (SELECT {_nbad} AS b FROM dirty)", ["dirty"])
add("dq_uniqueness", f"SELECT count(*) - count(DISTINCT k) AS duplicate_records FROM (SELECT {_key} AS k FROM dirty) WHERE k <> ''", ["dirty"])
add("dq_consistency", f"SELECT count(*) AS total_records, count(*) FILTER ({_order}) AS order_errors FROM dirty", ["dirty"])
add("dq_timeliness", f"SELECT count(*) AS total_records, count(*) FILTER ({_stale}) AS stale_records FROM dirty", ["dirty"])
_miss = " + ".join(f"CAST(coalesce({f}, '') = '' AS INTEGER)" for f in _crit)
cte("dq_counts", ["dirty"], f"""
    SELECT 'tickets' AS dataset_name, 'ticket' AS record_type, 5 AS nc, 9 AS nf, count(*) AS n, sum({_miss}) AS missing, sum({_nbad}) AS bad, count(*) FILTER ({_nbad} > 0) AS badrows, count(*) FILTER ({_order}) AS ord,
           count(*) FILTER ({_stale}) AS stale, (SELECT count(*) - count(DISTINCT k) FROM (SELECT {_key} AS k FROM dirty) WHERE k <> '') AS dup FROM dirty
    UNION ALL SELECT 'customers', 'customer', 2, 3, count(*), count(*) FILTER (c_custkey % 4 = 0), 0, 0, 0, 0,
           count(*) - (SELECT count(DISTINCT (c_name, c_mktsegment)) FROM customer) FROM customer""")
cte("dq_reports", ["dq_counts"], f"""
    SELECT dataset_name, record_type, '2000-01-01 00:00:00' AS report_date, {rnd('.3*c + .25*v + .2*u + .15*k + .1*t', 1)} AS overall_score, {rnd('c', 1)} AS completeness_score, {rnd('v', 1)} AS validity_score,
           {rnd('u', 1)} AS uniqueness_score, {rnd('k', 1)} AS consistency_score, {rnd('t', 1)} AS timeliness_score, n AS total_records, n - badrows AS valid_records, badrows AS invalid_records, dup AS duplicate_records,
           missing AS missing_critical_fields, least(n, badrows + dup) AS records_requiring_review
    FROM (SELECT *, 100 - missing * 100.0 / (n * nc) AS c, 100 - bad * 100.0 / (n * nf) AS v, 100 - dup * 100.0 / n AS u, 100 - ord * 100.0 / n AS k, 100 - stale * 100.0 / n AS t FROM dq_counts)""")
add("dq_report", "SELECT * FROM dq_reports", ["dq_reports"])
_blocks = {"customer": fv.CRITICAL_FIELDS["customer"], "ticket": fv.CRITICAL_FIELDS["ticket"]}
_have = ["ticket_number", "customer_name", "priority", "status", "created_date", "resolved_date", "customer_email", "amount_currency", "updated_at"]
_lost = {k: " + ".join(f"CAST(coalesce({f}, '') = '' AS INTEGER)" if f in _have else "1" for f in fields) for k, fields in _blocks.items()}
add("dq_documents", f"""
    SELECT * FROM (WITH r AS (SELECT *, CAST(substr(row_id, 3) AS BIGINT) // 2000 AS block FROM dirty),
    d AS (SELECT *, {pick(['customer_intelligence', 'it_operations', 'ticket'], 'block')} AS domain, {pick(['customer', 'operations', 'ticket'], 'block')} AS record_type FROM r),
    g AS (SELECT block, domain, record_type, CASE record_type WHEN 'customer' THEN 2 WHEN 'ticket' THEN 5 ELSE 1 END AS nc, count(*) AS n,
                 sum(CASE record_type WHEN 'customer' THEN {_lost['customer']} WHEN 'ticket' THEN {_lost['ticket']} ELSE 0 END) AS missing, sum({_nbad}) AS bad,
                 count(*) FILTER ({_nbad} > 0) AS badrows, count(*) FILTER ({_order}) AS ord, count(*) FILTER ({_stale}) AS stale,
                 count(*) FILTER ({_key} <> '') - count(DISTINCT CASE WHEN {_key} <> '' THEN {_key} END) AS dup FROM d GROUP BY ALL),
    s AS (SELECT *, greatest(0, 100 - missing * 100.0 / (n * nc)) AS c, 100 - bad * 100.0 / (n * 9) AS v, 100 - dup * 100.0 / n AS u, 100 - ord * 100.0 / n AS k, 100 - stale * 100.0 / n AS t FROM g)
    SELECT 'DOC-' || block AS document_id, 'part-' || block || '.csv' AS dataset_name, domain, record_type, '2000-01-01 00:00:00' AS report_date,
           {rnd('.3*c + .25*v + .2*u + .15*k + .1*t', 1)} AS overall_score, {rnd('c', 1)} AS completeness_score, {rnd('v', 1)} AS validity_score, {rnd('u', 1)} AS uniqueness_score,
           {rnd('k', 1)} AS consistency_score, {rnd('t', 1)} AS timeliness_score, n AS total_records, n - badrows AS valid_records, badrows AS invalid_records, dup AS duplicate_records,
           missing AS missing_critical_fields, least(n, badrows + dup) AS records_requiring_review FROM s)""", ["dirty"])
add("dq_summary", f"""
    SELECT {rnd('avg(overall_score)', 1)} AS avg_overall_score, {rnd('avg(completeness_score)', 1)} AS avg_completeness_score, {rnd('avg(validity_score)', 1)} AS avg_validity_score,
           sum(total_records) AS total_records_assessed, sum(invalid_records) AS total_invalid_records, sum(duplicate_records) AS total_duplicate_records FROM dq_reports""", ["dq_reports"])
_null = "CAST(NULL AS VARCHAR)"
_issue_parts = [f"SELECT 'missing_critical_field' AS kind, {_null} AS row_id, '{f}' AS field, {_null} AS value, {_null} AS message, count(*) AS affected_records FROM dirty WHERE coalesce({f}, '') = '' HAVING count(*) > 0" for f in _crit]
_issue_parts += [f"SELECT 'invalid_value', row_id, '{c}', {c}, {q(fv.VALIDITY_RULES[_bad[c]][1])}, NULL FROM dirty WHERE {w}" for c, w in _wrong.items()]
_issue_parts += [f"SELECT 'duplicate_record', NULL, NULL, k, NULL, count(*) - 1 FROM (SELECT {_key} AS k FROM dirty) WHERE k <> '' GROUP BY k HAVING count(*) > 1",
                 f"SELECT 'date_ordering', row_id, NULL, NULL, 'start_date > end_date: ' || created_date || ' > ' || resolved_date, NULL FROM dirty WHERE {_order}"]
add("dq_issues", " UNION ALL ".join(_issue_parts), ["dirty"])
_fields = ["ticket_number", "customer_name", "priority", "status", "created_date", "resolved_date", "customer_email", "amount_currency", "updated_at"]
add("dq_field_stats", " UNION ALL ".join(
    f"SELECT '{f}' AS field_name, count(*) AS total_count, count(*) FILTER (coalesce({f}, '') = '') AS null_count, {rnd(f'''count(*) FILTER (coalesce({f}, '') = '') * 100.0 / count(*)''', 1)} AS null_pct, count(DISTINCT nullif({f}, '')) AS unique_count FROM dirty" for f in _fields), ["dirty"])

# --- streams ----------------------------------------------------------------------------------------------------------------


def _windows(days: int) -> str:
    return f"""
    SELECT w AS window_start, w + INTERVAL {days} DAY AS window_end, topic, count(*) AS mentions FROM (
      SELECT topic, unnest(list_transform(range({days}), lambda i: date_trunc('day', created_at) - to_days(CAST(i AS INTEGER)))) AS w FROM mentions) GROUP BY ALL"""


_w = f"SELECT {stamp('window_start')} AS window_start, {stamp('window_end')} AS window_end, topic, mentions"
add("event_topic_windows", f"{_w} FROM ({_windows(30)})", ["mentions"])
add("stream_topic_windows", f"{_w} FROM ({_windows(7)}) x WHERE x.window_end <= (SELECT max(created_at) FROM mentions) - INTERVAL 1 DAY", ["mentions"])
