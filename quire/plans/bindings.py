"""How the given tables stand in for document, page and job tables."""

BINDINGS: dict[str, str] = {
    # conversation = document, turn = page
    "page_table": """
        SELECT conv_id AS document_id, CAST(turn + 1 AS INT) AS page_number, text AS markdown,
               CASE length(text) % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'needs_review'
                    ELSE 'unreviewed' END AS review_status,
               (length(text) % 100) / 100e0 AS confidence_score
        FROM {conversations}""",
    # one page of every document is not stored
    "page_docs": """
        SELECT conv_id AS document_id, CAST(max(turn) + 2 AS INT) AS num_pages,
               concat('My Report ', conv_id, '.pdf') AS document_name
        FROM {conversations} GROUP BY conv_id""",
    "doc_pages": "SELECT doc_id AS document_id, 1 AS page_number, text AS markdown FROM {documents}",
    # language = project, source = session
    "doc_table": """
        SELECT doc_id AS document_id, source AS session_id, lang AS project_id, text AS content,
               SHA256HEX(text) AS checksum, n_chars,
               concat('scan ', doc_id, '.png') AS name, 'image/png' AS mime_type,
               CAST(n_chars % 12 + 1 AS INT) AS num_pages, n_chars % 2 = 0 AS is_pdf
        FROM {documents}""",
    "session_table": """
        SELECT source AS session_id, min(lang) AS project_id, concat('Session ', source) AS session_title,
               min(doc_id) % 3 AS user_id, min(doc_id) % 2 = 1 AS is_pinned,
               min(doc_id) % 5 = 0 AS is_archived, max(doc_id) AS session_updated_at
        FROM {documents} GROUP BY source""",
    "project_table": """
        SELECT n_name AS project_id, concat('Project ', n_name) AS project_name FROM {nation}
        UNION ALL SELECT lang AS project_id, concat('Project ', lang) AS project_name
        FROM {documents} GROUP BY lang""",
    "review_pages": """
        SELECT d.doc_id AS document_id, 1 AS page_number, d.text AS markdown,
               CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'approved'
                    WHEN l.quality IS NOT NULL THEN 'needs_review' ELSE 'unreviewed' END AS review_status,
               (d.n_chars % 100) / 100e0 AS confidence_score
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # user = job, event = page
    "job_pages": """
        SELECT user_id AS job_id, event_id + 1 AS page_number,
               CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running'
                    WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status,
               CASE WHEN JSON_K(props) >= 90 THEN 1000 ELSE 0 END AS priority,
               CASE WHEN event_id % 2 = 0 THEN 'realtime' ELSE 'batch' END AS processing_mode,
               CASE WHEN event_type = 'error' THEN 'upstream' END AS error,
               value AS duration_seconds, ts, event_id
        FROM {events}""",
    # several events per page: page = k of the properties
    "status_events": """
        SELECT user_id AS job_id, JSON_K(props) + 1 AS page_number,
               CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running'
                    WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status,
               CASE WHEN event_type = 'error' THEN 'upstream' END AS error,
               CASE WHEN event_type = 'click' THEN CAST(round(value * 1000) AS BIGINT) END AS duration_ms,
               ts, event_id
        FROM {events}""",
    "jobs": """
        SELECT user_id AS job_id,
               CASE user_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'cancelling'
                    WHEN 3 THEN 'failed' WHEN 4 THEN 'cancelled' ELSE 'completed' END AS status,
               user_id % 7 = 0 AS cancel_requested, max(event_id) + 1 AS num_pages
        FROM {events} GROUP BY user_id""",
    # customer = document, order = job
    "order_jobs": """
        SELECT o_custkey AS document_id, o_orderkey AS job_id,
               CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN 'running'
                    WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN 'cancelling'
                    WHEN o_orderstatus = 'P' THEN 'queued' WHEN o_orderstatus = 'F' THEN 'failed'
                    WHEN o_orderpriority = '5-LOW' THEN 'cancelled' ELSE 'completed' END AS status,
               o_orderdate AS created_at
        FROM {orders}""",
    # line = claim, duplicate keys on purpose
    "claims": """
        SELECT l_orderkey AS document_id, l_linenumber AS page_number,
               concat(l_partkey, '-', l_suppkey) AS owner_token, l_shipdate AS claimed_at,
               l_extendedprice AS price
        FROM {lineitem}""",
    "range_specs": """
        SELECT spec_id, a, b, c, 10 AS total_pages,
               CASE spec_id % 6 WHEN 0 THEN concat(a, '-', b) WHEN 1 THEN concat(a, ', ', b, '-', a)
                    WHEN 2 THEN ' ALL ' WHEN 3 THEN concat(b, ', nope') WHEN 4 THEN concat(a, ',,', c)
                    ELSE concat(' ', c, ' - ', a, ' ,', b) END AS spec
        FROM (SELECT o_orderkey AS spec_id, CAST(o_custkey % 9 + 1 AS INT) AS a,
                     CAST(o_orderkey % 12 AS INT) AS b, CAST(o_custkey % 7 + 2 AS INT) AS c
              FROM {orders}) s""",
    "user_queries": "SELECT item_id AS query_id, text AS query FROM {benchmark}",
    # stored web pages = image assets of the documents
    "assets": """
        SELECT page_id AS document_id, 1 AS page_number,
               concat('page ', page_id, '-image-1.png') AS filename, html AS content
        FROM {pages}""",
    # one provider outcome per page, by the length of its text
    "provider_outcomes": """
        SELECT conv_id AS document_id, CAST(turn + 1 AS INT) AS page_number,
               concat(conv_id, ':', turn + 1) AS custom_id, text AS markdown,
               CASE length(text) % 10 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 400 ELSE 200 END AS status_code,
               CASE length(text) % 10 WHEN 0 THEN 'Too Many Requests' WHEN 1 THEN 'upstream broke'
                    WHEN 2 THEN '' END AS error,
               CASE length(text) % 10 WHEN 4 THEN 'abc' WHEN 5 THEN '1.7' ELSE '0.93' END AS score
        FROM {conversations}""",
    # order = invoice with order-dependent line items, one noise class per priority and key
    "invoices": """
        SELECT o_orderkey AS document_id, CAST(o_orderkey AS VARCHAR(20)) AS invoice_number,
               CASE WHEN o_orderkey % 50 = 3 THEN '   ' ELSE concat(' ', c_name) END AS customer_name,
               CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS invoice_date,
               o_totalprice AS total, CAST(o_orderkey % 4 AS INT) AS n_items,
               CAST(o_orderkey % 50 AS INT) AS noise, o_orderpriority AS note
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
}
