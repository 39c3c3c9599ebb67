"""Queries over pages, documents and sessions: sources, selections, joins, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import joins, selection
from quire.operators.exports import document_markdown, package_manifest, resolve_asset_links
from quire.plans.registry import bind, query
from quire.session import table, work_dir
from quire.sources import tables
from quire.sources.files import write_files
from quire.sources.lines import batch_request_lines
from quire.sources.uploads import ingest_files, validate_uploads


@query("ingest_files")
def _(spark, root):
    """The given table files as uploads; the extension list is widened to take them."""
    return ingest_files(spark, root, extensions=("parquet",), content=False)


@query(
    "validate_uploads",
    """
    WITH f AS (
      SELECT page_id, concat('f', page_id, CASE page_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.JPG'
               WHEN 3 THEN '.webp' WHEN 4 THEN '.txt' ELSE '.png' END) AS name,
             CASE WHEN length(html) % 7 = 0 THEN 'bad' WHEN length(html) % 7 = 1 THEN 'empty'
                  ELSE 'good' END AS kind FROM {pages}),
    m AS (SELECT *, page_id % 6 AS k FROM f)
    SELECT name,
           CASE WHEN kind = 'good' THEN CASE k WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png'
                  WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/webp' WHEN 5 THEN 'image/png' END END AS mime_type,
           kind = 'good' AND k <> 4 AS accepted,
           CASE WHEN k = 4 THEN 'unsupported extension' WHEN kind = 'empty' THEN 'empty file'
                WHEN kind = 'bad' AND k = 0 THEN 'not a valid PDF'
                WHEN kind = 'bad' THEN 'not a readable image' END AS reason
    FROM m
    """,
)
def _(spark, root):
    k = F.col("page_id") % 6
    tail = F.to_binary("html", F.lit("utf-8"))
    size = F.length("html") % 7
    magic = (
        F.when(k == 0, F.to_binary(F.lit("255044462D312E37"), F.lit("hex")))
        .when(k == 2, F.to_binary(F.lit("FFD8FFE0"), F.lit("hex")))
        .when(k == 3, F.to_binary(F.lit("524946460000000057454250"), F.lit("hex")))
        .otherwise(F.to_binary(F.lit("89504E470D0A1A0A"), F.lit("hex")))
    )
    suffix = (
        F.when(k == 0, ".pdf").when(k == 2, ".JPG").when(k == 3, ".webp").when(k == 4, ".txt").otherwise(".png")
    )
    files = table(spark, root, "pages").select(
        F.concat(F.lit("f"), F.col("page_id").cast("string"), suffix).alias("name"),
        F.when(size == 0, tail).when(size == 1, F.to_binary(F.lit(""), F.lit("utf-8")))
        .otherwise(F.concat(magic, tail)).alias("content"),
    )
    return validate_uploads(files).drop("content")


@query(
    "page_metadata_scan",
    "SELECT document_id, session_id, project_id, n_chars, name, mime_type, num_pages, is_pdf FROM [[doc_table]]",
)
def _(spark, root):
    return tables.page_metadata_scan(bind(spark, root, "doc_table"), ("content", "checksum"))


@query(
    "batch_request_lines",
    """
    SELECT concat(document_id, ':', page_number) AS custom_id,
           concat('{"custom_id":"', document_id, ':', page_number,
                  '","body":{"document":{"type":"image_url","image_url":"data:image/png;base64,',
                  base64(encode(markdown)),
                  '"},"include_image_base64":true,"confidence_scores_granularity":"page"}}') AS value
    FROM [[page_table]]
    """,
)
def _(spark, root):
    pages = bind(spark, root, "page_table")
    return batch_request_lines(
        pages.select(
            F.concat_ws(":", "document_id", "page_number").alias("custom_id"),
            F.to_binary("markdown", F.lit("utf-8")).alias("content"),
            F.lit("application/octet-stream").alias("mime_type"),
        )
    )


_MARKDOWN_SQL = """
    SELECT p.document_id, CAST(0 AS BIGINT) AS part,
           string_agg(concat('<!-- Page ', p.page_number, ' -->', chr(10), chr(10), p.markdown),
                      concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY p.page_number) AS markdown
    FROM [[page_table]] p GROUP BY p.document_id
"""


@query("document_markdown", _MARKDOWN_SQL)
def _(spark, root):
    return document_markdown(bind(spark, root, "page_table"), bind(spark, root, "page_docs"))


@query(
    "document_files",
    f"""
    SELECT concat('My_Report_', document_id, '.md') AS file_name, markdown, CAST(octet_length(encode(markdown)) AS BIGINT) AS bytes
    FROM ({_MARKDOWN_SQL})
    """,
)
def _(spark, root):
    """Every document as one file, read back as a whole."""
    parts = document_markdown(bind(spark, root, "page_table"), bind(spark, root, "page_docs"))
    path = work_dir(spark, "document-files")
    named = parts.withColumn("file_name", F.concat(F.lit("My_Report_"), "document_id", F.lit(".md")))
    write_files(named, path, "document_id", "part", "file_name", "markdown")
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    return stored.select(
        F.substring_index("path", "/", -1).alias("file_name"), F.decode("content", "UTF-8").alias("markdown"), F.col("length").alias("bytes")
    )


@query(
    "document_markdown_headings",
    """
    WITH w AS (SELECT document_id, unnest(range(1, num_pages + 1)) AS page_number FROM [[page_docs]])
    SELECT w.document_id, CAST(0 AS BIGINT) AS part,
           string_agg(concat('# Page ', w.page_number, chr(10), chr(10), coalesce(p.markdown, ''), chr(10)),
                      concat(chr(10), chr(10)) ORDER BY w.page_number) AS markdown
    FROM w LEFT JOIN [[page_table]] p ON w.document_id = p.document_id AND w.page_number = p.page_number
    GROUP BY w.document_id
    """,
)
def _(spark, root):
    return document_markdown(
        bind(spark, root, "page_table"), bind(spark, root, "page_docs"), header="heading"
    )


@query(
    "package_manifest",
    f"""
    WITH md AS ({_MARKDOWN_SQL})
    SELECT d.document_id, concat('My_Report_', d.document_id, '_markdown.md') AS path,
           CAST(octet_length(encode(md.markdown)) AS BIGINT) AS bytes
    FROM [[page_docs]] d JOIN md ON d.document_id = md.document_id
    UNION ALL
    SELECT a.document_id, concat('assets/', a.filename), CAST(octet_length(encode(a.content)) AS BIGINT)
    FROM [[assets]] a WHERE a.document_id IN (SELECT document_id FROM [[page_docs]])
    """,
)
def _(spark, root):
    return package_manifest(
        bind(spark, root, "page_table"), bind(spark, root, "page_docs"), bind(spark, root, "assets")
    )


@query(
    "ledger_unapplied",
    """
    SELECT DISTINCT d.source AS version FROM {documents} d
    WHERE d.source NOT IN (SELECT source FROM {documents} x JOIN {labels} l ON x.doc_id = l.doc_id
                           WHERE l.toxic = 1)
    """,
)
def _(spark, root):
    documents = table(spark, root, "documents")
    labels = table(spark, root, "labels")
    ledger = documents.join(labels.where("toxic = 1"), "doc_id", "left_semi").select(
        F.col("source").alias("version")
    )
    inputs = documents.select(F.col("source").alias("version")).distinct()
    return tables.ledger_unapplied(inputs, ledger)


@query(
    "add_missing_columns",
    """
    SELECT job_id, page_number, priority, CAST(0 AS INTEGER) AS attempts,
           CAST(NULL AS VARCHAR) AS remote_batch_id, CAST(1250 AS BIGINT) AS rate_limit_ppm FROM [[job_pages]]
    """,
)
def _(spark, root):
    old = bind(spark, root, "job_pages").select("job_id", "page_number", "priority")
    return tables.add_missing_columns(
        old,
        {"attempts": ("int", 0), "remote_batch_id": ("string", None), "rate_limit_ppm": ("bigint", 1250),
         "priority": ("int", 0)},
    )


@query(
    "backfill_checksum",
    """
    SELECT document_id, CASE WHEN num_pages > 6 THEN 'kept' ELSE SHA256HEX(content) END AS checksum
    FROM [[doc_table]]
    """,
)
def _(spark, root):
    documents = bind(spark, root, "doc_table").withColumn(
        "checksum", F.when(F.col("num_pages") > 6, F.lit("kept"))
    )
    return tables.backfill_checksum(documents).select("document_id", "checksum")


_LIST = "array_to_string(pages, ',')"
_RANGE_PARTS = """
    parts AS (
      SELECT spec_id, total_pages, trim(part) AS part
      FROM (SELECT spec_id, total_pages, unnest(string_split(lower(trim(spec)), ',')) AS part FROM [[range_specs]])),
    bounds AS (
      SELECT spec_id, total_pages, part, regexp_full_match(part, '[0-9]+\\s*(-\\s*[0-9]+)?') AS ok,
             TRY_CAST(regexp_extract(part, '^([0-9]+)', 1) AS BIGINT) AS x,
             TRY_CAST(coalesce(nullif(regexp_extract(part, '-\\s*([0-9]+)$', 1), ''),
                               regexp_extract(part, '^([0-9]+)', 1)) AS BIGINT) AS y FROM parts)
"""


@query(
    "page_range_strict",
    f"""
    WITH {_RANGE_PARTS},
    judged AS (
      SELECT spec_id, bool_and(coalesce(ok AND least(x, y) >= 1 AND greatest(x, y) <= total_pages, false)) AS fine
      FROM bounds GROUP BY spec_id),
    named AS (
      SELECT spec_id, array_to_string(list_sort(list_distinct(list(p))), ',') AS pages FROM (
        SELECT spec_id, unnest(range(least(x, y), greatest(x, y) + 1)) AS p FROM bounds WHERE ok) GROUP BY spec_id)
    SELECT s.spec_id,
           CASE WHEN lower(trim(s.spec)) IN ('', 'all', '*') THEN array_to_string(range(1, s.total_pages + 1), ',')
                WHEN j.fine THEN n.pages END AS pages,
           NOT (lower(trim(s.spec)) IN ('', 'all', '*') OR j.fine) AS rejected
    FROM [[range_specs]] s JOIN judged j ON s.spec_id = j.spec_id LEFT JOIN named n ON s.spec_id = n.spec_id
    """,
)
def _(spark, root):
    ranged = selection.page_range_strict(bind(spark, root, "range_specs"))
    return ranged.select("spec_id", F.array_join("pages", ",").alias("pages"), "rejected")


@query(
    "page_range_lenient",
    f"""
    WITH {_RANGE_PARTS},
    named AS (
      SELECT spec_id, array_to_string(list_sort(list_distinct(list(p))), ',') AS pages FROM (
        SELECT spec_id, unnest(range(greatest(1, least(x, y)), least(total_pages, greatest(x, y)) + 1)) AS p
        FROM bounds WHERE ok) GROUP BY spec_id)
    SELECT s.spec_id,
           CASE WHEN lower(trim(s.spec)) IN ('all', '*') THEN array_to_string(range(1, s.total_pages + 1), ',')
                ELSE n.pages END AS pages,
           NOT (lower(trim(s.spec)) IN ('all', '*')) AND n.pages IS NULL AS rejected
    FROM [[range_specs]] s LEFT JOIN named n ON s.spec_id = n.spec_id
    """,
)
def _(spark, root):
    ranged = selection.page_range_lenient(bind(spark, root, "range_specs"))
    return ranged.select("spec_id", F.array_join("pages", ",").alias("pages"), "rejected")


@query(
    "requested_pages",
    """
    WITH r AS (SELECT spec_id, least(a, c) AS first, greatest(a, c) AS last, total_pages FROM [[range_specs]]
               UNION ALL SELECT spec_id, b, b, total_pages FROM [[range_specs]]),
    bad AS (SELECT spec_id FROM r WHERE first < 1 OR last > total_pages)
    SELECT DISTINCT spec_id, CAST(unnest(range(first, last + 1)) AS INTEGER) AS page_number
    FROM r WHERE spec_id NOT IN (SELECT spec_id FROM bad)
    """,
)
def _(spark, root):
    specs = bind(spark, root, "range_specs")
    both = specs.select(
        "spec_id", F.least("a", "c").alias("first"), F.greatest("a", "c").alias("last"), "total_pages"
    ).union(specs.select("spec_id", "b", "b", "total_pages"))
    return selection.requested_pages(both)


@query("review_queue", "SELECT document_id, page_number FROM [[review_pages]] WHERE review_status = 'needs_review'")
def _(spark, root):
    return selection.review_queue(bind(spark, root, "review_pages")).select("document_id", "page_number")


@query(
    "workflow_step",
    """
    WITH active AS (SELECT DISTINCT document_id FROM [[order_jobs]] WHERE status IN ('queued', 'running', 'cancelling')),
    docs AS (SELECT doc_id AS document_id FROM {documents} UNION SELECT c_custkey FROM {customer}),
    pages AS (SELECT doc_id AS document_id, quality, toxic FROM {labels})
    SELECT d.document_id,
           CASE WHEN a.document_id IS NOT NULL THEN 'processing' WHEN p.document_id IS NULL THEN 'uploaded'
                WHEN p.quality = 1 AND p.toxic = 0 THEN 'approved' ELSE 'review' END AS step
    FROM docs d LEFT JOIN active a ON d.document_id = a.document_id LEFT JOIN pages p ON d.document_id = p.document_id
    """,
)
def _(spark, root):
    documents = (
        table(spark, root, "documents").select(F.col("doc_id").alias("document_id"))
        .union(table(spark, root, "customer").select("c_custkey")).distinct()
    )
    jobs = bind(spark, root, "order_jobs").where(F.col("status").isin(*selection.ACTIVE_JOB))
    status = table(spark, root, "labels").select(
        F.col("doc_id").alias("document_id"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "approved").otherwise("needs_review").alias(
            "review_status"
        ),
    )
    return selection.workflow_step(documents, jobs, status)


@query(
    "apply_patches",
    """
    WITH patch AS (
      SELECT source AS session_id, min(doc_id) % 4 AS kind, max(lang) AS new_project FROM {documents} GROUP BY source)
    SELECT s.session_id,
           CASE WHEN p.kind = 0 THEN 'Renamed' ELSE s.session_title END AS session_title,
           CASE WHEN p.kind = 1 THEN NULL WHEN p.kind = 2 THEN p.new_project ELSE s.project_id END AS project_id,
           CASE WHEN p.kind = 3 THEN true ELSE s.is_archived END AS is_archived,
           CASE WHEN p.kind = 3 THEN false ELSE s.is_pinned END AS is_pinned
    FROM [[session_table]] s JOIN patch p ON s.session_id = p.session_id
    """,
)
def _(spark, root):
    sessions = bind(spark, root, "session_table").select(
        "session_id", "session_title", "project_id", "is_archived", "is_pinned"
    )
    kind = F.col("kind")
    patches = (
        table(spark, root, "documents").groupBy(F.col("source").alias("session_id"))
        .agg((F.min("doc_id") % 4).alias("kind"), F.max("lang").alias("lang"))
        .select(
            "session_id",
            F.when(kind == 0, "Renamed").alias("session_title"),
            F.when(kind == 2, F.col("lang")).alias("project_id"),
            kind.isin(1, 2).alias("has_project"),
            F.when(kind == 3, F.lit(True)).alias("is_archived"),
        )
    )
    return selection.apply_patches(
        sessions, patches, "session_id",
        {"session_title": None, "project_id": "has_project", "is_archived": None},
        {"is_pinned": F.when(F.col("patch_is_archived"), False).otherwise(F.col("is_pinned"))},
    )


_EXPECTED = "SELECT document_id, unnest(range(1, num_pages + 1)) AS page_number FROM [[page_docs]]"


@query(
    "missing_pages",
    f"""
    SELECT w.document_id, CAST(w.page_number AS INTEGER) AS page_number FROM ({_EXPECTED}) w
    WHERE NOT EXISTS (SELECT 1 FROM [[page_table]] p
                      WHERE p.document_id = w.document_id AND p.page_number = w.page_number)
    """,
)
def _(spark, root):
    return selection.missing_pages(bind(spark, root, "page_docs"), bind(spark, root, "page_table"))


@query(
    "pages_to_run",
    """
    WITH docs AS (SELECT d.document_id, d.num_pages, 1 + d.document_id % d.num_pages AS start_page FROM [[page_docs]] d),
    done AS (SELECT document_id, page_number FROM [[page_table]] WHERE review_status = 'approved'),
    w AS (SELECT document_id, start_page, unnest(range(1, num_pages + 1)) AS page_number FROM docs)
    SELECT w.document_id, CAST(w.page_number AS INTEGER) AS page_number,
           CAST(CASE WHEN w.page_number = w.start_page THEN 0 ELSE 1 END AS INTEGER) AS run_class
    FROM w WHERE NOT EXISTS (SELECT 1 FROM done p WHERE p.document_id = w.document_id AND p.page_number = w.page_number)
    """,
)
def _(spark, root):
    documents = bind(spark, root, "page_docs").withColumn(
        "start_page", 1 + F.col("document_id") % F.col("num_pages")
    )
    done = selection.review_queue(bind(spark, root, "page_table"), "approved")
    return selection.pages_to_run(documents, done)


@query(
    "print_pages",
    f"""
    SELECT w.document_id, CAST(w.page_number AS INTEGER) AS page_number, p.document_id IS NOT NULL AS has_ocr,
           coalesce(p.markdown, '') AS markdown
    FROM ({_EXPECTED}) w LEFT JOIN [[page_table]] p
      ON p.document_id = w.document_id AND p.page_number = w.page_number
    """,
)
def _(spark, root):
    return joins.print_pages(bind(spark, root, "page_docs"), bind(spark, root, "page_table"))


@query(
    "search_enrich",
    """
    SELECT r.document_id, r.page_number, d.name AS document_name, s.session_title, p.project_name,
           r.review_status, round(r.confidence_score, 6) AS confidence_score
    FROM [[doc_pages]] h JOIN [[doc_table]] d ON h.document_id = d.document_id
    JOIN [[session_table]] s ON d.session_id = s.session_id
    LEFT JOIN (SELECT * FROM [[project_table]] WHERE project_id <> 'de') p ON s.project_id = p.project_id
    JOIN [[review_pages]] r ON r.document_id = h.document_id AND r.page_number = h.page_number
    """,
)
def _(spark, root):
    hits = bind(spark, root, "doc_pages").select("document_id", "page_number")
    documents = bind(spark, root, "doc_table").withColumnRenamed("name", "document_name")
    projects = bind(spark, root, "project_table").where("project_id <> 'de'")
    enriched = joins.search_enrich(
        hits, documents, bind(spark, root, "session_table"), projects, bind(spark, root, "review_pages")
    )
    return enriched.select(
        "document_id", "page_number", "document_name", "session_title", "project_name", "review_status",
        F.round("confidence_score", 6).alias("confidence_score"),
    )


@query(
    "owner_scoped",
    """
    SELECT d.document_id, d.session_id FROM [[doc_table]] d
    WHERE d.session_id IN (SELECT session_id FROM [[session_table]] WHERE user_id = 1)
    """,
)
def _(spark, root):
    documents = bind(spark, root, "doc_table").select("document_id", "session_id")
    return joins.owner_scoped(documents, bind(spark, root, "session_table"), 1)


@query(
    "project_session_counts",
    """
    SELECT p.project_id, p.project_name, count(s.session_id) AS session_count
    FROM [[project_table]] p LEFT JOIN [[session_table]] s ON s.project_id = p.project_id AND NOT s.is_archived
    GROUP BY p.project_id, p.project_name
    """,
)
def _(spark, root):
    return joins.project_session_counts(
        bind(spark, root, "project_table"), bind(spark, root, "session_table")
    )


@query(
    "delete_cascade",
    """
    WITH gone AS (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'MACHINERY'),
    o AS (SELECT o_orderkey FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM gone))
    SELECT 'orders' AS table_name, o_orderkey AS id, CAST(1 AS BIGINT) AS row_count FROM o
    UNION ALL
    SELECT 'lineitem', l_orderkey, count(*) FROM {lineitem} WHERE l_orderkey NOT IN (
      SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM gone)) GROUP BY l_orderkey
    """,
)
def _(spark, root):
    gone = table(spark, root, "customer").where("c_mktsegment = 'MACHINERY'").select(
        F.col("c_custkey").alias("document_id")
    )
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, root, "lineitem").select("l_orderkey")
    (kept,) = joins.delete_cascade([(orders, "o_custkey")], gone, "document_id")
    gone_orders = orders.join(gone.withColumnRenamed("document_id", "o_custkey"), "o_custkey", "left_semi")
    (kept_lines,) = joins.delete_cascade([(lines, "l_orderkey")], gone_orders, "o_orderkey")
    return kept.select(
        F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("id"), F.lit(1).cast("bigint").alias("row_count")
    ).union(
        kept_lines.groupBy("l_orderkey").count().select(F.lit("lineitem"), "l_orderkey", "count")
    )


@query(
    "delete_set_null",
    """
    SELECT o.o_orderkey,
           CASE WHEN c.c_mktsegment = 'MACHINERY' THEN NULL ELSE CAST(o.o_custkey AS VARCHAR) END AS o_custkey
    FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey
    """,
)
def _(spark, root):
    gone = table(spark, root, "customer").where("c_mktsegment = 'MACHINERY'")
    children = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    kept = joins.delete_set_null(children, gone, "c_custkey", "o_custkey")
    return kept.select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"))


@query(
    "reject_stale",
    """
    WITH r AS (
      SELECT document_id, CAST(1 AS INTEGER) AS page_number,
             CASE n_chars % 3 WHEN 0 THEN checksum WHEN 1 THEN 'outdated' END AS expected_checksum FROM [[doc_table]]
      UNION ALL SELECT -1 - item_id, 1, NULL FROM {benchmark}),
    running AS (SELECT DISTINCT doc_id AS document_id FROM {labels} WHERE quality = 1)
    SELECT r.document_id, r.page_number, r.expected_checksum,
           CASE WHEN d.document_id IS NULL THEN 'document_missing'
                WHEN r.expected_checksum IS NOT NULL AND r.expected_checksum IS DISTINCT FROM d.checksum
                  THEN 'content_changed'
                WHEN w.document_id IS NULL THEN 'page_not_running' END AS reject_reason
    FROM r LEFT JOIN [[doc_table]] d ON r.document_id = d.document_id
    LEFT JOIN running w ON r.document_id = w.document_id
    """,
)
def _(spark, root):
    documents = bind(spark, root, "doc_table")
    third = F.col("n_chars") % 3
    results = documents.select(
        "document_id", F.lit(1).alias("page_number"),
        F.when(third == 0, F.col("checksum")).when(third == 1, "outdated").alias("expected_checksum"),
    ).union(
        table(spark, root, "benchmark").select(-1 - F.col("item_id"), F.lit(1), F.lit(None).cast("string"))
    )
    running = table(spark, root, "labels").where("quality = 1").select(
        F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number")
    )
    return joins.reject_stale(results, documents, running)


@query(
    "find_duplicate_upload",
    """
    WITH k AS (SELECT session_id, checksum, min(document_id) FILTER (is_pdf) AS stored, min(document_id) AS first_id
               FROM [[doc_table]] GROUP BY session_id, checksum)
    SELECT d.document_id, coalesce(k.stored, k.first_id) AS stored_id,
           k.stored IS NOT NULL OR k.first_id <> d.document_id AS duplicate
    FROM [[doc_table]] d JOIN k ON d.session_id = k.session_id AND d.checksum = k.checksum
    """,
)
def _(spark, root):
    documents = bind(spark, root, "doc_table").select("document_id", "session_id", "checksum", "is_pdf")
    found = joins.find_duplicate_upload(documents.drop("is_pdf"), documents.where("is_pdf"))
    return found.select("document_id", "stored_id", "duplicate")


@query(
    "fk_audit",
    """
    SELECT 'orders.o_custkey' AS foreign_key, CAST(o_custkey AS VARCHAR) AS orphan_key, count(*) AS child_rows
    FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer}) GROUP BY o_custkey
    UNION ALL SELECT 'lineitem.l_orderkey', CAST(l_orderkey AS VARCHAR), count(*)
    FROM {lineitem} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {orders}) GROUP BY l_orderkey
    UNION ALL SELECT 'lineitem.l_partkey', CAST(l_partkey AS VARCHAR), count(*)
    FROM {lineitem} WHERE l_partkey NOT IN (SELECT p_partkey FROM {part}) GROUP BY l_partkey
    UNION ALL SELECT 'documents.doc_id', CAST(doc_id AS VARCHAR), count(*)
    FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels}) GROUP BY doc_id
    """,
)
def _(spark, root):
    t = {n: table(spark, root, n) for n in ("orders", "lineitem", "customer", "part", "documents", "labels")}
    return joins.fk_audit(
        [
            ("orders.o_custkey", t["orders"], "o_custkey", t["customer"], "c_custkey"),
            ("lineitem.l_orderkey", t["lineitem"], "l_orderkey", t["orders"], "o_orderkey"),
            ("lineitem.l_partkey", t["lineitem"], "l_partkey", t["part"], "p_partkey"),
            ("documents.doc_id", t["documents"], "doc_id", t["labels"], "doc_id"),
        ]
    )


@query(
    "edits_over_cache",
    f"""
    SELECT w.document_id, CAST(w.page_number AS INTEGER) AS page_number,
           coalesce(e.text, c.markdown, '') AS markdown
    FROM ({_EXPECTED}) w LEFT JOIN {{documents}} e ON e.doc_id = w.document_id AND w.page_number = 1
    LEFT JOIN [[page_table]] c ON c.document_id = w.document_id AND c.page_number = w.page_number
    """,
)
def _(spark, root):
    keys = bind(spark, root, "page_docs").select(
        "document_id", F.explode(F.sequence(F.lit(1), F.col("num_pages"))).alias("page_number")
    )
    return joins.edits_over_cache(keys, bind(spark, root, "doc_pages"), bind(spark, root, "page_table"))


@query(
    "unique_audit",
    """
    SELECT 'checksum per session' AS rule, concat_ws('|', session_id, checksum) AS key, count(*) AS row_count
    FROM [[doc_table]] GROUP BY session_id, checksum HAVING count(*) > 1
    UNION ALL SELECT 'active job per document', CAST(document_id AS VARCHAR), count(*) FROM [[order_jobs]]
    WHERE status IN ('queued', 'running', 'cancelling') GROUP BY document_id HAVING count(*) > 1
    UNION ALL SELECT 'part name', lower(p_name), count(*) FROM {part} GROUP BY lower(p_name) HAVING count(*) > 1
    """,
)
def _(spark, root):
    active = bind(spark, root, "order_jobs").where(F.col("status").isin(*selection.ACTIVE_JOB))
    return (
        joins.unique_audit(
            "checksum per session", bind(spark, root, "doc_table"), [F.col("session_id"), F.col("checksum")]
        )
        .union(joins.unique_audit("active job per document", active, [F.col("document_id")]))
        .union(joins.unique_audit("part name", table(spark, root, "part"), [F.lower("p_name")]))
    )


@query(
    "accent_insensitive_filter",
    """
    SELECT document_id, n_chars FROM [[doc_table]]
    WHERE contains(strip_accents(lower(content)), 'que la')
    """,
)
def _(spark, root):
    documents = bind(spark, root, "doc_table")
    return selection.accent_insensitive_filter(documents, "content", " Qué LA ").select("document_id", "n_chars")


@query(
    "resolve_asset_links",
    """
    WITH p AS (
      SELECT c.document_id, c.page_number,
             concat(c.markdown, ' ![a](assets/page-', c.document_id, '.png) ![b](assets/other.png) end') AS before,
             a.document_id IS NOT NULL AS known
      FROM [[page_table]] c LEFT JOIN (SELECT DISTINCT document_id FROM [[assets]]) a ON a.document_id = c.document_id)
    SELECT document_id, page_number,
           CASE WHEN known THEN replace(before, concat('(assets/page-', document_id, '.png)'),
                  concat('(/api/sessions/', 'sess%2A', document_id % 5, '/files/', document_id, '/assets/page-',
                         document_id, '.png)')) ELSE before END AS markdown
    FROM p
    """,
)
def _(spark, root):
    document = F.col("document_id").cast("string")
    pages = bind(spark, root, "page_table").select(
        "document_id", "page_number",
        F.concat(F.lit("sess*"), (F.col("document_id") % 5).cast("string")).alias("session_id"),
        F.concat(
            "markdown", F.lit(" ![a](assets/page-"), document, F.lit(".png) ![b](assets/other.png) end")
        ).alias("markdown"),
    )
    assets = bind(spark, root, "assets").select(
        "document_id", F.concat(F.lit("page-"), document, F.lit(".png")).alias("filename")
    )
    return resolve_asset_links(pages, assets).drop("session_id")
