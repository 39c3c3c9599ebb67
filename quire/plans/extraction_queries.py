"""Queries over provider results, extractions, logs and image measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import extraction, joins, userfuncs
from quire.plans.registry import bind, query
from quire.session import spread_rows, table
from quire.sources import lines
from quire.templates import template_catalogue


def _result_lines(spark, root):
    """Provider result lines, one per stored page; unstored pages have none."""
    outcomes = bind(spark, root, "provider_outcomes", heavy=True)
    page = F.struct(
        "markdown",
        F.array(
            F.struct(F.lit("a.png").alias("id"), F.base64(F.to_binary("custom_id", F.lit("utf-8"))).alias("image_base64")),
            F.struct(F.lit("b.png").alias("id"), F.lit("").alias("image_base64")),
        ).alias("images"),
        F.struct(F.col("score").alias("average_page_confidence_score")).alias("confidence_scores"),
    )
    body = F.when(F.col("status_code") == 200, F.struct(F.array(page).alias("pages")))
    line = F.to_json(
        F.struct(
            "custom_id", "error",
            F.struct(F.col("status_code"), body.alias("body")).alias("response"),
        )
    )
    return outcomes.select(line.alias("value"))


def _mapped(spark, root):
    return lines.map_provider_page(lines.parse_result_lines(_result_lines(spark, root)))


_ERROR = "CASE WHEN status_code = 400 THEN 'HTTP 400' WHEN status_code <> 200 THEN error END"


@query("batch_result_lines", f"SELECT custom_id, CAST(status_code AS INTEGER) AS status_code, {_ERROR} AS error FROM [[provider_outcomes]]")
def _(spark, root):
    return lines.parse_result_lines(_result_lines(spark, root)).drop("body")


@query(
    "map_provider_page",
    """
    SELECT custom_id, CASE WHEN status_code = 200 THEN markdown END AS markdown,
           CAST(CASE WHEN status_code = 200 THEN 1 ELSE -1 END AS INTEGER) AS n_images,
           CASE WHEN status_code = 200 THEN CASE score WHEN '1.7' THEN 1e0 WHEN 'abc' THEN NULL ELSE 93e-2 END END AS confidence
    FROM [[provider_outcomes]]
    """,
)
def _(spark, root):
    return _mapped(spark, root).select(
        "custom_id", "markdown", F.coalesce(F.size("images"), F.lit(-1)).alias("n_images"), "confidence"
    )


@query(
    "batch_correlate",
    f"""
    WITH w AS (SELECT document_id, unnest(range(1, num_pages + 1)) AS page_number FROM [[page_docs]])
    SELECT w.document_id, CAST(w.page_number AS INTEGER) AS page_number,
           CASE WHEN p.status_code = 200 THEN p.markdown END AS markdown,
           CASE WHEN p.custom_id IS NULL THEN 'no result for this page' ELSE {_ERROR} END AS error
    FROM w LEFT JOIN [[provider_outcomes]] p ON p.document_id = w.document_id AND p.page_number = w.page_number
    """,
)
def _(spark, root):
    requested = bind(spark, root, "page_docs").select(
        "document_id", F.explode(F.sequence(F.lit(1), F.col("num_pages"))).alias("page_number")
    ).withColumn("custom_id", F.concat_ws(":", "document_id", "page_number"))
    last = _mapped(spark, root).withColumn("line", F.lit(1))
    earlier = last.where("error IS NULL").withColumns({"markdown": F.concat(F.lit("~"), "markdown"), "line": F.lit(0)})
    return joins.batch_correlate(requested, last.unionByName(earlier), order="line").drop("custom_id")


_GATE = f"""
    SELECT document_id, count(*) FILTER ({_ERROR} IS NOT NULL) = 0 AS eligible,
           CAST(count(*) FILTER ({_ERROR} IS NULL) AS BIGINT) AS good_pages,
           CAST(count(*) FILTER ({_ERROR} IS NOT NULL) AS BIGINT) AS failed_pages,
           CAST(min(page_number) FILTER ({_ERROR} IS NOT NULL) AS VARCHAR) AS first_failed,
           CAST(max(page_number) FILTER ({_ERROR} IS NOT NULL) AS VARCHAR) AS last_failed
    FROM [[provider_outcomes]] GROUP BY document_id
"""


def _page_results(spark, root):
    ids = F.split("custom_id", ":")
    return lines.parse_result_lines(_result_lines(spark, root)).select(
        F.get(ids, F.lit(0)).cast("bigint").alias("document_id"),
        F.get(ids, F.lit(1)).cast("int").alias("page_number"), "error",
    )


@query("partial_extraction_gate", _GATE)
def _(spark, root):
    gate = extraction.partial_extraction_gate(_page_results(spark, root))
    return gate.withColumns({c: F.col(c).cast("string") for c in ("first_failed", "last_failed")})


@query(
    "failed_page_list",
    f"SELECT document_id, page_number, {_ERROR} AS error FROM [[provider_outcomes]] WHERE {_ERROR} IS NOT NULL",
)
def _(spark, root):
    return extraction.failed_page_list(_page_results(spark, root))


@query("extraction_eligible", "SELECT document_id, num_pages FROM [[doc_table]] WHERE num_pages <= 8")
def _(spark, root):
    return extraction.extraction_eligible(bind(spark, root, "doc_table")).select("document_id", "num_pages")


@query(
    "extraction_route",
    """
    SELECT d.document_id, CASE WHEN NOT d.is_pdf AND l.doc_id IS NULL THEN 'combined' ELSE 'page_first' END AS route
    FROM [[doc_table]] d LEFT JOIN {labels} l ON d.document_id = l.doc_id
    """,
)
def _(spark, root):
    counts = table(spark, root, "labels").groupBy(F.col("doc_id").alias("document_id")).agg(
        F.count(F.lit(1)).alias("ocr_pages")
    )
    return extraction.extraction_route(bind(spark, root, "doc_table"), counts).select("document_id", "route")


def _invoice_json(spark, root):
    """Invoice annotations with noise: arrays, boolean and huge totals, blank names, undeclared keys."""
    noise, total = F.col("noise"), F.col("total")
    items = F.when(
        F.col("n_items") > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.col("n_items"), F.lit(1))),
            lambda i: F.struct(
                F.concat(F.lit(" item "), i.cast("string"), F.lit(" ")).alias("description"),
                i.alias("quantity"), (total / i).alias("unit_price"), (i * 0.5).alias("amount"),
            ),
        ),
    )
    fixed = F.to_json(
        F.struct(
            "customer_name", "invoice_number", "invoice_date", items.alias("line_items"),
            F.array(F.lit(" Check "), F.lit("check"), F.lit(""), F.col("note")).alias("review_notes"),
            F.when(noise == 4, "extra").alias("undeclared"),
        )
    )
    amount = F.when(noise == 1, "true").when(noise == 2, "1e12").otherwise(total.cast("string"))
    whole = F.concat(
        F.substr(fixed, F.lit(1), F.length(fixed) - 1), F.lit(',"total_amount":'), amount, F.lit("}")
    )
    annotation = F.when(noise == 0, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    invoices = spread_rows(bind(spark, root, "invoices"), table(spark, root, "orders").count(), "document_id")
    return invoices.select("document_id", annotation.alias("annotation"))


def _normalized(spark, root):
    return extraction.normalize_extraction(
        extraction.parse_annotation(_invoice_json(spark, root)), "invoice"
    ).select("document_id", "data", "error")


_EXTRACTION_ERROR = """CASE noise WHEN 0 THEN 'invalid structured extraction' WHEN 1 THEN 'Amounts must be numbers'
    WHEN 2 THEN 'Amount is outside the supported range' END"""


@query(
    "parse_annotation",
    "SELECT document_id, noise <> 0 AS is_object, CASE WHEN noise = 0 THEN 'invalid structured extraction' END AS error FROM [[invoices]]",
)
def _(spark, root):
    return extraction.parse_annotation(_invoice_json(spark, root)).select(
        "document_id", F.col("parsed").isNotNull().alias("is_object"), "error"
    )


@query(
    "normalize_extraction",
    f"""
    SELECT document_id, {_EXTRACTION_ERROR} AS error,
           CASE WHEN noise > 2 THEN 'invoice' END AS document_type,
           CASE WHEN noise > 2 THEN invoice_number END AS invoice_number,
           CASE WHEN noise > 2 THEN nullif(trim(customer_name), '') END AS customer_name,
           CASE WHEN noise > 2 THEN invoice_date END AS invoice_date,
           CASE WHEN noise > 2 THEN round(total, 6) END AS total_amount,
           CASE WHEN noise > 2 THEN n_items ELSE -1 END AS n_items,
           CASE WHEN noise > 2 THEN concat('Check', ' | ', note) ELSE '' END AS notes
    FROM [[invoices]]
    """,
)
def _(spark, root):
    return _normalized(spark, root).select(
        "document_id", "error", "data.document_type", "data.invoice_number", "data.customer_name",
        "data.invoice_date", "data.total_amount",
        F.coalesce(F.size("data.line_items"), F.lit(-1)).alias("n_items"),
        F.coalesce(F.array_join("data.review_notes", " | "), F.lit("")).alias("notes"),
    )


_ITEMS = """
    items AS (SELECT *, CAST(unnest(CASE WHEN n_items > 0 THEN range(1, n_items + 1) ELSE [NULL] END) AS INTEGER) AS i
              FROM [[invoices]] WHERE noise > 2)
"""


@query(
    "extraction_items",
    f"""
    WITH {_ITEMS}
    SELECT document_id, CAST(i AS VARCHAR) AS item_number, CASE WHEN i > 0 THEN concat('item ', i) END AS description,
           CAST(i AS DOUBLE) AS quantity, round(total / i, 6) AS unit_price, CAST(NULL AS DOUBLE) AS tax_amount,
           i * 5e-1 AS amount FROM items
    """,
)
def _(spark, root):
    good = _normalized(spark, root).where("data is not null").select("document_id", "data")
    items = extraction.extraction_items(good, "line_items")
    return items.withColumn("item_number", F.col("item_number").cast("string"))


_FIELD_ROWS = """
    fields AS (SELECT document_id, noise, unnest(range(1, 14)) AS seq,
                 unnest(['Supplier', 'Registration number', 'Supplier address', 'Customer', 'Invoice number',
                         'Invoice date', 'Due date', 'Currency', 'Payment terms', 'Subtotal', 'Discount', 'Tax', 'Total']) AS label,
                 unnest([NULL, NULL, NULL, nullif(trim(customer_name), ''), invoice_number, invoice_date, NULL, NULL, NULL,
                         NULL, NULL, NULL, CAST(total AS VARCHAR)]) AS value
               FROM [[invoices]] WHERE noise > 2)
"""


@query(
    "extraction_fields_long",
    f"""
    WITH {_FIELD_ROWS}
    SELECT document_id, CAST(seq AS INTEGER) AS seq, CASE WHEN seq <= 9 THEN 'Invoice details' ELSE 'Totals' END AS section,
           label, value FROM fields
    """,
)
def _(spark, root):
    good = _normalized(spark, root).where("data is not null").select("document_id", "data")
    return extraction.extraction_fields_long(good, "invoice")


@query(
    "extraction_csv_rows",
    f"""
    WITH {_FIELD_ROWS}, {_ITEMS},
    r AS (
      SELECT document_id, 1 AS seq, 'field,value' AS line FROM [[invoices]] WHERE noise > 2
      UNION ALL SELECT document_id, seq + 1, concat(label, ',', coalesce(value, '')) FROM fields
      UNION ALL SELECT document_id, 15, concat('Review notes,Check | ', note) FROM [[invoices]] WHERE noise > 2
      UNION ALL SELECT document_id, 16, '' FROM [[invoices]] WHERE noise > 2
      UNION ALL SELECT document_id, 17, 'Line items' FROM [[invoices]] WHERE noise > 2
      UNION ALL SELECT document_id, 18, 'Description,Qty,Unit price,Tax,Amount' FROM [[invoices]] WHERE noise > 2
      UNION ALL SELECT document_id, 18 + i, concat('item ', i, ',', i, '.0,', CAST(round(total / i, 6) AS VARCHAR), ',,',
                       CAST(i * 5e-1 AS VARCHAR)) FROM items WHERE i > 0)
    SELECT document_id, CAST(seq AS INTEGER) AS seq, line FROM r
    """,
)
def _(spark, root):
    return extraction.extraction_csv_rows(_normalized(spark, root).select("document_id", "data"), "invoice")


@query(
    "extraction_csv_files",
    f"""
    WITH {_FIELD_ROWS}, {_ITEMS},
    f AS (SELECT document_id, string_agg(concat(label, ',', coalesce(value, ''), chr(13), chr(10)), '' ORDER BY seq) AS t
          FROM fields GROUP BY document_id),
    i AS (SELECT document_id, string_agg(concat('item ', i, ',', i, '.0,', CAST(round(total / i, 6) AS VARCHAR), ',,',
                 CAST(i * 5e-1 AS VARCHAR), chr(13), chr(10)), '' ORDER BY i) FILTER (i > 0) AS t
          FROM items GROUP BY document_id)
    SELECT v.document_id, concat('order_', v.document_id, '-invoice-data.csv') AS filename,
           concat(chr(65279), 'field,value', chr(13), chr(10), f.t, 'Review notes,Check | ', v.note, chr(13), chr(10),
                  chr(13), chr(10), 'Line items', chr(13), chr(10), 'Description,Qty,Unit price,Tax,Amount',
                  chr(13), chr(10), coalesce(i.t, '')) AS text
    FROM [[invoices]] v JOIN f ON f.document_id = v.document_id JOIN i ON i.document_id = v.document_id
    """,
)
def _(spark, root):
    named = _normalized(spark, root).withColumn(
        "document_name", F.concat(F.lit("order "), F.col("document_id").cast("string"), F.lit(".pdf"))
    )
    return extraction.extraction_csv_files(named, "invoice")


_USED = """
    WITH u AS (SELECT CASE quality + 2 * toxic WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'quotation'
                           ELSE 'resume' END AS template, count(*) AS documents FROM {labels} GROUP BY template)
"""


@query(
    "template_schema",
    _USED
    + """
    SELECT template, documents,
           CASE template WHEN 'invoice' THEN 13 WHEN 'receipt' THEN 11 WHEN 'quotation' THEN 18 ELSE 9 END AS scalar_fields,
           CASE template WHEN 'invoice' THEN 5 WHEN 'receipt' THEN 4 WHEN 'quotation' THEN 8 ELSE 22 END AS table_columns,
           CASE template WHEN 'resume' THEN 2 ELSE 1 END AS lists,
           CASE template WHEN 'resume' THEN 2 ELSE 1 END AS schema_version
    FROM u
    """,
)
def _(spark, root):
    """Catalogue sizes of the templates in use, beside the documents routed to each."""
    code = F.col("quality") + 2 * F.col("toxic")
    used = table(spark, root, "labels").groupBy(
        F.when(code == 0, "invoice").when(code == 1, "receipt").when(code == 2, "quotation").otherwise("resume").alias("template")
    ).agg(F.count(F.lit(1)).alias("documents"))
    kind = F.col("group_kind")
    sizes = template_catalogue(spark).groupBy("template").agg(
        F.count_if(kind == "section").cast("int").alias("scalar_fields"),
        F.count_if(kind == "table").cast("int").alias("table_columns"),
        F.count_if(kind == "list").cast("int").alias("lists"),
        F.max("schema_version").alias("schema_version"),
    )
    return used.join(F.broadcast(sizes), "template")


def _answer(content: str) -> str:
    """Deterministic stand-in for an annotation model."""
    import json

    if content.count("e") % 9 == 0:
        raise RuntimeError("no answer")
    return json.dumps({"merchant_name": f"  {content.count(' ')} blanks ", "total_amount": len(content) / 8, "ignored": 1})


@query(
    "annotate_documents",
    """
    SELECT document_id, CASE WHEN silent THEN 'no answer' END AS error,
           CASE WHEN NOT silent THEN concat(length(content) - length(replace(content, ' ', '')), ' blanks') END AS merchant_name,
           CASE WHEN NOT silent THEN length(content) / 8e0 END AS total_amount
    FROM (SELECT *, (length(content) - length(replace(content, 'e', ''))) % 9 = 0 AS silent FROM [[doc_table]])
    """,
)
def _(spark, root):
    documents = bind(spark, root, "doc_table", heavy=True).select("document_id", "content")
    return userfuncs.annotate_documents(documents, _answer, "receipt").select(
        "document_id", "error", "data.merchant_name", "data.total_amount"
    )


@query(
    "api_log_scan",
    """
    SELECT event_id, date_trunc('second', ts) AS ts, concat('ocr.', event_type, ':ok') AS event,
           CASE WHEN event_id % 3 > 0 THEN concat('user ', user_id) END AS detail,
           CASE WHEN event_id % 4 > 0 THEN CAST(user_id AS VARCHAR) END AS pages
    FROM {events}
    """,
)
def _(spark, root):
    """The events written as log lines and read back by the parser."""
    event = F.col("event_id")
    line = F.concat(
        F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] ocr."), "event_type", F.lit(":ok"),
        F.when(event % 3 > 0, F.concat(F.lit(" | user "), F.col("user_id").cast("string"))).otherwise(""),
        F.when(event % 4 > 0, F.concat(F.lit(" | pages="), F.col("user_id").cast("string"), F.lit(" type=pdf"))).otherwise(""),
    )
    logged = table(spark, root, "events").select("event_id", line.alias("value"))
    parsed = lines.parse_api_log(logged, keep=("event_id",))
    return parsed.select("event_id", "ts", "event", "detail", F.col("extra")["pages"].alias("pages"))


_SCANS = """
    SELECT p_partkey AS name, CAST(p_size * 40 + 100 AS INTEGER) AS width, CAST(p_partkey % 37 * 100 + 50 AS INTEGER) AS height,
           p_retailprice / 10e0 AS contrast, p_retailprice AS sharpness, p_size / 3e0 AS noise
    FROM {part}
"""


@query(
    "scan_quality",
    f"""
    SELECT name, round(35e-2 * least(1, contrast / 150) + 45e-2 * least(1, sharpness / 900)
                       + 20e-2 * least(1, least(width, height) / 1200e0), 6) AS quality FROM ({_SCANS})
    """,
)
def _(spark, root):
    scored = userfuncs.scan_quality(spark.sql(_SCANS, part=table(spark, root, "part")))
    return scored.select("name", F.round("quality", 6).alias("quality"))


@query(
    "scan_repair_plan",
    f"""
    WITH s AS (SELECT *, least(width, height) AS short, greatest(width, height) AS long FROM ({_SCANS})),
    f AS (SELECT *, least(3e0, 1200e0 / short, 3600e0 / long) AS factor FROM s)
    SELECT name, CASE WHEN short < 1200 AND factor >= 118e-2 THEN round(factor, 6) END AS upscale_factor,
           noise >= 11 AS denoise, contrast < 92 AS enhance_contrast, sharpness < 520 AS sharpen FROM f
    """,
)
def _(spark, root):
    plan = userfuncs.scan_repair_plan(spark.sql(_SCANS, part=table(spark, root, "part")))
    return plan.select("name", "upscale_factor", "denoise", "enhance_contrast", "sharpen")


@query("image_metrics")
def _(spark, root):
    """Pixel measurements of one small gray image per embedding vector."""
    vectors = table(spark, root, "embeddings")
    width = 16
    pixels = F.transform("embedding", lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 0.5) * 255))).cast("bigint")), 2, "0"))
    image = F.struct(
        (F.size("embedding") / width).cast("int").alias("height"), F.lit(width).alias("width"),
        F.lit(1).alias("nChannels"), F.unhex(F.array_join(pixels, "")).alias("data"),
    )
    measured = userfuncs.image_metrics(vectors.select("vec_id", image.alias("image")), key="vec_id")
    return userfuncs.scan_quality(measured)
