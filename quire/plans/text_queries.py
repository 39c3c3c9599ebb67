"""Queries over page text: search, line breaks, markup, embedded assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text
from quire.functions.skew import attach
from quire.operators import search, segments
from quire.operators.aggregates import corpus_stats
from quire.operators.exports import preprocess_report_rows
from quire.operators.joins import owner_scoped, search_enrich
from quire.operators.userfuncs import register_page_range
from quire.operators.windows import asset_ordinals, search_top_k
from quire.plans.registry import bind, query
from quire.session import table, work_dir

FIXED_QUERY = "the tion"
_TOKENS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"


def _tok(column: str) -> str:
    return _TOKENS.format(column)


@query(
    "tokenize_pages",
    f"""
    SELECT document_id, page_number, CAST(unnest(range(0, len(t))) AS INTEGER) AS position, unnest(t) AS token
    FROM (SELECT document_id, page_number, {_tok('markdown')} AS t FROM [[doc_pages]])
    """,
)
def _(spark, root):
    return search.tokenize_pages(bind(spark, root, "doc_pages", heavy=True))


_STATS = f"""
    t AS (SELECT document_id, page_number, {_tok('markdown')} AS t FROM [[doc_pages]]),
    p AS (SELECT document_id, page_number, len(t) AS dl, unnest(t) AS token FROM t),
    s AS (SELECT count(*) AS n_pages, avg(len(t)) AS avg_length FROM t)
"""


@query(
    "corpus_stats",
    f"""
    WITH {_STATS}
    SELECT token, count(DISTINCT (document_id, page_number)) AS page_frequency,
           (SELECT n_pages FROM s) AS n_pages, (SELECT round(avg_length, 6) FROM s) AS avg_length
    FROM p GROUP BY token
    """,
)
def _(spark, root):
    return corpus_stats(bind(spark, root, "doc_pages", heavy=True))


@query(
    "inverted_index",
    f"""
    WITH {_STATS}
    SELECT token, document_id, page_number, CAST(count(*) AS INTEGER) AS tf, CAST(max(dl) AS INTEGER) AS dl
    FROM p GROUP BY token, document_id, page_number
    """,
)
def _(spark, root):
    return search.inverted_index(bind(spark, root, "doc_pages", heavy=True))


@query(
    "build_search_query",
    """
    SELECT query_id, CASE WHEN len(t) > 0
             THEN array_to_string(list_transform(t, lambda x: concat('"', x, '"*')), ' AND ') END AS match_expression
    FROM (SELECT query_id, query, regexp_extract_all(query, '[\\p{L}\\p{N}]+') AS t FROM (
      SELECT query_id, query FROM [[user_queries]]
      UNION ALL SELECT -1 - o_orderkey, concat_ws('-', o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_custkey + 1,
        o_custkey + 2, o_custkey + 3, o_custkey + 4, o_custkey + 5, o_custkey + 6, o_custkey + 7, o_custkey + 8) FROM {orders}
      UNION ALL SELECT 1000000000 + doc_id, concat(source, '_', lang, ' ?') FROM {documents}))
    """,
)
def _(spark, root):
    given = bind(spark, root, "user_queries")
    customer = F.col("o_custkey")
    parts = ["o_orderkey", customer, "o_orderpriority", "o_orderstatus", *[customer + i for i in range(1, 9)]]
    long_queries = table(spark, root, "orders").select(-1 - F.col("o_orderkey"), F.concat_ws("-", *parts))
    queries = given.union(long_queries).union(
        table(spark, root, "documents").select(
            1000000000 + F.col("doc_id"), F.concat("source", F.lit("_"), "lang", F.lit(" ?"))
        )
    )
    return search.build_search_query(queries).select("query_id", "match_expression")


def _score(term_where: str) -> str:
    return f"""
    WITH {_STATS},
    q AS ({term_where}),
    w AS (SELECT query_id, term, count(*) AS weight FROM q GROUP BY query_id, term),
    v AS (SELECT DISTINCT token FROM p),
    m AS (SELECT DISTINCT v.token, d.term FROM v JOIN (SELECT DISTINCT term FROM w) d ON starts_with(v.token, d.term)),
    tp AS (SELECT m.term, p.document_id, p.page_number, count(*) AS tf, max(dl) AS dl
           FROM p JOIN m ON p.token = m.token GROUP BY m.term, p.document_id, p.page_number),
    f AS (SELECT term, count(*) AS n FROM tp GROUP BY term),
    scored AS (
      SELECT w.query_id, tp.document_id, tp.page_number, count(*) AS n_found,
             sum(w.weight * greatest(1e-6, ln(((SELECT n_pages FROM s) - f.n + 5e-1) / (f.n + 5e-1)))
                 * tp.tf * 22e-1 / (tp.tf + 12e-1 * (25e-2 + 75e-2 * tp.dl / (SELECT avg_length FROM s)))) AS score
      FROM tp JOIN w ON tp.term = w.term JOIN f ON f.term = tp.term GROUP BY w.query_id, tp.document_id, tp.page_number),
    hits AS (SELECT s.query_id, s.document_id, CAST(s.page_number AS INTEGER) AS page_number, round(s.score, 6) AS score
             FROM scored s WHERE s.n_found = (SELECT count(*) FROM w WHERE w.query_id = s.query_id))
    """


_FIXED = "SELECT 0 AS query_id, unnest(['the', 'tion']) AS term"


def _segments(spark, root):
    """The segmented index of all document texts, stored once a session."""
    known = getattr(_segments, "known", {})
    key = (spark.sparkContext.applicationId, root)
    if key not in known:
        path = work_dir(spark, "segments")
        segments.build_index(bind(spark, root, "doc_pages", heavy=True), path)
        _segments.known = {**known, key: path}
    return segments.Index(spark, _segments.known[key])


def _stored_index(spark, root):
    path = work_dir(spark, "index")
    search.write_index(bind(spark, root, "doc_pages", heavy=True), path, files=spark.sparkContext.defaultParallelism)
    return search.read_index(spark, path)


@query("search_pages", _score(_FIXED) + "SELECT document_id, page_number, score FROM hits")
def _(spark, root):
    hits = search.search_pages(*_stored_index(spark, root), FIXED_QUERY)
    return hits.withColumn("score", F.round("score", 6))


@query(
    "search_top_k",
    _score(_FIXED)
    + """
    SELECT h.document_id, h.page_number, h.score, d.session_updated_at AS updated_at FROM hits h
    JOIN (SELECT t.document_id, s.session_updated_at FROM [[doc_table]] t JOIN [[session_table]] s ON t.session_id = s.session_id) d
      ON h.document_id = d.document_id
    ORDER BY h.score DESC, d.session_updated_at DESC, h.document_id, h.page_number LIMIT 30
    """,
)
def _(spark, root):
    """Ranked over the stored index; of the best scores all ties stay until the dates order them."""
    hits = segments.search_stored(_segments(spark, root), FIXED_QUERY, 30)
    documents = bind(spark, root, "doc_table").select("document_id", "session_id")
    sessions = bind(spark, root, "session_table").select(
        "session_id", F.col("session_updated_at").alias("updated_at")
    )
    dated = hits.join(documents, "document_id").join(sessions, "session_id")
    return search_top_k(dated.drop("session_id"), 30)


@query(
    "search_owned",
    _score(_FIXED)
    + """
    SELECT h.document_id, h.page_number, h.score, d.name AS document_name, s.session_title, p.project_name, r.review_status
    FROM hits h JOIN [[doc_table]] d ON h.document_id = d.document_id
    JOIN [[session_table]] s ON d.session_id = s.session_id AND s.user_id = 1
    LEFT JOIN [[project_table]] p ON s.project_id = p.project_id
    JOIN [[review_pages]] r ON r.document_id = h.document_id AND r.page_number = h.page_number
    ORDER BY h.score DESC, s.session_updated_at DESC, h.document_id, h.page_number LIMIT 30
    """,
)
def _(spark, root):
    """The whole search: ranked by the statistics of all pages, among those of the owner's sessions, and only
    the top enriched."""
    sessions = bind(spark, root, "session_table")
    documents = bind(spark, root, "doc_table").withColumnRenamed("name", "document_name")
    dates = sessions.select("session_id", F.col("session_updated_at").alias("updated_at"))
    placed = attach(documents.select("document_id", "session_id"), dates, ["session_id"], "inner")
    visible = owner_scoped(placed, sessions, 1)
    hits = segments.search_stored(_segments(spark, root), FIXED_QUERY, 30, within=visible)
    owned = attach(hits, visible, ["document_id"], "inner")
    top = search_top_k(owned, 30).select("document_id", "page_number", "score")
    enriched = search_enrich(
        top, documents, sessions, bind(spark, root, "project_table"), bind(spark, root, "review_pages")
    )
    return enriched.select(
        "document_id", "page_number", "score", "document_name", "session_title", "project_name", "review_status"
    )


@query(
    "search_many",
    _score(
        f"SELECT query_id, unnest({_tok('query')}) AS term FROM [[user_queries]]"
    )
    + """
    SELECT query_id, document_id, page_number, score, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, page_number) AS INTEGER) AS rank
      FROM hits) WHERE rank <= 10
    """,
)
def _(spark, root):
    queries = bind(spark, root, "user_queries")
    return segments.search_index(_segments(spark, root), queries, 10).select("query_id", "document_id", "page_number", "score", "rank")


_WORDS = "regexp_split_to_array(trim({}, ' ' || chr(9) || chr(10) || chr(13)), '\\s+')"


@query(
    "search_excerpt",
    f"""
    WITH w AS (SELECT document_id, page_number, {_WORDS.format('markdown')} AS w,
                      {_WORDS.format('strip_accents(lower(markdown))')} AS f FROM [[doc_pages]]),
    h AS (SELECT *, list_transform(f, lambda x: regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}])the')) AS h1,
                 list_transform(f, lambda x: regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}])tion')) AS h2 FROM w),
    c AS (SELECT *, list_min(list_transform(list_filter(range(1, len(f) + 1), lambda i: h1[i] OR h2[i]), lambda i:
             {{'n': -(CAST(list_contains(h1[greatest(1, i - 5):greatest(1, i - 5) + 23], true) AS INT)
                   + CAST(list_contains(h2[greatest(1, i - 5):greatest(1, i - 5) + 23], true) AS INT)), 'i': i}})) AS k FROM h),
    b AS (SELECT *, greatest(1, k.i - 5) AS b FROM c)
    SELECT document_id, page_number, CASE WHEN k.i > 0 THEN
             concat(CASE WHEN b > 1 THEN '… ' ELSE '' END, array_to_string(w[b:b + 23], ' '),
                    CASE WHEN b + 23 < len(w) THEN ' …' ELSE '' END) END AS excerpt
    FROM b
    """.replace("{{", "{").replace("}}", "}"),
)
def _(spark, root):
    return search.search_excerpt(bind(spark, root, "doc_pages", heavy=True), FIXED_QUERY).drop("markdown")


@query(
    "highlight_terms",
    """
    SELECT document_id, page_number,
           regexp_replace(markdown, '(tion|the|a\\+)', '<mark>\\1</mark>', 'gi') AS markdown,
           CAST(list_min(list_filter([strpos(lower(markdown), 'the'), strpos(lower(markdown), 'tion'),
                                      strpos(lower(markdown), 'a+')], lambda x: x > 0)) - 1 AS VARCHAR) AS first_match
    FROM [[doc_pages]]
    """,
)
def _(spark, root):
    terms = ["The", "tion", "a+", "the"]
    return bind(spark, root, "doc_pages", heavy=True).select(
        "document_id", "page_number",
        text.mark_terms(F.col("markdown"), terms).alias("markdown"),
        text.first_match(F.col("markdown"), terms).cast("string").alias("first_match"),
    )


_LINES = "string_split(markdown, chr(10))"


@query(
    "soft_breaks",
    f"""
    SELECT document_id, page_number, array_to_string(list_transform(range(1, len(l) + 1), lambda i:
             l[i] || CASE WHEN i < len(l) AND (l[i] <> '' OR i = 1) AND (l[i + 1] <> '' OR i + 1 = len(l))
                               AND NOT ends_with(l[i], '  ') THEN '  ' ELSE '' END), chr(10)) AS markdown
    FROM (SELECT document_id, page_number, {_LINES} AS l FROM [[doc_pages]])
    """,
)
def _(spark, root):
    return bind(spark, root, "doc_pages", heavy=True).withColumn("markdown", text.soft_breaks(F.col("markdown")))


_STRUCTURED = (
    "(trim({0}) = '' OR contains({0}, '|') OR regexp_matches({0}, '^(\\s{{4,}}|\\s*#{{1,6}}\\s|\\s*[-*_]{{3,}}\\s*$|\\s*[-*+]\\s|\\s*[0-9]+\\.\\s|\\s*>)'))"
)


@query(
    "hard_breaks",
    f"""
    SELECT document_id, page_number, array_to_string(list_transform(range(1, len(l) + 1), lambda i:
             l[i] || CASE WHEN i = len(l) OR {_STRUCTURED.format('l[i]')} OR ends_with(l[i], '  ')
                               OR ends_with(trim(l[i]), chr(92)) OR {_STRUCTURED.format('l[i + 1]')}
                          THEN '' ELSE '  ' END), chr(10)) AS markdown
    FROM (SELECT document_id, page_number, {_LINES} AS l FROM [[doc_pages]])
    """,
)
def _(spark, root):
    """The corpus holds no fences or display math; those paths are tested against brute force."""
    return bind(spark, root, "doc_pages", heavy=True).withColumn("markdown", text.hard_breaks(F.col("markdown")))


@query("escape_html", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM {pages}")
def _(spark, root):
    return table(spark, root, "pages").select("page_id", text.escape_html(F.col("html")).alias("html"))


_BLANK_ENDS = "[ \\t\\n\\x0B\\f\\r]"


@query(
    "math_spans",
    f"""
    WITH RECURSIVE scan AS (
      SELECT page_id, 0 AS n, html AS rest, '' AS before, CAST(NULL AS VARCHAR) AS span FROM {{pages}} WHERE html IS NOT NULL
      UNION ALL
      SELECT page_id, n + 1, substr(tail, length(coalesce(found, '$')) + 1), right(coalesce(found, left(tail, 1)), 1), found
      FROM (
        SELECT *, CASE
          WHEN starts_with(tail, '$$') THEN CASE WHEN strpos(substr(tail, 3), '$$') > 0 THEN left(tail, strpos(substr(tail, 3), '$$') + 3) END
          WHEN starts_with(tail, '\\[') THEN CASE WHEN strpos(substr(tail, 3), '\\]') > 0 THEN left(tail, strpos(substr(tail, 3), '\\]') + 3) END
          WHEN starts_with(tail, '\\(') THEN CASE WHEN strpos(substr(tail, 3), '\\)') > 0 THEN left(tail, strpos(substr(tail, 3), '\\)') + 3) END
          WHEN previous <> '$' AND strpos(substr(tail, 2), '$') > 1 AND NOT contains(left(tail, strpos(substr(tail, 2), '$')), chr(10))
               AND NOT regexp_matches(substr(tail, 2, 1), '{_BLANK_ENDS}') AND NOT regexp_matches(substr(tail, strpos(substr(tail, 2), '$'), 1), '{_BLANK_ENDS}')
               AND NOT regexp_matches(substr(tail, strpos(substr(tail, 2), '$') + 2, 1), '[$0-9]')
          THEN left(tail, strpos(substr(tail, 2), '$') + 1) END AS found
        FROM (SELECT *, substr(rest, p) AS tail, CASE WHEN p > 1 THEN substr(rest, p - 1, 1) ELSE before END AS previous
              FROM (SELECT *, list_min(list_filter([strpos(rest, '$'), strpos(rest, '\\['), strpos(rest, '\\(')], lambda x: x > 0)) AS p FROM scan)
              WHERE p IS NOT NULL)))
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS position,
           CASE WHEN starts_with(span, '$') AND NOT starts_with(span, '$$') THEN concat('\\(', substr(span, 2, length(span) - 2), '\\)') ELSE span END AS span
    FROM scan WHERE span IS NOT NULL
    """,
)
def _(spark, root):
    """Web pages carry dollar junk."""
    pages = table(spark, root, "pages")
    return pages.select("page_id", F.posexplode(text.math_spans(F.col("html"))).alias("position", "span"))


_IMAGES = """
    SELECT document_id, page_number, markdown,
           concat(markdown, ' ![fig.jpeg](fig.jpeg) ![x.png](x.png) ![gone.gif](gone.gif)') AS source,
           length(markdown) % 4 = 0 AS broken, base64(encode(markdown)) AS packed
    FROM [[page_table]]
"""


def _packed(content):
    """Base64 in one line."""
    return F.replace(F.base64(F.to_binary(content, F.lit("utf-8"))), F.lit("\r\n"), F.lit(""))


def _images(spark, root):
    """Pages with three image references; the first image is broken on some, the third never delivered."""
    markdown = F.col("markdown")
    packed = _packed(markdown)
    first = F.when(F.length(markdown) % 4 == 0, F.lit("data:image/jpeg;base64,@@@")).otherwise(
        F.concat(F.lit("data:image/jpeg;base64,"), packed)
    )
    return bind(spark, root, "page_table", heavy=True).select(
        "document_id", "page_number",
        F.concat(markdown, F.lit(" ![fig.jpeg](fig.jpeg) ![x.png](x.png) ![gone.gif](gone.gif)")).alias("markdown"),
        F.array(
            F.struct(F.lit("fig.jpeg").alias("id"), first.alias("image_base64")),
            F.struct(F.lit("x.png").alias("id"), packed.alias("image_base64")),
        ).alias("images"),
    )


@query(
    "inline_images",
    f"""
    SELECT document_id, page_number, concat(markdown, ' ![fig.jpeg](data:image/jpeg;base64,',
             CASE WHEN broken THEN '@@@' ELSE packed END, ') ![x.png](', packed, ') ![gone.gif](gone.gif)') AS markdown
    FROM ({_IMAGES})
    """,
)
def _(spark, root):
    return _images(spark, root).select(
        "document_id", "page_number", text.inline_images(F.col("markdown"), F.col("images")).alias("markdown")
    )


@query(
    "shorten_image_refs",
    f"""
    SELECT document_id, page_number, concat(markdown, ' ![fig.jpeg](assets/My_Report-', page_number, '-image-1.',
             CASE WHEN broken THEN 'bin' ELSE 'jpg' END, ') ![x.png](assets/My_Report-', page_number,
             '-image-2.png) ![gone.gif](gone.gif)') AS markdown
    FROM ({_IMAGES})
    """,
)
def _(spark, root):
    short = text.shorten_image_refs(
        F.col("markdown"), F.lit("My Report.pdf"), F.col("page_number"), F.col("images")
    )
    return _images(spark, root).select("document_id", "page_number", short.alias("markdown"))


@query(
    "asset_ordinals",
    f"""
    SELECT document_id, page_number, CAST(1 AS INTEGER) AS ordinal, 'fig.jpeg' AS source_ref, 'image/jpeg' AS mime_type,
           'jpg' AS extension, packed FROM ({_IMAGES}) WHERE NOT broken
    UNION ALL SELECT document_id, page_number, CASE WHEN broken THEN 1 ELSE 2 END, 'x.png', 'image/png', 'png', packed
    FROM ({_IMAGES})
    """,
)
def _(spark, root):
    ordinals = asset_ordinals(_images(spark, root).drop("markdown"))
    return ordinals.withColumn("packed", F.replace(F.base64("content"), F.lit("\r\n"), F.lit(""))).drop("content")


@query(
    "decode_data_url",
    """
    SELECT page_id, CASE k WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/svg+xml' WHEN 4 THEN 'image/jpeg' END AS mime_type,
           CASE k WHEN 0 THEN 'png' WHEN 1 THEN 'svg' WHEN 4 THEN 'jpg' END AS extension,
           CASE WHEN k IN (0, 1, 4) THEN sha256(html) END AS content_hash,
           CASE k WHEN 2 THEN 'Unsupported OCR image encoding' WHEN 3 THEN 'OCR object is not an image'
                  WHEN 5 THEN 'OCR returned invalid image data' END AS error
    FROM (SELECT page_id, html, page_id % 6 AS k FROM {pages})
    """,
)
def _(spark, root):
    k = F.col("page_id") % 6
    packed = F.base64(F.to_binary("html", F.lit("utf-8")))
    url = (
        F.when(k == 0, F.concat(F.lit("data:image/PNG;base64,"), packed))
        .when(k == 1, F.concat(F.lit("data:image/svg+xml;charset=utf-8;base64,"), packed))
        .when(k == 2, F.concat(F.lit("data:image/png,"), packed))
        .when(k == 3, F.concat(F.lit("data:text/html;base64,"), packed))
        .when(k == 4, packed)
        .otherwise(F.concat(F.lit("data:image/png;base64,!"), packed))
    )
    decoded = table(spark, root, "pages").select(
        "page_id", text.decode_data_url(url, F.lit("img-0.jpeg")).alias("d")
    )
    return decoded.select(
        "page_id", "d.mime_type", "d.extension", F.sha2("d.content", 256).alias("content_hash"), "d.error"
    )


_EMBEDDED = """
    SELECT document_id, page_number, markdown, length(markdown) % 3 = 0 AS broken,
           base64(encode(markdown)) AS packed FROM [[page_table]]
"""


def _embedded(spark, root):
    markdown = F.col("markdown")
    packed = _packed(markdown)
    first = F.when(F.length(markdown) % 3 == 0, F.concat(packed, F.lit("A"))).otherwise(packed)
    pages = bind(spark, root, "page_table", heavy=True).select(
        "document_id", "page_number",
        F.concat(
            F.lit("![one](data:image/JPEG;base64,"), first, F.lit(") "), markdown,
            F.lit(" ![two](data:image/png;base64,"), packed, F.lit(")"),
        ).alias("markdown"),
    )
    return pages.withColumn(
        "assets", text.embedded_assets(F.col("markdown"), F.lit("old scan.pdf"), F.col("page_number"))
    )


@query(
    "extract_embedded_assets",
    f"""
    SELECT document_id, page_number, 'one' AS source_ref, concat('old-scan-', page_number, '-image-1.jpg') AS filename,
           'image/jpeg' AS mime_type, packed FROM ({_EMBEDDED}) WHERE NOT broken
    UNION ALL SELECT document_id, page_number, 'two', concat('old-scan-', page_number, '-image-',
           CASE WHEN broken THEN 1 ELSE 2 END, '.png'), 'image/png', packed FROM ({_EMBEDDED})
    """,
)
def _(spark, root):
    found = _embedded(spark, root).select("document_id", "page_number", F.inline("assets"))
    return found.where("filename is not null").select(
        "document_id", "page_number", "source_ref", "filename", "mime_type",
        F.replace(F.base64("content"), F.lit("\r\n"), F.lit("")).alias("packed"),
    )


@query(
    "rewrite_embedded_assets",
    f"""
    SELECT document_id, page_number,
           concat('![one](', CASE WHEN broken THEN concat('data:image/JPEG;base64,', packed, 'A')
                    ELSE concat('assets/old-scan-', page_number, '-image-1.jpg') END, ') ', markdown,
                  ' ![two](assets/old-scan-', page_number, '-image-', CASE WHEN broken THEN 1 ELSE 2 END, '.png)') AS markdown
    FROM ({_EMBEDDED})
    """,
)
def _(spark, root):
    return _embedded(spark, root).select(
        "document_id", "page_number", text.rewrite_embedded(F.col("markdown"), F.col("assets")).alias("markdown")
    )


@query(
    "asset_filename",
    """
    WITH s AS (SELECT page_id, regexp_extract(split_part(url, '#', 1), '([^/]+)/?$', 1) AS name FROM {pages}),
    c AS (SELECT page_id, name, regexp_replace(regexp_replace(regexp_replace(name, '^(.+)\\.[^.]+$', '\\1'),
                 '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS stem FROM s)
    SELECT page_id, concat(CASE WHEN stem = '' THEN 'document' ELSE stem END, '-2-image-3.',
           CASE page_id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'svg' WHEN 2 THEN 'bin' ELSE 'vndmicrosofticon' END) AS filename
    FROM c
    """,
)
def _(spark, root):
    k = F.col("page_id") % 4
    mime = (
        F.when(k == 0, "image/jpeg").when(k == 1, "image/svg+xml").when(k == 2, "image/")
        .otherwise("image/vnd.microsoft.icon")
    )
    name = F.regexp_extract(F.split_part("url", F.lit("#"), F.lit(1)), r"([^/]+)/?$", 1)
    return table(spark, root, "pages").select(
        "page_id", text.asset_filename(name, F.lit(2), F.lit(3), mime).alias("filename")
    )


_REPORTS = """
    SELECT p_partkey AS document_id, p_size AS page_number, p_partkey % 3 AS k,
           concat('upscaled_', p_size % 3 + 1, '.', p_size % 10, 'x') AS first_action,
           concat('deskewed_', CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END, p_size % 5, '_degrees') AS second_action,
           p_retailprice / 1e4 AS quality
    FROM {part}
"""


@query(
    "preprocess_report_rows",
    f"""
    WITH r AS ({_REPORTS}),
    a AS (SELECT *, false AS used_original, unnest([first_action, second_action, 'denoised']) AS action,
                 unnest(['upscaled', 'deskewed', 'denoised']) AS family,
                 unnest([TRY_CAST(replace(split_part(first_action, '_', 2), 'x', '') AS DOUBLE),
                         TRY_CAST(split_part(second_action, '_', 2) AS DOUBLE), NULL]) AS amount FROM r WHERE k > 0
          UNION ALL SELECT *, true, 'used_original', 'used_original', NULL FROM r WHERE k = 0)
    SELECT document_id, page_number, used_original, action, family, amount,
           round(quality, 6) AS quality_before, round(quality + 1, 6) AS quality_after FROM a
    """,
)
def _(spark, root):
    reports = spark.sql(_REPORTS, part=table(spark, root, "part"))
    actions = F.when(F.col("k") > 0, F.array("first_action", "second_action", F.lit("denoised"))).otherwise(
        F.array().cast("array<string>")
    )
    pages = reports.select(
        "document_id", "page_number",
        F.to_json(
            F.struct(
                F.lit(1).alias("version"), (F.col("k") == 0).alias("used_original"), actions.alias("actions"),
                F.struct(F.col("quality").alias("quality")).alias("quality_before"),
                F.struct((F.col("quality") + 1).alias("quality")).alias("quality_after"),
            )
        ).alias("preprocessing_json"),
    )
    rows = preprocess_report_rows(pages)
    return rows.withColumns({c: F.round(c, 6) for c in ("quality_before", "quality_after")})


@query(
    "dedupe_string_list",
    f"""
    SELECT document_id, page_number, array_to_string(list_filter(w, lambda x, i:
             x <> '' AND list_position(list_transform(w, lambda y: replace(lower(y), 'ß', 'ss')), replace(lower(x), 'ß', 'ss')) = i), ' ') AS words
    FROM (SELECT document_id, page_number, {_WORDS.format('markdown')} AS w FROM [[page_table]])
    """,
)
def _(spark, root):
    words = F.split(F.regexp_replace("markdown", r"^\s+|\s+$", ""), r"\s+")
    return bind(spark, root, "page_table", heavy=True).select(
        "document_id", "page_number", F.array_join(text.dedupe_string_list(words), " ").alias("words")
    )


@query(
    "page_range_udtf",
    """
    WITH b AS (SELECT spec_id, a, b, c, spec_id % 6 AS k FROM [[range_specs]]),
    r AS (SELECT spec_id, least(a, b) AS x, greatest(a, b) AS y, b >= 1 AND b <= 10 AS ok FROM b WHERE k IN (0, 1)
          UNION ALL SELECT spec_id, a, a, b >= 1 AND b <= 10 FROM b WHERE k = 1
          UNION ALL SELECT spec_id, 1, 10, true FROM b WHERE k = 2
          UNION ALL SELECT spec_id, least(a, c), greatest(a, c), b >= 1 AND b <= 10 FROM b WHERE k = 5
          UNION ALL SELECT spec_id, b, b, b >= 1 AND b <= 10 FROM b WHERE k = 5)
    SELECT DISTINCT spec_id, CAST(unnest(range(x, y + 1)) AS INTEGER) AS page_number FROM r WHERE ok
    """,
)
def _(spark, root):
    register_page_range(spark)
    return spark.sql(
        "SELECT s.spec_id, p.page_number FROM {specs} s, LATERAL page_range(s.spec, s.total_pages) p",
        specs=bind(spark, root, "range_specs"),
    )
