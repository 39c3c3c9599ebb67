"""Document assembly: Markdown parts, package manifests and link resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.skew import attach
from quire.functions.text import asset_name, asset_url, export_stem, image_links, join_links

SEPARATOR = "\n\n---\n\n"
_PAGE = ["document_id", "page_number"]


def document_markdown(
    pages: DataFrame, documents: DataFrame, header: str = "comment", block: int = 256
) -> DataFrame:
    """Stored pages of each document joined in page order: (document_id, part, markdown).

    A part holds at most ``block`` page numbers, and the parts of a document concatenate to its
    file, so a document of any length never meets in one row. ``header="comment"`` separates with
    a rule and titles pages only where num_pages > 1; ``header="heading"`` titles every page and
    counts missing ones as empty.
    """
    page = F.col("page_number")
    if header == "heading":
        wanted = documents.select(
            "document_id", F.explode(F.sequence(F.lit(1), F.col("num_pages"))).alias("page_number")
        )
        pages = wanted.join(pages.select(*_PAGE, "markdown"), _PAGE, "left")
        title, tail, separator = "# Page ", "\n", "\n\n"
    else:
        title, tail, separator = "<!-- Page ", "", SEPARATOR
    close = " -->" if header == "comment" else ""
    section = F.concat(
        F.lit(title), page.cast("string"), F.lit(close + "\n\n"),
        F.coalesce(F.col("markdown"), F.lit("")), F.lit(tail),
    )
    parts = pages.groupBy("document_id", F.floor((page - 1) / F.lit(block)).alias("part")).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(page.alias("p"), section.alias("s")))),
                lambda x: x["s"],
            ),
            separator,
        ).alias("_text")
    )
    first = pages.groupBy("document_id").agg(
        F.floor((F.min("page_number") - 1) / F.lit(block)).alias("_first")
    )
    info = documents.select("document_id", "num_pages").join(first, "document_id")
    joined = attach(parts, info, ["document_id"], "inner")
    text = F.col("_text")
    if header == "comment":
        single = len("<!-- Page 1 -->\n\n") + 1
        text = F.when(F.col("num_pages") > 1, text).otherwise(F.substr(text, F.lit(single)))
    lead = F.when(F.col("part") > F.col("_first"), F.lit(separator)).otherwise(F.lit(""))
    return joined.select("document_id", "part", F.concat(lead, text).alias("markdown"))


def write_documents(parts: DataFrame, path: str) -> None:
    """Store parts sorted inside each document."""
    parts.repartition("document_id", "part").sortWithinPartitions("document_id", "part").write.parquet(path)


def package_manifest(
    pages: DataFrame, documents: DataFrame, assets: DataFrame, with_pdf: bool = False
) -> DataFrame:
    """Files of each document's bundle: (document_id, path, bytes); a PDF's size is unknown here.

    The Markdown size is summed from its pages, so no text is assembled or shuffled.
    """
    n = F.count(F.lit(1))
    body = F.sum(F.octet_length("markdown").cast("bigint"))
    titles = F.sum(F.length(F.concat(F.lit("<!-- Page  -->\n\n"), F.col("page_number").cast("string"))))
    sizes = pages.groupBy("document_id").agg(
        body.alias("_body"), titles.alias("_titles"), n.alias("_n")
    )
    total = (
        F.coalesce("_body", F.lit(0))
        + F.when(F.col("num_pages") > 1, F.coalesce("_titles", F.lit(0))).otherwise(0)
        + F.greatest(F.lit(0), F.coalesce("_n", F.lit(0)) - 1) * len(SEPARATOR)
    )
    stem = export_stem(F.col("document_name"))
    base = documents.select("document_id", "document_name", "num_pages")
    text_rows = base.join(sizes, "document_id", "left").select(
        "document_id", F.concat(stem, F.lit("_markdown.md")).alias("path"), total.alias("bytes")
    )
    asset_rows = attach(assets, documents.select("document_id"), ["document_id"], "left_semi").select(
        "document_id",
        F.concat(F.lit("assets/"), F.col("filename")).alias("path"),
        F.octet_length("content").cast("bigint").alias("bytes"),
    )
    rows = text_rows.unionByName(asset_rows)
    if with_pdf:
        rows = rows.unionByName(
            base.select(
                "document_id", F.concat(stem, F.lit("_markdown.pdf")).alias("path"),
                F.lit(None).cast("bigint").alias("bytes"),
            )
        )
    return rows


def resolve_asset_links(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """Page text with ``assets/x`` image links turned into URLs where x is a stored asset.

    ``pages`` carry session_id. Only the links found in a page travel to the join, and each page
    takes back just its own matches.
    """
    names = F.filter(F.transform(image_links(F.col("markdown")), lambda x: asset_name(x["target"])), lambda n: n.isNotNull())
    links = pages.select(*_PAGE, F.explode(F.array_distinct(names)).alias("filename"))
    known = (
        attach(links, assets.select("document_id", "filename"), ["document_id", "filename"], "left_semi")
        .groupBy(*_PAGE)
        .agg(F.collect_set("filename").alias("_known"))
    )

    def link(reference: Column) -> Column:
        name = asset_name(reference["target"])
        url = asset_url(F.col("session_id").cast("string"), F.col("document_id").cast("string"), name)
        target = F.when(F.array_contains("_known", name), url).otherwise(reference["target"])
        return F.struct(reference["alt"].alias("alt"), target.alias("target"), reference["rest"].alias("rest"))

    rebuilt = join_links(F.transform(image_links(F.col("markdown")), link))
    joined = pages.join(known, _PAGE, "left")
    return joined.withColumn(
        "markdown",
        F.when(F.col("_known").isNull(), F.col("markdown")).otherwise(rebuilt),
    ).drop("_known")


def preprocess_report_rows(pages: DataFrame, report: str = "preprocessing_json") -> DataFrame:
    """One row per preprocessing action with its family and number; ``used_original`` when there is none."""
    schema = (
        "version int, used_original boolean, actions array<string>, "
        "quality_before struct<quality: double>, quality_after struct<quality: double>"
    )
    ids = [c for c in pages.columns if c != report]
    parsed = pages.withColumn("_r", F.from_json(report, schema))
    action = F.coalesce(F.col("_action"), F.lit("used_original"))
    number = F.regexp_extract(action, r"_([+-]?\d+(?:\.\d+)?)(?:x|_degrees)$", 1)
    family = (
        F.when(action.startswith("upscaled_"), "upscaled")
        .when(action.startswith("deskewed_"), "deskewed")
        .otherwise(action)
    )
    return parsed.select(*ids, "_r", F.explode_outer("_r.actions").alias("_action")).select(
        *ids,
        F.coalesce("_r.used_original", F.lit(False)).alias("used_original"),
        action.alias("action"),
        family.alias("family"),
        number.try_cast("double").alias("amount"),
        F.col("_r.quality_before.quality").alias("quality_before"),
        F.col("_r.quality_after.quality").alias("quality_after"),
    )
