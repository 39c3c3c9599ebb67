"""Line formats: batch request and result JSON lines, and the API log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.binding import let

RESULT_SCHEMA = (
    "custom_id string, error string, response struct<status_code: string, body: string>"
)
BODY_SCHEMA = (
    "pages array<struct<markdown: string, images: array<struct<id: string, image_base64: string>>, "
    "confidence_scores: struct<average_page_confidence_score: string>>>"
)


def batch_request_lines(images: DataFrame) -> DataFrame:
    """One request line per (custom_id, content, mime_type) page image."""
    safe = F.when(F.col("mime_type").startswith("image/"), F.col("mime_type")).otherwise("image/png")
    packed = F.replace(F.base64("content"), F.lit("\r\n"), F.lit(""))
    url = F.concat(F.lit("data:"), safe, F.lit(";base64,"), packed)
    body = F.struct(
        F.struct(F.lit("image_url").alias("type"), url.alias("image_url")).alias("document"),
        F.lit(True).alias("include_image_base64"),
        F.lit("page").alias("confidence_scores_granularity"),
    )
    line = F.to_json(F.struct(F.col("custom_id").cast("string").alias("custom_id"), body.alias("body")))
    return images.select("custom_id", line.alias("value"))


def write_request_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


def parse_result_lines(lines: DataFrame, error_file: bool = False) -> DataFrame:
    """(custom_id, status_code, body, error) per non-blank line; lines of an error file are all errors."""
    parsed = lines.where(F.trim("value") != "").select("value", F.from_json("value", RESULT_SCHEMA).alias("_l"))
    status = F.coalesce(F.col("_l.response.status_code").try_cast("int"), F.lit(0))
    body = F.col("_l.response.body")
    if error_file:
        given = F.coalesce(F.col("_l.error"), F.col("value"))
        error = given
    else:
        empty = body.isNull() | body.isin("", "{}")
        given = F.coalesce(
            F.nullif(F.col("_l.error"), F.lit("")), F.when(~empty, body),
            F.concat(F.lit("HTTP "), status.cast("string")),
        )
        error = F.when(status != 200, given)
    return parsed.select(
        F.col("_l.custom_id").alias("custom_id"),
        status.alias("status_code"),
        F.when(error.isNull(), body).alias("body"),
        error.alias("error"),
    )


def batch_result_lines(spark: SparkSession, path: str, error_path: str | None = None) -> DataFrame:
    """Result lines, followed by those of the error file where there is one."""
    rows = parse_result_lines(spark.read.text(path))
    if error_path:
        rows = rows.unionByName(parse_result_lines(spark.read.text(error_path), error_file=True))
    return rows


def clamp_confidence(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def map_provider_page(results: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``markdown``, ``images`` (id and data both present) and ``confidence`` of the first page.

    A result without pages is an empty page.
    """
    page = F.get(F.col("_b.pages"), F.lit(0))
    images = F.filter(
        page["images"],
        lambda i: (F.coalesce(i["id"], F.lit("")) != "") & (F.coalesce(i["image_base64"], F.lit("")) != ""),
    )
    return (
        results.withColumn("_b", F.from_json(body, BODY_SCHEMA))
        .withColumn("markdown", F.when(F.col(body).isNotNull(), F.coalesce(page["markdown"], F.lit(""))))
        .withColumn("images", images)
        .withColumn("confidence", clamp_confidence(page["confidence_scores"]["average_page_confidence_score"]))
        .drop("_b")
    )


def _pairs(text: Column) -> Column:
    """Map of the ``k=v`` pieces of a text; of a repeated key the last value counts. A
    piece without ``=`` is a key without a value."""
    pieces = F.transform(
        F.split(text, " "),
        lambda x, i: F.struct(
            F.substring_index(x, "=", 1).alias("key"), (-i).alias("back"),
            F.when(x.contains("="), F.substr(x, F.locate("=", x) + 1)).alias("value"),
        ),
    )
    last = let(
        F.sort_array(pieces),
        lambda s: F.filter(s, lambda e, i: (i == 0) | (e["key"] != F.get(s, i - 1)["key"])),
    )
    ordered = F.sort_array(F.transform(last, lambda e: F.struct((-e["back"]).alias("at"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["key"], e["value"])))


def parse_api_log(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``[ts] event | detail | k=v k=v`` as (ts, event, detail, extra map); detail and extra are optional."""
    value = F.col("value")
    fields = F.split(F.regexp_replace(value, r"^\[[^\]]*\] ", ""), r" \| ")
    second, third = F.get(fields, F.lit(1)), F.get(fields, F.lit(2))
    paired = F.forall(F.split(second, " "), lambda x: x.contains("=") & ~x.startswith("="))
    extra = F.coalesce(third, F.when(paired, second))
    detail = F.when(third.isNotNull() | ~paired, second)
    return lines.where(value.startswith("[")).select(
        *keep,
        F.regexp_extract(value, r"^\[([^\]]*)\]", 1).try_cast("timestamp_ntz").alias("ts"),
        F.get(fields, F.lit(0)).alias("event"),
        detail.alias("detail"),
        F.when(extra.isNotNull(), _pairs(extra)).alias("extra"),
    )


def api_log_scan(spark: SparkSession, path: str) -> DataFrame:
    return parse_api_log(spark.read.text(path))
