"""Structured extraction: parsing, normalising, items, long form and CSV rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.binding import computed, let
from quire.functions.text import dedupe_string_list, export_stem
from quire.templates import TEMPLATES, Field, Group, Template

#: An amount: digits with an optional sign, fraction and exponent, or the name of a special value.
_AMOUNT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)\s*$"
_AMOUNT_BOUND = 1e12
# Every Unicode blank.
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def parse_annotation(df: DataFrame, json: str = "annotation") -> DataFrame:
    """Adds ``parsed`` (variant, objects only) and ``error``."""
    raw = F.col(json)
    read = computed(df, "_read", F.try_parse_json(raw))
    is_object = F.ltrim(raw, F.lit(" \t\r\n")).startswith("{")  # it is valid JSON where this is asked
    error = (
        F.when(raw.isNull() | (F.trim(raw) == ""), "no structured extraction")
        .when(F.col("_read").isNull(), "not valid JSON")
        .when(~is_object, "invalid structured extraction")
    )
    judged = computed(read, "error", error)
    return judged.withColumn("parsed", F.when(F.col("error").isNull(), F.col("_read"))).drop("_read")


def _raw_leaves(fields: Sequence[Field], parent: Column) -> list[Column]:
    """Each scalar as text; nested JSON given for a scalar keeps its JSON form."""
    return [F.try_variant_get(parent, f"$.{f.key}", "string").alias(f.key) for f in fields]


def _raw_list(parsed: Column, key: str) -> Column:
    given = F.try_variant_get(parsed, f"$.{key}", "variant")
    return F.struct(
        F.try_variant_get(parsed, f"$.{key}", "array<variant>").alias("items"),
        (given.isNotNull() & ~F.is_variant_null(given)).alias("given"),
    ).alias(key)


def _raw_item_of(group: Group) -> Callable[[Column], Column]:
    """(is_object, is_null, leaves) of one entry."""
    return lambda item: F.struct(
        F.try_variant_get(item, "$", "map<string,variant>").isNotNull().alias("is_object"),
        F.is_variant_null(item).alias("is_null"),
        *_raw_leaves(group.fields, item),
    )


def _text(raw: Column) -> Column:
    """Trimmed text, blank as null."""
    trimmed = F.btrim(raw, F.lit(_BLANKS))
    return F.when(trimmed != "", trimmed)


def _amount(raw: Column) -> Column:
    """A number by its form; literals with a type suffix are none."""
    return F.when(raw.rlike(_AMOUNT), F.btrim(raw, F.lit(_BLANKS)).try_cast("double"))


def _number(raw: Column) -> Column:
    return F.round(_amount(raw), 6)


def _number_error(raw: Column) -> Column:
    """A blank string counts as absent, as does null; anything else must be a finite amount."""
    return _judged_number(raw, _amount(raw))


def _judged_number(raw: Column, number: Column) -> Column:
    return F.when(raw.isNotNull() & (raw != "") & number.isNull(), "Amounts must be numbers").when(
        F.isnan(number) | (F.abs(number) >= _AMOUNT_BOUND), "Amount is outside the supported range"
    )


def _item_number_error(raw: Column) -> Column:
    """The same inside a lambda, where common parts are not shared: the amount is read once, if any is given."""
    return F.when(raw.isNotNull(), let(_amount(raw), lambda number: _judged_number(raw, number)))


def _leaves(fields: Sequence[Field], raw: Column) -> list[Column]:
    return [(_number(raw[f.key]) if f.is_number else _text(raw[f.key])).alias(f.key) for f in fields]


def _leaf_errors(fields: Sequence[Field], raw: Column) -> list[Column]:
    return [_number_error(raw[f.key]) for f in fields if f.is_number]


def _item_of(group: Group) -> Callable[[Column], Column]:
    return lambda item: F.when(item["is_object"], F.struct(*_leaves(group.fields, item)))


def _item_error_of(group: Group) -> Callable[[Column], Column]:
    return lambda item: F.when(
        ~item["is_object"] & ~item["is_null"], "Structured sections must be objects"
    ).when(item["is_object"], F.coalesce(F.lit(None).cast("string"), *[_item_number_error(item[f.key]) for f in group.fields if f.is_number]))


def _item_line_of(group: Group) -> Callable[[Column], Column]:
    return lambda item: _csv_line(group.fields, item)


def _first_error(errors: Column) -> Column:
    return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))


def normalize_extraction(df: DataFrame, template_id: str, parsed: str = "parsed") -> DataFrame:
    """Adds ``data`` (the template's struct) and fills ``error``; data is null where error is set.

    Undeclared keys vanish, text is trimmed, amounts are rounded to six places, and the first
    failing field names the error.
    The variant is read once into raw text, which the rules then work on.
    """
    template = TEMPLATES[template_id]
    value = F.col(parsed)
    repeated = [group.key for group in template.tables] + [key for key, _ in template.lists]
    lists = computed(df, "_lists", F.struct(*[_raw_list(value, key) for key in repeated]))
    raw_items = [
        F.transform(F.col("_lists")[g.key]["items"], _raw_item_of(g)).alias(g.key) for g in template.tables
    ]
    raw_texts = [
        F.transform(
            F.col("_lists")[key]["items"], lambda item: F.try_variant_get(item, "$", "string")
        ).alias(key)
        for key, _ in template.lists
    ]
    read = computed(
        lists, "_raw", F.struct(*_raw_leaves(template.scalars, value), *raw_items, *raw_texts)
    )
    raw = F.col("_raw")
    columns = [F.lit(template.id).alias("document_type"), *_leaves(template.scalars, raw)]
    errors = _leaf_errors(template.scalars, raw)
    for group in template.tables:
        empty = F.array().cast(template.struct_type()[group.key].dataType)
        columns.append(F.coalesce(F.transform(raw[group.key], _item_of(group)), empty).alias(group.key))
        errors.append(_first_error(F.transform(raw[group.key], _item_error_of(group))))
    for key, _label in template.lists:
        unique = dedupe_string_list(F.transform(raw[key], _text))
        columns.append(F.coalesce(unique, F.array().cast("array<string>")).alias(key))
    for key in repeated:
        part = F.col("_lists")[key]
        errors.append(F.when(part["given"] & part["items"].isNull(), "Repeated fields must be lists"))
    known = [F.col("error")] if "error" in df.columns else []
    found = F.coalesce(*known, *errors)
    worked = computed(read, "_n", F.struct(found.alias("error"), F.struct(*columns).alias("data")))
    fine = F.col("_n.error").isNull() & value.isNotNull()
    return (
        worked.withColumn("data", F.when(fine, F.col("_n.data")))
        .withColumn("error", F.col("_n.error"))
        .drop("_n", "_raw", "_lists")
    )


def extraction_items(df: DataFrame, key: str, data: str = "data") -> DataFrame:
    """One row per entry of a repeated section with its ordinal; documents without entries keep one row."""
    ids = [c for c in df.columns if c != data]
    exploded = df.select(*ids, F.posexplode_outer(F.col(data)[key]).alias("_pos", "item"))
    return exploded.select(*ids, (F.col("_pos") + 1).alias("item_number"), "item.*")


def extraction_fields_long(df: DataFrame, template_id: str, data: str = "data") -> DataFrame:
    """Scalar fields as (section, seq, label, value) rows."""
    template = TEMPLATES[template_id]
    ids = [c for c in df.columns if c != data]
    entries = [
        F.struct(
            F.lit(section.title).alias("section"),
            F.lit(field.label).alias("label"),
            cell_text(field, F.col(data)).alias("value"),
        )
        for section in template.sections
        for field in section.fields
    ]
    return df.select(*ids, F.posexplode(F.array(*entries)).alias("_pos", "_entry")).select(
        *ids, (F.col("_pos") + 1).alias("seq"), "_entry.*"
    )


def number_text(value: Column) -> Column:
    """Plain decimal text with at least one fraction digit, as in ``10.6`` or ``216.0``."""
    cut = F.rtrim(value.cast("decimal(20,6)").cast("string"), F.lit("0"))
    fixed = F.rtrim(F.replace(F.concat(cut, F.lit("|")), F.lit(".|"), F.lit(".0|")), F.lit("|"))
    tiny = F.regexp_replace(
        F.regexp_replace(value.cast("string"), r"\.0E", "E"), r"E-(\d)$", "e-0$1"
    )
    return F.when((F.abs(value) < 1e-4) & (value != 0), tiny).otherwise(fixed)


def cell_text(field: Field, data: Column) -> Column:
    value = data[field.key]
    return number_text(value) if field.is_number else value


def csv_cell(text: Column) -> Column:
    """Minimal CSV quoting; null is an empty cell."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike("[\",\r\n]"), quoted).otherwise(text), F.lit(""))


def _csv_cell_of(field: Field, data: Column) -> Column:
    """A number never needs quotes."""
    text = cell_text(field, data)
    return F.coalesce(text, F.lit("")) if field.is_number else csv_cell(text)


def _csv_line(fields: Sequence[Field], data: Column) -> Column:
    return F.concat_ws(",", *[_csv_cell_of(f, data) for f in fields])


def _csv_head(*cells: Column) -> Column:
    return F.concat_ws(",", *[csv_cell(c) for c in cells])


def csv_lines(template: Template, value: Column) -> Column:
    """CSV lines of one extraction in order: header, fields, lists, then each table."""
    head = [F.lit("field,value")]
    head += [
        F.concat_ws(",", csv_cell(F.lit(f.label)), _csv_cell_of(f, value)) for s in template.sections for f in s.fields
    ]
    head += [
        _csv_head(F.lit(label), F.array_join(value[key], " | ")) for key, label in template.lists
    ]
    parts = [F.array(*head)]
    for group in template.tables:
        titles = [F.lit(f.label) for f in group.fields]
        parts.append(F.array(F.lit(""), _csv_head(F.lit(group.title)), _csv_head(*titles)))
        parts.append(F.transform(value[group.key], _item_line_of(group)))
    return reduce(lambda a, b: F.concat(a, b), parts)


def extraction_csv_rows(df: DataFrame, template_id: str, data: str = "data") -> DataFrame:
    """CSV lines of each extraction with their number.

    All lines of a document come from its own row, so nothing is shuffled.
    """
    value = F.col(data)
    ids = [c for c in df.columns if c != data]
    lines = csv_lines(TEMPLATES[template_id], value)
    made = df.where(value.isNotNull()).select(*ids, lines.alias("_lines"))  # compiled there, interpreted inside a generator
    return made.select(*ids, F.posexplode("_lines").alias("_pos", "line")).select(*ids, (F.col("_pos") + 1).alias("seq"), "line")


def extraction_csv_files(df: DataFrame, template_id: str, name: str = "document_name", data: str = "data") -> DataFrame:
    """One CSV file per extraction as (document_id, filename, text), with byte-order mark and CRLF ends."""
    lines = csv_lines(TEMPLATES[template_id], F.col(data))
    return df.where(F.col(data).isNotNull()).select(
        "document_id",
        F.concat(export_stem(F.col(name)), F.lit(f"-{template_id}-data.csv")).alias("filename"),
        F.concat(F.lit("\ufeff"), F.array_join(lines, "\r\n"), F.lit("\r\n")).alias("text"),
    )


def extraction_eligible(documents: DataFrame, limit: int = 8) -> DataFrame:
    """Documents short enough for annotation."""
    return documents.where(F.col("num_pages") <= limit)


def extraction_route(documents: DataFrame, page_counts: DataFrame) -> DataFrame:
    """``combined`` for a single image without pages, else ``page_first``."""
    counted = documents.join(page_counts, "document_id", "left")
    pages = F.coalesce(F.col("ocr_pages"), F.lit(0))
    return counted.withColumn(
        "route", F.when(~F.col("is_pdf") & (pages == 0), "combined").otherwise("page_first")
    ).drop("ocr_pages")


def partial_extraction_gate(page_results: DataFrame) -> DataFrame:
    """Documents with a failed page are blocked from annotation; failed pages are counted and bounded.

    One row per document with ``eligible``, the number of failed pages and the first and last
    of them; :func:`failed_page_list` gives the pages themselves as rows.
    """
    failed = F.col("error").isNotNull()
    return page_results.groupBy("document_id").agg(
        (~F.bool_or(failed)).alias("eligible"),
        F.count(F.when(~failed, 1)).alias("good_pages"),
        F.count(F.when(failed, 1)).alias("failed_pages"),
        F.min(F.when(failed, F.col("page_number"))).alias("first_failed"),
        F.max(F.when(failed, F.col("page_number"))).alias("last_failed"),
    )


def failed_page_list(page_results: DataFrame) -> DataFrame:
    return page_results.where(F.col("error").isNotNull()).select("document_id", "page_number", "error")
