"""Extraction templates: the fixed field catalogue and the Spark types derived from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PAGE_LIMIT = 8

# Keys, labels and kinds of every template, in layout order.
# A section or table is (title, key, fields); a field is (key, label, kind).
_INVOICE = (
    ("Invoice details", None, (
        ("supplier_name", "Supplier", "text"),
        ("supplier_registration_number", "Registration number", "text"),
        ("supplier_address", "Supplier address", "long_text"),
        ("customer_name", "Customer", "text"),
        ("invoice_number", "Invoice number", "text"),
        ("invoice_date", "Invoice date", "date"),
        ("due_date", "Due date", "date"),
        ("currency", "Currency", "text"),
        ("payment_terms", "Payment terms", "long_text"),
    )),
    ("Totals", None, (
        ("subtotal", "Subtotal", "number"),
        ("discount_amount", "Discount", "number"),
        ("tax_amount", "Tax", "number"),
        ("total_amount", "Total", "number"),
    )),
    ("Line items", "line_items", (
        ("description", "Description", "text"),
        ("quantity", "Qty", "number"),
        ("unit_price", "Unit price", "number"),
        ("tax_amount", "Tax", "number"),
        ("amount", "Amount", "number"),
    )),
)
_RECEIPT = (
    ("Receipt details", None, (
        ("merchant_name", "Merchant", "text"),
        ("merchant_registration_number", "Registration number", "text"),
        ("merchant_address", "Merchant address", "long_text"),
        ("receipt_number", "Receipt number", "text"),
        ("transaction_datetime", "Date and time", "text"),
        ("currency", "Currency", "text"),
        ("payment_method", "Payment method", "text"),
    )),
    ("Totals", None, (
        ("subtotal", "Subtotal", "number"),
        ("discount_amount", "Discount", "number"),
        ("tax_amount", "Tax", "number"),
        ("total_amount", "Total", "number"),
    )),
    ("Purchased items", "purchased_items", (
        ("description", "Description", "text"),
        ("quantity", "Qty", "number"),
        ("unit_price", "Unit price", "number"),
        ("amount", "Amount", "number"),
    )),
)
_QUOTATION = (
    ("Quotation details", None, (
        ("supplier_name", "Supplier", "text"),
        ("supplier_registration_number", "Registration number", "text"),
        ("supplier_address", "Supplier address", "long_text"),
        ("supplier_contact", "Supplier contact", "text"),
        ("customer_name", "Customer", "text"),
        ("customer_address", "Customer address", "long_text"),
        ("quotation_number", "Quotation number", "text"),
        ("quotation_date", "Quotation date", "date"),
        ("valid_until", "Valid until", "date"),
        ("subject", "Subject / project", "long_text"),
        ("currency", "Currency", "text"),
    )),
    ("Commercial terms", None, (
        ("payment_terms", "Payment terms", "long_text"),
        ("delivery_terms", "Delivery terms", "long_text"),
        ("warranty_terms", "Warranty terms", "long_text"),
    )),
    ("Totals", None, (
        ("subtotal", "Subtotal", "number"),
        ("discount_amount", "Discount", "number"),
        ("tax_amount", "Tax", "number"),
        ("total_amount", "Total", "number"),
    )),
    ("Quoted items", "quoted_items", (
        ("item_code", "Item code", "text"),
        ("description", "Description", "text"),
        ("quantity", "Qty", "number"),
        ("unit", "Unit", "text"),
        ("unit_price", "Unit price", "number"),
        ("discount_amount", "Discount", "number"),
        ("tax_amount", "Tax", "number"),
        ("amount", "Amount", "number"),
    )),
)
_RESUME = (
    ("Profile", None, (
        ("full_name", "Full name", "text"),
        ("professional_title", "Professional title", "text"),
        ("email", "Email", "text"),
        ("phone", "Phone", "text"),
        ("location", "Location", "text"),
        ("linkedin_url", "LinkedIn", "text"),
        ("github_url", "GitHub", "text"),
        ("portfolio_url", "Portfolio / website", "text"),
        ("professional_summary", "Professional summary", "long_text"),
    )),
    ("Experience", "experience", (
        ("employer", "Employer", "text"),
        ("job_title", "Role", "text"),
        ("location", "Location", "text"),
        ("start_date", "Start", "text"),
        ("end_date", "End", "text"),
        ("description", "Description", "text"),
    )),
    ("Education", "education", (
        ("institution", "Institution", "text"),
        ("qualification", "Qualification", "text"),
        ("field_of_study", "Field", "text"),
        ("start_date", "Start", "text"),
        ("end_date", "End", "text"),
    )),
    ("Projects", "projects", (
        ("name", "Project", "text"),
        ("description", "Description", "text"),
        ("technologies", "Technologies", "text"),
    )),
    ("Certifications", "certifications", (
        ("name", "Certification", "text"),
        ("issuer", "Issuer", "text"),
        ("date", "Date", "text"),
    )),
    ("Achievements", "achievements", (
        ("title", "Achievement", "text"),
        ("date", "Date", "text"),
        ("description", "Description", "text"),
    )),
    ("Languages", "languages", (
        ("language", "Language", "text"),
        ("proficiency", "Proficiency", "text"),
    )),
)


@dataclass(frozen=True)
class Field:
    key: str
    label: str
    kind: str

    @property
    def is_number(self) -> bool:
        return self.kind == "number"


@dataclass(frozen=True)
class Group:
    """One titled section of scalar fields, or one repeated table."""

    title: str
    key: str | None
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class Template:
    id: str
    label: str
    schema_version: int
    sections: tuple[Group, ...]
    tables: tuple[Group, ...]
    lists: tuple[tuple[str, str], ...]

    @property
    def scalars(self) -> tuple[Field, ...]:
        return tuple(f for section in self.sections for f in section.fields)

    def struct_type(self) -> T.StructType:
        """Spark type of a normalised extraction."""
        fields = [T.StructField("document_type", T.StringType())]
        fields += [T.StructField(f.key, _leaf(f)) for f in self.scalars]
        for group in self.tables:
            item = T.StructType([T.StructField(f.key, _leaf(f)) for f in group.fields])
            fields.append(T.StructField(group.key, T.ArrayType(item)))
        fields += [T.StructField(key, T.ArrayType(T.StringType())) for key, _ in self.lists]
        return T.StructType(fields)


def _leaf(field: Field) -> T.DataType:
    return T.DoubleType() if field.is_number else T.StringType()


def _template(id: str, label: str, version: int, groups: tuple, lists: tuple) -> Template:
    built = [Group(title, key, tuple(Field(*field) for field in fields)) for title, key, fields in groups]
    return Template(
        id, label, version,
        tuple(g for g in built if g.key is None),
        tuple(g for g in built if g.key is not None),
        lists,
    )


_NOTES = ("review_notes", "Review notes")
TEMPLATES: dict[str, Template] = {
    t.id: t
    for t in (
        _template("invoice", "Invoice", 1, _INVOICE, (_NOTES,)),
        _template("receipt", "Receipt", 1, _RECEIPT, (_NOTES,)),
        _template("quotation", "Quotation", 1, _QUOTATION, (_NOTES,)),
        _template("resume", "CV / Résumé", 2, _RESUME, (("skills", "Skills"), _NOTES)),
    )
}


def template_schema(template_id: str) -> T.StructType:
    return TEMPLATES[template_id].struct_type()


def template_catalogue(spark: SparkSession) -> DataFrame:
    """One row per template field, table column and list, in layout order."""
    rows = []
    for template in TEMPLATES.values():
        entries = [("section", g.title, None, f) for g in template.sections for f in g.fields]
        entries += [
            ("list", label, key, Field(key, label, "list")) for key, label in template.lists
        ]
        entries += [("table", g.title, g.key, f) for g in template.tables for f in g.fields]
        rows += [
            (template.id, template.label, template.schema_version, PAGE_LIMIT, seq, group, title,
             table_key, f.key, f.label, f.kind)
            for seq, (group, title, table_key, f) in enumerate(entries, start=1)
        ]
    return spark.createDataFrame(
        rows,
        "template string, template_label string, schema_version int, max_pages int, seq int, "
        "group_kind string, group_title string, table_key string, field string, label string, "
        "kind string",
    )
