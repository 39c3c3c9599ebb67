"""Updates of a bucketed table against updates of the whole table."""

import glob
import os
import random

from quire.operators.transitions import upsert_pages
from quire.sources.buckets import BucketedTable, create_table

OLD = "document_id int, page_number int, source_markdown string, markdown string, preprocessing_json string, confidence_score double, review_status string, reviewed_at timestamp"
NEW = "document_id int, page_number int, source_markdown string, markdown string, preprocessing_json string, confidence_score double"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def rows_of(df):
    return sorted(map(tuple, df.select("document_id", "page_number", "source_markdown", "markdown", "confidence_score", "review_status").collect()))


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "t")
    whole = spark.createDataFrame([(d, p, "s", f"{d}.{p}", None, 0.9, "approved", None) for d in range(60) for p in (1, 2)], OLD)
    table = create_table(whole, path, ["document_id"], 16)
    for batch in range(4):
        documents = rng.sample(range(70), 3)
        changes = spark.createDataFrame([(d, p, None if d % 2 else "ocr", f"v{batch}", None, 0.5) for d in documents for p in (1, 3)], NEW)
        before, held = files(path), dict(table.held)
        table = table.update(changes, batch, upsert_pages)
        whole = spark.createDataFrame(upsert_pages(whole, changes).collect(), OLD)
        after = files(path)
        same = [b for b, v in held.items() if table.held.get(b) == v]
        assert len(held) - len(same) <= 3 and all(after[f] == t for f, t in before.items())
        again = BucketedTable(spark, path).update(changes, batch, upsert_pages)
        assert (again.version, files(path)) == (table.version, after)
        assert rows_of(again.read()) == rows_of(whole)


def test_an_emptied_bucket_and_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    table = create_table(spark.createDataFrame([], OLD), path, ["document_id"], 4)
    assert table.read().count() == 0
    new = spark.createDataFrame([(1, 1, None, "a", None, None)], NEW)
    table = table.update(new, 0, upsert_pages)
    assert table.read().count() == 1
    table = table.update(new, 1, lambda old, gone: old.join(gone.select("document_id"), "document_id", "left_anti").select(old.columns))
    assert table.read().count() == 0 and table.held == {}
