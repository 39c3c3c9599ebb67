"""Files hashed in pieces, against their hash in one go."""

import hashlib

import numpy as np
import pytest

from quire.plans import page_queries  # noqa: F401
from quire.plans.registry import QUERIES
from quire.sources import uploads
from quire.sources.uploads import ingest_files

MARK = b"\xef\xbb\xbf"
BYTES = np.random.default_rng(4).bytes(300_000)
FILES = {
    "plain.pdf": b"%PDF-1.7\nx", "ended.pdf": b"%PDF-1.7\nx\n", "returns.pdf": b"%PDF\r\n\r\n\n", "feed.pdf": b"\n", "feeds.pdf": b"\n" * 7, "one.pdf": b"a",
    "marked.pdf": MARK + b"%PDF-1.7", "marked ended.pdf": MARK + b"%PDF-1.7\n", "mark alone.pdf": MARK, "mark feed.pdf": MARK + b"\n", "two marks.pdf": MARK + MARK + b"x", "half a mark.pdf": MARK[:2],
    "a+b 100% ü#?.PDF": b"\x89PNG\r\n\x1a\n" + BYTES[:5000], "below/large.png": b"\x89PNG\r\n\x1a\n" + BYTES, "below/long.png": b"\x00" * 200_000, "same.png": b"\x89PNG\r\n\x1a\n" + BYTES,
    "empty.pdf": b"", "other.txt": b"x",
}


@pytest.mark.parametrize("split", ["128m", "20000b"])
def test_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(uploads, "PIECE_BYTES", 700)
    for name, content in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = ingest_files(spark, str(tmp_path), content=False).collect()
        small = ingest_files(spark, str(tmp_path), content=False, max_bytes=10).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = ingest_files(spark, str(tmp_path)).drop("content").collect()
    assert got[0].asDict().keys() == want[0].asDict().keys()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and len(got) == len(FILES) - 2
    told = {r.name: r.sha256 for r in got}
    assert told == {n.split("/")[-1]: hashlib.sha256(c).hexdigest() for n, c in FILES.items() if n.split("/")[-1] in told}
    assert {r.name for r in small} == {n for n, c in FILES.items() if 0 < len(c) <= 10 and n.lower().endswith("pdf")}


def test_the_query_holds_no_file_whole(spark, root):
    """The reader of whole files makes each a row; one beyond 2 GB is no row at all."""
    files = QUERIES["ingest_files"](spark, root)
    text, whole = (files._jdf.queryExecution().executedPlan().toString().split(f"FileScan {kind}")[1].split("FileScan")[0] for kind in ("text", "binaryFile"))
    assert "file_size" in text and "LessThanOrEqual(length,3)" in whole
    assert sorted(map(tuple, files.collect())) == sorted(map(tuple, ingest_files(spark, root, extensions=("parquet",)).drop("content").collect()))
