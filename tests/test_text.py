"""Literal and brute-force cases of the text rules."""

import random
import re

from pyspark.sql import functions as F

from quire.functions import text
from quire.functions.tokens import fold, match_expression, word_count
from quire.operators import search
from quire.operators.exports import document_markdown, package_manifest, resolve_asset_links, write_documents
from quire.operators.windows import asset_ordinals


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("v")).first()["v"]


def brute_hard_breaks(source: str) -> str:
    """Line-by-line statement of the hard-break rules."""

    def structured(line):
        patterns = (r"\s{4,}", r"\s*#{1,6}\s", r"\s*[-*_]{3,}\s*$", r"\s*[-*+]\s", r"\s*\d+\.\s", r"\s*>")
        return not line.strip() or "|" in line or any(re.match(p, line) for p in patterns)

    lines, out, inside = source.split("\n"), [], None
    for i, line in enumerate(lines):
        marker = next((m for m in ("```", "$$") if line.startswith(m)), None)
        if inside:
            inside = None if marker == inside else inside
        elif marker:
            inside = marker
        elif i + 1 < len(lines):
            following = lines[i + 1]
            plain = not structured(line) and not line.endswith("  ") and not line.strip().endswith("\\")
            if plain and not structured(following) and not following.startswith(("```", "$$")):
                line += "  "
        out.append(line)
    return "\n".join(out)


def test_hard_breaks_match_brute_force(spark):
    rng = random.Random(5)
    pieces = ["```", "```py", "$$", "$$x$$", "plain", "two words", "", "  ", "| a | b |", "# head", "#nohead", "- item",
              "1. one", "> quote", "---", "    code", "end  ", "back\\", "back\\ ", "\ttab", "* * *", "12.x", " $$ no"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", text.hard_breaks(F.col("t")).alias("got")
    ).collect()
    for row in rows:
        assert row["got"] == brute_hard_breaks(row["t"]), row["t"]


def test_hard_breaks_keep_tables_math_and_fences(spark):
    for kept in ("| a | b |\n| - | - |\n| 1 | 2 |\n\n$$\nx = 1\ny = 2\n$$", "```\na\n$$\nb\n```"):
        assert one(spark, text.hard_breaks(F.col("t")), t=kept) == kept


def test_hard_breaks_long_text_does_not_overflow(spark):
    long = "word\n" * 200000 + "end"
    assert one(spark, text.hard_breaks(F.col("t")), t=long) == "word  \n" * 200000 + "end"


def test_soft_breaks_match_lookaround(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", " ", "  ", "\n", "\n\n", "b"]) for _ in range(12)) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", text.soft_breaks(F.col("t")).alias("got")
    ).collect()
    for row in rows:
        assert row["got"] == re.sub(r"(?<!  )(?<!\n)\n(?!\n)", "  \n", row["t"])


def test_math_spans(spark):
    assert one(spark, text.math_spans(F.col("t")), t="costs $12K today and $20K later") == []
    assert one(spark, text.math_spans(F.col("t")), t=r"so $\rho = \frac{\lambda}{\mu}$ holds") == [
        r"\(\rho = \frac{\lambda}{\mu}\)"
    ]
    assert one(spark, text.math_spans(F.col("t")), t="$$a\nb$$ and \\[c\\] and \\(d\\)") == ["$$a\nb$$", "\\[c\\]", "\\(d\\)"]


def scanned_math(t):
    """Math by reading characters: paired delimiters first, then a lone dollar."""
    found, at = [], 0
    while at < len(t):
        end = -1
        for opens, closes in (("$$", "$$"), ("\\[", "\\]"), ("\\(", "\\)")):
            if end < 0 and t.startswith(opens, at) and (close := t.find(closes, at + 2)) >= 0:
                end = close + 2
        if end < 0 and t[at] == "$" and t[at - 1 : at] != "$":
            close = t.find("$", at + 1)
            inner, behind = t[at + 1 : close], t[close + 1 : close + 2]
            if close > at + 1 and "\n" not in inner and not inner[0].isspace() and not inner[-1].isspace() and behind != "$" and not behind.isdigit():
                end = close + 1
        if end > 0:
            found.append(t[at:end])
        at = max(at + 1, end)
    return found


def test_math_spans_match_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["$", "$$", "x", "1", " ", "\n", "\\(", "\\)", "\\[", "\\]"]) for _ in range(14)) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.math_spans(F.col("t")).alias("got")).collect()
    for row in rows:
        found = scanned_math(row["t"])
        want = [f"\\({s[1:-1]}\\)" if s.startswith("$") and not s.startswith("$$") else s for s in found]
        assert row["got"] == want, row["t"]


def test_escape_html_leaves_quotes(spark):
    assert one(spark, text.escape_html(F.col("t")), t='<script>"a" & b') == '&lt;script&gt;"a" &amp; b'


def test_image_refs_are_shortened(spark):
    rows = spark.createDataFrame(
        [("![figure](figure.jpeg)", 3, [("figure.jpeg", "data:image/jpeg;base64,aW1hZ2U=")])],
        "markdown string, page int, images array<struct<id: string, image_base64: string>>",
    )
    got = rows.select(
        text.shorten_image_refs(F.col("markdown"), F.lit("My Report.pdf"), F.col("page"), F.col("images")).alias("v")
    ).first()["v"]
    assert got == "![figure](assets/My_Report-3-image-1.jpg)"


def test_embedded_asset_is_extracted(spark):
    rows = spark.createDataFrame([("![legacy](data:image/png;base64,aW1hZ2U=)",)], "markdown string").withColumn(
        "assets", text.embedded_assets(F.col("markdown"), F.lit("legacy.pdf"), F.lit(1))
    )
    row = rows.select("assets", text.rewrite_embedded(F.col("markdown"), F.col("assets")).alias("markdown")).first()
    assert row["markdown"] == "![legacy](assets/legacy-1-image-1.png)"
    assert bytes(row["assets"][0]["content"]) == b"image"


def test_text_without_embedded_assets_is_untouched(spark):
    rows = spark.createDataFrame([("no image ![x](assets/x.png)\n",)], "markdown string").withColumn(
        "assets", text.embedded_assets(F.col("markdown"), F.lit("a.pdf"), F.lit(1))
    )
    assert rows.select(text.rewrite_embedded(F.col("markdown"), F.col("assets")).alias("v")).first()["v"].startswith("no image")


def test_only_decodable_images_use_an_ordinal(spark):
    rows = spark.createDataFrame(
        [(1, [("a.png", "!!!"), ("b.png", "aW1hZ2U="), ("c", "data:text/plain;base64,aW1hZ2U=")])],
        "document_id int, images array<struct<id: string, image_base64: string>>",
    )
    got = asset_ordinals(rows).collect()
    assert [(r["ordinal"], r["source_ref"], r["mime_type"]) for r in got] == [(1, "b.png", "image/png")]


def test_list_dedupe_keeps_first_spelling(spark):
    rows = spark.createDataFrame([(["Python", "python", "", "SQL", None, "Straße", "STRASSE"],)], "x array<string>")
    assert rows.select(text.dedupe_string_list(F.col("x")).alias("v")).first()["v"] == ["Python", "SQL", "Straße"]


def test_asset_names(spark):
    name = text.asset_filename(F.col("t"), F.lit(1), F.lit(2), F.lit("image/svg+xml"))
    assert one(spark, name, t="  ..weird name?.PDF") == "weird-name-1-image-2.svg"
    assert one(spark, name, t="???.pdf") == "document-1-image-2.svg"


def test_links_of_known_assets_become_urls(spark):
    pages = spark.createDataFrame(
        [("d 1", 1, "s", "![a](assets/x y.png) ![b](assets/x.png) ![c](assets/none.png)")],
        "document_id string, page_number int, session_id string, markdown string",
    )
    assets = spark.createDataFrame([("d 1", "x.png")], "document_id string, filename string")
    got = resolve_asset_links(pages, assets).first()["markdown"]
    assert got == "![a](assets/x y.png) ![b](/api/sessions/s/files/d%201/assets/x.png) ![c](assets/none.png)"


def test_word_count_and_fold(spark):
    assert one(spark, word_count(F.col("t")), t="  a\tb \n c ") == 3
    assert one(spark, word_count(F.col("t")), t=" \n ") == 0
    assert one(spark, fold(F.col("t")), t="ÀÉîõŠß") == "aeiosß"


def test_search_query_text(spark):
    assert one(spark, match_expression(F.col("t")), t="Foo_bar, é!") == '"Foo"* AND "bar"* AND "é"*'
    assert one(spark, match_expression(F.col("t")), t="_ !") is None
    assert one(spark, match_expression(F.col("t")), t="x" * 201) == '"' + "x" * 201 + '"*'
    assert one(spark, match_expression(F.col("t")), t=" ".join("abcdefghijklmnop")).count("AND") == 15


def test_search_over_index_equals_text_search(spark):
    rng = random.Random(8)
    words = ["alpha", "alphabet", "beta", "betamax", "gamma", "Été"]
    rows = [(d, p, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for d in range(30) for p in (1, 2)]
    pages = spark.createDataFrame(rows, "document_id int, page_number int, markdown string")
    index = search.inverted_index(pages)
    size = spark.createDataFrame(
        [(len(rows), sum(len(r[2].split()) for r in rows) / len(rows))], "n_pages long, avg_length double"
    )
    for query in ("alpha beta", "be be ete", "zzz", ""):
        a = {(r[0], r[1]): round(r[2], 9) for r in search.search_pages(index, size, query).collect()}
        b = {(r[0], r[1]): round(r[2], 9) for r in search.search_text(pages, query).collect()}
        assert a == b
        terms = search.search_terms(query)
        folded = {(d, p): t.lower().replace("été", "ete").split() for d, p, t in rows}
        want = {k for k, ws in folded.items() if terms and all(any(w.startswith(t) for w in ws) for t in terms)}
        assert set(a) == want


def test_document_parts_are_written_in_order(spark, tmp_path):
    rows = [(d, p, f"{d}-{p}") for d in (1, 2) for p in range(1, 8)]
    pages = spark.createDataFrame(rows, "document_id int, page_number int, markdown string")
    documents = spark.createDataFrame([(1, 7), (2, 7)], "document_id int, num_pages int")
    write_documents(document_markdown(pages, documents, block=3), str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.groupBy("document_id").count().where("count = 3").count() == 2


def test_document_parts_concatenate_to_the_whole(spark):
    rows = [(1, p, f"text {p}") for p in (2, 3, 5, 9)] + [(2, 1, "only")]
    pages = spark.createDataFrame(rows, "document_id int, page_number int, markdown string")
    documents = spark.createDataFrame([(1, 9, "a.pdf"), (2, 1, "b.png")], "document_id int, num_pages int, document_name string")
    for header in ("comment", "heading"):
        whole = {r["document_id"]: r["markdown"] for r in document_markdown(pages, documents, header).collect()}
        parts = document_markdown(pages, documents, header, block=2).orderBy("document_id", "part").collect()
        for document, text_ in whole.items():
            assert "".join(r["markdown"] for r in parts if r["document_id"] == document) == text_
    comments = {r["document_id"]: r["markdown"] for r in document_markdown(pages, documents).collect()}
    assert comments[2] == "only"
    assert comments[1].startswith("<!-- Page 2 -->\n\ntext 2\n\n---\n\n<!-- Page 3 -->")
    assets = spark.createDataFrame([(1, "x.png", bytearray(b"abc"))], "document_id int, filename string, content binary")
    sizes = {r["path"]: r["bytes"] for r in package_manifest(pages, documents, assets, with_pdf=True).collect()}
    assert sizes == {
        "a_markdown.md": len(comments[1].encode()), "b_markdown.md": 4, "assets/x.png": 3,
        "a_markdown.pdf": None, "b_markdown.pdf": None,
    }


def test_large_embedded_image(spark):
    """Megabytes of base64 pass through the patterns without deep recursion."""
    import base64

    content = bytes(range(256)) * 12000
    packed = base64.b64encode(content).decode()
    rows = spark.createDataFrame([(f"a ![x](data:image/png;base64,{packed}) b",)], "markdown string").withColumn(
        "assets", text.embedded_assets(F.col("markdown"), F.lit("big.pdf"), F.lit(2))
    )
    row = rows.select("assets", text.rewrite_embedded(F.col("markdown"), F.col("assets")).alias("v")).first()
    assert row["v"] == "a ![x](assets/big-2-image-1.png) b"
    assert bytes(row["assets"][0]["content"]) == content


def test_empty_terms_and_other_scripts(spark):
    assert one(spark, text.mark_terms(F.col("t"), []), t="ab") == "ab"
    rows = [(i, 1, w) for i, w in enumerate(["корейский ёлка", "한국 가이드", "ガイド", "Ελλάς", "हिन्दी", "Été"])]
    pages = spark.createDataFrame(rows, "document_id int, page_number int, markdown string")
    for document, _, words in rows:
        for word in words.split():
            assert [r.document_id for r in search.search_text(pages, word).collect()] == [document], word
    assert search.search_excerpt(pages, " !").where("excerpt IS NOT NULL").count() == 0
    assert len(search.search_terms(" ".join("abcdefghijklmnop"))) == 16


def test_excerpt_covers_most_terms(spark):
    """Against all windows, also with more terms than one number has bits."""
    rng = random.Random(11)
    words = [f"t{i:02d}" for i in range(70)] + ["filler"] * 200
    for query, width in (("t00 t01 t02", 4), (" ".join(f"t{i:02d}" for i in range(70)), 6)):
        terms = search.search_terms(query)
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)]
        pages = spark.createDataFrame(list(enumerate(texts)), "document_id int, markdown string")
        for row in search.search_excerpt(pages, query, width, 1).collect():
            own = row.markdown.split()
            starts = sorted({max(0, i - 1) for i, w in enumerate(own) if any(w.startswith(t) for t in terms)})
            if not starts:
                assert row.excerpt is None
                continue
            covers = {s: len({t for t in terms if any(w.startswith(t) for w in own[s : s + width])}) for s in starts}
            best = min(s for s in starts if covers[s] == max(covers.values()))
            want = ("… " if best else "") + " ".join(own[best : best + width]) + (" …" if best + width < len(own) else "")
            assert row.excerpt == want


def test_full_case_folding(spark):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).isalpha() or chr(c).casefold() != chr(c))]
    texts = ["".join(letters[at : at + 400]) for at in range(0, len(letters), 400)] + ["STRASSE", "Straße ΐ ﬃ İI"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.casefold(F.col("t")).alias("got")).collect()
    assert all(r.got == r.t.casefold() for r in rows)


def test_image_links_are_taken_apart(spark):
    given = "a ![x](assets/p q.png) ![y](assets/ok.png)![z](data:image/png;base64,aW1hZ2U=) ![n] (no) ![u](open"
    links = one(spark, text.image_links(F.col("t")), t=given)
    assert [(x.alt, x.target) for x in links] == [(None, None), ("x", "assets/p q.png"), ("y", "assets/ok.png"), ("z", "data:image/png;base64,aW1hZ2U="), (None, None), (None, None)]
    assert one(spark, text.join_links(text.image_links(F.col("t"))), t=given) == given


def test_a_document_of_many_pages_is_one_file(spark, tmp_path):
    from quire.sources.files import write_files

    pages = spark.range(10_000).select(F.lit(1).alias("document_id"), (F.col("id") + 1).cast("int").alias("page_number"), F.concat(F.lit("page é "), "id").alias("markdown"))
    more = spark.createDataFrame([(2, 1, "one"), (3, 1, "a"), (3, 2, "b")], "document_id int, page_number int, markdown string")
    documents = spark.createDataFrame([(1, 10_000), (2, 1), (3, 2)], "document_id int, num_pages int")
    parts = document_markdown(pages.union(more), documents).withColumn("file_name", F.concat(F.lit("d"), "document_id", F.lit(".md")))
    for _ in range(2):  # a second write replaces the files
        write_files(parts, str(tmp_path / "out"), "document_id", "part", "file_name", "markdown")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["d1.md", "d2.md", "d3.md"]
    assert (tmp_path / "out/d1.md").read_text() == "\n\n---\n\n".join(f"<!-- Page {i + 1} -->\n\npage é {i}" for i in range(10_000))
    assert (tmp_path / "out/d2.md").read_text() == "one"
