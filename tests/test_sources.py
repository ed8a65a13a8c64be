"""Directory scans, formats and their registration, workbooks, faults."""

import pytest
from pyspark.sql import functions as F
from sample import SAMPLE_PAGE, workbook

from doctables.operators.clean import clean_sheet, name_columns, normalize_missing
from doctables.operators.profile import profile_grids
from doctables.sources.extract import (
    DEFAULT_FORMATS,
    Formats,
    extract_files,
    extract_pages,
    extract_sheet,
    file_documents,
    list_sheets,
    missing_files,
    page_documents,
    route,
    scan_directory,
)
from doctables.sources.grids import cap_tables, outcomes, tables
from doctables.sources.html_tables import ParsedTable

BOOK = workbook(
    {
        "Stock": [
            ["Item", None, "Count", "Empty", "When"],
            ["Sword", "inline:x <y>", 3, None, 45292],
            [None, None, None, None, None],
            ["Pick", None, 4.5, None, 45293.5],
            [True, None, None, None, None],
        ],
        "Blank": [],
        "Other": [["h"], ["v"]],
    },
    dates=("E2", "E4"),
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    (root / "guide.html").write_text(SAMPLE_PAGE)
    (root / "UPPER.HTM").write_text("<p>no tables</p>")
    (root / "book.xlsx").write_bytes(BOOK)
    (root / "broken.xlsx").write_bytes(b"not a zip")
    (root / "old.xls").write_bytes(b"\xd0\xcf")
    (root / "notes.txt").write_text("text")
    (root / "sub").mkdir()
    (root / "sub" / "deep.html").write_text("<table><tr><td>1<td>2</table>")
    return str(root)


def documents(spark, folder, recursive=False):
    return file_documents(scan_directory(spark, folder, recursive))


def stems(df):
    return sorted(r["source_file"].rsplit("/", 1)[1] for r in df.select("source_file").distinct().collect())


def test_scan(spark, folder):
    assert stems(documents(spark, folder)) == ["UPPER.HTM", "book.xlsx", "broken.xlsx", "guide.html", "old.xls"]
    assert "deep.html" in stems(documents(spark, folder, recursive=True))
    with pytest.raises(FileNotFoundError):
        scan_directory(spark, folder + "/missing")
    with pytest.raises(NotADirectoryError):
        scan_directory(spark, folder + "/notes.txt")


def test_extraction_never_fails(spark, folder):
    done = extract_files(documents(spark, folder))
    out = {r["source_file"].rsplit("/", 1)[1]: r for r in outcomes(done).collect()}
    assert {k: (r["tables_found"], r["ok"]) for k, r in out.items()} == {
        "UPPER.HTM": (0, True), "book.xlsx": (2, True), "broken.xlsx": (0, False),
        "guide.html": (2, True), "old.xls": (0, False),
    }
    assert "not a zip file" in out["broken.xlsx"]["error"]
    ids = {r["table_id"] for r in tables(done).collect()}
    assert ids == {"guide_table_1", "guide_table_2", "book_Stock", "book_Other"}
    assert cap_tables(done, 1).filter("ordinal > 0").count() == 2


def test_sample_page_schema(spark, folder):
    guide = tables(extract_files(documents(spark, folder))).filter(F.col("table_id").startswith("guide"))
    done = profile_grids(name_columns(normalize_missing(guide))).orderBy("ordinal").collect()
    assert done[0]["labels"] == ["string", "integer", "integer", "integer", "float", "boolean"]
    assert done[1]["labels"] == ["string", "integer", "string", "integer"]
    assert done[0]["body"][0] == ["Grey Point", "1874", "212", "48310", "31.5", "yes"]
    assert (done[0]["n_rows"], done[1]["n_cols"]) == (4, 4)


def test_workbook(spark, folder):
    books = documents(spark, folder).filter(F.col("source_file").endswith("book.xlsx"))
    names = list_sheets(documents(spark, folder).filter(F.col("source_file").endswith(".xlsx")))
    assert [r["sheet_name"] for r in names.orderBy("sheet_pos").collect()] == ["Stock", "Blank", "Other"]
    stock = clean_sheet(tables(extract_sheet(books, "Stock"))).first()
    assert stock["header"] == [["Item", "Column_2", "Count", "When"]]
    assert stock["body"] == [
        ["Sword", "x <y>", "3", "2024-01-01 00:00:00"],
        ["Pick", "", "4.5", "2024-01-02 12:00:00"],
        ["True", "", "", ""],
    ]
    assert tables(extract_sheet(books, "Nowhere")).count() == 0


def test_route_and_missing(spark):
    df = spark.createDataFrame([("a/x.HTML",), ("b/.html",), ("c/y.pdf",), ("d/noext",)], "source_file string")
    got = {r["source_file"]: r for r in route(df).collect()}
    assert got["a/x.HTML"]["format"] == "html" and got["a/x.HTML"]["error"] is None
    assert got["b/.html"]["format"] is None
    assert got["c/y.pdf"]["error"] == (
        "No extractor found for file: c/y.pdf (extension: .pdf). Supported extensions: .htm, .html, .xls, .xlsx"
    )
    seen = df.select(F.col("source_file").alias("path"))
    wanted = seen.unionByName(spark.createDataFrame([("gone.html",)], "path string"))
    assert [r["path"] for r in missing_files(wanted, seen).collect()] == ["gone.html"]


def test_formats(spark):
    def one(content):
        return [ParsedTable("table_1", None, [["a"]], [["1"]])]

    def two(content):
        return [ParsedTable(f"t{i}", None, [["b"]], [[content.decode()]]) for i in (1, 2)]

    formats = Formats().register("one", [".test1"], one).register("two", [".TEST2", ".test1"], two)
    assert formats.names() == ["one", "two"] and formats.extensions() == [".test1", ".test2"]
    assert formats.by_extension()[".test1"].name == "two"  # the later one wins
    docs = spark.createDataFrame([("1", "x.test1", bytearray(b"q")), ("2", "y.unsupported", bytearray(b""))],
                                 "doc_id string, source_file string, content binary")
    found = tables(extract_files(docs, formats)).orderBy("ordinal").collect()
    assert [(r["table_id"], r["body"]) for r in found] == [("x_t1", [["q"]]), ("x_t2", [["q"]])]
    failed = outcomes(extract_files(docs, formats)).filter("not ok").first()
    assert failed["error"].startswith("No extractor found for file: y.unsupported")
    left, was = formats.unregister("two")
    assert was and left.by_extension()[".test1"].name == "one"
    assert left.unregister("none") == (left, False)
    assert DEFAULT_FORMATS.subset(["html"]).extensions() == [".htm", ".html"]
    with pytest.raises(ValueError):
        DEFAULT_FORMATS.subset(["html", "nope"])
    with pytest.raises(TypeError):
        Formats().register("bad", [".x"], "not a function")
    with pytest.raises(ValueError):
        Formats().register("bad", ["x"], one)


def test_pages_without_tables_stay_in_the_jvm(spark):
    pages = spark.createDataFrame([("http://x/a.html", "<p>" * 1000), ("http://x/b.html", "<TABLE><tr><td>1")], "url string, html string")
    done = extract_pages(page_documents(pages))
    assert sorted((r["source_file"], r["tables_found"]) for r in outcomes(done).collect()) == [
        ("http://x/a.html", 0), ("http://x/b.html", 1),
    ]
