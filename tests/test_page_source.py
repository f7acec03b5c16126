"""Pages read from files through the data source, with a text stand-in as parser."""

from evidentia.sources import page_source
from evidentia.sources.page_source import PageTextSource, Share, read_page_files, shares


class Pages:
    """A document whose third page can't be read."""

    def __init__(self, data):
        self.parts = data.decode("utf-8").split("\f")

    def __len__(self):
        return len(self.parts)

    def __getitem__(self, i):
        if self.parts[i] == "bad page":
            raise ValueError("no text here")
        return None if self.parts[i] == "none" else self.parts[i]


def files(folder):
    (folder / "sub").mkdir()
    (folder / "a.txt").write_text("one\ftwo\fthree", "utf-8")
    (folder / "sub" / "b.txt").write_text("page é\f\fnone", "utf-8")
    (folder / "broken.txt").write_bytes(b"\xff\xfe\xff")
    (folder / "empty.txt").write_bytes(b"")
    (folder / "other.csv").write_text("x")
    (folder / "long.txt").write_text("\f".join(f"page {i} " + "x" * 50 for i in range(1, 1001)), "utf-8")


def test_pages_and_errors(spark, tmp_path):
    files(tmp_path)
    pages, rejects = read_page_files(spark, f"file://{tmp_path}", "*.txt")
    got = {(r.document_id.rsplit("/", 1)[1], r.pdf_page): r.text for r in pages.collect()}
    assert {k: v for k, v in got.items() if k[0] != "long.txt"} == {("a.txt", 1): "one", ("a.txt", 2): "two", ("a.txt", 3): "three", ("b.txt", 1): "page é", ("b.txt", 2): "", ("b.txt", 3): "none"}
    assert [got["long.txt", i].split(" x")[0] for i in range(1, 1001)] == [f"page {i}" for i in range(1, 1001)]
    (bad,) = rejects.collect()
    assert bad.document_id.endswith("broken.txt") and bad.pdf_page is None and bad.error.startswith("UnicodeDecodeError")


def test_a_long_file_is_shared_out_and_a_bad_page_is_a_row(spark, tmp_path):
    files(tmp_path)
    (tmp_path / "c.txt").write_text("good\fbad page\fnone", "utf-8")
    spark.dataSource.register(PageTextSource)
    rows = spark.read.format("page_text").option("pattern", "*.txt").option("bytes", 5000).option("parser", f"{__name__}:Pages").load(f"file://{tmp_path}")
    got = rows.collect()
    assert rows.rdd.getNumPartitions() > 10 and len({(r.document_id, r.pdf_page) for r in got}) == len(got)
    assert sorted(r.pdf_page for r in got if r.document_id.endswith("long.txt")) == list(range(1, 1001))
    assert {(r.pdf_page, r.text, r.error) for r in got if r.document_id.endswith("c.txt")} == {(1, "good", None), (2, None, "ValueError: no text here"), (3, "", None)}


def test_without_text_no_page_is_parsed(spark, tmp_path):
    (tmp_path / "c.txt").write_text("good\fbad page", "utf-8")
    spark.dataSource.register(PageTextSource)
    rows = spark.read.format("page_text").schema("document_id string, pdf_page int, error string").option("parser", f"{__name__}:Pages").load(f"file://{tmp_path}")
    assert sorted((r.pdf_page, r.error) for r in rows.collect()) == [(1, None), (2, None)]


def test_no_files(spark, tmp_path):
    assert all(part.count() == 0 for part in read_page_files(spark, f"file://{tmp_path}"))
    assert read_page_files(spark, f"file://{tmp_path}/absent")[0].count() == 0


def test_files_are_packed_by_size():
    packed = shares([("a", 4), ("b", 5), ("c", 25), ("d", 3), ("e", 0)], 10)
    assert [p.files for p in packed] == [[("c", 0, 3)], [("c", 1, 3)], [("c", 2, 3)], [("a", 0, 1), ("b", 0, 1)], [("d", 0, 1), ("e", 0, 1)]]
    assert shares([], 10) == [] and isinstance(packed[0], Share) and page_source.form_feeds(b"") == []
