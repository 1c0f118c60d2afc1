"""A Python data source for a library's book files: one partition a file, read-only.

    spark.dataSource.register(BookFiles)
    spark.read.format("bookfiles").option("root", root).option("table", "pages").load()

Options: root; table, pages (the default) or toc; ids, a comma-separated list of books (default: all files found). The files must
be reachable from the executors. A file that can't be read is a row with its error, so the others are not lost with it.

Filters on book_id choose the files, and filters on page_id go into the statement that reads a file, where its page ids are its row ids; both with the
option filters=true in a session that has spark.sql.python.filterPushdown.enabled, as read() sets them. Spark evaluates every filter again, so a file that can't use them gives the same rows.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from quire.errors import QuireError
from quire.sources.library import introspect, open_read_only, probe_book, probe_catalogue, quoted, shard_path

SCHEMAS = {
    "pages": "book_id string, page_id int, part string, printed_page double, body string, error string",
    "toc": "book_id string, title_id int, page_id int, level int, title string, error string",
}
#: Rows of a batch.
FETCH_ROWS = 2000
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


class BookFile(InputPartition):
    def __init__(self, book_id: str, path: str):
        self.book_id, self.path = book_id, path


def text_of(value) -> str | None:
    value = str(value).strip() if value is not None else ""
    return value or None


def number_of(value) -> float | None:
    try:
        n = float(value)
    except (TypeError, ValueError):
        return None
    return n if n - n == 0 else None


def int_of(value) -> int | None:
    n = number_of(value)
    return int(n) if n is not None and abs(n) < 2**31 else None


class BookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.table = options["root"], options.get("table", "pages")
        self.ids = [x for x in options.get("ids", "").split(",") if x] or None
        self.books: set[str] | None = None  # by the filters; None: all
        self.pages: list[tuple[str, list[int]]] = []  # conditions on a page's id, each with its values

    def _condition(self, con: sqlite3.Connection, table: str, column: str | None) -> tuple[str, list[int]]:
        """What a file's statement can say of the filters: nothing, unless its page ids are row ids, which are whole numbers."""
        own = [(kind or "").upper() for _, name, kind, _, _, key in con.execute(f"pragma table_info({quoted(table)})") if name == column and key == 1] if column else []
        if not self.pages or own != ["INTEGER"]:
            return "", []
        return " where " + " and ".join(f"{quoted(column)} {test}" for test, _ in self.pages), [v for _, values in self.pages for v in values]

    def partitions(self) -> list[BookFile]:
        folder = Path(self.root) / "database"
        files = {p.stem: str(p) for p in sorted(folder.glob("book/*/*.db"))}
        wanted = files if self.ids is None else {b: str(folder / (shard_path(b) or "")) for b in self.ids}
        return [BookFile(b, p) for b, p in wanted.items() if self.books is None or b in self.books]

    def read(self, partition: BookFile) -> Iterator[pa.RecordBatch]:
        book = partition.book_id
        try:
            con = open_read_only(partition.path)
            profile = probe_book(introspect(con))
        except QuireError as e:
            yield _batch(self.table, [(book, None, None, None, None, e.code)])
            return
        r = profile.roles
        role = lambda name: quoted(r[name]) if r[name] else "null"
        if self.table == "pages":
            where, values = self._condition(con, profile.tables["pages"], r["page_id"])
            rows = con.execute(f"select {role('page_id')}, {role('page_part')}, {role('page_printed')}, {role('page_text')} from {quoted(profile.tables['pages'])}{where} order by 1", values)
            while some := rows.fetchmany(FETCH_ROWS):
                yield _batch(self.table, [(book, int_of(i), text_of(part), number_of(printed), None if body is None else str(body), None) for i, part, printed, body in some])
        elif profile.tables["titles"]:
            rows = con.execute(f"select {role('title_id')}, {role('title_page')}, {role('title_level')}, {role('title_text')} from {quoted(profile.tables['titles'])}")
            while some := rows.fetchmany(FETCH_ROWS):
                if held := [(book, int_of(i), int_of(page), int_of(level) or 1, text_of(title), None) for i, page, level, title in some if int_of(page) is not None]:
                    yield _batch(self.table, held)
        con.close()


class FilteringReader(BookReader):
    """A reader that takes filters. Spark wants the session to allow that, or it fails; so it is asked for by the option filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            values = [f.value] if type(f) in signs else [v for v in f.value if v is not None] if type(f) is In else None
            if values is not None and f.attribute == ("book_id",) and type(f) in (EqualTo, In):
                self.books = {str(v) for v in values} if self.books is None else self.books & {str(v) for v in values}
            elif values is not None and f.attribute == ("page_id",) and self.table == "pages":
                self.pages.append((signs[type(f)] + " ?" if type(f) in signs else f"in ({', '.join('?' * len(values))})", values))
        return filters


def _batch(table: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as one Arrow batch of the table's schema."""
    fields = [f.split() for f in SCHEMAS[table].split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


class BookFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bookfiles"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "pages")]

    def reader(self, schema) -> BookReader:
        return (FilteringReader if self.options.get("filters") == "true" else BookReader)(dict(self.options))


def read(spark: SparkSession, root: str, table: str = "pages") -> DataFrame:
    """A table of all book files below root, with filters on book and page pushed into them; allows this session's Python sources to take filters."""
    spark.dataSource.register(BookFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("bookfiles").option("root", root).option("table", table).option("filters", "true").load()


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """The catalogue of a library (one small file, read on the driver) in the form of quire.schema.BOOK."""
    from quire.schema import BOOK

    con = open_read_only(str(Path(root) / "database" / "master.db"))
    tables = introspect(con)
    p = probe_catalogue(tables)
    r, t = p.roles, p.tables
    col = lambda of, name: f"{of}.{quoted(r[name])}" if r[name] else "null"
    joins, author, category = "", col("b", "book_author_name"), "null"
    if not r["book_author_name"] and t["authors"] and r["author_key"] and r["author_name"] and r["book_author_ref"]:
        joins += f" left join {quoted(t['authors'])} a on {col('a', 'author_key')} = {col('b', 'book_author_ref')}"
        author = col("a", "author_name")
    if t["categories"] and r["category_key"] and r["category_name"] and r["book_category_ref"]:
        joins += f" left join {quoted(t['categories'])} c on {col('c', 'category_key')} = {col('b', 'book_category_ref')}"
        category = col("c", "category_name")
    flag = next((f"b.{quoted(c)}" for c in tables[t["books"]] if c.lower() == "major_ondisk"), "null")
    rows = []
    for x in con.execute(f"select {col('b', 'book_id')}, {col('b', 'book_title')}, {author}, {col('b', 'book_category_ref')}, {category}, {flag} from {quoted(t['books'])} b{joins}"):
        book = text_of(x[0])
        if book:
            path = Path(root) / "database" / (shard_path(book) or "none")
            here = path.is_file()
            rows.append((book, text_of(x[1]), text_of(x[2]), text_of(x[3]), text_of(x[4]), here and (x[5] is None or (number_of(x[5]) or 0) > 0), str(path) if here else None))
    con.close()
    return spark.createDataFrame(rows, BOOK)
