"""Documents as a data source: spark.read.format("folio_documents") and readStream.

Files are listed once and dealt to partitions by their bytes. Filters on path, format, kind and the number of a unit are taken by the
source: a file that they exclude is never opened, and records of excluded units are not handed on. The stream gives each file once, in
the order of (modified, path), whose last value is its offset. Files are reached by pyarrow's file systems, so any that it knows will do.

options: path (a folder; files below it are not read), partition_bytes (32 MB), and for streams max_files (1000) a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith

from . import formats

NAMES = [c.split()[0] for c in formats.RECORD.split(", ")]
SCHEMA = f"{formats.RECORD}, format string, unit_number int"
ERROR_KIND = "error"


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def listed(path: str) -> list[tuple[str, int, int]]:
    """path, bytes, modified (ns) of the files of a folder, not below it, by name without case."""
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    found = where.get_file_info(fs.FileSelector(at, recursive=False))
    good = [f for f in found if f.is_file and not f.base_name.startswith((".", "_"))]
    return sorted(((f.path, f.size, int(f.mtime_ns or 0)) for f in good), key=lambda f: (f[0].lower(), f[0]))


def format_of(path: str, data: bytes) -> str | None:
    """S1 for one file: the format by suffix where the first bytes agree."""
    dot = path.rfind(".")
    name = formats.SUFFIXES.get(path[dot:].lower()) if dot > path.rfind("/") else None
    heads = formats.SIGNATURES.get(name or "")
    return name if not heads or any(data.startswith(bytes.fromhex(h)) for h in heads) else None


def split(files: list[tuple[str, int]], most: int) -> list[Files]:
    """Files in order, as many a partition as fit into its bytes; a larger file stands alone."""
    out, held, size = [], [], 0
    for path, n in files:
        if held and size + n > most:
            out.append(Files(held))
            held, size = [], 0
        held.append((path, n))
        size += n
    return out + ([Files(held)] if held else [])


class Wanted:
    """What pushed filters leave: tests of a file's path, of its format, of a record's kind and of its unit's number."""

    COLUMNS = ("path", "format", "kind", "unit_number")

    def __init__(self):
        self.tests: dict[str, list] = {c: [] for c in self.COLUMNS}

    def take(self, f: Filter) -> bool:
        tests = {
            EqualTo: lambda v: v == f.value, In: lambda v: v in f.value, StringEndsWith: lambda v: v.endswith(f.value), GreaterThan: lambda v: v > f.value, GreaterThanOrEqual: lambda v: v >= f.value,
            LessThan: lambda v: v < f.value, LessThanOrEqual: lambda v: v <= f.value,
        }
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if type(f) not in tests or column not in self.tests:
            return False
        self.tests[column].append((type(f).__name__, f.value))
        return True

    def holds(self, column: str, value) -> bool:
        by = {
            "EqualTo": lambda a: value == a, "In": lambda a: value in a, "StringEndsWith": lambda a: value.endswith(a), "GreaterThan": lambda a: value > a, "GreaterThanOrEqual": lambda a: value >= a,
            "LessThan": lambda a: value < a, "LessThanOrEqual": lambda a: value <= a,
        }
        return value is not None and all(by[name](arg) for name, arg in self.tests[column]) if self.tests[column] else True

    def file(self, path: str) -> bool:
        """By path and by the format that the suffix names; a file whose bytes deny it is an error row of no format."""
        dot = path.rfind(".")
        return self.holds("path", path) and (not self.tests["format"] or self.holds("format", formats.SUFFIXES.get(path[dot:].lower())))


def records(files: Iterable[tuple[str, int]], wanted: Wanted) -> Iterator[tuple]:
    """Rows of the files; a file that cannot be read is one error row."""
    from pyarrow import fs

    for path, _ in files:
        where, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        try:
            with where.open_input_stream(at) as f:
                data = f.read()
            fmt = format_of(path, data)
            if fmt is None:
                raise ValueError("unsupported format or signature")
            numbers: dict[str, int] = {}
            rows = []
            for r in formats.read_file(fmt, data):
                if r[0] == "unit":
                    numbers[r[1]] = r[3]
                cells = None if r[7] is None else [(int(a), int(b), v) for a, b, v in r[7]]
                row = (path, *r[:7], cells, *r[8:], None, fmt, numbers.get(r[1]))
                if wanted.holds("kind", r[0]) and wanted.holds("unit_number", row[-1]) and wanted.holds("format", fmt):
                    rows.append(row)
        except Exception as e:  # one bad file is one error row, never a failed job
            bad = (path, ERROR_KIND, *[None] * (len(NAMES) - 3), f"{type(e).__name__}: {e}", None, None)
            rows = [bad] if wanted.holds("kind", ERROR_KIND) and not wanted.tests["format"] and not wanted.tests["unit_number"] else []
        yield from rows


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("partition_bytes", 32 << 20))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Files]:
        return split([(p, n) for p, n, _ in listed(self.path) if self.wanted.file(p)], self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from records(partition.files, self.wanted)


class Stream(DataSourceStreamReader):
    """Offsets are (modified, path) of the last file handed out."""

    def __init__(self, options: dict):
        self.path, self.most, self.files = options["path"], int(options.get("partition_bytes", 32 << 20)), int(options.get("max_files", 1000))
        self.at: dict = {"modified": -1, "path": ""}

    def _after(self, start: dict, end: dict | None = None) -> list[tuple[int, str, int]]:
        key = lambda o: (o["modified"], o["path"])
        found = sorted((m, p, n) for p, n, m in listed(self.path))
        return [f for f in found if f[:2] > key(start) and (end is None or f[:2] <= key(end))]

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        new = self._after(self.at)[: self.files]
        if new:
            self.at = {"modified": new[-1][0], "path": new[-1][1]}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.at = max(self.at, end, key=lambda o: (o["modified"], o["path"]))
        return split([(p, n) for _, p, n in self._after(start, end)], self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from records(partition.files, Wanted())

    def commit(self, end: dict) -> None:
        pass


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> Stream:
        return Stream(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Documents)
