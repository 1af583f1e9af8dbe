"""Format detection and record scans of document containers.

``scan`` turns binaryFile rows into records, units and assets in one pass over each file; a file that cannot be read becomes one row
with its error. Records carry ``kind`` (units, records, assets), so callers pick a branch by a filter.
"""

from __future__ import annotations

import csv
import hashlib
import io
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: suffixes, signatures, required container parts and media types
SUFFIXES = {".pdf": "pdf", ".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg", ".tif": "tiff", ".tiff": "tiff", ".docx": "docx", ".pptx": "pptx", ".xlsx": "xlsx", ".csv": "csv", ".html": "html", ".htm": "html", ".md": "markdown", ".markdown": "markdown", ".epub": "epub", ".odt": "odt", ".odp": "odp", ".ods": "ods"}
SIGNATURES = {"pdf": ["255044462D"], "png": ["89504E470D0A1A0A"], "jpeg": ["FFD8FF"], "tiff": ["49492A00", "4D4D002A"]}
PARTS = {"docx": {"[Content_Types].xml", "word/document.xml"}, "pptx": {"[Content_Types].xml", "ppt/presentation.xml"}, "xlsx": {"[Content_Types].xml", "xl/workbook.xml"}}
MIMETYPES = {"odt": b"application/vnd.oasis.opendocument.text", "odp": b"application/vnd.oasis.opendocument.presentation", "ods": b"application/vnd.oasis.opendocument.spreadsheet", "epub": b"application/epub+zip"}
MEDIA = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff", ".svg": "image/svg+xml", ".webp": "image/webp"}
MAX_ENTRIES, MAX_EXPANDED = 10_000, 1_000_000_000

RECORD = "path string, kind string, unit_id string, unit_kind string, seq int, type string, text string, anchor string, cells array<struct<row:int,col:int,text:string>>, sha256 string, media_type string, error string"


def format_of(path: Column, content: Column) -> Column:
    """The format by suffix where the first bytes agree, else null. Containers and encodings are checked by ``scan``."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    fmt = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[suffix]
    head = F.hex(F.substring(content, 1, 8))
    wrong = F.lit(False)
    for name, heads in SIGNATURES.items():
        ok = F.lit(False)
        for h in heads:
            ok = ok | F.startswith(head, F.lit(h))
        wrong = wrong | ((fmt == name) & ~ok)
    return F.when(~wrong, fmt)


def discover(spark: SparkSession, folder: str, suffixes: list[str]) -> DataFrame:
    """Files of a folder by suffix, not below it, each once, in order of lowered name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes)).dropDuplicates(["path"]).orderBy(F.lower("path"))


def validated(files: DataFrame, max_bytes: int) -> DataFrame:
    """Identity, hash and a reason to refuse (empty, too large, unknown format)."""
    f = files.withColumn("format", format_of(F.col("path"), F.col("content"))).withColumn("sha256", F.sha2("content", 256))
    return f.withColumn("error", F.when(F.length("content") == 0, "empty file").when(F.length("content") > max_bytes, "file is too large").when(F.col("format").isNull(), "unsupported format or signature"))


def guarded(data: bytes) -> zipfile.ZipFile:
    """An archive within its limits."""
    z = zipfile.ZipFile(io.BytesIO(data))
    if len(z.infolist()) > MAX_ENTRIES:
        raise ValueError("archive has too many entries")
    if sum(i.file_size for i in z.infolist()) > MAX_EXPANDED:
        raise ValueError("archive expands too far")
    return z


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attr(node, name: str, default=None):
    return next((v for k, v in node.attrib.items() if _name(k) == name), default)


def _said(node) -> str:
    return " ".join("".join(node.itertext()).split())


def _inside(node, name: str):
    return (x for x in node.iter() if _name(x.tag) == name)


class _Tree(HTMLParser):
    """A light tree of an HTML text; stray end tags are passed over, an end tag closes what stands open inside it."""

    EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.root = {"tag": "", "path": "", "attrs": {}, "items": [], "seen": {}}
        self.open = [self.root]
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        up = self.open[-1]
        n = up["seen"][tag] = up["seen"].get(tag, 0) + 1
        node = {"tag": tag, "path": f"{up['path']}/{tag}[{n}]", "attrs": dict(attrs), "items": [], "seen": {}}
        up["items"].append(node)
        if tag not in self.EMPTY:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k]["tag"] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1]["items"].append(data)


BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "table"}


def _nodes(node):
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(i for i in reversed(x["items"]) if isinstance(i, dict))


def _strings(node):
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                yield x.strip()
        elif x["tag"] not in ("script", "style"):
            todo.extend(reversed(x["items"]))


def html_blocks(text: str, prefix: str = ""):
    """(type, text, path) of the leaf blocks, tables as a whole; then the images."""
    root = _Tree(text).root
    for n in _nodes(root):
        if n["tag"] in BLOCKS and (n["tag"] == "table" or not any(x["tag"] in BLOCKS for x in _nodes(n) if x is not n)):
            said = " ".join(_strings(n))
            if said:
                yield "table" if n["tag"] == "table" else "text", said, prefix + n["path"], None
    for n in _nodes(root):
        if n["tag"] == "img":
            yield "image", n["attrs"].get("alt"), prefix + n["path"], n["attrs"].get("src")


def markdown_blocks(text: str):
    """(type, text, anchor) of blocks between blank lines."""
    lines, start = text.splitlines(), 0
    for i in range(len(lines) + 1):
        if i < len(lines) and lines[i].strip():
            continue
        block, first, start = lines[start:i], start + 1, i + 1
        if not block:
            continue
        if all(x.lstrip().startswith("|") for x in block):
            rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in block if not re.fullmatch(r"\s*\|?(?:\s*:?-+:?\s*\|)+\s*", x)]
            yield "table", " ".join(c for r in rows for c in r), f"/markdown/lines[{first}:{i}]", rows
        else:
            yield "text", re.sub(r"^(?:#{1,6}|[-*+] |\d+[.)] )\s*", "", "\n".join(block)).strip(), f"{first}:1-{i}:{len(block[-1]) + 1}", None


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _range(cells: dict[tuple[int, int], str]) -> tuple[str, list]:
    """The used range and the cells relative to it."""
    r0, r1 = min(r for r, _ in cells), max(r for r, _ in cells)
    c0, c1 = min(c for _, c in cells), max(c for _, c in cells)
    return f"{column_letters(c0)}{r0}:{column_letters(c1)}{r1}", [(r - r0, c - c0, v) for (r, c), v in sorted(cells.items())]


def _xlsx(z: zipfile.ZipFile):
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    rels = {_attr(r, "Id"): _attr(r, "Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    shared = [_said(si) for si in _inside(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    for n, sheet in enumerate(_inside(book, "sheet"), 1):
        target = rels[sheet.attrib.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")]
        name = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
        cells = {}
        for c in _inside(ElementTree.fromstring(z.read(name)), "c"):
            m = re.fullmatch(r"([A-Z]+)(\d+)", c.attrib["r"])
            col = 0
            for ch in m[1]:
                col = col * 26 + ord(ch) - 64
            formula, value = next(_inside(c, "f"), None), next(_inside(c, "v"), None)
            if formula is not None and formula.text:
                said = "=" + formula.text
            elif c.attrib.get("t") == "inlineStr":
                said = _said(c)
            elif value is not None and value.text is not None:
                said = shared[int(value.text)] if c.attrib.get("t") == "s" else value.text
            else:
                continue
            cells[(int(m[2]), col)] = said
        yield f"sheet-{n}", "sheet", n, cells and ("table", " ".join(v for _, v in sorted(cells.items())), f"{sheet.attrib['name']}!{_range(cells)[0]}", _range(cells)[1])


def _odf(z: zipfile.ZipFile, fmt: str):
    body = next(_inside(ElementTree.fromstring(z.read("content.xml")), "body"))
    if fmt == "ods":
        for n, t in enumerate(_inside(body, "table"), 1):
            cells, r = {}, 0
            for row in _inside(t, "table-row"):
                repeat, c, here = int(_attr(row, "number-rows-repeated", 1)), 0, {}
                for cell in row:
                    if _name(cell.tag) in ("table-cell", "covered-table-cell"):
                        times, said = int(_attr(cell, "number-columns-repeated", 1)), _said(cell)
                        if said:
                            here |= {c + k: said for k in range(times)}
                        c += times
                if here:
                    cells |= {(r + k + 1, c + 1): v for k in range(repeat) for c, v in here.items()}
                r += repeat
            yield f"sheet-{n}", "sheet", n, [("table", " ".join(v for _, v in sorted(cells.items())), f"{_attr(t, 'name')}!{_range(cells)[0]}", _range(cells)[1])] if cells else []
        return
    holders = list(_inside(body, "page")) if fmt == "odp" else [body]
    for n, holder in enumerate(holders, 1):
        out, count = [], {}
        def walk(node, path):
            for x in node:
                name = _name(x.tag)
                here = (path, name)
                count[here] = count.get(here, 0) + 1
                at = f"{path}/{name}[{count[here]}]"
                if name in ("p", "h"):
                    if said := _said(x):
                        out.append(("text", said, at, None))
                elif name == "table":
                    out.append(("table", " ".join(_said(c) for c in _inside(x, "table-cell")), at, None))
                else:
                    walk(x, at)
        walk(holder, f"/content/page[{n}]" if fmt == "odp" else "/content/body")
        yield (f"slide-{n}", "slide", n, out) if fmt == "odp" else ("document-1", "document", 1, out)


def read_file(fmt: str, data: bytes):
    """(kind, unit_id, unit_kind, seq, type, text, anchor, cells, sha256, media_type) of one file."""
    def asset(unit, seq, name, blob):
        return ("asset", unit, None, seq, "image", PurePosixPath(name).name, f"/{name}", None, hashlib.sha256(blob).hexdigest(), MEDIA.get(PurePosixPath(name).suffix.lower()))

    def unit(uid, kind, n, records):
        yield ("unit", uid, kind, n, None, None, None, None, None, None)
        for k, (typ, said, anchor, cells) in enumerate(records, 1):
            yield ("record", uid, kind, k, typ, said, anchor, cells, None, None)

    if fmt in PARTS or fmt in MIMETYPES:
        z = guarded(data)
        names = set(z.namelist())
        if not PARTS.get(fmt, set()) <= names:
            raise ValueError("container misses required parts")
        if fmt in MIMETYPES and ("mimetype" not in names or z.read("mimetype") != MIMETYPES[fmt]):
            raise ValueError("container has an invalid mimetype")
    media = {"docx": "word/media/", "pptx": "ppt/media/"}.get(fmt)
    if fmt == "docx":
        body, count, out = next(_inside(ElementTree.fromstring(z.read("word/document.xml")), "body")), {"p": 0, "tbl": 0}, []
        for x in body:
            name = _name(x.tag)
            if name in count:
                count[name] += 1
                said = _said(x) if name == "p" else " ".join(_said(c) for c in _inside(x, "tc"))
                if said or name == "tbl":
                    out.append(("paragraph" if name == "p" else "table", said, f"/word/document/body/{name}[{count[name]}]", None))
        yield from unit("document-1", "document", 1, out)
    elif fmt == "pptx":
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for n, name in enumerate(slides, 1):
            out = []
            shapes = (x for x in ElementTree.fromstring(z.read(name)).iter() if _name(x.tag) in ("sp", "graphicFrame"))
            for k, shape in enumerate(shapes, 1):
                label = next(_inside(shape, "cNvPr"), None)
                at = f"/ppt/slides/slide[{n}]/shape[id={k if label is None else label.attrib.get('id', k)}]"
                grid = next(_inside(shape, "tbl"), None)
                if grid is not None:
                    out += [("table", _said(grid), at, None)] if _said(grid) else []
                else:
                    out += [("text", _said(p), f"{at}/paragraph[{i}]", None) for i, p in enumerate(_inside(shape, "p"), 1) if _said(p)]
            yield from unit(f"slide-{n}", "slide", n, out)
    elif fmt == "xlsx":
        for uid, kind, n, found in _xlsx(z):
            yield from unit(uid, kind, n, [found] if found else [])
    elif fmt in ("odt", "odp", "ods"):
        for uid, kind, n, out in _odf(z, fmt):
            yield from unit(uid, kind, n, out)
    elif fmt == "epub":
        package = next(_attr(x, "full-path") for x in _inside(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile"))
        tree = ElementTree.fromstring(z.read(package))
        href = {x.attrib["id"]: x.attrib["href"] for x in _inside(tree, "item") if "id" in x.attrib}
        for n, item in enumerate(_inside(tree, "itemref"), 1):
            own = href[item.attrib["idref"]]
            name = posixpath.normpath(posixpath.join(posixpath.dirname(package), own))
            found = list(html_blocks(z.read(name).decode(), f"epub:{own}:"))
            yield from unit(f"section-{n}", "section", n, [(t, s, a, None) for t, s, a, _ in found if t != "image"])
            for k, (_, alt, anchor, src) in enumerate((f for f in found if f[0] == "image"), 1):
                target = posixpath.normpath(posixpath.join(posixpath.dirname(name), src or ""))
                yield ("asset", f"section-{n}", None, k, "image", alt, anchor, None, hashlib.sha256(z.read(target)).hexdigest() if src and target in names else None, MEDIA.get(PurePosixPath(src or "").suffix.lower()))
    elif fmt == "csv":
        rows = list(csv.reader(io.StringIO(data.decode("utf-8-sig"))))
        cells = [(r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]
        width = max((len(r) for r in rows), default=1)
        yield from unit("document-1", "document", 1, [("table", " ".join(v for _, _, v in cells), f"rows[1:{len(rows)}]/columns[1:{width}]", cells)] if rows else [])
    elif fmt == "html":
        found = list(html_blocks(data.decode("utf-8-sig")))
        yield from unit("document-1", "document", 1, [(t, s, a, None) for t, s, a, _ in found if t != "image"])
        for k, (_, alt, anchor, src) in enumerate((f for f in found if f[0] == "image"), 1):
            yield ("asset", "document-1", None, k, "image", alt, anchor, None, None, MEDIA.get(PurePosixPath(src or "").suffix.lower()))
    elif fmt == "markdown":
        yield from unit("document-1", "document", 1, [(t, s, a, [(r, c, v) for r, row in enumerate(g) for c, v in enumerate(row)] if g else None) for t, s, a, g in markdown_blocks(data.decode("utf-8-sig"))])
    else:
        raise ValueError(f"no record scan for {fmt}")
    if media:
        for k, name in enumerate(sorted(n for n in names if n.startswith(media)), 1):
            yield asset("document-1" if fmt == "docx" else "slide-1", k, name, z.read(name))


def scan(files: DataFrame) -> DataFrame:
    """Records, units and assets of files (path, content)."""
    typed = files.select("path", "content", format_of(F.col("path"), F.col("content")).alias("format"))
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for path, content, fmt in batch.itertuples(index=False):
                try:
                    if fmt is None:
                        raise ValueError("unsupported format or signature")
                    rows = [(path, *r[:7], None if r[7] is None else [{"row": int(a), "col": int(b), "text": v} for a, b, v in r[7]], *r[8:], None) for r in read_file(fmt, bytes(content))]
                except Exception as e:  # one bad file is one error row, never a failed job
                    rows = [(path, "error", *[None] * 9, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names).astype({"seq": "Int32"})

    return typed.mapInPandas(run, RECORD)


def unit_counts(scanned: DataFrame) -> DataFrame:
    """S3: natural units of each file."""
    return scanned.where("kind = 'unit'").groupBy("path", "unit_kind").agg(F.count(F.lit(1)).alias("n_units"))


def in_range(df: DataFrame, index: str, start: int, end: int) -> DataFrame:
    """P5: rows of an inclusive 1-based range; a plain predicate, so it reaches the scan."""
    return df.where(F.col(index).between(start, end))


def html_records(pages: DataFrame, key: str, column: str) -> DataFrame:
    """S13 over a table of HTML texts: key, seq, type, text, path."""
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for batch in batches:
            rows = [(k, n, t, s, p) for k, h in batch.itertuples(index=False) for n, (t, s, p, _) in enumerate((b for b in html_blocks(h or "") if b[0] != "image"), 1)]
            yield pd.DataFrame(rows, columns=[key, "seq", "type", "text", "path"])

    return pages.select(key, column).mapInPandas(run, f"{key} {kind}, seq int, type string, text string, path string")


def markdown_documents(files: DataFrame) -> DataFrame:
    """Title, summary, headings and word count of Markdown texts (path, text), as column expressions."""
    body = F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", "")
    heads = F.regexp_extract_all(body, F.lit(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$"), F.lit(1))
    plain = F.regexp_replace(body, r"(?m)^#{1,6}[ \t]+.*$", "")
    return files.select("path", F.coalesce(F.try_element_at(heads, F.lit(1)), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("title"), F.trim(F.regexp_extract(plain, r"(?s)\S[^\n]*(?:\n[^\n]+)*", 0)).alias("summary"), heads.alias("headings"), F.coalesce(F.regexp_count(body, F.lit(r"\S+")), F.lit(0)).alias("n_words"))


def schema_fields(text: str) -> list[dict]:
    """Fields (name, description, type) of a Markdown schema, either one table or bullets ``- **name** (type): description``."""
    lines = text.lstrip("﻿").splitlines()
    split = lambda x: [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", x.strip().strip("|"))]
    tables = [i for i, x in enumerate(lines) if [c.lower() for c in split(x)][:2] == ["field name", "description"]]
    bullets = [m for x in lines if (m := re.match(r"^\s*[-*]\s+(?:\*\*|`)?([^*`:(]+?)(?:\*\*|`)?\s*(?:\(([^)]*)\))?\s*:\s*(.*)$", x))]
    if tables and bullets:
        raise ValueError("a schema has a table or bullets, not both")
    out = []
    if tables:
        head = [c.lower() for c in split(lines[tables[0]])]
        for x in lines[tables[0] + 2 :]:
            if not x.strip():
                break
            cells = split(x)
            if len(cells) != len(head):
                raise ValueError("a table row has another number of cells than its head")
            out.append({"name": cells[0], "description": cells[1], "type": (cells[2] if len(cells) > 2 else "") or "string"})
    out += [{"name": m[1].strip(), "description": m[3].strip(), "type": m[2] or "string"} for m in bullets]
    if not out:
        raise ValueError("a schema has fields")
    if len({f["name"].lower() for f in out}) < len(out):
        raise ValueError("field names are unique")
    return out


def snapshot(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Path, category by the first matching pattern, hash and size of repository files (path, content)."""
    category = F.lit("other")
    for pattern, name in reversed(rules):
        category = F.when(F.col("path").rlike(pattern), name).otherwise(category)
    return files.select("path", category.alias("category"), F.sha2("content", 256).alias("sha256"), F.length("content").alias("size"))
