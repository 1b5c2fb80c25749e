"""Guideline HTML as graphs of nodes, spans and regions.

Parsing is stdlib html.parser under a small tree builder: void elements, implied ends of p, li,
tr, td, th and the like, a tbody around bare rows. It doesn't repair markup as browsers do, so
results for badly nested input may differ from theirs. One document is one row in, many rows out.

Only direct children of the root are walked: headings open sections, p, lists and tables become
nodes, and anything else leaves one residual and its subtree is skipped. The root is body, or an
element named by `root` (for pages whose content stands deeper; an extension).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.session import in_arrow

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What a start tag closes if it is the open element.
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, "thead": {"caption", "colgroup"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
_HEAD = frozenset("title meta link style script base".split())


@dataclass
class Element:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    def text(self) -> str:
        out, todo = [], list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.children))
        return "".join(out)

    def find(self, name: str) -> Element | None:
        todo = [self]
        while todo:
            x = todo.pop()
            if x.name == name:
                return x
            todo.extend(c for c in reversed(x.children) if isinstance(c, Element))
        return None


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.head, self.body = Element("head"), Element("body")
        self.open: list[Element] = [self.body]
        self.in_head = True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "head"):
            return
        if tag == "body":
            self.in_head = False
            return
        if self.in_head and tag in _HEAD:
            element = Element(tag, {k: v or "" for k, v in attrs})
            self.head.children.append(element)
            if tag not in VOID:
                self.open = [self.body, element]
            return
        self.in_head = False
        closes = _CLOSES.get(tag, set())
        while len(self.open) > 1 and self.open[-1].name in closes:
            self.open.pop()
        if tag in _BLOCK and self.open[-1].name == "p":
            self.open.pop()
        if tag == "tr" and self.open[-1].name == "table":
            self._push(Element("tbody"))
        element = Element(tag, {k: v or "" for k, v in attrs})
        self._push(element)
        if tag in VOID:
            self.open.pop()

    def _push(self, element: Element) -> None:
        self.open[-1].children.append(element)
        self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.in_head, self.open = False, [self.body]
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.in_head and len(self.open) == 1:
            if not data.strip():
                return
            self.in_head = False
        children = self.open[-1].children
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)


def parse(html: str) -> Element:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.body


class Rejected(Exception):
    """A table that isn't a plain grid."""


class _Walk:
    """Rows of one document. Ids count up per pool, so their order is document order."""

    def __init__(self, document_id: str):
        self.document_id = document_id
        self.rows: list[dict] = []
        self.count = {"n": 0, "s": 0, "r": 0}
        self.residual_region: dict[str, str] = {}

    def take(self, pool: str) -> str:
        k = self.count[pool]
        self.count[pool] = k + 1
        return f"{pool}.{k}"

    def row(self, part: str, ident: str | None, **rest) -> None:
        self.rows.append({"document_id": self.document_id, "part": part, "ord": len(self.rows), "id": ident, **rest})

    def node(self, kind: str, parent: str | None, attrs: dict[str, str] | None = None) -> str:
        ident = self.take("n")
        self.row("node", ident, kind=kind, parent_id=parent, attrs=list((attrs or {}).items()))
        return ident

    def region(self, node_id: str, span_id: str | None) -> str:
        ident = self.take("r")
        self.row("region", ident, node_ids=[node_id], span_ids=[span_id] if span_id else [])
        return ident

    def span(self, node_id: str, text: str) -> None:
        order = self.count["s"]
        ident = self.take("s")
        self.row("span", ident, node_id=node_id, raw_text=text, reading_order=order)
        self.region(node_id, ident)

    def residual(self, code: str, detail: str, node_id: str) -> None:
        if node_id not in self.residual_region:
            self.residual_region[node_id] = self.region(node_id, None)
        self.row("diagnostic", None, node_id=node_id, code=code, outcome="residual", detail=" ".join(detail.split()), span_ids=[self.residual_region[node_id]])

    def textual(self, kind: str, parent: str, element: Element, attrs: dict[str, str] | None = None) -> None:
        """A node and span for a unit with visible text; none for an empty one."""
        text = element.text()
        if text.strip():
            self.span(self.node(kind, parent, attrs), text)

    def document(self, root: Element) -> None:
        top = self.node("document", None)
        sections: list[tuple[int, str]] = []
        for child in root.children:
            here = sections[-1][1] if sections else top
            if isinstance(child, str):
                if child.strip():
                    self.residual("extraction_uncertain", f"stray text: {child.strip()}", here)
                continue
            name = child.name
            if len(name) == 2 and name[0] == "h" and name[1] in "123456":
                level = int(name[1])
                while sections and sections[-1][0] >= level:
                    sections.pop()
                section = self.node("section", sections[-1][1] if sections else top)
                text = child.text()
                if text.strip():
                    self.span(section, text)
                else:
                    self.residual("extraction_uncertain", "empty heading", section)
                sections.append((level, section))
            elif name == "p":
                self.textual("paragraph", here, child)
            elif name in ("ul", "ol"):
                self.list_of(child, here)
            elif name == "table":
                self.table(child, here)
            else:
                self.residual("extraction_uncertain", f"unknown flow element: {name}", here)

    def list_of(self, element: Element, parent: str) -> None:
        ident = self.node("list", parent)
        for child in element.children:
            if isinstance(child, Element) and child.name == "li":
                self.textual("paragraph", ident, child)
            elif isinstance(child, Element) or child.strip():
                what = f"unknown flow element: {child.name}" if isinstance(child, Element) else f"stray text: {child.strip()}"
                self.residual("extraction_uncertain", what, ident)

    def table(self, element: Element, parent: str) -> None:
        ident = self.node("table", parent)
        try:
            caption, grid = plain_grid(element)
        except Rejected as e:
            self.residual("table_structure_uncertain", str(e), ident)
            return
        if caption is not None:
            self.textual("caption", ident, caption)
        for r, row in enumerate(grid):
            for c, cell in enumerate(row):  # an empty cell makes no node but keeps its column
                self.textual("cell", ident, cell, {"col": str(c), **({"header": "true"} if cell.name == "th" else {}), "row": str(r)})


def plain_grid(table: Element) -> tuple[Element | None, list[list[Element]]]:
    """Caption and rows of cells; Rejected for a second caption, spans, nested tables, unknown
    children or stray text."""
    caption, rows = None, []

    def only(element: Element, allowed: tuple[str, ...]) -> Iterator[Element]:
        for x in element.children:
            if isinstance(x, str):
                if x.strip():
                    raise Rejected(f"stray text in {element.name}")
            elif x.name not in allowed:
                raise Rejected(f"unexpected {x.name} in {element.name}")
            else:
                yield x

    for part in only(table, ("caption", "colgroup", "col", "thead", "tbody", "tfoot", "tr")):
        if part.name == "caption":
            if caption is not None:
                raise Rejected("second caption")
            caption = part
        elif part.name in ("thead", "tbody", "tfoot", "tr"):
            for row in [part] if part.name == "tr" else only(part, ("tr",)):
                cells = list(only(row, ("td", "th")))
                for cell in cells:
                    if any(cell.attrs.get(k, "1").strip() != "1" for k in ("rowspan", "colspan")):
                        raise Rejected("cell spans")
                    if any(isinstance(x, Element) and x.find("table") for x in cell.children):
                        raise Rejected("nested table")
                rows.append(cells)
    return caption, rows


_FLAT = pa.schema(
    [("document_id", pa.string()), ("part", pa.string()), ("ord", pa.int32()), ("id", pa.string()), ("node_id", pa.string()), ("kind", pa.string()), ("parent_id", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("raw_text", pa.string()), ("reading_order", pa.int64()), ("node_ids", pa.list_(pa.string())), ("span_ids", pa.list_(pa.string())), ("code", pa.string()), ("outcome", pa.string()), ("detail", pa.string())]
)
_FLAT_DDL = "document_id string, part string, ord int, id string, node_id string, kind string, parent_id string, attrs map<string,string>, raw_text string, reading_order long, node_ids array<string>, span_ids array<string>, code string, outcome string, detail string"


def document_rows(document_id: str, html: str | None, root: str | None = None) -> list[dict]:
    walk = _Walk(document_id)
    body = parse(html or "")
    start = body.find(root) if root else body
    if start is None:
        top = walk.node("document", None)
        walk.residual("extraction_uncertain", f"no element {root}", top)
    else:
        walk.document(start)
    return walk.rows


def extract(docs: DataFrame, root: str | None = None) -> DataFrame:
    """All rows (part: node, span, region, diagnostic) of documents (document_id, html). A null
    html is an empty document. One narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[dict] = []
            for ident, html in zip(batch.column(0), batch.column(1)):
                held.extend(document_rows(ident.as_py(), html.as_py(), root))
                if len(held) > 5000:
                    yield pa.RecordBatch.from_pylist(held, _FLAT)
                    held = []
            yield pa.RecordBatch.from_pylist(held, _FLAT)

    return docs.select("document_id", "html").transform(in_arrow, run, _FLAT_DDL)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """nodes, spans, regions and diagnostics of extract()."""
    part = lambda name: rows.where(F.col("part") == name)
    return {
        "nodes": part("node").select("document_id", F.col("id").alias("node_id"), F.col("ord").alias("pos"), "kind", "parent_id", "attrs"),
        "spans": part("span").select("document_id", F.col("id").alias("span_id"), "node_id", "raw_text", F.lit(0).cast("long").alias("start"), "reading_order"),
        "regions": part("region").select("document_id", F.col("id").alias("region_id"), F.col("ord").alias("pos"), "node_ids", "span_ids"),
        "diagnostics": part("diagnostic").select("document_id", "code", "outcome", "detail", F.col("span_ids").alias("region_ids")),
    }


def read_files(spark, paths: dict[str, str]) -> DataFrame:
    """(document_id, html) of files by document id: one read of all files, joined to the ids by path. A
    file that can't be read fails the read; callers check paths first where a document may be missing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def qualified(path: str) -> str:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).makeQualified(p).toString()

    ids = spark.createDataFrame([(i, qualified(p)) for i, p in sorted(paths.items())], "document_id string, path string")
    files = spark.read.format("binaryFile").load(sorted(set(paths.values())))
    return ids.join(files, "path").select("document_id", F.decode("content", "UTF-8").alias("html"))
