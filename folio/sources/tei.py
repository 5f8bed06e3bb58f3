"""TEI-XML: written by string assembly over block rows, read by an Arrow map with an XML parser.

Writing needs Python only for the XML of tables: each block renders to a string, headings close and open sections by the depth that windows
give them, and a document is its blocks' strings in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import fixed_values as V
from ..functions.spans import cut_lines
from ..operators import semantics, sequences
from ..operators.blocks import complete, order
from ..operators.notes import has_spans
from .batches import gathered

NS = "http://www.tei-c.org/ns/1.0"
XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
RENDITIONS = (("italic", "italic"), ("bold", "bold"), ("small_caps", "small-caps"), ("sup", "sup"), ("sub", "sub"))


def escape(t: Column) -> Column:
    """Text for XML: the three special characters as entities, characters that XML can't hold left out."""
    clean = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    return F.replace(F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def attribute(t: Column) -> Column:
    """Text for an attribute in double quotes; line ends and tabs are written as references, for a reader would make them blanks."""
    out = F.replace(escape(t), F.lit('"'), F.lit("&quot;"))
    for sign, code in (("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def inline(spans: Column, notes: Column) -> Column:
    """Spans as TEI: styles as hi elements, note calls as the notes they call (notes: a map from note_id to a rendered note element)."""

    def one(x: Column) -> Column:
        tokens = F.concat_ws(" ", *(F.when(F.coalesce(x[f], F.lit(False)), F.lit(name)) for f, name in RENDITIONS))
        text = escape(F.coalesce(x["text"], F.lit("")))
        styled = F.when((tokens != "") & (text != ""), F.concat(F.lit('<hi rend="'), tokens, F.lit('">'), text, F.lit("</hi>"))).otherwise(text)
        note = F.coalesce(F.try_element_at(notes, x["note_ref"]), F.lit(""))
        return F.when((x["kind"] == "note_call") & x["note_ref"].isNotNull(), note).otherwise(styled)

    return F.array_join(F.transform(spans, one), "")


NO_NOTES = "cast(map() as map<string,string>)"


def rendered_notes(notes: DataFrame) -> DataFrame:
    """doc_id, __notes: each document's notes by id, as note elements with their styles; of several notes with one id the first by label and text.

    A call inside a note shows the note it calls, unless that one calls others in turn: those calls aren't followed.
    """
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("note_id")) if "label" in notes.columns else F.col("note_id")
    element = lambda body: F.concat(F.lit('<note place="foot" xml:id="'), attribute(F.col("note_id")), F.lit('" n="'), attribute(label), F.lit('">'), body, F.lit("</note>"))
    plain = escape(F.coalesce(F.col("text"), F.lit("")))
    within = lambda known: F.when(F.size("spans") > 0, inline(F.col("spans"), known)).otherwise(plain)

    def by_doc(df: DataFrame, body: Column) -> DataFrame:
        one = df.where("note_id is not null").groupBy("doc_id", "note_id").agg(F.min(F.struct(element(body).alias("x"))).alias("m"))
        return one.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("note_id", F.col("m.x")))).alias("__notes"))

    if not has_spans(notes):
        return by_doc(notes, plain)
    first = by_doc(notes, within(F.expr(NO_NOTES)))
    nested = F.exists(F.coalesce("spans", F.array()), lambda x: (x["kind"] == "note_call") & x["note_ref"].isNotNull())
    both = notes.withColumn("__nested", F.coalesce(nested, F.lit(False))).join(first, "doc_id", "left")
    return by_doc(both, F.when(F.col("__nested"), within(F.coalesce("__notes", F.expr(NO_NOTES)))).otherwise(within(F.expr(NO_NOTES))))


PARSED = T.StructType([T.StructField("code", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))])


def parse_table(ooxml: str | None) -> dict:
    """A table's rows and cells from its XML: direct children only, so a nested table belongs to no cell; a cell's non-blank paragraphs are its lines.

    A table cut out of its document may lack the declaration of the prefix w.
    """
    if not (ooxml or "").strip():
        return {"code": V.TABLE_MISSING, "reason": V.TABLE_REASONS[0], "rows": []}
    try:
        root = ET.fromstring(ooxml) if "xmlns" in ooxml else ET.fromstring(f'<t xmlns:w="w">{ooxml}</t>')[0]
    except (ET.ParseError, IndexError):
        return {"code": V.TABLE_MISSING, "reason": V.TABLE_REASONS[1], "rows": []}
    local = lambda node, name: [n for n in node if isinstance(n.tag, str) and n.tag.rpartition("}")[2] == name]
    words = lambda p: "".join(t.text or "" for t in p.iter() if isinstance(t.tag, str) and t.tag.rpartition("}")[2] == "t").strip()
    rows = [["\n".join(filter(None, map(words, local(cell, "p")))) for cell in local(row, "tc")] for row in local(root, "tr")]
    return {"code": V.TABLE_SHOWN, "reason": None, "rows": rows} if rows else {"code": V.TABLE_EMPTY, "reason": V.TABLE_REASONS[2], "rows": []}


@F.pandas_udf(PARSED)
def _parsed_tables(ooxml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_table(x) if isinstance(x, str) else parse_table(None) for x in ooxml], columns=["code", "reason", "rows"])


def _with_tables(df: DataFrame) -> DataFrame:
    """Adds __table, the parsed table of blocks that are one."""
    ooxml = F.col("table_ooxml") if "table_ooxml" in df.columns else F.lit(None).cast("string")
    is_table = F.col("block_type") == "table"
    if "table_ooxml" not in df.columns:
        missing = F.struct(F.lit(V.TABLE_MISSING).alias("code"), F.lit(V.TABLE_REASONS[0]).alias("reason"), F.expr("cast(array() as array<array<string>>)").alias("rows"))
        return df.withColumn("__table", F.when(is_table, missing))
    return df.withColumn("__table", F.when(is_table, _parsed_tables(F.when(is_table, ooxml))))


def table(parsed: Column) -> Column:
    """A parsed table as TEI; a paragraph that says why in its place where there is no row to show."""
    cell = lambda c: F.concat(F.lit("<cell>"), escape(c), F.lit("</cell>"))
    row = lambda r: F.concat(F.lit("<row>"), F.array_join(F.transform(r, cell), ""), F.lit("</row>"))
    shown = F.concat(F.lit("<table>"), F.array_join(F.transform(parsed["rows"], row), ""), F.lit("</table>"))
    return F.when(F.size(parsed["rows"]) > 0, shown).otherwise(F.concat(F.lit("<p>[table not exported: "), F.coalesce(parsed["reason"], F.lit("unknown")), F.lit("]</p>")))


def table_diagnostics(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, target, code, reason, rows, cells of every table."""
    df = _with_tables(complete(blocks).where("block_type = 'table'"))
    rows = F.col("__table")["rows"]
    cells = F.aggregate(F.transform(rows, F.size), F.lit(0), lambda a, n: a + n)
    return df.select("doc_id", "pos", F.col("block_id").alias("target"), F.col("__table.code").alias("code"), F.col("__table.reason").alias("reason"), F.size(rows).cast("long").alias("rows"), cells.cast("long").alias("cells"))


def table_counts(blocks: DataFrame) -> DataFrame:
    """doc_id, exported, not_exported for every document: a table is exported if it has a row to show."""
    df = _with_tables(complete(blocks))
    shown = F.coalesce(F.col("__table.code") == V.TABLE_SHOWN, F.lit(False))
    return df.groupBy("doc_id").agg(F.count_if(shown).alias("exported"), F.count_if((F.col("block_type") == "table") & ~shown).alias("not_exported"))


def write(blocks: DataFrame, notes: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """doc_id, xml for every document: sections nest by heading level (at most three deep).

    A note call shows its note with the note's styles; a call of an unknown note shows nothing.  Verse is written line by
    line from its spans, cut at their line breaks, or from its recorded lines where it has no spans.
    """
    df = _with_tables(sequences.section_depth(complete(blocks)))
    sem, kind = semantics.read_semantics(F.col("semantic")), F.col("block_type")
    wrap = lambda before, c, after: F.concat(F.lit(before), c, F.lit(after))
    plain = escape(F.col("text"))
    written = F.array_join(F.transform(semantics.verse_lines(sem, F.col("text")), lambda x: wrap("<l>", escape(x), "</l>")), "")
    body, lines = plain, written
    if has_spans(blocks):
        called = F.expr(NO_NOTES)
        if notes is not None:  # both sides are dealt by doc_id already, so none is sent to every task
            df = df.join(rendered_notes(notes).hint("merge"), "doc_id", "left")
            called = F.coalesce("__notes", called)
        body = F.when(F.size("spans") > 0, inline(F.col("spans"), called)).otherwise(plain)
        cut = F.transform(cut_lines(F.col("spans")), lambda x: wrap("<l>", inline(x, called), "</l>"))
        lines = F.when(F.size(cut) > 0, F.array_join(cut, "")).otherwise(written)
    # rendered before the windows, which then carry strings only
    df = df.withColumns({"__body": body, "__lines": F.when(semantics.is_lineated(kind, sem), lines)}).drop("__notes")
    body, lines, lineated = F.col("__body"), F.col("__lines"), F.col("__lines").isNotNull()
    opened = F.concat(F.lit('<div type="section'), F.col("level").cast("string"), F.lit('"><head>'), body, F.lit("</head>"))
    # neighbouring lineated rows of one group share an lg
    df = df.withColumn("__group", F.when(lineated, F.struct((kind == "quote_block").alias("quoted"), F.coalesce(F.nullif(F.trim("group_id"), F.lit("")), "block_id").alias("id"))))
    starts, stops = (~F.col("__group").eqNullSafe(f("__group").over(order())) for f in (F.lag, F.lead))
    quoted = kind == "quote_block"
    group = F.concat(F.when(starts, F.when(quoted, "<cit><quote><lg>").otherwise("<lg>")).otherwise(""), lines, F.when(stops, F.when(quoted, "</lg></quote></cit>").otherwise("</lg>")).otherwise(""))
    piece = (
        F.when(kind == "heading", opened).when(lineated, group)
        .when(kind == "quote_block", wrap("<cit><quote>", body, "</quote></cit>")).when(kind == "table", table(F.col("__table"))).otherwise(wrap("<p>", body, "</p>"))
    )
    before = F.coalesce(F.lag("depth").over(order()), F.lit(0))
    closed = F.when(kind == "heading", F.repeat(F.lit("</div>"), before - F.col("depth") + 1)).otherwise("")
    df = df.withColumns({"__piece": F.concat(closed, piece)})
    docs = df.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "__piece"))), lambda x: x["__piece"]), "").alias("body"), F.max_by("depth", "pos").alias("left_open"))
    docs = docs.join(titles.select("doc_id", "title"), "doc_id", "left") if titles is not None else docs.withColumn("title", F.lit(None).cast("string"))
    header = F.concat(
        F.lit(f'<TEI xmlns="{NS}"><teiHeader><fileDesc><titleStmt><title>'), F.coalesce(escape(F.col("title")), F.lit("Untitled")),
        F.lit("</title></titleStmt><publicationStmt><p>Publication metadata not set.</p></publicationStmt><sourceDesc><p>"), escape(F.col("doc_id").cast("string")), F.lit("</p></sourceDesc></fileDesc></teiHeader><text><body>"),
    )
    return docs.select("doc_id", F.concat(header, "body", F.repeat(F.lit("</div>"), F.col("left_open")), F.lit("</body></text></TEI>")).alias("xml"))


@dataclass
class Tei:
    blocks: DataFrame
    notes: DataFrame
    errors: DataFrame


def _text(node: ET.Element) -> str:
    """Text of a node without its notes, but with what follows them."""
    out = node.text or ""
    for child in node:
        out += ("" if child.tag.endswith("}note") or child.tag == "note" else _text(child)) + (child.tail or "")
    return out


def parse(xml: str) -> list[dict]:
    root = ET.fromstring(xml)
    local = lambda n: n.tag.rpartition("}")[2] if isinstance(n.tag, str) else ""
    body = next((n for n in root.iter() if local(n) == "body"), root)
    kinds = {"head": "heading", "p": "paragraph", "quote": "quote_block", "l": "paragraph", "cell": "paragraph"}
    rows = [{"part": "block", "pos": i, "block_type": kinds[local(n)], "xml_tag": local(n), "text": _text(n).strip()} for i, n in enumerate(x for x in body.iter() if local(x) in kinds)]
    for i, n in enumerate(x for x in root.iter() if local(x) == "note"):
        rows.append({"part": "note", "pos": i, "note_id": n.get(XML_ID) or f"note{i + 1}", "label": n.get("n"), "text": "".join(n.itertext()).strip()})
    return rows


def read(documents: DataFrame, column: str = "xml") -> Tei:
    """documents(doc_id, xml) -> blocks, notes, and documents that can't be parsed."""
    fields = ["part", "pos", "block_type", "xml_tag", "note_id", "label", "text"]
    schema = T.StructType([documents.schema["doc_id"], *(T.StructField(f, T.LongType() if f == "pos" else T.StringType()) for f in fields)])
    arrow = to_arrow_schema(schema)

    def of(doc_id, xml: str | None) -> list[dict]:
        try:
            rows = parse(xml)
        except (ET.ParseError, TypeError) as e:
            rows = [{"part": "error", "pos": 0, "text": str(e)}]
        return [r | {"doc_id": doc_id} for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered((of(doc_id.as_py(), xml.as_py()) for batch in batches for doc_id, xml in zip(batch.column(0), batch.column(1))), arrow)

    parsed = documents.select("doc_id", F.col(column).alias("xml")).mapInArrow(run, schema)
    return Tei(
        parsed.where("part = 'block'").select("doc_id", "pos", "block_type", "xml_tag", "text"),
        parsed.where("part = 'note'").select("doc_id", "note_id", "label", "text"),
        parsed.where("part = 'error'").select("doc_id", F.col("text").alias("error")),
    )


WITH_ID = ("div", "head", "p", "note", "list", "item", "listBibl", "bibl")
ET.register_namespace("", NS)


def _rend(node: ET.Element) -> str:
    return (node.get("rend") or "").strip()


def normalise(xml: str) -> str:
    """One document with unique ids (given ones stay where they are unique), equal neighbouring hi elements joined (white space
    between them goes in) and notes numbered."""
    root = ET.fromstring(xml)
    local = lambda n: n.tag.rpartition("}")[2] if isinstance(n.tag, str) else ""
    used: set[str] = set()
    counts: dict[str, int] = {}
    for node in root.iter():
        name = local(node)
        own = node.get(XML_ID)
        if own is None and name not in WITH_ID or own is not None and own not in used:
            used.add(own)
            continue
        while own is None or own in used:
            counts[name] = counts.get(name, 0) + 1
            own = f"{name}-{counts[name]:03d}"
        used.add(own)
        node.set(XML_ID, own)
    for parent in root.iter():
        last: ET.Element | None = None
        for node in list(parent):
            if last is not None and local(node) == local(last) == "hi" and _rend(node) == _rend(last) != "" and not (last.tail or "").strip():
                between = (last.tail or "") + (node.text or "")
                if len(last):
                    last[-1].tail = (last[-1].tail or "") + between
                else:
                    last.text = (last.text or "") + between
                last.extend(list(node))
                last.tail = node.tail
                parent.remove(node)
            else:
                last = node
    for number, note in enumerate((n for n in root.iter() if local(n) == "note"), 1):
        note.set("n", str(number))
    return ET.tostring(root, encoding="unicode")


@F.pandas_udf(T.StringType())
def normalised(xml: pd.Series) -> pd.Series:
    return xml.map(normalise, na_action="ignore")
