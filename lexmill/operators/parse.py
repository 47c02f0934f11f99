"""Law texts to elements. (P1-P11, P14-P21, P36, W5, W6, G5's input)

A text is exploded into numbered lines; headers are found by pattern per line, and windows over a document's lines give
contents, descriptions and parents. Only match offsets and XML trees need Python, by Arrow batch."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.rules import URI_KINDS, article_confidence, by_keywords, derogated
from ..functions.text import escape_xml, ordinal, roman, slug

#: Article headers, most specific first. The dash form also takes an "o" before its dash.
ARTICLE_HEADERS = (
    r"^(?:Art[íi]culo|ART[ÍI]CULO)\s+(\d+o?\.?)\s+((?:Bis|BIS)\s*\d*)", r"^(?:Art[íi]culo|ART[ÍI]CULO)\s+(\d+)o?-([A-Z])\b",
    r"^(?:Art[íi]culo|ART[ÍI]CULO)\s+(\d+o?\.?)()", r"^Art\.\s+(\d+)()",
)
#: An article's header at the beginning of its text.
ARTICLE_HEAD = r"^(?:Art[íi]culo|ART[ÍI]CULO|Art\.)\s+\d+o?(?:-[A-Z]\b)?\.?(?:\s+(?:Bis|BIS)\s*\d*)?[.\-–—\s]*"
ORDINALS_O = "PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO|S[ÉE]PTIMO|OCTAVO|NOVENO|D[ÉE]CIMO"
ORDINALS_A = "PRIMERA|SEGUNDA|TERCERA|CUARTA|QUINTA"
STRUCTURE = {
    "title": rf"^T[ÍI]TULO\s+([IVX]+|{ORDINALS_O})\b", "book": rf"^LIBRO\s+([IVX]+|{ORDINALS_O})\b", "part": rf"^PARTE\s+([IVX]+|{ORDINALS_A})\b",
    "chapter": rf"^CAP[ÍI]TULO\s+([IVX]+|{ORDINALS_O})\b", "section": rf"^SECCI[ÓO]N\s+([IVX]+|{ORDINALS_A})\b",
}
TRANSITORY_HEADER = r"(?iuU)^\s*(?:ART[ÍI]CULOS?\s+TRANSITORIOS?|TRANSITORIOS?|DISPOSICION(?:ES)?\s+TRANSITORIAS?)\s*$"
TRANSITORY_ITEM = r"(?iuU)^\s*(?:ART[ÍI]CULO\s+)?((?:D[ÉE]CIM[OA]\s+)?(?:PRIMER[OA]|SEGUND[OA]|TERCER[OA]|CUART[OA]|QUINT[OA]|SEXT[OA]|S[ÉE]PTIM[OA]|OCTAV[OA]|NOVEN[OA])|D[ÉE]CIM[OA]|UND[ÉE]CIM[OA]|DUOD[ÉE]CIM[OA]|[ÚU]LTIM[OA])\b[\s.\-–—:]*(.*)$"
REFORM = r"(?iuU)(Art[íi]culo|Fracci[óo]n|P[áa]rrafo|Inciso|Cap[íi]tulo|T[íi]tulo)\s+(reformad[oa]|adicionad[oa]|derogad[oa]|abrogad[oa]|modificad[oa]|sustitu[íi]d[oa])\s+DOF\s+(\d{2}-\d{2}-\d{4})"
FRACTION = r"^\s*(?:([IVXLCDM]+)\.|([a-z])\)|(\d+)\))\s"
#: Forms of references with their weights; groups are named for what they hold.
_LAW, _ART = r"(?:ley|c[óo]digo|reglamento)", r"\d+[A-Z]?(?:-[A-Z])?"
REFERENCES = (
    (rf"art[íi]culo\s+(?P<art>{_ART})\s+de\s+(?:la|el)\s+(?P<law>{_LAW}\s+[^,.;]+)", 2.0),
    (rf"(?P<law>{_LAW}\s+[^,.]{{5,}}),\s+art[íi]culo\s+(?P<art>{_ART})", 2.0),
    (rf"fracci[óo]n\s+(?P<frac>[IVXLCDM]+)\s+del\s+art[íi]culo\s+(?P<art>{_ART})", 1.8),
    (rf"art[íi]culo\s+(?P<art>{_ART}),\s+fracci[óo]n\s+(?P<frac>[IVXLCDM]+)", 1.5),
    (r"(?P<law>ley\s+(?:federal|general|org[áa]nica)\s+de\s+[^,.;]+)", 1.0),
    (rf"(?P<law>{_LAW}\s+(?:federal|general|estatal|municipal|org[áa]nic[oa])\s+[^,.;]{{10,}})", 1.2),
)
REFERENCE_TYPE = ArrayType(StructType([
    *[StructField(n, StringType()) for n in ("text", "law_name", "article_num", "fraction")], StructField("confidence", DoubleType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
]))


def lines(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, line_number, line) of lines that aren't blank; numbers count all lines."""
    rows = docs.select(F.col(id_), F.posexplode(F.split(F.col(text), "\r?\n")).alias("line_number", "line"))
    return rows.where(F.trim("line") != "")


def article_id(line: Column) -> Column:
    """Id of an article header line, else null."""
    found = None
    for p in ARTICLE_HEADERS:
        number, mark = F.regexp_extract(line, p, 1), F.regexp_extract(line, p, 2)
        made = F.concat(F.lit("art-"), F.regexp_replace(number, r"[.o]+$", ""), F.lower(F.regexp_replace(mark, r"\s+", "")))
        found = F.when(line.rlike(p), made) if found is None else found.when(line.rlike(p), made)
    return found


#: Ordinals that head an article in municipal texts.
ORDINAL_HEADERS = (
    r"^(PRIMER[OA]|Primer[oa])\b", r"^(SEGUND[OA]|Segund[oa])\b", r"^(TERCER[OA]|Tercer[oa])\b", r"^(CUART[OA]|Cuart[oa])\b", r"^(QUINT[OA]|Quint[oa])\b",
    r"^(SEXT[OA]|Sext[oa])\b", r"^(S[ÉE]PTIM[OA]|S[ée]ptim[oa])\b", r"^(OCTAV[OA]|Octav[oa])\b", r"^(NOVEN[OA]|Noven[oa])\b",
    r"^(D[ÉE]CIM[OA]\s+(?:PRIMER|SEGUND|TERCER)[OA]|D[ée]cim[oa]\s+(?:primer|segund|tercer)[oa])\b", r"^(D[ÉE]CIM[OA]|D[ée]cim[oa])\b",
    r"^(UND[ÉE]CIM[OA]|Und[ée]cim[oa])\b", r"^(DUOD[ÉE]CIM[OA]|Duod[ée]cim[oa])\b", r"^(VIG[ÉE]SIM[OA]|Vig[ée]sim[oa])\b",
)


def ordinal_article_id(line: Column) -> Column:
    """P1 for municipal texts: id of a line that an ordinal heads, else null. Kept apart, as ordinals also head transitory articles."""
    said = F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in ORDINAL_HEADERS])
    return F.concat(F.lit("art-"), F.get(F.transform(F.array(said), ordinal), F.lit(0)).cast("string"))  # a lambda reads the patterns once


def structure_kind(line: Column) -> Column:
    """Title, book, part, chapter or section."""
    out = None
    for kind, p in STRUCTURE.items():
        hit = line.rlike("(?iuU)" + p)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def structure_number(line: Column) -> Column:
    raw = F.coalesce(*[F.nullif(F.regexp_extract(line, "(?iuU)" + p, 1), F.lit("")) for p in STRUCTURE.values()])
    return F.coalesce(ordinal(raw), F.nullif(roman(raw), F.lit(0)))


def body_and_transitory(rows: DataFrame, id_: str) -> DataFrame:
    """Adds ``transitory``: whether a line comes after the first transitory header."""
    seen = F.max(F.col("line").rlike(TRANSITORY_HEADER).cast("int")).over(Window.partitionBy(id_).orderBy("line_number"))
    return rows.withColumn("transitory", seen == 1)


def structures(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, kind, number, description, line_number); a description is the next line if it isn't a header itself."""
    rows = body_and_transitory(lines(docs, id_, text), id_).where("not transitory").withColumn("kind", structure_kind(F.col("line")))
    nxt, after = (F.lead(c).over(Window.partitionBy(id_).orderBy("line_number")) for c in ("line", "kind"))
    described = rows.withColumn("description", F.when(after.isNull() & article_id(nxt).isNull(), F.trim(nxt)))
    return described.where("kind is not null").select(id_, "kind", structure_number(F.col("line")).alias("number"), "description", "line_number")


def articles(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, article_id, content, line_number, reforms, derogated, confidence), the first of each id. Content ends at the
    next header, structure or the transitory part."""
    rows = body_and_transitory(lines(docs, id_, text), id_).where("not transitory")
    rows = rows.withColumn("aid", article_id(F.col("line"))).withColumn("kind", structure_kind(F.col("line")))
    order = Window.partitionBy(id_).orderBy("line_number")
    cut = F.sum((F.col("aid").isNotNull() | F.col("kind").isNotNull()).cast("int")).over(order)
    marked = rows.withColumn("block", cut).where("kind is null")
    head = F.regexp_replace("line", ARTICLE_HEAD, "")
    piece = F.when(F.col("aid").isNotNull(), head).otherwise(F.col("line"))
    blocks = marked.groupBy(id_, "block").agg(
        F.max("aid").alias("article_id"), F.min("line_number").alias("line_number"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", piece.alias("p")))), lambda x: x.p), "\n").alias("raw"),
    ).where("article_id is not null")
    out = blocks.withColumn("reforms", reforms(F.col("raw"))).withColumn("content", F.trim(F.regexp_replace("raw", REFORM, "")))
    out = out.withColumn("derogated", derogated(F.col("content"))).withColumn("confidence", article_confidence(F.col("content")))
    first = F.row_number().over(Window.partitionBy(id_, "article_id").orderBy("line_number"))
    return out.withColumn("r", first).where("r = 1").select(id_, "article_id", "content", "line_number", "reforms", "derogated", "confidence")


def reforms(text: Column) -> Column:
    """Array of (element, action, dof_date, full_text)."""
    whole = F.regexp_extract_all(text, F.lit(REFORM), 0)
    return F.transform(whole, lambda m: F.struct(F.regexp_extract(m, REFORM, 1).alias("element"), F.regexp_extract(m, REFORM, 2).alias("action"), F.regexp_extract(m, REFORM, 3).alias("dof_date"), m.alias("full_text")))


def transitory_articles(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """P5: (id, number, content) after the transitory header."""
    rows = body_and_transitory(lines(docs, id_, text), id_).where("transitory").where(~F.col("line").rlike(TRANSITORY_HEADER))
    head = F.col("line").rlike(TRANSITORY_ITEM)
    rows = rows.withColumn("block", F.sum(head.cast("int")).over(Window.partitionBy(id_).orderBy("line_number"))).where("block > 0")
    piece = F.when(head, F.regexp_extract("line", TRANSITORY_ITEM, 2)).otherwise(F.col("line"))
    name = F.when(head, F.regexp_extract("line", TRANSITORY_ITEM, 1))
    return rows.groupBy(id_, "block").agg(
        ordinal(F.max(name)).alias("number"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", piece.alias("p")))), lambda x: x.p), "\n")).alias("content"),
    ).drop("block")


def parents(elements: DataFrame, id_: str) -> DataFrame:
    """Elements (id, kind, label, line_number) with the latest title, chapter and section above; a title ends chapters."""
    order = Window.partitionBy(id_).orderBy("line_number")
    rows = elements
    for above, kind in (((), "book"), (("book",), "title"), (("book", "title"), "chapter"), (("book", "title", "chapter"), "section")):
        mark = F.when(F.col("kind") == kind, F.col("label")).when(F.col("kind").isin(*above) if above else F.lit(False), F.lit(""))
        rows = rows.withColumn(kind, F.nullif(F.last(mark, True).over(order), F.lit("")))
    return rows


def law_gaps(rows: DataFrame, id_: str, more_than: int = 1) -> DataFrame:
    """Missing article numbers."""
    from .history import gaps

    numbered = rows.withColumn("number", F.regexp_extract("article_id", r"^art-(\d+)", 1).cast("int"))
    return gaps(numbered, id_, "number", more_than)


def metadata(docs: DataFrame, arts: DataFrame, structs: DataFrame, trans: DataFrame, id_: str) -> DataFrame:
    """Counts, mean confidence and warnings per document."""
    a = arts.groupBy(id_).agg(F.count("*").alias("n_articles"), F.avg("confidence").alias("confidence"))
    s = structs.groupBy(id_).agg(F.count("*").alias("n_structures"), F.count_if(F.col("kind").isin("book", "title")).alias("n_tops"))
    t = trans.groupBy(id_).agg(F.count("*").alias("n_transitory"))
    g = law_gaps(arts, id_).groupBy(id_).agg(F.count("*").alias("n_gaps"))
    out = docs.select(id_).distinct()
    for part in (a, s, t, g):
        out = out.join(part, id_, "left")
    out = out.na.fill(0, ["n_articles", "n_structures", "n_tops", "n_transitory", "n_gaps"])
    warn = [("no_articles", F.col("n_articles") == 0), ("no_book_or_title", F.col("n_tops") == 0), ("no_transitory", F.col("n_transitory") == 0), ("gaps", F.col("n_gaps") > 0)]
    return out.withColumn("warnings", F.filter(F.array(*[F.when(c, k) for k, c in warn]), lambda x: x.isNotNull()))


def find_references(text: str) -> list[dict]:
    """P10: all matches of all forms, with offsets in the text."""
    found = []
    for pattern, weight in _compiled():
        for m in pattern.finditer(text):
            g = m.groupdict()
            law, art, frac = (g.get("law") or "").strip() or None, g.get("art"), (g.get("frac") or "").upper() or None
            base = (0.4 if law else 0) + (0.1 if law and len(law) > 20 else 0) + (0.4 if art else 0) + (0.1 if frac else 0)
            found.append({"text": m.group(), "law_name": law, "article_num": art, "fraction": frac, "confidence": min(1.0, base * weight / 2), "start": m.start(), "end": m.end()})
    return sorted(found, key=lambda r: r["start"])


_cache: list = []


def _compiled() -> list:
    if not _cache:
        _cache.extend((re.compile(p, re.IGNORECASE | re.MULTILINE), w) for p, w in REFERENCES)
    return _cache


@F.pandas_udf(REFERENCE_TYPE)
def reference_matches(texts: pd.Series) -> pd.Series:
    """P10 by Arrow batch: Spark's regex functions don't tell where a match is."""
    return texts.fillna("").map(find_references)


def resolve_overlaps(refs: Column) -> Column:
    """By start; of a reference and the last kept one that it overlaps, the more confident stays, the earlier on a tie. The fold carries
    the last kept reference and only appends those that nothing can replace, so it is linear but for the copies of arrays."""
    ordered = F.array_sort(refs, lambda a, b: F.when(a.start < b.start, -1).when(a.start > b.start, 1).otherwise(0))
    one = REFERENCE_TYPE.elementType.simpleString()
    none = F.lit(None).cast(one)

    def step(state: Column, r: Column) -> Column:
        apart = state.last.isNull() | (state.last.end <= r.start)
        last = F.when(apart | (r.confidence > state.last.confidence), r).otherwise(state.last)
        done = F.when(apart & state.last.isNotNull(), F.array_append(state.done, state.last)).otherwise(state.done)
        return F.struct(done.alias("done"), last.alias("last"))

    start = F.struct(F.array().cast(REFERENCE_TYPE).alias("done"), none.alias("last"))
    return F.aggregate(ordered, start, step, lambda s: F.when(s.last.isNull(), s.done).otherwise(F.array_append(s.done, s.last)))


def references(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """One row per reference."""
    return docs.select(id_, F.inline(resolve_overlaps(reference_matches(F.col(text)))))


def simple_references(text: Column) -> Column:
    """Article numbers that a text refers to."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?iuU)(?:del?\s+|en\s+el\s+|conforme\s+al\s+|seg[úu]n\s+el\s+)art[íi]culo\s+(\d+)"), 1))


def is_fraction(line: Column) -> Column:
    """P14."""
    return line.rlike(FRACTION)


#: A repeated article number before its text, and a line end within a sentence.
REPEATED = r"^(?:Art[ií]culo|ARTÍCULO)\s+\d+[\w\s]*\.\s*"
WRAPPED = r"(?<=[a-záéíóúñü,;])\n(?=[a-záéíóúñü])"


def clean_article_text(text: Column) -> Column:
    """A paragraph of an article without the article's repeated number; a line end between letters, or behind a comma or semicolon, is a space; others stay; runs of spaces are one."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    bare = F.regexp_replace(strip(text), f"(?U){REPEATED}", "")
    return strip(F.regexp_replace(F.regexp_replace(bare, f"(?iu){WRAPPED}", " "), " {2,}", " "))


def clean_paragraph(text: str) -> str:
    """``clean_article_text`` of one paragraph inside an XML reader."""
    bare = re.sub(REPEATED, "", text.strip())
    return re.sub(" {2,}", " ", re.sub(WRAPPED, " ", bare, flags=re.IGNORECASE)).strip()


def article_text(article: ET.Element) -> str:
    """The paragraphs of an article element, reform notes left out, parted by an empty line; of an article without any, its text without its number."""

    def paragraphs(e: ET.Element) -> Iterator[str]:
        for child in e:
            if _tag(child) == "p":
                yield "".join(child.itertext())
            if _tag(child).endswith("note"):
                continue
            yield from paragraphs(child)

    found = [clean_paragraph(p) for p in paragraphs(article) if p.strip()]
    if found:
        return "\n\n".join(found)
    raw, num = "".join(article.itertext()).strip(), next((x.text for x in article if _tag(x) == "num"), None)
    return raw.replace(num.strip(), "", 1).strip() if num and num.strip() else raw


def uri_kind(name: Column) -> Column:
    """The kind of law that a name says."""
    return by_keywords(F.lower(name), URI_KINDS, "ley")


def state_frbr_uri(name: Column, state: Column, municipality_: Column, published: Column) -> Column:
    """The work URI of a state's or a municipality's law."""
    place = F.concat_ws("/", F.lit("/mx"), slug(state), F.nullif(slug(municipality_), F.lit("")))
    return F.concat_ws("/", place, uri_kind(name), F.coalesce(F.date_format(published, "yyyy-MM-dd"), F.lit("2023-01-01")), slug(name), F.lit("main"))


def frbr_uri(kind: Column, jurisdiction: Column, published: Column, slug_: Column) -> Column:
    """P18."""
    return F.concat_ws("/", F.lit("/mx"), jurisdiction, kind, F.date_format(published, "yyyy-MM-dd"), slug_)


def content_type(text: Column) -> Column:
    """P36."""
    head = F.left(text, F.lit(500))
    return F.when(F.startswith(F.ltrim(head), F.lit("<?xml")) | F.contains(head, F.lit("<akomaNtoso")), "akn").otherwise("text")


AKN = "http://docs.oasis-open.org/legaldocml/ns/akn/3.0"


#: Documents whose results a task holds at once.
ROWS = 64


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _row_by_row(read: Callable[[str | None], Iterable[tuple]], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over (id, document): the id before each of the ``width`` strings of the tuples that ``read`` makes of a document. Beside Spark's batch, a worker has one document
    as a string and as a tree, and the results of ``ROWS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs = batch.columns
            for k in range(0, batch.num_rows, ROWS):
                rows = [(ids[n], *r) for n in range(k, min(k + ROWS, batch.num_rows)) for r in read(docs[n].as_py())]
                columns = [*zip(*rows, strict=True)] or [()] * (width + 1)
                made = [pa.array([i.as_py() for i in columns[0]], ids.type), *(pa.array(c, pa.string()) for c in columns[1:])]
                yield pa.RecordBatch.from_arrays(made, [str(n) for n in range(width + 1)])

    return run


def akn_elements(docs: DataFrame, id_: str, xml: str) -> DataFrame:
    """(id, eid, num, title, chapter, text) of the articles of an AKN document, their texts cleaned and without notes; malformed documents give no row."""
    kind = docs.schema[id_].dataType.simpleString()

    def walk(e: ET.Element, above: dict) -> Iterator[tuple]:
        for child in e:
            name = _tag(child)
            if name == "article":
                num = next((x.text for x in child if _tag(x) == "num"), None)
                yield child.get("eId") or child.get("id"), num, above.get("title"), above.get("chapter"), article_text(child)
            elif name in ("title", "chapter"):
                label = " ".join(x.text for x in child if _tag(x) in ("num", "heading") and x.text)
                yield from walk(child, above | {name: label} | ({"chapter": None} if name == "title" else {}))
            else:
                yield from walk(child, above)

    def read(x: str | None) -> Iterator[tuple]:
        try:
            root = ET.fromstring(x)
        except (ET.ParseError, TypeError):
            return
        yield from walk(root, {})

    return docs.select(id_, xml).mapInArrow(_row_by_row(read, 5), f"{id_} {kind}, eid string, num string, title string, chapter string, text string")


#: Elements that hold others, the outermost first: one that opens ends those of its level and below.
LEVELS = ("book", "title", "chapter")


def akn_document(elements: DataFrame, id_: str) -> DataFrame:
    """Elements in order (id, kind: book, title, chapter, article or transitory, label, content, line_number, and, if there are any, reforms with ``full_text``) as one AKN document each. Articles stand
    in the innermost element that is open, transitory ones are articles numbered by their ordinal, reforms are notes of their article. A document's parts are
    gathered in a row, as it is one value."""
    before = Window.partitionBy(id_).orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    # A level is open if the last element that could have ended it has opened it.
    opened = {k: F.coalesce(F.last(F.when(F.col("kind").isin(*LEVELS[: n + 1]), F.col("kind") == k), True).over(before), F.lit(False)) for n, k in enumerate(LEVELS)}
    close = F.concat(*[F.when(F.col("kind").isin(*LEVELS[: n + 1]) & opened[k], f"</{k}>").otherwise("") for n, k in reversed(list(enumerate(LEVELS)))])
    label, eid = escape_xml(F.col("label")), F.concat(F.col("kind"), F.lit("-"), F.col("line_number").cast("string"))
    head = F.concat(F.lit("<"), F.col("kind"), F.lit(' id="'), eid, F.lit('"><num>'), label, F.lit("</num>"))
    ids = F.when(F.col("kind") == "transitory", F.concat(F.lit("trans-"), F.col("line_number").cast("string"))).otherwise(label)
    noted = F.transform("reforms", lambda r: F.concat(F.lit('<note placement="bottom"><p>'), escape_xml(r["full_text"]), F.lit("</p></note>"))) if "reforms" in elements.columns else F.array()
    notes = F.coalesce(F.array_join(noted.cast("array<string>"), ""), F.lit(""))
    article = F.concat(F.lit('<article id="'), ids, F.lit('"><num>'), label, F.lit("</num><content><p>"), escape_xml(F.coalesce("content", F.lit(""))), F.lit("</p></content>"), notes, F.lit("</article>"))
    piece = F.concat(close, F.when(F.col("kind").isin("article", "transitory"), article).otherwise(head))
    rows = elements.where(F.col("kind").isin(*LEVELS, "article", "transitory")).select(id_, "line_number", "kind", piece.alias("x"))
    last = {k: F.max(F.when(F.col("kind") == k, F.col("line_number"))).alias(f"last_{k}") for k in LEVELS}
    parts = rows.groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("line_number", "x"))).alias("p"), *last.values())
    at = [F.coalesce(F.col(f"last_{k}").cast("long"), F.lit(-(1 << 62))) for k in LEVELS]
    still = [F.col(f"last_{k}").isNotNull() & (at[n] > F.greatest(*at[:n], F.lit(-(1 << 62)))) if n else F.col(f"last_{k}").isNotNull() for n, k in enumerate(LEVELS)]
    tail = F.concat(*[F.when(still[n], f"</{LEVELS[n]}>").otherwise("") for n in (2, 1, 0)])
    body = F.array_join(F.transform("p", lambda r: r.x), "")
    return parts.select(id_, F.concat(F.lit(f'<akomaNtoso xmlns="{AKN}"><act><meta/><body>'), body, tail, F.lit("</body></act></akomaNtoso>")).alias("xml"))


@F.pandas_udf(IntegerType())
def akn_article_count(texts: pd.Series) -> pd.Series:
    """AKN articles of a document; -1 if it isn't well-formed; null for null."""

    def count(x: str | None) -> int | None:
        if x is None:
            return None
        try:
            return sum(1 for _ in ET.fromstring(x.encode()).iter(f"{{{AKN}}}article"))
        except ET.ParseError:
            return -1

    return texts.map(count).astype("Int64")


def _issues(root: ET.Element) -> Iterator[tuple[str, str]]:
    """P20: (check, issue) of a parsed document."""
    found: dict[str, list[ET.Element]] = {}
    for e in root.iter():
        found.setdefault(_tag(e), []).append(e)
    child = lambda e, n: next((x for x in e if _tag(x) == n), None)
    arts = found.get("article", [])
    nums = [m for a in arts if (n := child(a, "num")) is not None and (m := re.search(r"\d+", n.text or ""))]
    if not arts:
        yield "article_sequence", "no articles"
    elif not nums:
        yield "article_sequence", "no article numbers"
    numbers = sorted(int(m.group()) for m in nums)
    for a, b in zip(numbers, numbers[1:]):
        if b - a > 5:
            yield "article_sequence", f"gap {a}-{b}"
    if "meta" not in found:
        yield "frbr_metadata", "no meta"
    else:
        inner = {_tag(e): e for e in reversed(list(found["meta"][0].iter()))}
        for kind in ("FRBRWork", "FRBRExpression", "FRBRManifestation"):
            if kind not in inner:
                yield "frbr_metadata", f"no {kind}"
                continue
            for part in ("FRBRthis", "FRBRuri", "FRBRdate"):
                if child(inner[kind], part) is None:
                    yield "frbr_metadata", f"no {part} in {kind}"
    sizes = [len("".join(p.text or "" for p in a.iter() if _tag(p) == "p")) for a in arts]
    short, empty = sum(n < 20 for n in sizes), sum(n < 5 for n in sizes)
    if short > 0.05 * len(arts):
        yield "content_length", f"{short} short articles"
    if empty:
        yield "content_length", f"{empty} empty articles"
    if "body" not in found:
        yield "hierarchy", "no body"
    elif (chapters := sum(_tag(e) == "chapter" for e in found["body"][0].iter())) and sum(_tag(e) == "article" for e in found["body"][0].iter()) < chapters:
        yield "hierarchy", "fewer articles than chapters"
    for kind in ("chapter", "title"):
        for e in found.get(kind, []):
            if (n := child(e, "num")) is None or not n.text:
                yield "structure_elements", f"{kind} without num"


def completeness(docs: DataFrame, id_: str, xml: str) -> DataFrame:
    """P20: (id, check, issue) of five checks: article sequence, FRBR metadata, content length, hierarchy, numbers of titles and chapters; no
    row for a complete document, one of check parse_error for a malformed one."""
    kind = docs.schema[id_].dataType.simpleString()

    def check(x: str | None) -> Iterator[tuple]:
        try:
            root = ET.fromstring(x)
        except (ET.ParseError, TypeError):
            yield "parse_error", "not well-formed"
            return
        yield from _issues(root)

    return docs.select(id_, xml).mapInArrow(_row_by_row(check, 2), f"{id_} {kind}, check string, issue string")


def schema_validity(docs: DataFrame, id_: str, xml: str) -> DataFrame:
    """(id, issue) of what an AKN document lacks; none for a valid one."""
    kind = docs.schema[id_].dataType.simpleString()

    def check(x: str | None) -> Iterator[tuple]:
        try:
            names = [_tag(e) for e in ET.fromstring(x).iter()]
        except (ET.ParseError, TypeError):
            yield ("not_well_formed",)
            return
        yield from ((f"no_{n}",) for n in ("meta", "body") if n not in names)
        if names[0] != "akomaNtoso":
            yield ("wrong_root",)

    return docs.select(id_, xml).mapInArrow(_row_by_row(check, 1), f"{id_} {kind}, issue string")
