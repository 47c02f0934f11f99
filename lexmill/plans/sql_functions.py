"""The library in SQL: rules and text functions as SQL functions, and the parser as a table function. (Section 2.13)

``register(spark)`` makes a temporary SQL function of each rule from its own Column expression, so that a call is planned as that expression and runs in the JVM. ``parse_law`` is a table function over the lines
of documents: ``SELECT * FROM parse_law(TABLE(SELECT doc, line_number, line FROM ..))``. It asks for its lines by document in order, so the planner shuffles them, and it holds one element at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import rules, text
from ..operators import analysis, parse

#: Name: a function of one text column. Spark can't write an expression with a lambda as SQL, so rules that have one aren't among them.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "fold": text.fold, "alnum_key": text.alnum_key, "slug": text.slug, "collapse": text.collapse, "ordinal": text.ordinal, "any_date": text.any_date,
    "clean_law_name": text.clean_law_name, "escape_latex": text.escape_latex, "escape_xml": text.escape_xml, "derogated": rules.derogated, "article_confidence": rules.article_confidence, "law_status": rules.law_status,
    "article_id": parse.article_id, "structure_kind": parse.structure_kind, "content_type": parse.content_type, "clean_article_text": parse.clean_article_text, "law_stem": analysis.stem,
}


def expression(spark: SparkSession, rule: Callable[[Column], Column]) -> str:
    """SQL text of a rule over a parameter ``x``."""
    plan = spark.createDataFrame([], "x string").select(rule(F.col("x")).alias("y"))._jdf.queryExecution().analyzed()
    return plan.projectList().apply(0).child().sql()


def _python(pattern: str) -> re.Pattern:
    """A pattern of the parser for Python, where classes are Unicode's without being told."""
    return re.compile(pattern.replace("(?iuU)", "(?i)"))


HEADERS = [_python(p) for p in parse.ARTICLE_HEADERS]
STRUCTURE = {k: _python("(?iuU)" + p) for k, p in parse.STRUCTURE.items()}
TRANSITORY, REFORM = _python(parse.TRANSITORY_HEADER), _python(parse.REFORM)


class ParseLaw:
    """(doc, kind, article_id, content, line_number): articles with their contents, the first of each id, and structures with their lines, up to the transitory part."""

    def __init__(self):
        self.doc, self.now, self.seen, self.over = None, None, set(), False

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        fields = {f.name.lower(): f for f in lines.dataType.fields} if lines.isTable else {}
        if not {"doc", "line_number", "line"} <= set(fields):
            raise ValueError("parse_law takes a table with the columns doc, line_number and line")
        out = StructType([StructField("doc", fields["doc"].dataType), StructField("kind", StringType()), StructField("article_id", StringType()), StructField("content", StringType()), StructField("line_number", IntegerType())])
        return AnalyzeResult(out, partitionBy=[PartitioningColumn("doc")], orderBy=[OrderingColumn("line_number")])

    def _done(self) -> Iterator[tuple]:
        if self.now:
            number, article, pieces = self.now
            if article not in self.seen:
                self.seen.add(article)
                yield self.doc, "article", article, REFORM.sub("", "\n".join(pieces)).strip(" "), number
        self.now = None

    def eval(self, row) -> Iterator[tuple]:
        self.doc, line, number = row["doc"], row["line"], row["line_number"]
        if self.over or line is None or not line.strip(" "):
            return
        if TRANSITORY.search(line):
            yield from self._done()
            self.over = True
            return
        kind = next((k for k, p in STRUCTURE.items() if p.search(line)), None)
        if kind:
            yield from self._done()
            yield self.doc, kind, None, line, number
            return
        for p in HEADERS:
            if m := p.search(line):
                yield from self._done()
                article = "art-" + re.sub(r"[.o]+$", "", m.group(1)) + re.sub(r"\s+", "", m.group(2)).lower()
                self.now = (number, article, [re.sub(parse.ARTICLE_HEAD, "", line)])
                return
        if self.now:
            self.now[2].append(line)

    def terminate(self) -> Iterator[tuple]:
        yield from self._done()


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session; their names."""
    for name, rule in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURN {expression(spark, rule)}")
    spark.udtf.register("parse_law", udtf(ParseLaw))
    return [*FUNCTIONS, "parse_law"]
