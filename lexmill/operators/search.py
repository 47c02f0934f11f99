"""Full-text search over an inverted index held as a table.

Ranking follows published BM25 (k1 = 1.2, b = 0.75, idf = ln(1 + (N - n + 0.5) / (n + 0.5))), the best field counting, with
field boosts, and ties by id. The index is (field, term, doc, tf, dl), partial counts before the shuffle; queries touch only
their terms' rows, so an index stored by term reads a few files.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, icontains
from .analysis import terms

K1, B = 1.2, 0.75
BOOSTS = {"law_name": 3.0, "law_name.keyword": 5.0, "text": 1.0, "tags": 0.5}
#: Most terms that a misspelt one may stand for.
EXPANSIONS = 50


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda t: t != "")


def whole(text: Column) -> Column:
    """The keyword form: one term for the whole folded text."""
    return F.filter(F.array(F.trim(fold(text))), lambda t: t != "")


def _analysers(fields, analyse) -> list[tuple[str, str, Callable[[Column], Column]]]:
    """(field, column, analyser); a field ``name.keyword`` is the column ``name`` as one term."""
    return [(f, f.removesuffix(".keyword"), whole if f.endswith(".keyword") else analyse) for f in fields]


def inverted_index(docs: DataFrame, id_: str, fields: Sequence[str], analyse=tokens, only: Sequence[str] | None = None) -> DataFrame:
    """(field, term, doc, tf, dl), from one scan of the documents. For one query without a stored index, ``only`` names its terms: no row is
    made for others."""
    made = F.array(*[F.struct(F.lit(f).alias("field"), how(F.coalesce(F.col(c), F.lit(""))).alias("t")) for f, c, how in _analysers(fields, analyse)])
    rows = docs.select(F.col(id_).alias("doc"), F.inline(made))
    kept = F.col("t") if only is None else F.filter("t", lambda t: t.isin(list(only)))
    return rows.select("field", "doc", F.size("t").alias("dl"), F.explode(kept).alias("term")).groupBy("field", "term", "doc", "dl").agg(F.count("*").alias("tf"))


def store_index(index: DataFrame, path: str) -> DataFrame:
    """The index as Parquet in ranges of terms: a query's terms are pushed to the scan, where statistics leave only their row groups."""
    index.repartitionByRange("term", "doc").sortWithinPartitions("term", "field", "doc").write.parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def field_stats(docs: DataFrame, fields: Sequence[str], analyse=tokens) -> DataFrame:
    """(field, n_docs, avg_dl): one row per field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.size(how(F.coalesce(F.col(c), F.lit("")))).alias("dl")) for f, c, how in _analysers(fields, analyse)])
    return docs.select(F.inline(pairs)).groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))


def bm25(index: DataFrame, stats: DataFrame, terms: Sequence[str], boosts: Mapping[str, float] | None = None, weight: str | None = None) -> DataFrame:
    """R2: (doc, score) of documents with any of the terms: per field the sum over terms, the best boosted field counts. ``weight`` names a
    column of the index rows that weighs a term."""
    hits = index.where(F.col("term").isin(list(terms)))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))  # at most terms x fields rows
    scored = hits.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(stats), "field")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    boost = F.lit(1.0) if not boosts else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv]), F.col("field")), F.lit(1.0))
    return scored.groupBy("field", "doc").agg(F.sum(idf * tf * boost * (F.col(weight) if weight else 1.0)).alias("s")).groupBy("doc").agg(F.max("s").alias("score"))


def boosted(hits: DataFrame, flag: Column, bonus: float = 1.5) -> DataFrame:
    """An additive bonus; never a filter."""
    return hits.withColumn("score", F.col("score") + F.when(flag, bonus).otherwise(0.0))


def top(hits: DataFrame, n: int, offset: int = 0) -> DataFrame:
    ordered = hits.orderBy(F.desc("score"), "doc")
    return ordered.offset(offset).limit(n) if offset else ordered.limit(n)


def fuzzy_terms(vocabulary: DataFrame, term: str) -> DataFrame:
    """(term, distance) within the edits that its length allows: none up to 2 letters, 1 up to 5, else 2."""
    edits = 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2
    near = vocabulary.where(F.length("term").between(len(term) - edits, len(term) + edits))
    return near.select("term", F.levenshtein("term", F.lit(term), edits).alias("distance")).where("distance >= 0")


def spelt(index: DataFrame, terms: Sequence[str]) -> list[tuple[str, float]]:
    """(term of the index, weight) for each term of a query, at most ``EXPANSIONS`` for one: the nearest, then the first. A term counts as
    itself, an edit takes its share of the shorter length."""
    found: dict[str, float] = {t: 1.0 for t in terms}
    vocabulary = index.select("term").distinct()
    for t in terms:
        if len(t) > 2:
            for r in fuzzy_terms(vocabulary, t).where("distance > 0").orderBy("distance", "term").limit(EXPANSIONS).collect():
                found[r["term"]] = max(found.get(r["term"], 0.0), 1 - r["distance"] / min(len(t), len(r["term"])))
    return sorted(found.items())


def snippet(text: Column, word: str, width: int = 200) -> Column:
    """``width`` characters about the first hit, or the beginning."""
    return F.coalesce(F.get(fragments(text, word, 1, width), F.lit(0)), F.left(text, F.lit(width)))


def fragments(text: Column, word: str, n: int = 2, width: int = 200) -> Column:
    """Up to n pieces of ``width`` characters about hits, none beginning in the one before."""
    low = F.lower(text)

    def step(state: Column, _: Column) -> Column:
        at = F.position(F.lit(word.lower()), low, state.next)
        start = F.greatest(at - width // 2, state.next, F.lit(1))
        piece = F.substring(text, start, F.lit(width))
        return F.when(at > 0, F.struct((start + width).alias("next"), F.array_append(state.found, piece).alias("found"))).otherwise(state)

    empty = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), empty, step, lambda s: s.found)


def in_law(index: DataFrame, stats: DataFrame, articles: DataFrame, law: str, terms: Sequence[str], size: int = 50, fuzzy: bool = True) -> DataFrame:
    """Search within one law, misspelt terms too. Near spellings and the documents that have a term are those of the whole index, as for any
    other query; the law only filters. Scores are ranked by nine places: sums of another order differ in their last digits."""
    ids = articles.where(F.col("law_id") == law).select(F.col("article").alias("doc"))
    words = spelt(index, terms) if fuzzy else [(t, 1.0) for t in terms]
    weights = F.broadcast(index.sparkSession.createDataFrame(words, "term string, weight double"))
    hits = bm25(index.join(weights, "term"), stats, [t for t, _ in words], weight="weight").join(ids, "doc", "left_semi")
    return top(hits.withColumn("score", F.round("score", 9)), size)


def more_like(index: DataFrame, stats: DataFrame, doc, n_terms: int = 25) -> DataFrame:
    """(doc, score) by the ``n_terms`` terms of highest tf-idf of one document, itself excluded. Only the document's own terms are
    counted in the index: at most as many rows as it has words."""
    own = index.where(F.col("doc") == doc).select("field", "term", "tf")
    df = index.join(F.broadcast(own.select("field", "term")), ["field", "term"], "left_semi").groupBy("field", "term").agg(F.count("*").alias("df"))
    weight = F.col("tf") * F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    picked = own.join(df, ["field", "term"]).join(F.broadcast(stats), "field").withColumn("w", weight).orderBy(F.desc("w"), "term").limit(n_terms)
    rows = picked.select("field", "term", "w").collect()  # at most n_terms
    weights = F.broadcast(index.sparkSession.createDataFrame([(r["field"], r["term"], r["w"]) for r in rows], "field string, term string, w double"))
    hits = index.where((F.col("doc") != doc) & F.col("term").isin([r["term"] for r in rows])).join(weights, ["field", "term"])
    return hits.groupBy("doc").agg(F.sum("w").alias("score"))


def more_like_text(index: DataFrame, stats: DataFrame, text: str, analyse, own: DataFrame, field: str = "text", n_terms: int = 25) -> DataFrame:
    """(doc, score) by the ``n_terms`` terms of highest tf-idf of an example text, the documents ``own`` (doc) excluded. An example is a few articles' beginnings: its terms go to the
    driver, and only they are read from the index."""
    spark = index.sparkSession
    tf = spark.range(1).select(F.explode(analyse(F.lit(text))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    names = [r["term"] for r in tf.select("term").collect()]
    hits = index.where((F.col("field") == field) & F.col("term").isin(names))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.col("tf") * F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    picked = df.join(F.broadcast(tf), "term").crossJoin(F.broadcast(stats.where(F.col("field") == field).drop("field"))).select("term", weight.alias("w")).orderBy(F.desc("w"), "term").limit(n_terms)
    return hits.join(F.broadcast(picked), "term").join(own, "doc", "left_anti").groupBy("doc").agg(F.sum("w").alias("score"))


def by_group(hits: DataFrame, owners: DataFrame, group: str, size: int = 8) -> DataFrame:
    """Groups by number of hits, each with its best hit."""
    rows = hits.join(owners, "doc").groupBy(group).agg(F.count("*").alias("doc_count"), F.max_by("doc", F.struct("score", F.negative(F.xxhash64("doc")))).alias("best"))
    return rows.orderBy(F.desc("doc_count"), group).limit(size)


def suggest(names: DataFrame, column: str, prefix: str, size: int = 8) -> DataFrame:
    """Distinct names that begin so, or that hold it if none begins so; at least two characters."""
    if len(prefix) < 2:
        return names.select(column).limit(0)
    found = names.where(F.startswith(F.lower(column), F.lit(prefix.lower()))).select(column).distinct().orderBy(column).limit(size)
    return found if found.take(1) else names.where(icontains(F.col(column), prefix)).select(column).distinct().orderBy(column).limit(size)


def related_by_category(laws: DataFrame, law, size: int = 8) -> DataFrame:
    """R7's fallback: same category and tier, by name."""
    one = laws.where(F.col("id") == law).select(F.col("category").alias("c"), F.col("tier").alias("t"))
    return laws.where(F.col("id") != law).join(F.broadcast(one), (F.col("category") == F.col("c")) & (F.col("tier") == F.col("t"))).drop("c", "t").orderBy("name", "id").limit(size)


def search(
    docs: DataFrame, index: DataFrame, stats: DataFrame, id_: str, query: str, *, boosts: Mapping[str, float] = BOOSTS, where: Column | None = None, bonus: Column | None = None,
    facet_sizes: Mapping[str, int] | None = None, size: int = 20, page: int = 1, fuzzy: bool = True, analyse=terms,
) -> tuple[DataFrame, DataFrame | None]:
    """A page of hits with all columns of docs, and facets over all that match. The query is analysed as the index was; its
    terms and near spellings are looked up in the fields of ``boosts``, the whole query in keyword fields; ``where`` filters without
    changing scores, ``bonus`` adds 1.5 where it holds."""
    from .catalog import facets

    asked = docs.sparkSession.range(1).select(analyse(F.lit(query)).alias("terms"), whole(F.lit(query)).alias("all")).first()
    words = spelt(index.where(~F.endswith("field", F.lit(".keyword"))), asked["terms"]) if fuzzy else [(t, 1.0) for t in asked["terms"]]
    rows = [(t, w, False) for t, w in words] + [(t, 1.0, True) for t in asked["all"]]
    if not rows:
        return docs.withColumn("score", F.lit(0.0)).limit(0), None
    weights = F.broadcast(docs.sparkSession.createDataFrame(rows, "term string, weight double, keyword boolean"))
    some = index.where(F.col("term").isin([r[0] for r in rows]) & F.col("field").isin(list(boosts))).withColumn("keyword", F.endswith("field", F.lit(".keyword")))
    hits = bm25(some.join(weights, ["term", "keyword"]), stats, [r[0] for r in rows], boosts, "weight").withColumnRenamed("doc", id_)
    matched = docs.join(hits, id_)
    matched = boosted(matched, bonus) if bonus is not None else matched
    matched = matched.where(where) if where is not None else matched
    found = matched.orderBy(F.desc("score"), id_).offset((page - 1) * size).limit(size)
    return found, facets(matched, facet_sizes) if facet_sizes else None


def ranked_window(hits: DataFrame, key: str, n: int) -> DataFrame:
    return hits.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "doc"))).where(F.col("r") <= n)
