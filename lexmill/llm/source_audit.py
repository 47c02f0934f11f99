"""Source divergence audit: how far the term shares of a language's sources are from each other, and which terms set a source apart.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language keeps the terms of ``least`` documents. With V kept terms, of
which a group (language, source) holds N, a term that it holds ``n`` times has the share p = 1 + floor(10**9 * (n + 1) / (N + V)); the distance of
p from q is f(p, q) = floor((p - q)**2 / q). All arithmetic is in integers.

Pairs: f summed over all kept terms. Most terms are in neither of two sources, or in one: a pair starts from the baseline V * f(p0, q0), p0 being the
share of a term that isn't there; terms of one source correct it by that source's distinct counts, terms of both by the term's own list of
sources, so that no term that is absent is ever a row.

Terms: the ``k`` greatest values above the language's share, by radix select: histograms over the leading bits of the values, summed over all tasks, give the
bucket of each group's kth value, which is refined bits by bits; a bucket of equal values is refined by the bytes that come after what its terms have
in common. When few rows are left in a group's bucket, they are sorted with those above.

Defined cases: null text, lang and source are ''; a document without terms makes its group occur; repeated rows are documents each; a language without kept terms
has values of 0 for its pairs and no term rows; a language of one source has no pairs; other columns are ignored; an empty table gives no rows. Counts may reach 9 * 10**15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded, saved

SHARE = 1_000_000_000
#: Letters keep their place or are lower-cased, bytes beyond ASCII stay, all else parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Terms that a task counts before it passes them on, and tokens that are counted at once.
HELD, SLICE = 600_000, 1 << 20
#: Pairs of a term's sources that are made at once.
AT_ONCE = 1 << 20
#: Bits of a value that a histogram tells apart.
DIGIT = 12
#: Rows of a group's last bucket that are sorted with the rows above it.
SLACK = 1000


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in lists of bounded size; a text is cut only where terms part."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        part = raw[at:end].translate(_TERMS)
        while end < len(raw) and not part.endswith(b" "):  # to the end of the term
            more = raw[end : end + 4096].translate(_TERMS)
            cut = more.find(b" ")
            part, end = (part + more, end + 4096) if cut < 0 else (part + more[: cut + 1], end + cut + 1)
        yield part.split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, df documents), summed over all tasks; dealt by language and term, for what groups by those next."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                each = iter(n)
                while terms := list(islice(each, 50_000)):
                    columns = [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms]), pa.array([df[t] for t in terms])]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "df"])
            held.clear()

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in _pieces(text.as_py()):
                    n.update(terms)
                    seen.update(terms)
                df.update(seen)
                size += len(n) - before
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    given = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    each = given.mapInArrow(count, "lang string, source string, term string, n long, df long")
    return each.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: str, total: str, v: str) -> Column:
    """p of a count; decimals hold products beyond 64 bits."""
    return F.expr(f"1 + (cast({SHARE} as decimal(10, 0)) * cast({n} + 1 as decimal(20, 0))) div cast({total} + {v} as decimal(20, 0))")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Each occurring group (lang, source) with its number ``sid`` in the language, ``group_size`` (N), ``p0`` (share of an absent term), and the language's ``terms`` (V) and ``lang_size``.
    The window is over a language's sources, one row each."""
    both = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"))
    sizes = kept.select("lang", F.inline("sources")).groupBy("lang", "source").agg(F.sum("n").alias("group_size"))
    rows = both.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["group_size", "terms", "lang_size"])
    p0 = share("0", "group_size", "greatest(terms, 1)")
    return rows.withColumn("p0", p0).withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")))


def term_shares(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, term, source, sid, p, p0, q) of the terms that a group holds; q is the language's share."""
    rows = kept.select("lang", "term", "total", F.inline("sources")).join(bounded(groups, 128), ["lang", "source"])
    return rows.select("lang", "term", "source", "sid", share("n", "group_size", "terms").alias("p"), "p0", share("total", "lang_size", "terms").alias("q"))


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of pairs of sources by the terms that both hold, summed by pair for each million of pairs of a term."""
    f = lambda p, q: (p - q) * (p - q) // q
    for batch in batches:
        lists = batch.column("sources")
        flat = lists.flatten()
        sid, p, p0 = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        langs = batch.column("lang").dictionary_encode()
        lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)  # where the lists of each entry's term begin
        partners = np.repeat(sizes, sizes)
        ends, a = np.cumsum(partners), 0
        while a < len(sid):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, side="right")))
            left = np.repeat(np.arange(a, b), partners[a:b])
            begin = np.cumsum(partners[a:b]) - partners[a:b]
            right = first[left] + np.arange(len(left)) - np.repeat(begin, partners[a:b])
            apart = left != right
            left, right = left[apart], right[apart]
            value = f(p[left], p[right]) - f(p[left], p0[right]) - f(p0[left], p[right]) + f(p0[left], p0[right])
            order = np.lexsort((sid[right], sid[left], lang[left]))
            left, right, value = left[order], right[order], value[order]
            if len(left):
                new = np.flatnonzero(np.concatenate(([True], (lang[left][1:] != lang[left][:-1]) | (sid[left][1:] != sid[left][:-1]) | (sid[right][1:] != sid[right][:-1]))))
                columns = [langs.dictionary.take(pa.array(lang[left[new]])), pa.array(sid[left[new]], pa.int32()), pa.array(sid[right[new]], pa.int32()), pa.array(np.add.reduceat(value, new))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "s", "t", "value"])
            a = b


def pair_values(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources. A term's sources are gathered in a row: at most as many as the language has."""
    a = groups.select("lang", F.col("sid").alias("s"), "source", F.col("p0").alias("ps"), "terms")
    b = groups.select("lang", F.col("sid").alias("t"), F.col("source").alias("item"), F.col("p0").alias("pt"))
    pairs = a.join(bounded(b, 128), "lang").where("s <> t").withColumn("base", F.col("terms") * distance("ps", "pt"))
    counts = saved(shares.groupBy("lang", "sid", "p").agg(F.count("*").alias("m")), "audit-counts")  # p of a source tells its counts apart
    ends = bounded(pairs.select("lang", "s", "t", "ps", "pt"), 64)
    of_s = counts.withColumnRenamed("sid", "s").join(ends, ["lang", "s"]).select("lang", "s", "t", (F.col("m") * (distance("p", "pt") - distance("ps", "pt"))).alias("value"))
    of_t = counts.withColumnRenamed("sid", "t").join(ends, ["lang", "t"]).select("lang", "s", "t", (F.col("m") * (distance("ps", "p") - distance("ps", "pt"))).alias("value"))
    lists = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "p", "p0")).alias("sources")).where(F.size("sources") > 1)
    both = lists.select("lang", "sources").mapInArrow(_common, "lang string, s int, t int, value long")
    more = of_s.unionByName(of_t).unionByName(both).groupBy("lang", "s", "t").agg(F.sum("value").alias("more"))
    return pairs.join(more, ["lang", "s", "t"], "left").select("lang", "source", "item", (F.col("base") + F.coalesce("more", F.lit(0))).alias("value"))


def _byte(item: Column, at: Column) -> Column:
    """Byte number ``at`` (from 0) of an item, plus 1; 0 behind its end."""
    return F.when(F.octet_length(item) > at, F.conv(F.hex(F.substring(item.cast("binary"), at + 1, 1)), 16, 10).cast("long") + 1).otherwise(F.lit(0).cast("long"))


def top_by_radix(values: DataFrame, keys: Sequence[str], k: int, slack: int = SLACK) -> DataFrame:
    """Rows (keys, item, value) of a saved table that are among the k of each group by value descending, then item; a few more rows come with them.
    Values aren't negative, items distinct in a group.

    A group's state is its bucket: rows with value >> shift = prefix whose item begins with ``head``, or is ``head`` where it ``ends``; ``need`` of them are
    still to be found, all above are in. States are a row a group, histograms at most 4096 rows a group."""
    keys = list(keys)
    digits = F.ceil(F.length(F.bin(F.max("value"))) / DIGIT)  # that a group's greatest value has
    sizes = values.groupBy(*keys).agg(F.count("*").alias("size"), (digits * DIGIT).cast("int").alias("shift"))
    state = saved(sizes.select(*keys, F.lit(0).cast("long").alias("prefix"), "shift", F.lit(k).cast("long").alias("need"), "size", F.lit("").cast("binary").alias("head"), F.lit(False).alias("ends")), "radix")
    in_bucket = F.expr("shiftright(value, shift) = prefix and (shift > 0 or octet_length(head) = 0 or startswith(cast(item as binary), head))")
    while state.where(F.col("size") > F.col("need") + slack).take(1):
        open_, done = state.where(F.col("size") > F.col("need") + slack), state.where(F.col("size") <= F.col("need") + slack)
        rows = values.join(bounded(open_, 128), keys).where(in_bucket)
        # In a bucket of one value, what its least and its greatest item have in common is a beginning of all.
        ends = rows.where("shift = 0").groupBy(*keys).agg(F.min("item").alias("a"), F.max("item").alias("z"))
        same = F.expr("array_position(transform(sequence(1, least(octet_length(a), octet_length(z)) + 1), i -> substring(cast(a as binary), i, 1) <> substring(cast(z as binary), i, 1)), true)") - 1
        ends = ends.select(*keys, F.expr("cast(a as binary)").substr(F.lit(1), same.cast("int")).alias("common"), same.alias("at"))
        rows = rows.join(bounded(saved(ends, "radix-ends"), 128), keys, "left")
        by_value = F.expr(f"shiftright(value, shift - {DIGIT}) & {(1 << DIGIT) - 1}")
        digit = F.when(F.col("shift") > 0, (1 << DIGIT) - by_value).otherwise(_byte(F.col("item"), F.coalesce("at", F.lit(0))))  # ascending: the first come first
        counts = rows.groupBy(*keys, "prefix", "shift", "need", "head", "common", digit.alias("digit")).agg(F.count("*").alias("n"))
        order = Window.partitionBy(*keys).orderBy("digit")
        counts = counts.withColumn("upto", F.sum("n").over(order)).where("upto >= need and upto - n < need")
        byte = F.when(F.col("digit") > 0, F.unhex(F.lpad(F.hex(F.col("digit") - 1), 2, "0"))).otherwise(F.lit("").cast("binary"))
        new = counts.select(
            *keys, F.when(F.col("shift") > 0, F.shiftleft("prefix", DIGIT) + ((1 << DIGIT) - F.col("digit"))).otherwise(F.col("prefix")).alias("prefix"),
            F.greatest(F.col("shift") - DIGIT, F.lit(0)).alias("shift"), (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"), F.col("n").alias("size"),
            F.when(F.col("shift") > 0, F.col("head")).otherwise(F.concat("common", byte)).alias("head"), ((F.col("shift") == 0) & (F.col("digit") == 0)).alias("ends"),
        )
        state = saved(done.unionByName(new), "radix")
    # Items below the head in byte order come before the bucket.
    among = F.expr("shiftright(value, shift) > prefix or (shiftright(value, shift) = prefix and (shift > 0 or octet_length(head) = 0 or cast(item as binary) < head or if(ends, cast(item as binary) = head, startswith(cast(item as binary), head))))")
    return values.join(bounded(state, 128), keys).where(among).select(*keys, "item", "value")


def ranked(rows: DataFrame, part: str, k: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return out if k is None else out.where(F.col("rank") <= k)


def audit(docs: DataFrame, least: int = 3, k: int = 200, slack: int = SLACK) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language, part ``term`` the terms of a source."""
    counts = term_counts(docs).groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("sources"))
    kept = saved(counts.where(F.col("df") >= least).select("lang", "term", "total", "sources"), "audit-terms")
    groups = saved(groups_of(docs, kept), "audit-groups")
    shares = saved(term_shares(kept, groups), "audit-shares")
    apart = saved(shares.where("p > q").select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value")), "audit-values")
    return ranked(pair_values(shares, groups), "pair").unionByName(ranked(top_by_radix(apart, ["lang", "source"], k, slack), "term", k))


#: DuckDB SQL for ``audit`` over documents.
AUDIT_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
toks AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
per AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS df FROM toks GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS total FROM per GROUP BY ALL HAVING sum(df) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS nl FROM kept GROUP BY ALL),
held AS MATERIALIZED (SELECT per.* FROM per JOIN kept USING (lang, term)),
sizes AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM held GROUP BY ALL),
grp AS MATERIALIZED (SELECT g.lang, g.source, coalesce(s.n, 0) AS n, coalesce(l.v, 0) AS v, coalesce(l.nl, 0) AS nl
        FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes s USING (lang, source) LEFT JOIN langs l USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS cnt, 1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 1)) // (g.n + g.v) AS p,
             1 + (1000000000::HUGEINT * (k.total + 1)) // (g.nl + g.v) AS q
      FROM grp g JOIN kept k USING (lang) LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE cnt > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)))::INT AS rank FROM every
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)))::INT AS rank FROM terms) WHERE rank <= 200
"""
