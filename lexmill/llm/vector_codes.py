"""Vector code compression: product codes in integer arithmetic.

Each component x becomes floor(4096 * x). Vectors are cut into equal consecutive parts; each part position has a codebook of entries, at first
that part of the vectors of the smallest ids. In each round a kd-tree per codebook goes to all tasks; a branch-and-bound search finds every part's
nearest entry, visiting nodes whose bound equals the best so far, so that of equal entries the lower index wins; the tasks' integer sums are
added up, and an entry becomes the componentwise floor of its parts' mean. The driver holds nothing but the codebooks.

Defined cases: rows whose vector is null or empty or holds null or non-finite components drop out, and so do rows whose vector isn't as long as
that of the smallest kept id; a length that the parts don't divide is filled with zeros; integers stop at +-2**28, so that no squared distance
leaves 64 bits; an id that several rows have is one start of the codebooks, by its least vector, and each row gets its code; a null id comes after all others;
with fewer kept ids than entries the codebooks are smaller; labels may be null, which is a label of its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded, saved

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Largest integer component: squared differences of 2**29 over up to 32 components of a part stay in 64 bits.
MOST = 1 << 28
LEAF = 2


@dataclass
class Node:
    """A kd-tree node with the bounding box of its entries; a leaf has entries, another node has two children."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None
    points: np.ndarray | None = None
    children: tuple[Node, Node] | None = None

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each row to the box."""
        gap = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        return (gap * gap).sum(axis=1)


def kd_tree(points: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """Split at the median of the widest axis."""
    entries = np.arange(len(points)) if entries is None else entries
    own = points[entries]
    low, high = own.min(axis=0), own.max(axis=0)
    if len(entries) <= LEAF:
        return Node(low, high, entries, own)
    order = entries[np.argsort(own[:, np.argmax(high - low)], kind="stable")]
    return Node(low, high, children=tuple(kd_tree(points, half) for half in np.array_split(order, 2)))


def nearest(tree: Node, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row: all rows go down together, each to its nearer child first, and to the other one unless its
    bound is greater than the best found."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).max)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.children is None:
            for entry, point in zip(node.entries, node.points, strict=True):
                d = ((x[rows] - point) ** 2).sum(axis=1)
                better = (d < best[rows]) | ((d == best[rows]) & (entry < at[rows]))
                best[rows[better]], at[rows[better]] = d[better], entry
            return
        a, b = node.children
        to_a, to_b = a.bound(x[rows]), b.bound(x[rows])
        first = to_a <= to_b
        visit(a, rows[first])
        visit(b, rows[~first])
        for far, other, bound in ((b, rows[first], to_b[first]), (a, rows[~first], to_a[~first])):
            visit(far, other[bound <= best[other]])

    visit(tree, np.arange(len(x)))
    return at, best


def integers(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Saved rows (id, label, ints) of the vectors that can be coded."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("int"))
    good = v.isNotNull() & (F.size(v) > 0) & ~bad
    rows = saved(vectors.where(good).select(F.col(id_).alias("id"), F.col(label).alias("label"), whole.alias("ints")), "vectors")
    size = rows.agg(F.min_by(F.size("ints"), F.struct(F.col("id").isNull().alias("none"), "id", "ints"))).first()[0]
    return rows.where(F.size("ints") == (size or 0))


def matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Parts of a batch of vectors: (rows, parts, width) integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)
    more = -flat.shape[1] % parts
    return np.pad(flat, ((0, 0), (0, more))).reshape(len(flat), parts, -1)


def first_entries(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width) from the smallest ids."""
    order = F.col("id").asc_nulls_last()
    ids = [r["id"] for r in rows.select("id").distinct().orderBy(order).limit(entries).collect()]
    known = [i for i in ids if i is not None]
    some = F.col("id").isin(known) if known else F.lit(False)
    some = some | F.col("id").isNull() if None in ids else some
    found = rows.where(some).groupBy("id").agg(F.min("ints").alias("ints")).orderBy(order).collect()  # at most ``entries`` rows
    return matrix(pa.array([r["ints"] for r in found], pa.list_(pa.int32())), parts).transpose(1, 0, 2) if found else np.zeros((parts, 0, 0), np.int64)


def one_round(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Assign all parts, and move each entry that has any to the floor of their mean."""
    sent = rows.sparkSession.sparkContext.broadcast([kd_tree(b) for b in books])
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = matrix(batch.column("ints"), parts)
            for p, tree in enumerate(sent.value):
                at, _ = nearest(tree, x[:, p])
                np.add.at(total[p], at, x[:, p])
                count[p] += np.bincount(at, minlength=entries)
        there = np.nonzero(count)
        columns = [*there, count[there], pa.array(list(total[there]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["part", "entry", "n", "sums"])

    each = rows.select("ints").mapInArrow(sums, "part long, entry long, n long, sums array<long>")
    wide = each.select("part", "entry", "n", F.posexplode("sums").alias("place", "x"))
    new = books.copy()
    for r in wide.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # parts x entries x width numbers
        new[r["part"], r["entry"], r["place"]] = int(r["x"]) // r["n"]
    sent.destroy()
    return new


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of the rows of ``integers``."""
    if not 1 <= entries <= 256:
        raise ValueError("two hexadecimal digits hold 256 entries")
    books = first_entries(rows, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = one_round(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error): two hexadecimal digits a part, and the squared distances to the entries, summed."""
    trees = rows.sparkSession.sparkContext.broadcast([kd_tree(b) for b in books] if books.size else [])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    digits = np.array([f"{i:02x}" for i in range(256)])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = matrix(batch.column("ints"), len(trees.value))
                found = [nearest(tree, x[:, p]) for p, tree in enumerate(trees.value)]
                code = ["".join(c) for c in np.stack([digits[at] for at, _ in found], axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code), pa.array(sum(d for _, d in found))], ["id", "label", "code", "error"])

    return rows.select("id", "label", "ints").mapInArrow(codes, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``coded`` with the vector that its codes stand for, as ``decoded``."""
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1
    table = [F.array(*[F.array(*[F.lit(int(v) / SCALE) for v in e]) for e in book]) for book in books]
    return coded.withColumn("decoded", F.flatten(F.array(*[F.element_at(t, entry(p)) for p, t in enumerate(table)])))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def compressed(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per kept row: id, code, error, label_error (the label's summed error) and codebooks_sha256."""
    rows = integers(vectors, id_, vector, label)
    books = fit(rows, parts, entries, rounds)
    coded = saved(encode(rows, books), "vector-codes")
    labels = bounded(saved(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "vector-labels"), 32)
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds as one chain of tables."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (SELECT r, part, entry, sum((x - v) * (x - v))::BIGINT AS d FROM x JOIN b{r} USING (part, place) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT r, part, min(d) AS d, arg_min(entry, d * {entries} + entry) AS entry FROM d{r} GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
s{r} AS MATERIALIZED (SELECT part, entry, place, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM x JOIN a{r} USING (r, part) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT part, entry, place, coalesce((s - ((s % n) + n) % n) // n, v) AS v FROM b{r} LEFT JOIN s{r} USING (part, entry, place))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda e: floor(4096 * e::DOUBLE)::BIGINT) AS v
              FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT r, ((p - 1) // (len(v) // {parts}))::INT AS part, ((p - 1) % (len(v) // {parts}))::INT AS place, v[p] AS x FROM kept, unnest(range(1, len(v) + 1)) AS t(p)),
b0 AS MATERIALIZED (SELECT part, (r - 1)::INT AS entry, place, x AS v FROM x WHERE r <= {entries}),{','.join(steps)},
books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS sha FROM b{rounds}),
codes AS (SELECT vec_id, label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} JOIN kept USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM codes, books
"""


#: DuckDB SQL for ``compressed`` over embeddings.
CODES_SQL = _sql()
