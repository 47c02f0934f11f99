"""Exact join of documents at Jaccard distance of at most r = 0.2 on word 5-gram sets, in the metric space of sets.

Pivots are documents; a document's region is that of a pivot, and ``d`` its distance to it.

1. Nearly all distances between documents are 1, so pivots drawn blindly would part nothing. A document at distance of at
   most r from x shares one of the first |x| - ceil(0.8 |x|) + 1 shingles of x in an order that holds for all documents; these
   are its window, and documents meet where windows share a shingle. The order puts frequent shingles last. By the same argument
   a wider window must share more than one with a partner's; documents for which too few of it occur in any other are out. Among those that meet, the one whose
   window is the least its own (the original rather than a much changed copy) is the pivot, and each other one is in its
   Voronoi region: a document is measured once against each pivot that it meets, and against no other.
2. Within r of the pivot a document is linked with it, and so with all others of that inner part: nothing between them is left
   to find. By the triangle inequality a document at d > r (the outer part) finds partners only at distances of d - r to d + r
   from the pivot: that is the ring of inner documents that are replicated into the join of the outer part.
3. The region's outer part and ring join recursively. The order is now: shingles outside of the pivot first, the rarest of the
   region before others. A pair
   that may link shares u = ceil(4/9 (|x| + |y|)) shingles, so one of the first |x| - u + 1 in it (with the region's least size
   for |y|); that is the new window, and pivots are chosen where these meet. A document whose cut with the pivot leaves
   no room for u has no window and is out. Regions that hold one class are closed, and those where documents have few of other
   classes (``LEAF``) are settled as they are: documents of the largest class are dealt out, all others go with each part and are
   compared where classes differ, and only links leave the task. So a class with a few strangers at its edge, which pivots
   can't part, is settled at any size.

A sub-region is without its pivot, so the recursion ends. Every pair left out is in one class or proven farther than r: classes are exact. Equal texts are one member. Sets are compared on 64-bit shingle
hashes, and 64-bit names of sub-regions only bring documents together that are then measured.

It gives classes, not linked pairs or their number: pairs of one class aren't measured, which is what keeps a group of
copies linear.

Defined cases: null, empty and wordless texts have an empty set and link with nothing; texts of fewer than n words have
their whole sequence as the one shingle; component_id is the smallest doc_id of the class, null only if all of its ids
are; repeated rows get one class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded, distinct_texts, forget, kept_rows, saved
from ._encode import pieces_of
from ._words import M2, distinct, mix, plain, word_hashes
from .components import components

SHINGLE = 5
#: Similarity of at least PART / WHOLE.
PART, WHOLE = 4, 5
R = 1 - PART / WHOLE
#: Shingles whose frequency is known to the order, at most; the order holds for any table, so that bounds a broadcast and no result.
FREQUENT = 1 << 18
#: A shingle is a candidate for that table with so many documents of a slice.
OFTEN = 4
#: Regions of at most so many documents beside the pivot, or whose documents have on average at most LEAF * LEAF / 2 of other classes, are
#: settled at once, in parts of at most so many shingles, of which documents outside of the largest class have half; others are parted further.
LEAF, SHINGLES = 64, 4 << 20
NO_ID = (1 << 63) - 1
_places = mix(np.arange(1, 65, dtype=np.uint64) * M2) | np.uint64(1)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct shingle hashes of each text, one text after the other; their numbers)."""
    h, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    full = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for j in range(n):
        full += h[j : j + len(full)] * _places[j]
    full = mix(full + np.uint64(n))
    sets = []
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if b - a >= n:
            sets.append(distinct(full[a : b - n + 1]))
        elif b > a:
            sets.append(mix(np.array([(h[a:b] * _places[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.fromiter(map(len, sets), np.int64, len(sets))


def needed(n: int) -> int:
    """Shingles of a set of n that a partner must share: ceil(0.8 n)."""
    return -(-PART * n // WHOLE)


def wide(n: int) -> int:
    """Length of the wide window of a set of n: floor(0.3 n) + 1."""
    return min(n, 3 * n // 10 + 1)


def partners_share(n: int) -> int:
    """Shingles of its wide window that a linked document has in its own at least. Sets of m have wide windows of more than
    m - ceil(0.8 m) + m / 10, and windows that long for a common order share more than m / 10 for the lesser m, which is 0.8 n or more."""
    return needed(n) // 10 + 1


def cut_of(n: int, m: int) -> int:
    """Shingles that linked sets of n and m share at least: ceil(4/9 (n + m))."""
    return -(-PART * (n + m) // (PART + WHOLE))


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending; classes of frequency) of the most frequent shingles, by counts over all texts of those that are
    frequent within slices."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces_of(b, "text")):
            flat = np.sort(shingle_sets(plain(batch.column("text")))[0])
            first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(flat)))
            yield pa.RecordBatch.from_arrays([pa.array(flat[first][n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN])], ["h", "n"])

    rows = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    by = np.argsort(h)
    return h[by], (np.log2(n[by]).astype(np.uint8) if len(n) else np.zeros(0, np.uint8))


def windows(texts: DataFrame) -> DataFrame:
    """Per row of ``texts`` (digest, rep, text): digest, rep, n, the wide window, how many of it are the window itself (lead), and
    how many of it a partner has at least in its own (least); saved; ``t`` numbers the rows."""
    often = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts))  # at most FREQUENT entries

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, level = often.value
        for batch in (x for b in batches for x in pieces_of(b, "text")):
            flat, n = shingle_sets(plain(batch.column("text")))
            at = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
            rank = np.where(names[at] == flat, level[at], 0) if len(names) else np.zeros(len(flat), np.uint8)
            found = []
            for a, b in zip((np.cumsum(n) - n).tolist(), np.cumsum(n).tolist(), strict=True):
                x = flat[a:b]
                if rank[a:b].any():
                    x = x[np.argsort(rank[a:b], kind="stable")]
                found.append(x[: wide(b - a)])
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)))
            lead, least = ([f(x) for x in n.tolist()] for f in (lambda x: x - needed(x) + 1, partners_share))
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("rep"), pa.array(n), lists, pa.array(lead, pa.int32()), pa.array(least, pa.int32())],
                ["digest", "rep", "n", "window", "lead", "least"],
            )

    rows = texts.select("digest", "rep", "text").mapInArrow(choose, "digest string, rep bigint, n bigint, window array<bigint>, lead int, least int")
    return saved(rows.select(F.monotonically_increasing_id().alias("t"), "*"), "jaccard-windows")


def met(windows_: DataFrame) -> DataFrame:
    """(key, t, n, own) of the windows' shingles in which several documents meet that may have partners; ``own`` is the share of a
    wide window that no other document has."""
    spread = windows_.select("t", F.posexplode("window").alias("place", "key"), "lead").select("key", "t", (F.col("place") < F.col("lead")).alias("leads"))
    crowd = saved(spread.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "jaccard-crowd")
    rows = saved(spread.join(crowd, "key"), "jaccard-wide")
    counts = windows_.select("t", "n", F.size("window").alias("w"), "least").join(rows.groupBy("t").agg(F.count("*").alias("k")), "t").where("k >= least")
    members = saved(counts.select("t", "n", (1 - F.col("k") / F.col("w")).alias("own")), "jaccard-able")
    out = saved(rows.where("leads").select("key", "t").join(bounded(members, 24), "t"), "jaccard-met")
    forget(crowd, rows)
    return out


def sets_of(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(t, rep, n, fps) of the members (t, digest, rep): whole sets, eight bytes a shingle, ascending; saved."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces_of(b, "text")):
            flat, n = shingle_sets(plain(batch.column("text")))
            raw, ends = flat.tobytes(), np.cumsum(n) * 8
            fps = [raw[a:b] for a, b in zip((ends - n * 8).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("rep"), pa.array(n), pa.array(fps, pa.binary())], ["t", "rep", "n", "fps"])

    rows = texts.select("digest", "text").join(bounded(members.select("t", "digest", "rep"), 80), "digest").select("t", "rep", "text")
    return saved(rows.mapInArrow(read, "t bigint, rep bigint, n bigint, fps binary"), "jaccard-sets")


def measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (t, p, own, least: the region's least size) with n, m (size of the pivot), both reps, i (size of the cut), take (length of
    the window around the pivot), the shingles outside of the pivot, and of those inside as many as the window may need."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("n", "m", "least"))
            for n, m, least, fx, fp in zip(*columns, batch.column("fx"), batch.column("fp"), strict=True):
                x, y = np.frombuffer(fx.as_buffer(), np.uint64), np.frombuffer(fp.as_buffer(), np.uint64)
                inside = y[np.minimum(np.searchsorted(y, x), m - 1)] == x
                i = int(inside.sum())
                take = max(0, n - cut_of(n, max(least, needed(n))) + 1)
                if n >= m and WHOLE * i >= PART * (n + m - i):  # an inner document at least as large as the pivot meets partners outside of the pivot
                    take = min(take, n - i)
                rows.append((i, take, x[~inside].view(np.int64), x[inside][: max(0, take - n + i)].view(np.int64)))
            size, take, outside, inner = zip(*rows, strict=True) if rows else ((), (), (), ())
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("t", "p", "own", "n", "m", "rep", "prep")), pa.array(size, pa.int64()), pa.array(take, pa.int64()), pa.array(outside, lists), pa.array(inner, lists)],
                ["t", "p", "own", "n", "m", "rep", "prep", "i", "take", "outside", "inside"],
            )

    left = sets.select("t", "n", "rep", F.col("fps").alias("fx"))
    right = sets.select(F.col("t").alias("p"), F.col("n").alias("m"), F.col("rep").alias("prep"), F.col("fps").alias("fp"))
    both = pairs.join(left, "t").join(right, "p").select("t", "p", "own", "n", "m", "rep", "prep", "least", "fx", "fp")
    return both.mapInArrow(cut, "t bigint, p bigint, own double, n bigint, m bigint, rep bigint, prep bigint, i bigint, take bigint, outside array<bigint>, inside array<bigint>")


def around(rows: DataFrame) -> DataFrame:
    """(key, t, n, own, outer) of the windows of measured documents: of a region's shingles outside of its pivot those come first that fewest of
    its documents have; ones that no other has take their places of a window and meet nothing."""
    same = ["p", "t", "n", "own", "outer"]
    each = rows.select(*same, (F.col("take") - F.size("outside")).alias("spare"), F.explode("outside").alias("s"))
    df = saved(each.groupBy("p", "s").agg(F.count("*").alias("k")).where("k > 1"), "jaccard-shared")
    own = Window.partitionBy("p", "t")  # a document's shingles
    shared = each.join(df, ["p", "s"]).withColumns({"place": F.row_number().over(own.orderBy("k", "s")), "there": F.count("*").over(own)})
    outside = shared.where(F.col("place") <= F.col("there") + F.col("spare")).select(*same, "s")
    inside = rows.select(*same, F.explode("inside").alias("s"))
    return outside.unionByName(inside).select(F.xxhash64("p", "s").alias("key"), "t", "n", "own", "outer")


def node(rep: str, t: str) -> Column:
    """Of the graph of links; the least of a class has its smallest doc_id."""
    return F.struct(F.coalesce(F.col(rep), F.lit(NO_ID)).alias("rep"), F.col(t).alias("t"))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two ascending sets are at distance of at most r."""
    n, m = len(x), len(y)
    if WHOLE * min(n, m) < PART * max(n, m):
        return False
    i = int((y[np.minimum(np.searchsorted(y, x), m - 1)] == x).sum())
    return WHOLE * i >= PART * (n + m - i)


def linked_with_any(sets: list[np.ndarray]) -> Callable[[int], list[int]]:
    """For the number of a set, those of all sets at distance of at most r: one pass over the shingles, numbered once."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(n)
    starts = ends - n
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    mark = np.zeros(int(codes.max()) + 1, np.int32)

    def find(j: int) -> list[int]:
        own = codes[starts[j] : ends[j]]
        mark[own] = 1
        i = np.add.reduceat(mark[codes], starts)
        mark[own] = 0
        return np.flatnonzero(WHOLE * i >= PART * (n + n[j] - i)).tolist()

    return find


def settle(region: pa.Table) -> pa.Table:
    """Links of a part of a region (t, class, rep, fps) that join classes, each with the first that it meets. Documents outside of its largest
    class are compared with all."""
    t, rep = (region.column(c).to_pylist() for c in ("t", "rep"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in region.column("fps")]
    known = np.unique(region.column("class").to_numpy(), return_inverse=True)[1]
    main, many = np.bincount(known).argmax(), linked_with_any(sets) if len(sets) > LEAF else None
    before, out = np.flatnonzero(known == main).tolist(), []
    for j in np.flatnonzero(known != main).tolist():
        for a in before if many is None else many(j):
            if known[a] != known[j] and (many is not None or linked(sets[a], sets[j])):
                out.append((t[a], rep[a], t[j], rep[j]))
                gone, kept = (known[a], known[j]) if known[j] == main else (known[j], known[a])
                known[known == gone] = kept
        before.append(j)
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["t", "rep", "p", "prep"])


def classes(rows: DataFrame, sets: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(t, low: the smallest doc_id of its class) of the documents that have a partner; ``rows`` (key, t, n, own) say where they meet."""
    rows, links, label = rows.withColumn("outer", F.lit(True)), None, None
    none = rows.sparkSession.createDataFrame([], "t bigint, class bigint, low bigint")
    while True:
        known = (label if label is not None else none).select("t", "class")
        held = rows.join(bounded(known, 24), "t", "left").withColumn("class", F.coalesce("class", "t"))
        first = F.min(F.struct("own", F.xxhash64("t"), "t")).alias("first")
        regions = held.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.max("outer").alias("open"), first).where("lo <> hi and open").select("key", F.col("first.t").alias("p"))
        pairs = saved(held.join(regions, "key").where("t <> p").groupBy("t", "p").agg(*[F.first(c).alias(c) for c in ("n", "own", "class")]), "jaccard-pairs")
        each = pairs.groupBy("p", "class").agg(F.count("*").alias("c"), F.min("n").alias("least"), F.sum("n").alias("all"))
        sizes = each.groupBy("p").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("c")).alias("same"), F.min("least").alias("least"), F.sum("all").alias("all"), F.max(F.struct("c", "all", "class")).alias("main"))
        few = (F.col("k") <= leaf) | (F.col("k") * F.col("k") - F.col("same") <= leaf * leaf / 2 * F.col("k"))
        small = (F.col("k") == 1) | (few & (F.col("all") - F.col("main.all") <= SHINGLES // 2))
        sizes = saved(sizes.select("p", "least", small.alias("small"), F.col("main.class").alias("main"), F.ceil(F.col("main.all") / (SHINGLES // 2)).cast("int").alias("parts")), "jaccard-sizes")
        pairs = pairs.join(bounded(sizes, 40), "p")
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        dealt = F.when(F.col("class") == F.col("main"), F.array(F.pmod(F.xxhash64("t"), "parts").cast("int"))).otherwise(every)
        members = pairs.where("small").select("p", "t", F.explode(dealt).alias("part")).unionByName(sizes.where("small").select("p", F.col("p").alias("t"), F.explode(every).alias("part")))
        members = members.join(bounded(known, 24), "t", "left").withColumn("class", F.coalesce("class", "t"))
        members = saved(members, "jaccard-members")  # narrow: sets stay where they are and only go to their regions
        new = saved(sets.select("t", "rep", "fps").join(bounded(members, 32), "t").groupBy("p", "part").applyInArrow(settle, "t bigint, rep bigint, p bigint, prep bigint"), "jaccard-links")
        more = bool(sizes.where("not small").take(1))
        if more:
            union = F.col("n") + F.col("m") - F.col("i")
            big = pairs.where("not small")
            found = measure(big.select("t", "p", "own", "least"), sets).withColumns({"outer": WHOLE * F.col("i") < PART * union, "d": 1 - F.col("i") / union})
            found = saved(found, "jaccard-measured")
            new = new.unionByName(found.where("not outer").select("t", "rep", "p", "prep"))
        if label is not None:  # links inside a class tell nothing new
            of = lambda c: bounded(known, 24).select(F.col("t").alias(c), F.col("class").alias(f"{c}_class"))
            new = new.join(of("t"), "t", "left").join(of("p"), "p", "left").where(F.coalesce("t_class", "t") != F.coalesce("p_class", "p"))
        if new.take(1):
            edges = new.select(node("rep", "t").alias("a"), node("prep", "p").alias("b"))
            links = edges if links is None else links.unionByName(edges)
            label = saved(components(links).select(F.col("node.t").alias("t"), F.col("component.t").alias("class"), F.col("component.rep").alias("low")), "jaccard-classes")
        if not more:
            return (label if label is not None else none).select("t", "low")
        ring = saved(found.where("outer").groupBy("p").agg((F.min("d") - R - 1e-9).alias("from")), "jaccard-rings")
        stay = found.join(bounded(ring, 16), "p").where(F.col("outer") | (F.col("d") >= F.col("from")))
        rows = saved(around(stay), "jaccard-met")


def near_duplicates(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id (smallest doc_id that links reach), the same for any ``leaf`` of 1 or more."""
    texts = distinct_texts(docs)
    wide_windows = windows(texts)
    rows = met(wide_windows)
    named = saved(wide_windows.select("t", "digest", "rep", "n"), "jaccard-names")
    forget(wide_windows)
    members = saved(named.join(rows.select("t").distinct(), "t", "left_semi").select("t", "digest", "rep"), "jaccard-members")
    label = classes(rows, sets_of(texts, members), leaf)
    low = F.nullif(F.coalesce("low", F.col("rep")), F.lit(NO_ID))
    ids = saved(named.select("t", "digest", "n", "rep").join(bounded(label, 24), "t", "left").select("digest", "n", low.alias("low")), "jaccard-ids")
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("low"))
    return each.join(bounded(ids, 100), "digest").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one of each class: the one of the smallest doc_id. Documents without words stay, all of them."""
    ids = near_duplicates(docs).where("component_id <=> doc_id").select("doc_id").distinct()
    return kept_rows(docs, ids)
