"""Language-model scores by a probabilistic suffix tree.

States are contexts of up to ``DEPTH`` words. A context is retained if what followed it diverges from what its parent (the
context without its earliest word) predicts: the log-likelihood of its followers, each left out of its own count, must
exceed the parent's by ``GAIN``. Next-word distributions are smoothed with the parent's,
P(w | s) = (c(s w) + m P(w | parent)) / (c(s) + m), where m is the multiple of c(s) in ``STRENGTHS`` that the same
left-out likelihood prefers; the root is the add-one distribution of words. A text's score is the sum over its words and its
end of log10 P(word | longest retained suffix of what precedes it).

The counts are of the whole training corpus and stay distributed: chunks of documents exchange n-grams level by level. Words are
counted; then pairs behind words of ``LEAST`` occurrences, then triples behind such pairs, and so on to ``DEPTH``. A bucket numbers what it has counted, so behind a
context of under ``HEAVY`` occurrences an n-gram is two numbers, the context's in its bucket and the word's, and that bucket, which has all
followers, also settles the divergence. A more frequent context is spread over buckets by fingerprints (64 bits) of its n-grams; its divergence is the sum over
chunks of what their own followers of it gain, in a pass of its own. No table of the model is collected or broadcast.

Defined cases: a null, empty or wordless text is its end alone; a null doc_id counts as the empty id for the split;
repeated rows count and are scored each; without training texts all words are unknown and P = 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_bytes
from ._exchange import BUCKET_BYTES, M1, M2, M3, Answers, Arrays, answers, bucket_of, buckets_for, chunked, distinct_of, exchange, mix, open_chunks, pack, unpack
from ._words import plain, word_hashes

#: A context must occur LEAST times, however large the corpus.
DEPTH, LEAST, GAIN = 3, 8, 4.0
STRENGTHS = (0.25, 2.0, 16.0, 128.0)
#: From so many occurrences, followers of a context are too many for one bucket.
HEAVY = 4096
#: Pairs and triples, the most n-grams, are counted in so many rounds, each for a share of the buckets, so that less is on disk at once.
ROUNDS = {1: 2, 2: 2}
END = np.uint64(0x2545F4914F6CDD1D)
OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_deep bigint"


class Chunk:
    """Words of a chunk, each document's with its end: ``names`` are the distinct ones, ``of`` which one is at each place, ``n`` how
    many a document has."""

    #: Columns that it is stored in, without its texts.
    COLUMNS = ("rows", "distinct", "places")

    def __init__(self, table: pa.Table, words: tuple[np.ndarray, np.ndarray] | None = None):
        self.rows = table
        if words is None:
            found, n = word_hashes(plain(table.column("text")))
            inner = np.ones(len(found) + len(n), bool)
            inner[np.cumsum(n + 1) - 1] = False
            each = np.full(len(inner), END)
            each[inner] = found
            words = distinct_of(each)
            self.rows = table.drop_columns("text").append_column("n", pa.array(n + 1))  # with the end
        self.names, self.of = words
        self.n = self.rows.column("n").to_numpy()
        self.first = np.cumsum(self.n) - self.n
        self.held = self.rows.column("held_out").to_numpy()
        self.weight = np.repeat(~self.held, self.n)
        self.starts = np.zeros(len(self.of), bool)
        self.starts[self.first] = True

    @staticmethod
    def stored(table: pa.Table) -> dict[str, bytes]:
        c, sink = Chunk(table), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, c.rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(c.rows)
        return dict(zip(Chunk.COLUMNS, (sink.getvalue().to_pybytes(), pack({"key": c.names}), pack({"of": c.of.astype(np.uint32)})), strict=True))

    @staticmethod
    def read(blobs: dict[str, pa.Buffer]) -> Chunk:
        rows, names, of = (blobs[c] for c in Chunk.COLUMNS)
        return Chunk(pa.ipc.open_stream(rows).read_all().combine_chunks(), (unpack(names)["key"], unpack(of)["of"].astype(np.int64)))


class Level:
    """The distinct n-grams of k + 1 words that are counted in a chunk: ``at`` are the places where one ends, ``of`` which one, ``names``
    fingerprints, ``train`` training occurrences in the chunk. Each is ``word`` (of level 0) behind ``ctx`` (of level k - 1), which
    occurs ``n`` times. Of what is answered: ``total`` is the training count, ``number`` the n-gram's own (bucket, number there),
    ``best`` the strength of its context."""

    def __init__(self, at: np.ndarray, of: np.ndarray, names: np.ndarray, weight: np.ndarray):
        self.at, self.of, self.names = at, of, names
        self.train = np.bincount(of, weights=weight[at], minlength=len(names)).astype(np.uint32)
        self.total, self.best = np.zeros(len(names)), np.zeros(len(names), np.uint8)
        self.bucket, self.number = np.zeros(len(names), np.uint64), np.zeros(len(names), np.uint64)
        self.ctx = self.word = np.zeros(0, np.int64)
        self.n = np.zeros(0)
        self.spread = np.arange(len(names))  # n-grams that are sent by fingerprint, in that order
        self.near = np.zeros(0, np.int64)  # those that are sent to their context's bucket

    def answered(self, of: np.ndarray, got: Arrays, kind: int) -> None:
        if "n" in got:
            self.total[of] = got["n"]
            self.bucket[of] = got.get("bucket", 0)
            self.number[of] = got.get("id", np.zeros(1, np.uint32)).astype(np.uint64) << np.uint64(1) | np.uint64(kind > 0)
        if "best" in got:
            self.best[of] = got["best"]

    def contexts(self, least: int) -> np.ndarray:
        """Those that are counted behind, by bucket and number."""
        many = np.flatnonzero(self.total >= least)
        return many[np.argsort(self.bucket[many] << np.uint64(33) | self.number[many])]


def strongest(total: np.ndarray, bound: float) -> np.ndarray:
    """The strength that a context is best smoothed with: 1 + its index, or 0 if it isn't retained."""
    return np.where(np.max(total, axis=0, initial=-np.inf) > bound, np.argmax(total, axis=0) + 1, 0).astype(np.uint8)


def gain(seen: np.ndarray, n: np.ndarray, p: np.ndarray, strength: float) -> np.ndarray:
    """What one of ``seen`` followers of a context of ``n`` gains on the parent's ``p``, left out of its own count."""
    m = n * strength
    return np.log((np.maximum(seen - 1, 0) + m * p) / ((np.maximum(n - 1, 0) + m) * p))


def numbers(n: np.ndarray, least: int) -> np.ndarray:
    """Numbers of the n-grams of a bucket that can be contexts, in their order; others have that of one before."""
    return np.maximum(np.cumsum(n >= least) - 1, 0).astype(np.uint32)


def settle_counts(least: int) -> Callable[[Arrays], tuple[Arrays, Arrays]]:
    """Counts by fingerprint. At level 0 (``least`` 1) each training word has a number."""

    def settle(values: Arrays) -> tuple[Arrays, Arrays]:
        kinds, of = distinct_of(values["key"])
        n = np.bincount(of, weights=values["n"], minlength=len(kinds))
        counts = n.astype(np.int64 if n.max(initial=0) >= 1 << 32 else np.uint32)
        return {"n": counts[of], "id": numbers(n, least)[of]}, {"all": np.array([n.sum()]), "kinds": np.array([(n > 0).sum()], float)}

    return settle


def settle_gains(bound: float) -> Callable[[Arrays], tuple[Arrays, None]]:
    def settle(values: Arrays) -> tuple[Arrays, None]:
        kinds, of = distinct_of(values["key"])
        total = [np.bincount(of, weights=values[f"g{j}"], minlength=len(kinds)) for j in range(len(STRENGTHS))]
        return {"best": strongest(np.array(total), bound)[of]}, None

    return settle


def settle_followers(least: int, bound: float) -> Callable[[Arrays], tuple[Arrays, None]]:
    """Counts of all followers of a bucket's contexts, and each context's strength."""

    def settle(values: Arrays) -> tuple[Arrays, None]:
        words, word = distinct_of(values["word"])
        bits = np.uint64(len(words).bit_length())
        kinds, of = distinct_of(values["ctx"] << bits | word.astype(np.uint64))
        n = np.bincount(of, weights=values["n"], minlength=len(kinds))
        p, given = np.ones(len(kinds)), values["p"] > 0  # where it occurs in training
        p[of[given]] = values["p"][given]
        new = np.diff(kinds >> bits, prepend=np.uint64((1 << 64) - 1)) != 0
        first, ctx = np.flatnonzero(new), np.cumsum(new) - 1
        whole = np.add.reduceat(n, first)[ctx] if len(first) else n
        seen = n > 0
        total = [np.bincount(ctx[seen], weights=n[seen] * gain(n[seen], whole[seen], p[seen], s), minlength=len(first)) for s in STRENGTHS]
        return {"n": n.astype(np.uint32)[of], "id": numbers(n, least)[of], "best": strongest(np.array(total), bound)[ctx][of]}, None

    return settle


class Model:
    """What a pass over a chunk knows: the answers so far. Pass k has answered the counts of level k and the strengths of contexts of
    k words; ``gained[k]`` has those of frequent ones."""

    def __init__(self, passes: list[Answers], n_all: float = 0, kinds: float = 0, least: int = LEAST, heavy: int = HEAVY):
        self.passes, self.n_all, self.kinds, self.least, self.heavy = passes, n_all, kinds, least, heavy
        self.gained: dict[int, Answers] = {}

    def as_now(self) -> Model:
        """A copy for a pass that is sent to workers."""
        out = Model(list(self.passes), self.n_all, self.kinds, self.least, self.heavy)
        out.gained = dict(self.gained)
        return out

    def levels(self, chunk: int, c: Chunk, upto: int, near: bool = True) -> list[Level]:
        """Levels 0 to ``upto``, with what is answered; without ``near`` only n-grams behind frequent contexts, whose suffixes are as frequent."""
        out = [Level(np.arange(len(c.of)), c.of, c.names, c.weight)]
        bits = np.uint64(len(c.names).bit_length())
        for k in range(upto + 1):
            if k:
                out.append(self.behind(c, out, bits, self.least if near else max(self.least, self.heavy)))
            level = out[k]
            if k < len(self.passes):
                level.answered(level.spread, answers(self.passes[k], chunk), 0)
                if len(level.near):
                    level.answered(level.near, answers(self.passes[k], chunk, 1), 1)
            if k in self.gained and len(level.spread):
                ctx = self.frequent(out, k)
                best = np.zeros(len(out[k - 1].names), np.uint8)
                best[ctx] = answers(self.gained[k], chunk)["best"]
                level.best[level.spread] = best[level.ctx[level.spread]]
        return out

    def behind(self, c: Chunk, levels: list[Level], bits: np.uint64, least: int) -> Level:
        """The next level: n-grams behind contexts of ``least`` occurrences."""
        last, root = levels[-1], levels[0]
        contexts = last.contexts(least)
        rank = np.full(len(last.names), -1)
        rank[contexts] = np.arange(len(contexts))
        before = np.full(len(c.of), -1)
        before[last.at] = rank[last.of]
        at = np.flatnonzero((before[:-1] >= 0) & ~c.starts[1:]) + 1
        both, of = distinct_of(before[at - 1].astype(np.uint64) << bits | root.of[at].astype(np.uint64))
        ctx = contexts[(both >> bits).astype(np.int64)]
        word = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        level = Level(at, of, mix(last.names[ctx] * M1 + root.names[word] * M2 + M3), c.weight)
        level.ctx, level.word, level.n = ctx, word, last.total[ctx]
        frequent = level.n >= self.heavy
        spread = np.flatnonzero(frequent)
        level.spread, level.near = spread[np.argsort(level.names[spread])], np.flatnonzero(~frequent)
        return level

    def frequent(self, levels: list[Level], k: int) -> np.ndarray:
        """Contexts of k words (of level k - 1) whose n-grams are spread, by fingerprint."""
        there = np.zeros(len(levels[k - 1].names), bool)
        there[levels[k].ctx[levels[k].spread]] = True
        ctx = np.flatnonzero(there)
        return ctx[np.argsort(levels[k - 1].names[ctx])]

    def root(self, level: Level) -> np.ndarray:
        return (level.total + 1) / (self.n_all + self.kinds + 1)

    def counts(self, c: Chunk, levels: list[Level], k: int, buckets: int) -> list[tuple[np.ndarray, Arrays]]:
        """What a chunk sends of level k: n-grams by fingerprint, and those for their contexts' buckets."""
        level = levels[k]
        names = level.names[level.spread]
        out = [(bucket_of(names, buckets), {"key": names, "n": level.train[level.spread]})]
        if k:
            p, _ = self.probabilities(levels, k - 1)
            each = np.zeros(len(level.names))
            each[level.of] = p[level.at]
            ctx, word, last, root = level.ctx[level.near], level.word[level.near], levels[k - 1], levels[0]
            known = root.total[word] > 0
            word = np.where(known, root.bucket[word] << np.uint64(32) | root.number[word], 0 if not len(word) else (np.uint64(1) << np.uint64(63)) | word.astype(np.uint64))
            out.append((last.bucket[ctx], {"ctx": last.number[ctx], "word": word, "n": level.train[level.near], "p": np.where(level.train > 0, each, 0)[level.near].astype(np.float32)}))
        return out

    def gains(self, levels: list[Level], k: int, buckets: int) -> list[tuple[np.ndarray, Arrays]]:
        """What each frequent context of k words gains on its parent over a chunk's followers, for each strength."""
        p, _ = self.probabilities(levels, k - 1)
        level, ctx = levels[k], self.frequent(levels, k)
        each = np.ones(len(level.names))
        each[level.of] = p[level.at]
        use = level.spread[level.train[level.spread] > 0]
        sums = [np.bincount(level.ctx[use], weights=level.train[use] * gain(level.total[use], level.n[use], each[use], s), minlength=len(levels[k - 1].names)) for s in STRENGTHS]
        names = levels[k - 1].names[ctx]
        return [(bucket_of(names, buckets), {"key": names} | {f"g{j}": x[ctx].astype(np.float32) for j, x in enumerate(sums)})]

    def probabilities(self, levels: list[Level], upto: int) -> tuple[np.ndarray, np.ndarray]:
        """(probability at each place by states of up to ``upto`` words, depth of its state)."""
        p = self.root(levels[0])[levels[0].of]
        depth = np.zeros(len(p), np.int8)
        for k in range(1, upto + 1):
            level = levels[k]
            here = (level.best[level.of] > 0) & (depth[level.at] == k - 1)  # a state's suffixes are states
            at, of = level.at[here], level.of[here]
            m = level.n * np.array((0, *STRENGTHS))[level.best]
            p[at] = (level.total[of] + m[of] * p[at]) / (level.n + m)[of]
            depth[at] = k
        return p, depth


def score(docs: DataFrame, held_out: Callable[[], object] | None = None, depth: int = DEPTH, least: int = LEAST, gain: float = GAIN, heavy: int = HEAVY) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and n_deep (words scored from a
    state of at least one word). ``held_out``: a column that is true for texts to leave out of training; by default those
    whose crc32(doc_id) mod 7 is 2. Contexts of up to ``depth`` words count from ``least`` occurrences and are retained beyond ``gain``; those of ``heavy`` occurrences are spread over buckets."""
    rule = held_out() if held_out else F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rule.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = text_bytes(docs)
    buckets, few = buckets_for(size), buckets_for(size, 16 * BUCKET_BYTES)
    chunks = chunked(rows, "tree", Chunk.stored, Chunk.COLUMNS)
    model = Model([], least=least, heavy=heavy)
    for k in range(depth + 1):

        def send(chunk: int, blobs: dict[str, pa.Buffer], k: int = k, model: Model = model.as_now()) -> list[tuple[np.ndarray, Arrays]]:
            c = Chunk.read(blobs)
            return model.counts(c, model.levels(chunk, c, k), k, buckets)

        model.passes.append(exchange(chunks, f"tree-{k}", send, [settle_counts(least if k else 1), settle_followers(least, gain)], buckets, ROUNDS.get(k, 1)))
        if not k:
            figures = docs.sparkSession.read.schema("bucket int, payload binary, chunk bigint").parquet(*model.passes[0].paths).where("chunk = -1").select("payload")
            model.n_all, model.kinds = totals(figures)
            continue

        def send_gains(chunk: int, blobs: dict[str, pa.Buffer], k: int = k, model: Model = model.as_now()) -> list[tuple[np.ndarray, Arrays]]:
            return model.gains(model.levels(chunk, Chunk.read(blobs), k, near=False), k, few)

        model.gained[k] = exchange(chunks, f"tree-gains-{k}", send_gains, [settle_gains(gain)], few)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, blobs in open_chunks(batches):
            c = Chunk.read(blobs)
            levels = model.levels(chunk, c, depth)
            p, state = model.probabilities(levels, depth)
            base = np.log10(model.root(levels[0]))[levels[0].of]
            known = levels[0].total[levels[0].of] > 0
            each = lambda x: np.add.reduceat(x, c.first) if len(c.first) else np.zeros(0)  # noqa: E731  every document has its end
            yield pa.RecordBatch.from_arrays(
                [
                    c.rows.column("doc_id").combine_chunks(), pa.array(c.held), pa.array(c.n),
                    pa.array(each(known.astype(np.int64)).astype(np.int64)), pa.array(np.full(len(c.n), int(model.n_all))), pa.array(each(base)), pa.array(each(np.log10(p))),
                    pa.array(each((state > 0).astype(np.int64)).astype(np.int64)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_deep"],
            )

    return chunks.mapInArrow(finish, OUT)


def totals(figures: DataFrame) -> tuple[float, float]:
    """Sum of the buckets' figures: training tokens and distinct ones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._exchange import unpack

        for batch in batches:
            got = [unpack(x.as_buffer()) for x in batch.column("payload")]
            yield pa.RecordBatch.from_arrays([pa.array([float(sum(x[k][0] for x in got))]) for k in ("all", "kinds")], ["n", "kinds"])

    row = figures.mapInArrow(read, "n double, kinds double").agg(F.sum("n"), F.sum("kinds")).first()
    return row[0] or 0.0, row[1] or 0.0
