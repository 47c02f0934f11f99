"""Toxicity by noisy-channel deobfuscation.

A writer's word goes through a channel that swaps letters for look-alikes, stretches letters and puts marks or spaces
between them. A token that shows such traces (look-alikes among letters, a letter three times in a row, single letters
parted by marks, runs of single-letter words) is decoded: a lattice holds the letters that each character may stand for,
and Viterbi's algorithm finds the word that a character trigram model and the channel's costs make likeliest. Other tokens
are their own likeliest word. Tokens and runs are decoded whole, whatever their length. Where marks or spaces part letters,
borders of words can't be told from them, so a word may begin at each letter after one. A text's score is that of its most
telling word, as read and as restored.

The character model is counted over all texts. The classifier, a decision list, is fitted on at most ``SAMPLE`` labelled
rows outside the held-out part, taken in an order fixed by a hash of doc_id. Its features are words and word beginnings of 3 to 7 letters, which catch
inflected and compounded forms.

Defined cases: null and empty texts, and texts without a telling word, get the lowest score; a null doc_id is in the part
with crc32("") and can't be labelled; labels with a null are ignored; repeated rows are scored each; without labels all
scores are 0; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import kept_rows, release, saved
from ._encode import pieces_of
from ._words import plain

#: Labelled rows that the classifier is fitted on at most: clean, toxic.
SAMPLE = (16_000, 2_500)
LEAST, SHRINK, CUT = 4, 12.0, 0.3
PREFIXES = (3, 4, 5, 6, 7)
#: Letters that a character may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
MARKS = frozenset(".-_*~'`,:;/\\ ·​")
#: Costs (natural logarithms) of a look-alike, a mark and a stretched letter.
SWAP, MARK, STRETCH = -2.0, -0.7, -0.7
EDGE = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in "@$!|+(") + "«»“”„’…"
TRACE = re.compile(
    r"(?=.*[^\W\d_])(?=.*[0-9@$!|+(€£¡])(?:.*[^\W\d_])?.*[0-9@$!|+(€£¡].*[^\W\d_]"  # look-alikes before a letter
    r"|[^\W\d_].*[0-9@$!|+(€£¡]$|([^\W\d_])\1\1|^[^\W_](?:[.\-_*~,:;/\\·][^\W_]){2,}$"
)
#: Byte classes of the character model: 0 parts words, 1-26 a-z, then lead and continuation bytes.
SYMBOL = np.zeros(256, np.int64)
SYMBOL[0x61:0x7B] = SYMBOL[0x41:0x5B] = np.arange(1, 27)
SYMBOL[0xC3], SYMBOL[0xC0:0xC3], SYMBOL[0xC4:] = 27, 28, 28
SYMBOL[0x80:0xC0] = 29 + (np.arange(0x80, 0xC0) & 0x1F)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of the 64 ** 3 symbol trigrams of all texts: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 18, np.int64)
        for batch in (x for b in batches for x in pieces_of(b, "text")):
            text = batch.column("text")
            ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
            s = SYMBOL[np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
            if len(s) > 2:
                total += np.bincount(s[:-2] << 12 | s[1:-1] << 6 | s[2:], minlength=1 << 18)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << 18)
    out[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out


def trigram_logs(counts: np.ndarray) -> np.ndarray:
    """log P(c | a b), smoothed with P(c | b) and P(c)."""
    c3 = counts.reshape(64, 64, 64)
    c2 = c3.sum(axis=0)
    p1 = (c2.sum(axis=0) + 1) / (c2.sum() + 64)
    p2 = (c2 + 8 * p1) / (c2.sum(axis=1, keepdims=True) + 8)
    return np.log((c3 + 8 * p2) / (c3.sum(axis=2, keepdims=True) + 8)).astype(np.float32)


class Decoder:
    """Viterbi over a token's lattice; a state is the last two symbols and the last letter written."""

    def __init__(self, logs: np.ndarray, limit: int = 100_000):
        self.logs, self.limit = logs, limit
        self.cache: dict[str, tuple[str, list[int]]] = {}

    def __call__(self, token: str) -> str:
        return self.parts(token)[0]

    def parts(self, token: str) -> tuple[str, list[int]]:
        """(the word, places of its letters that follow a mark)."""
        if (got := self.cache.get(token)) is None:
            got = self._decode(token)
            if len(self.cache) < self.limit and len(token) <= 64:  # longer ones seldom come again
                self.cache[token] = got
        return got

    def _step(self, state: tuple[int, int], letter: str) -> tuple[float, tuple[int, int]]:
        gain, (a, b) = 0.0, state
        for byte in letter.encode():
            c = int(SYMBOL[byte])
            gain += float(self.logs[a, b, c])
            a, b = b, c
        return gain, (a, b)

    def _decode(self, token: str) -> tuple[str, list[int]]:
        """A path is a chain (path before, letter written, whether a mark precedes it), so a step costs the same at any length."""
        best: dict[tuple, tuple[float, tuple | None]] = {((0, 0), ""): (0.0, None)}
        marked = False
        for seen in token:
            options = [(x, SWAP) for x in LOOKS.get(seen, "")] + ([(seen, 0.0)] if seen.isalpha() else [])
            new: dict[tuple, tuple[float, tuple | None]] = {}
            for (state, last), (score, path) in best.items():
                ways = []
                if seen in MARKS or not options:
                    ways.append((score + MARK, (state, last), path))
                for letter, cost in options:
                    if letter == last:
                        ways.append((score + cost + STRETCH, (state, last), path))
                    gain, after = self._step(state, letter)
                    ways.append((score + cost + gain, (after, letter), (path, letter, marked)))
                for way in ways:
                    if way[1] not in new or way[0] > new[way[1]][0]:
                        new[way[1]] = (way[0], way[2])
            best, marked = new, seen in MARKS or not options
        _, path = max(((s + float(self.logs[k[0][0], k[0][1], 0]), p) for k, (s, p) in best.items()), key=lambda x: x[0], default=(0.0, None))
        letters, after = [], []
        while path is not None:
            path, letter, follows = path
            letters.append(letter)
            after.append(follows)
        return "".join(reversed(letters)), [i for i, x in enumerate(reversed(after)) if x and i]


def features(word: str) -> list[str]:
    """The word, and its beginnings."""
    return [f"={word}", *(word[:k] for k in PREFIXES if len(word) >= k)]


def inner(word: str, starts: Iterable[int], wanted: Mapping[str, object] | frozenset[str] | None, lengths: Sequence[int]) -> Iterator[tuple[str, str]]:
    """(feature, letters) of the words and word beginnings that may begin at ``starts`` of decoded letters; ``lengths`` are those of the
    features in ``wanted``. A whole word is looked for only where it is wanted, as its end isn't known."""
    if wanted is None:
        yield from ((word[i : i + k], word[i : i + k]) for i in starts for k in PREFIXES if i + k <= len(word))
        return
    for i in starts:
        for k in lengths:
            if i + k > len(word):
                break
            part = word[i : i + k]
            yield from ((f, part) for f in (part, f"={part}") if f in wanted)


def lengths_of(wanted: Iterable[str] | None) -> list[int]:
    return sorted({len(f.removeprefix("=")) for f in wanted or ()} - {0})


class Reader:
    """Distinct words of texts, as written and as restored."""

    def __init__(self, logs: np.ndarray):
        self.decode = Decoder(logs)

    def forms(self, token: str) -> Sequence[str]:
        core = token.strip(EDGE)
        if core.isalpha() and not TRACE.search(core):
            return (core,)
        if TRACE.search(core):
            return (core, self.decode(core))
        return (core,) if core else ()

    def parted(self, token: str) -> tuple[str, Sequence[int]]:
        """(decoded letters, places at which words may begin beside the first) of a token with marks."""
        core = token.strip(EDGE)
        return self.decode.parts(core) if not core.isalpha() and TRACE.search(core) else ("", ())

    def texts(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, list[tuple[int, str]]]:
        """(distinct tokens, token of each place, tokens per text, (text, letters) of runs of single-letter words)."""
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        n = np.diff(offsets)
        single = np.fromiter((len(x) == 1 and (x.isalnum() or x in LOOKS) for x in names), bool, len(names))
        runs = []
        if single.any():
            on = np.concatenate(([False], single[codes], [False]))
            border = np.zeros(len(codes) + 1, bool)  # before the place: another text, where a run ends
            border[offsets - offsets[0]] = True
            first = on[1:-1] & (~on[:-2] | border[:-1])
            last = on[1:-1] & (~on[2:] | border[1:])
            for a, b in zip(np.flatnonzero(first), np.flatnonzero(last) + 1, strict=True):
                if b - a >= 4:
                    owner = int(np.searchsorted(offsets - offsets[0], a, "right") - 1)
                    runs.append((owner, "".join(names[c] for c in codes[a:b])))
        return names, codes, n, runs


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels outside the held-out part; nothing is learned from others."""
    return labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic").withColumn("held", held_out()).where("not held").drop("held")


def labelled(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """(digest, text, toxic) of labelled rows outside the held-out part, at most as many clean and toxic ones as ``sample``
    says, each text once."""
    known = learnable(labels)
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in enumerate(sample)]
    ids = some[0].unionByName(some[1]).select(F.col("doc_id").alias("labelled_id"), "toxic")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id")).select("text", "toxic")  # ids are bounded by the sample
    return rows.groupBy(F.md5("text").alias("digest")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, logs: np.ndarray, sample: tuple[int, int] = SAMPLE) -> tuple[dict[str, float], float]:
    """A decision list, as shares of toxic texts by feature, and the overall share.

    The next rule is the feature with the highest share among the texts without a feature of earlier rules, shrunk to the
    overall share; the list ends below ``CUT``. So words that merely stand beside telling ones get no rule. What comes to
    the driver is bounded by the sample."""
    rows = saved(labelled(docs, labels, sample), "toxic-sample")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return {}, 0.0
    known = {r["toxic"]: r["n"] for r in learnable(labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = known.get(1, 0) / max(1, known.get(0, 0) + known.get(1, 0))
    weight = (known.get(0, 0) / max(1, n.get(0, 0))) / (known.get(1, 0) / n[1])

    def holders(part: DataFrame, wanted: frozenset[str] | None, lists: bool = False) -> DataFrame:
        """(feature, number of texts with it, and their list if asked for)."""
        lengths = lengths_of(wanted)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, total = Reader(logs), {}
            for batch in (x for b in batches for x in pieces_of(b, "text")):
                names, codes, n, runs = reader.texts(plain(batch.column("text")))
                made = [[f for w in reader.forms(x) for f in features(w) if wanted is None or f in wanted] + [f for f, _ in inner(*reader.parted(x), wanted, lengths)] for x in names]
                spaced: dict[int, set[str]] = {}
                for o, letters in runs:
                    for w in {letters, reader.decode(letters)}:
                        spaced.setdefault(o, set()).update([f for f in features(w) if wanted is None or f in wanted], (f for f, _ in inner(w, range(len(w)), wanted, lengths)))
                ends, digests = np.cumsum(n), batch.column("digest").to_pylist()
                for i, (a, b) in enumerate(zip((ends - n).tolist(), ends.tolist(), strict=True)):
                    here = {f for c in np.unique(codes[a:b]).tolist() for f in made[c]}
                    here |= spaced.get(i, set())
                    for f in here:
                        total.setdefault(f, []).append(digests[i])
            texts = [x if lists else [] for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([len(x) for x in total.values()], pa.int64()), pa.array(texts, pa.list_(pa.string()))], ["feature", "n", "texts"])

        return part.select("digest", "text").mapInArrow(find, "feature string, n bigint, texts array<string>").groupBy("feature").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("texts")).alias("texts"))

    number: dict[str, int] = {}
    some = frozenset(r["feature"] for r in holders(rows.where("toxic = 1"), None).where(F.col("n") >= LEAST).select("feature").toLocalIterator())
    bad = {r["feature"]: [number.setdefault(t, len(number)) for t in r["texts"]] for r in holders(rows.where("toxic = 1"), some, True).toLocalIterator()}
    good = {r["feature"]: r["n"] for r in holders(rows.where("toxic = 0"), frozenset(bad)).select("feature", "n").collect()}

    def share(f: str, k: int) -> float:
        return (k + SHRINK * prior) / (k + weight * good.get(f, 0) + SHRINK)

    heap = [(-share(f, len(x)), f, len(x)) for f, x in bad.items()]
    heapq.heapify(heap)
    done, rules = bytearray(len(number)), {}
    while heap and -heap[0][0] >= CUT:
        p, f, k = heapq.heappop(heap)
        left = sum(not done[i] for i in bad[f])
        if left < k:
            heapq.heappush(heap, (-share(f, left), f, left))
            continue
        rules[f] = -p
        for i in bad[f]:
            done[i] = 1
    return rules, prior


def score(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (score >= ``CUT``) and the restored word that tells most."""
    spark = docs.sparkSession
    logs = trigram_logs(trigram_counts(docs))
    share, prior = fit(docs, labels, logs, sample)
    model = spark.sparkContext.broadcast((share, prior / 2, logs))  # bounded by the sample and the alphabet

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, low, logs = model.value
        reader, lengths = Reader(logs), lengths_of(share)

        def best(words: Sequence[str], letters: str = "", starts: Iterable[int] = ()) -> tuple[float, str]:
            found = [(share.get(f, low), w) for w in words for f in features(w)]
            return max([*found, *((share[f], w) for f, w in inner(letters, starts, share, lengths))], default=(low, ""))

        for batch in (x for b in batches for x in pieces_of(b, "text")):
            names, codes, n, runs = reader.texts(plain(batch.column("text")))
            told = [best(reader.forms(x), *reader.parted(x)) for x in names]
            p = np.fromiter((x[0] for x in told), float, len(told))
            out, word = np.full(len(n), low), [""] * len(n)
            full = np.flatnonzero(n)
            if len(full):
                first = (np.cumsum(n) - n)[full]
                out[full] = np.maximum(low, np.maximum.reduceat(p[codes], first))
                for i in full[out[full] > low].tolist():
                    a = int(n[:i].sum())
                    word[i] = told[codes[a + int(np.argmax(p[codes[a : a + n[i]]]))]][1]
            for i, letters in runs:
                got = max(best((w,), w, range(len(w))) for w in (letters, reader.decode(letters)))
                if got[0] > out[i]:
                    out[i], word[i] = got
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(out), pa.array((out >= CUT).astype(np.int32)), pa.array(word, pa.string())],
                ["doc_id", "held_out", "score", "predicted", "word"],
            )
            release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(rate, "doc_id bigint, held_out boolean, score double, predicted int, word string")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, unchanged. Rows with one doc_id (null is one too) go together if one of them is; docs may have
    any other columns."""
    return kept_rows(docs, score(docs, labels).where("predicted = 1").select("doc_id").distinct(), there=False)
