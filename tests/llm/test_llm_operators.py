"""The ten operators against plain forms, and on odd input: nulls, empty and long texts, ties, repeated rows, empty tables,
extra columns with clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute import contaminated, near_duplicates, repeated_spans, suffix_tree
from pyspark.sql import functions as F

from lexmill.llm import _exchange, audio, decontaminate, jaccard_join, mixing, suffix_dedup, token_files, token_spans, toxicity, warc
from lexmill.llm import suffix_tree as tree
from lexmill.llm._encode import Encoder
from lexmill.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("digest", "size", "key", "chunk", "bucket", "w", "n", "held_out", "whole", "target", "class", "rep", "payload", "row", "finish", "score", "start", "toxic", "labelled_id", "bad_id", "keep", "hit_digest", "hit_words", "t", "low", "own", "window", "spans", "predicted", "d", "again")
SYLLABLES = "ta re mi so la do ve nu ki po".split()


def text(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    passage, texts = text(rng, 25), []
    for i in range(n):
        t = text(rng, rng.randint(1, 120))
        if i % 5 == 1:
            t = texts[rng.randrange(len(texts))]  # a copy
        elif i % 5 == 2:
            w = texts[rng.randrange(len(texts))].split()  # a near copy
            if w:
                w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif i % 7 == 3:
            t = f"{t} {passage} {text(rng, 10)}"
        texts.append(t)
    texts += ["", "One", "one two Three", "ONE two three", "a" * 400, "a" * 180, "é" * 60, "é" * 60 + " tail", "\n\t ", text(rng, 4000)]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"src{(d or 0) % 3}" if d != 4 else None, len(t or "")) for d, t in rows], DOCS)


def odd(spark):
    """Nulls, repeats and clashing names."""
    rows = [(1, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1), (2, None, None, None, None), (None, "x y", "fr", "b", 3), (3, "", "de", "", 0), (4, "idiot " * 3000, "en", "b", 2), (1, "another text here", "en", "c", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def collect(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


def test_near_duplicates(spark):
    rows = corpus()
    assert collect(jaccard_join.near_duplicates(frame(spark, rows))) == near_duplicates(rows)


@pytest.mark.parametrize("leaf", [1, 64])
def test_near_duplicates_chain_and_crowd(spark, leaf):
    rng = random.Random(5)
    base = text(rng, 200).split()
    rows = []
    for i in range(40):  # a chain: each differs from the next in one place, ends differ in many
        w = list(base)
        for k in range(i):
            w[5 * k] = f"new{k}"
        rows.append((100 + i, " ".join(w)))
    shared = text(rng, 60)
    rows += [(200 + i, shared + " " + text(rng, 14 + i % 3)) for i in range(30)]  # shares much, links with few
    assert collect(jaccard_join.near_duplicates(frame(spark, rows), leaf)) == near_duplicates(rows)


@pytest.mark.parametrize("leaf", [1, 8, 64])
def test_near_duplicates_around_an_original(spark, leaf):
    rng = random.Random(8)
    base = text(rng, 150).split()
    rows = [(300, " ".join(base))]
    for i in range(90):  # from links with the original to links with other copies only, or none
        w = list((rows[rng.randrange(len(rows))][1] if i % 3 == 0 else rows[0][1]).split())
        for k in rng.sample(range(150), 1 + i % 9):
            w[k] = rng.choice(("left", "right", f"own{i}"))
        rows.append((301 + i, " ".join(w)))
    assert collect(jaccard_join.near_duplicates(frame(spark, rows), leaf)) == near_duplicates(rows)


@pytest.mark.parametrize("shingles", [1 << 12, 4 << 20])  # a region in several parts, in one
def test_strangers_at_the_edge_of_a_class_take_few_levels(spark, monkeypatch, shingles):
    rng = random.Random(21)
    base = [f"{w}{k}" for k, w in enumerate(text(rng, 200).split())]
    changed = lambda places, word: " ".join(word if k in places else w for k, w in enumerate(base))
    rows = [(500, " ".join(base))] + [(501 + i, changed({3 + i}, "")) for i in range(120)]
    rows += [(2000 + i, changed({130 + i, 145 + i, 160 + i, 175 + i, 198}, f"strange{i}")) for i in range(3)]  # 174 of 196 shingles are left: just outside
    levels, parts, measure, saved = [], [], jaccard_join.measure, jaccard_join.saved

    def measured(*a):
        assert len(levels) < 2
        levels.append(1)
        return measure(*a)

    def written(df, label):
        out = saved(df, label)
        if label == "jaccard-members" and "part" in df.columns:
            parts.append(out.agg(F.max("part")).first()[0] or 0)
        return out

    for name, value in (("SHINGLES", shingles), ("measure", measured), ("saved", written)):
        monkeypatch.setattr(jaccard_join, name, value)
    assert collect(jaccard_join.near_duplicates(frame(spark, rows), 8)) == near_duplicates(rows)
    assert (max(parts) > 0) == (shingles < 1 << 20)


def test_one_of_each(spark):
    rows = corpus(3)
    kept = {r[0] for r in collect(jaccard_join.one_of_each(frame(spark, rows)), "doc_id")}
    assert kept == {c for _, n, c in near_duplicates(rows)}


def test_repeated_spans(spark):
    rows = corpus(2)
    assert collect(suffix_dedup.repeated_spans(frame(spark, rows))) == repeated_spans(rows)


def test_kept_bytes(spark):
    rows = corpus(4, 20)
    for r in suffix_dedup.repeated_spans(frame(spark, rows), keep=True).collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


@pytest.mark.parametrize("depth, least, gain", [(2, 3, 0.5), (4, 2, 0.0)])
def test_suffix_tree(spark, depth, least, gain):
    rows = [(d, " ".join(t.split()[:60])) for d, t in corpus(6, 80)]
    got = collect(tree.score(frame(spark, rows), depth=depth, least=least, gain=gain), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = suffix_tree(rows, depth, least, gain, tree.STRENGTHS)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5)


def test_suffix_tree_scores(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(("red car", "blue sky", "green tree")) for _ in range(40))) for i in range(60)]
    got = collect(tree.score(frame(spark, rows)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = suffix_tree(rows, tree.DEPTH, tree.LEAST, tree.GAIN, tree.STRENGTHS)
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=1e-5)
    assert sum(g[6] for g in got if g[1]) > 0.6 * sum(g[5] for g in got if g[1])


@pytest.mark.parametrize("heavy", (1, 6, 12))
def test_suffix_tree_of_frequent_contexts(spark, heavy):
    """Contexts that are spread over buckets and those that aren't give one model."""
    rows = [(d, " ".join(t.split()[:60])) for d, t in corpus(6, 80)]
    got = collect(tree.score(frame(spark, rows), least=2, gain=0.5, heavy=heavy), "doc_id", "score")
    want = suffix_tree(rows, tree.DEPTH, 2, 0.5, tree.STRENGTHS)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[6] for w in want], rtol=1e-5)


def test_suffix_tree_sends_an_ngram_once():
    """An n-gram behind a context that isn't frequent is two small numbers, a count and a probability, and its context isn't sent again: 8 + 4
    bytes for each n-gram and 8 + 16 for each context were sent before."""
    rng = np.random.default_rng(5)
    c = tree.Chunk(pa.table({"text": [" ".join(f"w{i}" for i in rng.zipf(1.3, 20_000) % 5000)], "held_out": [False]}))
    model = tree.Model([], n_all=len(c.of), kinds=len(c.names), heavy=1 << 40)
    levels = model.levels(0, c, 0)
    levels[0].answered(levels[0].spread, {"n": levels[0].train, "id": np.arange(len(c.names), dtype=np.uint32), "bucket": np.zeros(len(c.names), np.uint64)}, 0)
    levels.append(model.behind(c, levels, np.uint64(len(c.names).bit_length()), model.least))
    spread, near = model.counts(c, levels, 1, 1)
    assert not len(spread[0]) and len(near[0]) == len(levels[1].names) > 5000
    sent, plain = len(_exchange.pack(near[1])), 12 * len(near[0]) + 24 * len(np.unique(levels[1].ctx))
    assert sent < 0.6 * plain
    # the followers of a context of the chunk settle its strength
    found, _ = tree.settle_followers(2, 0.0)(near[1])
    assert (found["n"] == levels[1].train[levels[1].near]).all() and len(found["best"]) == len(near[0])


def test_packed_columns():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        whole = {"key": np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)), "n": rng.integers(0, 9, n).astype(np.uint32), "p": rng.random(n).astype(np.float32), "id": rng.integers(0, 9, n).astype(np.uint32)}
        back = _exchange.unpack(_exchange.pack(whole))
        assert list(back) == list(whole) and all((back[k] == whole[k]).all() and back[k].dtype == whole[k].dtype for k in whole)
    for x in (rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 50, 5000).astype(np.uint64), np.array([1 << 63, (1 << 63) + 1, 1 << 63, 0], np.uint64), np.full(3, (1 << 64) - 1, np.uint64)):
        names, of = _exchange.distinct_of(x)
        assert (names == np.unique(x)).all() and (names[of] == x).all()


def test_contexts_count_at_every_size(monkeypatch):
    """A context of ``least`` occurrences has counted followers, also in a corpus of 5 billion words."""
    c = tree.Chunk(pa.table({"text": ["red car red car"], "held_out": [False]}))
    monkeypatch.setattr(tree, "answers", lambda found, chunk, kind=0: {"n": np.full(3, tree.LEAST, np.uint32)})
    model = tree.Model([tree.Answers("counts", 1)], n_all=5e9, kinds=1e6)
    assert len(model.levels(0, c, 1)[1].at) == 4


def test_suffix_tree_of_texts_left_out(spark):
    """A caller's own rule for texts to leave out, on every continuation of short contexts."""
    words = [f"w{i}" for i in range(6)]
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(40)]
    rows += [(10_000 + i, f"{a} {b} {w}") for i, (a, b, w) in enumerate((a, b, w) for a in words[:2] for b in words for w in (*words, "new"))]
    got = collect(tree.score(frame(spark, rows), held_out=lambda: F.col("doc_id") >= 10_000, least=2, gain=0.0), "doc_id", "held_out", "score")
    want = suffix_tree(rows, tree.DEPTH, 2, 0.0, tree.STRENGTHS, held=lambda d: d >= 10_000)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[6] for w in want], rtol=1e-5)


def test_mix(spark):
    rows = corpus(7)
    got = mixing.mixed(frame(spark, rows)).collect()
    budget = sum(r["size"] for r in got)
    assert sum(r["taken"] for r in got) == budget and all(r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["target"], [0, r["source_size"], 0])[0] += r["taken"]
        by[r["target"]][2] = max(by[r["target"]][2], r["size"])
    assert all(abs(t - n) <= largest for t, (n, _, largest) in by.items())
    assert all(t <= 3 * s + 1e-9 for t, (_, s, _) in by.items()) and abs(sum(by) - budget) < 1e-6
    assert sorted(map(tuple, got)) == collect(mixing.mixed(frame(spark, rows)))


def test_mix_rows_follow_the_mix(spark):
    docs = frame(spark, corpus(7))
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mixed(docs).collect()}
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    times = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert times == {d: -(-t // n) for d, (t, n) in taken.items() if t}


def test_decontaminate(spark):
    rng = random.Random(8)
    items = [(i, text(rng, n)) for i, n in enumerate((30, 10, 11, 9, 7, 5, 4, 3, 2, 40))] + [(50, None), (51, "..."), (52, text(rng, 12).upper())]
    rows = corpus(8)
    for k, (i, t) in enumerate(items[:10]):
        d, old = rows[k * 3]
        rows[k * 3] = (d, f"{old}, {(t or '').replace(' ', '; ', 2)} {old}")
    want = contaminated(rows, items)
    got = collect(decontaminate.report(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")))
    assert got == want and sum(w[5] for w in want) >= 10
    clean = collect(decontaminate.drop_contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")), "doc_id")
    assert clean == [(w[0],) for w in want if not w[5]]


def test_decontaminate_removes_spans(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    out = decontaminate.remove_spans(frame(spark, [(1, f"Before {item.upper()} after"), (2, "Clean Text")]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert collect(out, "doc_id", "text") == [(1, "before after"), (2, "Clean Text")]


def test_warc_round_trip(spark):
    long = "<p>" + "x" * 200
    pages = spark.createDataFrame([(5, "http://a/1", long), (3, "http://a/2", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (None, "u", long), (3, "http://a/2", long), (8, "u\r\nX: y", "é" * 99)], "page_id long, url string, html string")
    got = sorted(((r["page_id"] or -1), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(pages).collect())
    assert got == sorted([(5, "revisit", 3, 203), (3, "response", None, 203), (9, "revisit", 3, 203), (1, "response", None, 5), (2, "response", None, 5), (7, "response", None, 0), (-1, "response", None, 203), (3, "response", None, 203), (8, "response", None, 198)])
    digests = {r["payload_digest"] for r in warc.round_trip(pages).where("page_id in (3, 5, 9)").collect()}
    assert digests == {hashlib.sha256(long.encode()).hexdigest()}
    assert not warc.round_trip(pages.limit(0)).collect()


def test_warc_records_are_members():
    import gzip

    one = warc.record(1, "http://a", b"body", "00", None)
    two = warc.record(2, "http://a", b"body", hashlib.sha256(b"body").hexdigest(), 1)
    rows = list(warc.parse(gzip.compress(one) + gzip.compress(two)))
    assert rows[0] == (1, 4, hashlib.sha256(b"body").hexdigest(), "response", None)
    assert rows[1] == (2, 4, hashlib.sha256(b"body").hexdigest(), "revisit", 1)
    assert b"body" not in two


@pytest.fixture(scope="module")
def logs():
    sample = ("the idiot said that this is a stupid thing and the clown went with them " * 50).encode()
    s = toxicity.SYMBOL[np.frombuffer(sample, np.uint8)]
    return toxicity.trigram_logs(np.bincount(s[:-2] << 12 | s[1:-1] << 6 | s[2:], minlength=1 << 18).astype(float))


@pytest.mark.parametrize("seen, meant", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiiiiot", "idiot"), ("st0p1d", None), ("c|0wn", "clown"), ("$tup1d", "stupid"), ("the", "the")])
def test_decoder(logs, seen, meant):
    got = toxicity.Decoder(logs)(seen)
    assert got == meant if meant else got.isalpha()


def test_decoder_is_best_of_all_paths(logs):
    """Viterbi against every path of the lattice."""

    def paths(token):
        todo = [(0.0, (0, 0), "", "")]
        d = toxicity.Decoder(logs)
        for seen in token:
            options = [(x, toxicity.SWAP) for x in toxicity.LOOKS.get(seen, "")] + ([(seen, 0.0)] if seen.isalpha() else [])
            new = []
            for score, state, last, word in todo:
                if seen in toxicity.MARKS or not options:
                    new.append((score + toxicity.MARK, state, last, word))
                for letter, cost in options:
                    if letter == last:
                        new.append((score + cost + toxicity.STRETCH, state, last, word))
                    gain, after = d._step(state, letter)
                    new.append((score + cost + gain, after, letter, word + letter))
            todo = new
        return max((s + float(logs[a, b, 0]), w) for s, (a, b), _, w in todo)

    for token in ("1d1ot", "cl0wnn", "s.t.u.p.1.d", "|1!"):
        assert toxicity.Decoder(logs)(token) == paths(token)[1]


def test_toxicity(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = text(rng, 40).split()
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(("zorgling", "zorgly", "zorgen", "blarp")) if i % 8 else rng.choice(("z0rgling", "bl4rp", "b l a r p", "blaaarp")))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    got = toxicity.score(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [(r["predicted"], int(r["doc_id"] % 4 == 0)) for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(p == y for p, y in held) >= 0.97 * len(held) and not any(p and not y for p, y in held)


def test_toxicity_by_a_plain_decision_list(spark):
    """Scores of plain words by a list that is made step by step: the feature of the highest share among texts that no earlier rule has."""
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(300):
        w = text(rng, 25).split()
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(("zorgling", "zorgly", "blarp", "grumph")))
        if i % 7 == 0:
            w.append("blarpless")  # a beginning that clean texts have too
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    shown = [(t, y) for (d, t), (_, _, y) in zip(rows, labels, strict=True) if zlib.crc32(str(d).encode()) % 4 != 2]
    sets = [({f for w in t.split() for f in (f"={w}", *(w[:k] for k in range(3, 8) if len(w) >= k))}, y) for t, y in shown]
    n = [sum(y == k for _, y in shown) for k in (0, 1)]
    prior = n[1] / sum(n)
    good = {f: sum(f in s for s, y in sets if not y) for s, y in sets if y for f in s}
    able = {f for f in good if sum(f in s for s, y in sets if y) >= toxicity.LEAST}
    left, rules = [s for s, y in sets if y], {}
    while True:
        share = {f: (k + toxicity.SHRINK * prior) / (k + good[f] + toxicity.SHRINK) for f in able - set(rules) for k in [sum(f in s for s in left)]}
        best = min(share, key=lambda f: (-share[f], f), default=None)
        if best is None or share[best] < toxicity.CUT:
            break
        rules[best] = share[best]
        left = [s for s in left if best not in s]
    got = scores(spark, rows, labels)
    for d, t in rows:
        want = max([rules[f] for w in t.split() for f in (f"={w}", *(w[:k] for k in range(3, 8) if len(w) >= k)) if f in rules], default=prior / 2)
        assert abs(got[d][1] - want) < 1e-9, (d, got[d], want)


def spaced_case():
    """Labelled texts around the word blarp, and probes from 1000 on, all of which are outside the labels."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(400):
        w = text(rng, 30).split()
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), "blarp")
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


def scores(spark, rows, labels):
    got = toxicity.score(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {r["doc_id"]: (r["predicted"], r["score"], r["word"]) for r in got}


def test_toxicity_reads_spaced_text_whole(spark):
    rows, labels = spaced_case()
    rest = text(random.Random(13), 60).replace(" ", "")
    probes = [
        (1000, "mire sola a b l a r p"), (1001, " ".join("tamireso" * 9 + "blarp")), (1002, " ".join(rest + "blarp" + rest)),
        (1004, ".".join("resola" * 12 + "bl4rp")), (1005, " ".join(rest)), (1006, ".".join("resola" * 20)),
    ]
    got = scores(spark, rows + [x for p in probes for x in (p, (p[0] + 1000, "mire sola"))], labels)
    assert [got[d][0] for d in (1000, 1001, 1002, 1004, 1005, 1006)] == [1, 1, 1, 1, 0, 0]


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    rows, labels = spaced_case()
    other = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 and d % 3 else t) for d, q, t in labels]
    assert other != labels and scores(spark, rows, other) == scores(spark, rows, labels)


def test_runs_end_with_their_text(logs):
    reader = toxicity.Reader(logs)
    texts = ["mire t a m i", "b l a r p sola", "", "r e s o", "s o l a", "m i r e sola t a m i"]
    want = [(0, "tami"), (1, "blarp"), (3, "reso"), (4, "sola"), (5, "mire"), (5, "tami")]
    assert reader.texts(pa.array(texts))[3] == want
    assert [r for t in texts for r in reader.texts(pa.array([t]))[3]] == [(0, w) for _, w in want]


def test_toxicity_of_neighbours(spark):
    rows, labels = spaced_case()
    got = scores(spark, rows + [(1000, "mire t a m i"), (1001, "b l a r p sola")], labels)
    assert (got[1000][0], got[1001][0]) == (0, 1)


def test_decoder_reads_long_tokens_whole(logs):
    decode = toxicity.Decoder(logs)
    assert decode("i" * 100 + "diot") == "idiot" and decode(".".join("the" * 30 + "1d10t")).endswith("idiot")
    assert decode.parts("the.1d10t") == ("theidiot", [3])


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(odd(spark), none).collect()} == {0.0}


def test_audio(spark):
    rows = [(1, "hello"), (2, ""), (3, None), (4, "é" * 1000), (5, "é" * 1000), (6, "x" * 576), (7, "word " * 9000)]
    got = {r["doc_id"]: r for r in audio.features(frame(spark, rows)).collect()}
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_sha256"] == hashlib.sha256(audio.wav(payload)).hexdigest() and r["media_bytes"] == len(payload) + 44
        assert r["frames"] == len(payload) // 192 and audio.tensors(bytes(r["mel"])).num_rows == -(-r["frames"] // 48)
    assert got[4]["feature"] == got[5]["feature"] and got[4]["mel"] == got[5]["mel"] and got[2]["feature"] == got[3]["feature"]


def test_resample_keeps_low_tones():
    t = np.arange(5760) / audio.RATE
    y = audio.resample(np.sin(2 * np.pi * 440 * t))
    want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / audio.OUT_RATE)
    assert len(y) == 3840
    spectrum = np.abs(np.fft.rfft(y[200:-200] * np.hanning(len(y) - 400)))
    assert abs(np.argmax(spectrum) * audio.OUT_RATE / (len(y) - 400) - 440) < 10 and abs(np.std(y) - np.std(want)) < 0.05
    assert np.std(audio.resample(np.sin(2 * np.pi * 7500 * t))[100:-100]) < 0.1  # above the new limit


def test_hysteresis():
    level = np.array([0, 5, 3, 1, 3, 0, 3, 5.0, 5, 0])
    first, on, off = np.array([0, 6]), np.full(10, 4), np.full(10, 1)
    assert audio.hysteresis(level, first, on, off).tolist() == [False, True, True, True, True, False, False, True, True, False]


def plain_features(payload):
    """(frames x bands of log-mel values, segments) by sums over single samples and frames."""
    n = len(payload) * 2 // 3
    x = np.zeros(len(payload) + 2000)
    x[1000 : 1000 + len(payload)] = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    h = audio.prototype().T.ravel()  # the filter at twice the input's rate
    up = np.zeros(2 * len(x))
    up[::2] = x
    full = np.convolve(up, h)
    y = np.array([full[2000 + 16 + 3 * k] for k in range(n + 256)])
    hz = np.arange(129) * audio.OUT_RATE / 256
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, mel(audio.OUT_RATE / 2), 18)]
    out, level = [], []
    for k in range(n // 128):
        cut = y[128 * k : 128 * k + 256]
        power = np.abs(np.fft.rfft(cut * np.hanning(256))) ** 2
        out.append([np.log(sum(p * max(0, min((f - a) / (b - a), (c - f) / (c - b))) for f, p in zip(hz, power)) + 1e-10) for a, b, c in zip(edges, edges[1:], edges[2:])])
        level.append(10 * np.log10(np.mean(cut**2) + 1e-10))
    mean, on, segments = np.mean(level), False, []
    for k, v in enumerate(level):
        if not on and v >= mean + 1.5:
            on = True
            segments.append([k, k])
        elif on and v < mean:
            on = False
        if on:
            segments[-1][1] = k + 1
    return np.array(out), segments


def test_audio_features_by_single_samples(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(32, 127, n))) for n in (10, 1000, 4000)] + ["quiet " * 300 + "~!" * 500 + "quiet " * 300]
    step = audio.HOP / audio.OUT_RATE
    for r in audio.features(frame(spark, list(enumerate(texts)))).collect():
        raw = texts[r["doc_id"]].encode()
        mel, segments = plain_features(raw + b"\xff" * (-len(raw) % 576))
        table = audio.tensors(bytes(r["mel"]))
        assert table.schema.field("mel").type == pa.fixed_shape_tensor(pa.float16(), [48, 16])
        got = table.column("mel").combine_chunks().to_numpy_ndarray().reshape(-1, 16)[: r["frames"]].astype(float)
        assert got.shape == mel.shape and np.allclose(got, mel, atol=0.02)
        assert [(round(s["start"] / step), round(s["stop"] / step)) for s in r["segments"]] == [tuple(s) for s in segments]
        assert all(b > a for a, b in zip(table["start"].to_pylist(), table["stop"].to_pylist(), strict=True))


TRICKY = ["  foo  bar\n\n baz's \t x", "", "   ", "\n", "a  b c", "it's don't  'll x", "a  \n b", "\n\n x", "é́ o", "x \n", "tab\t\tq   z <|endoftext|> w", "ǅ İstanbul ΣΑΣ ß ﬁ", "a b  c", "(foo)bar[1],2.5%!! --x", "Wort, das; 'quoted'", "漢字 かな123abc", "😀 a😀b"]


@pytest.mark.parametrize("name, joined", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("spans", [False, True])
def test_encoder_gives_what_the_library_gives(name, joined, spans):
    texts = [*TRICKY, *(t for _, t in corpus(12, 20)), " ".join(TRICKY)]
    made = Encoder(tokenizer_file(name), joined)
    n, out, _ = made.encode(pa.array(texts), spans)
    at = 0
    for t, k in zip(texts, n, strict=True):
        e = made.tokenizer.encode(t, add_special_tokens=False)
        want = [(i, *o) for i, o in zip(e.ids, e.offsets, strict=True)] if spans else e.ids
        got = out[at : at + k].tolist()
        assert [tuple(g) for g in got] == want if spans else got == want, t
        at += k


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(d, t) for d, t in corpus(13, 30)] + [(500 + i, t) for i, t in enumerate(TRICKY)] + [(900, None)]
    path = str(tmp_path / "ids")
    token_files.write_tokens(frame(spark, rows), path, tokenizer_file("word_bpe_49k.json"), part_bytes=4000)
    got = {r["doc_id"]: tuple(r) for r in token_files.read_tokens(spark.read.parquet(path)).collect()}
    made, start = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), 0
    for d, t in sorted(rows):
        ids = [*made.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[d] == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    files = sorted((tmp_path / "ids").glob("*.parquet"))
    assert len(files) > 1
    group = pq.ParquetFile(files[0]).metadata.row_group(0)
    columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
    assert all(c.has_column_index and c.has_offset_index for k, c in columns.items() if k != "ids") and columns["ids"].has_offset_index
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["ids"].has_dictionary_page


@pytest.mark.parametrize("rule", token_spans.RULES)
def test_token_spans(spark, rule):
    from tokenizers import Tokenizer

    rows = [(d, t.replace(" ta", "\nta").replace(" re", "\n re")) for d, t in corpus(14, 15)] + [(500, None), (501, "\n\n a\n\n\nb\n"), (502, "x\n")]
    got = {}
    for r in token_spans.section_counts(frame(spark, rows), tokenizer_file("byte_bpe_50k.json"), rule=rule).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    made = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    for d, t in rows:
        source = f"src{d % 3}" if d != 4 else ""
        whole = f"en {source}\n{t or ''}"
        body = len(f"en {source}\n")
        starts = [0, 3, body, *[body + i + 1 for i, c in enumerate(t or "") if c == "\n" and i + 1 < len(t)]]
        ends = [*starts[1:], len(whole)]
        counts, cross = [0] * len(starts), [0] * len(starts)
        for a, b in made.encode(whole, add_special_tokens=False).offsets:
            over = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends, strict=True)]
            touched = [i for i, o in enumerate(over) if o]
            i = {"most": over.index(max(over)), "first": touched[0], "last": touched[-1]}[rule]
            counts[i] += 1
            cross[i] += len(touched) > 1
        want = [(i, ("lang", "source", "text")[min(i, 2)], s, e, c, x) for i, (s, e, c, x) in enumerate(zip(starts, ends, counts, cross, strict=True))]
        assert sorted(got[d]) == want, (d, whole[:60])


def labels(d):
    return d.sparkSession.createDataFrame([(1, 1, 1), (4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def items(d):
    return d.sparkSession.createDataFrame([(1, "two three"), (None, "x"), (3, None)], "item_id long, text string").withColumn("doc_id", F.lit("clash"))


OPERATORS = {
    "suffix_tree": tree.score, "jaccard": jaccard_join.near_duplicates, "mix": mixing.mixed, "audio": audio.digests, "suffix_dedup": suffix_dedup.repeated_spans,
    "token_spans": lambda d: token_spans.section_counts(d, tokenizer_file("byte_bpe_50k.json")), "token_files": lambda d: token_files.token_rows(d, tokenizer_file("word_bpe_49k.json")),
    "mixed_rows": mixing.mixed_rows, "one_of_each": jaccard_join.one_of_each,
    "toxicity": lambda d: toxicity.score(d, labels(d)),
    "decontaminate": lambda d: decontaminate.report(d, items(d)), "drop_contaminated": lambda d: decontaminate.drop_contaminated(d, items(d)),
    "remove_spans": lambda d: decontaminate.remove_spans(d, items(d)), "clean": lambda d: toxicity.clean(d, labels(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](empty(spark)).collect() == []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    docs = odd(spark)
    rows = OPERATORS[name](docs).collect()
    if name == "token_spans":
        assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, None}
    elif name in ("drop_contaminated", "remove_spans", "clean"):
        assert all(set(r.asDict()) == set(docs.columns) for r in rows)
        if name == "remove_spans":
            assert len(rows) == 7 and {r["text"] for r in rows} == {"one four five six", None, "y", "", "idiot " * 3000, "another text here"}
        elif name == "drop_contaminated":
            assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "3", "4"]
    elif name == "mixed_rows":
        assert rows and docs.columns == list(rows[0].asDict())
    elif name == "one_of_each":
        assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, None}
    else:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "1", "1", "2", "3", "4", "None"])


def test_warc_of_odd_rows(spark):
    """Nulls, repeated rows, ties and clashing names; and an empty table."""
    rows = [(1, "u", "x" * 200), (1, "u", "x" * 200), (2, None, "x" * 200), (3, "u", None), (None, "u", "y" * 99), (4, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in (*CLASHES, "refers_to", "path", "name", "least")})
    got = [tuple(r) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    want = [(1, 200, "response", None), (1, 200, "response", None), (2, 200, "revisit", 1), (3, 0, "response", None), (None, 99, "response", None), (4, 0, "response", None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_near_duplicates_of_odd_rows(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(odd(spark)).collect()}
    assert got == {(1, 2, 1), (1, 1, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (None, 1, None)}


@pytest.mark.parametrize("limit", [64 << 20, 0])  # broadcast, shuffled
def test_spans_above_the_bound_of_a_broadcast(spark, limit):
    rng = random.Random(12)
    passage = text(rng, 40)
    rows = [(i, f"{text(rng, 20)} {passage} {text(rng, 5)}" if i % 2 else text(rng, 30)) for i in range(12)]
    items = spark.createDataFrame([("a", passage)], "item_id string, text string")
    cleaned = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(frame(spark, rows), items, limit=limit).collect()}
    assert all(cleaned[i] == (t.replace(f" {passage}", "") if i % 2 else t) for i, t in rows)
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.repeated_spans(frame(spark, rows), keep=True, limit=limit).collect()}
    want = {d: sha for d, *_, sha in repeated_spans(rows)}
    assert {d: hashlib.sha256(b).hexdigest() for d, b in kept.items()} == want
