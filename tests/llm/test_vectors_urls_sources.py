"""Vector codes, URL filters and the source audit against plain forms and the registered SQL, and on odd input."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import queries as llm
from lexmill.llm import source_audit, url_filter, vector_codes
from lexmill.llm._common import saved

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_url_filter", "op13_source_audit"])
def test_registered_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = llm.queries()[name](spark, DATA)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({llm.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# Vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (id, vector, label) that can be coded."""
    cut = {}
    for k, (i, v, _) in enumerate(rows):
        ints = [int(np.floor(4096 * float(np.float32(x)))) for x in v]
        w = len(ints) // parts
        cut[k] = [tuple(ints[p * w : p * w + w]) for p in range(parts)]
    starts = {}
    for k in sorted(cut, key=lambda k: (rows[k][0], cut[k])):
        starts.setdefault(rows[k][0], k)
    books = [[cut[k][p] for _, k in sorted(starts.items())[:entries]] for p in range(parts)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for k in cut:
                groups[assign(p, cut[k][p])[1]].append(cut[k][p])
            books[p] = [tuple(sum(c) // len(groups[j]) for c in zip(*groups[j])) if j in groups else e for j, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = {k: [assign(p, cut[k][p]) for p in range(parts)] for k in cut}
    errors = {k: sum(d for d, _ in f) for k, f in found.items()}
    labels = Counter()
    for k in cut:
        labels[rows[k][2]] += errors[k]
    return sorted((rows[k][0], "".join(f"{j:02x}" for _, j in found[k]), errors[k], labels[rows[k][2]], sha) for k in cut)


def test_codes_with_ties_and_repeats(spark):
    rng = random.Random(3)
    few = [[rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(16)] for _ in range(12)]  # many equal parts, so many ties
    rows = [(i, rng.choice(few) if i % 2 else [rng.gauss(0, 1) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(3, few[0], 1), (3, few[1], None), (7, rows[7][1], rows[7][2])]
    got = vector_codes.compressed(spark.createDataFrame(rows, VECTORS).repartition(5))
    assert sorted(map(tuple, got.collect())) == plain_codes(rows)


def test_search_takes_the_lower_of_equal_entries():
    rng = np.random.default_rng(1)
    for entries in (1, 2, 3, 16, 57):
        points = rng.integers(-2, 3, (entries, 3))
        x = rng.integers(-4, 5, (500, 3))
        d = ((x[:, None] - points[None]) ** 2).sum(axis=2)
        at, best = vector_codes.nearest(vector_codes.kd_tree(points), x)
        assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [0.25 * i, -0.1, 3.0, 0.0, 1.5, 2.0, -2.0, 0.7], None) for i in range(5)]
    odd = [(None, [1.0] * 8, 4), (20, None, 1), (21, [nan] + [1.0] * 7, 1), (22, [inf] * 8, 1), (23, [None] + [1.0] * 7, 1), (24, [], 1), (25, [1.0] * 9, 1), (26, [1e30] * 8, 5)]
    rows = spark.createDataFrame(good + odd, VECTORS).withColumns({c: F.lit("clash") for c in ("id", "ints", "of", "part", "entry", "n", "code", "error", "x")})
    got = {r["vec_id"]: r for r in vector_codes.compressed(rows).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 26, None}
    assert got[0]["label_error"] == sum(got[i]["error"] for i in range(5))
    assert len(got[None]["code"]) == 16
    assert got[26]["error"] == 0  # seven ids are seven starts
    assert vector_codes.compressed(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.compressed(spark.createDataFrame(odd[1:-1], VECTORS).where("size(embedding) = 0 or embedding is null")).collect() == []
    ten = vector_codes.compressed(spark.createDataFrame([(1, [0.5] * 10, 1), (2, [1.0] * 10, 1)], VECTORS)).collect()  # filled to 16
    assert sorted((r["code"], r["error"]) for r in ten) == [("00" * 5 + "00" * 3, 0), ("01" * 5 + "00" * 3, 0)]


def test_codes_decode(spark):
    rows = spark.createDataFrame([(i, [0.5 * i] * 8, i) for i in range(4)], VECTORS)
    ints = vector_codes.integers(rows)
    books = vector_codes.fit(ints)
    got = vector_codes.decode(vector_codes.encode(ints, books), books).collect()
    assert {r["id"]: r["decoded"] for r in got} == {i: [0.5 * i] * 8 for i in range(4)}


# URL filters


def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(len(h), len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


URLS = [
    None, "", "no scheme/en/", "://", "http://", "http://net", "http://net/", "http://NET/x", "http://a.net?x=/en/", "http://example.net#t", "https://example.net/en", "https://example.net/en/", "https://W.Example.NET/en/a/b?q#f",
    "http://notexample.net/en/", "http://example.com/de/1", "http://example.com/fr/1", "http://m.example.org/fr/", "http://m.example.org/fr", "http://example.net:80/en/", "http://u@example.net/en/", "http://a..net/", "http://net./",
    "http://x.com/a/b/c/d", "http://x.com/a/bc", "http://y.x.com/a/b/", "http://x.com//a", "http://x.com/" + "long/" * 3000, "http://é.net/ä", "a://b://net/", "http://net/a\nb",
]
MORE = [*url_filter.RULES, ("block", "x.com", "/a/b"), ("allow", "x.com", "/a/b/c"), ("block", "y.x.com", ""), ("allow", "x.com", "//"), ("block", "com", "/"), ("allow", "com", "/"), ("allow", "x.com", "/a/bc"), ("block", "x.com", "/" + "long/" * 1500)]


@pytest.mark.parametrize("limit", [64 << 20, 0])  # the trie, the joins
@pytest.mark.parametrize("rules", [url_filter.RULES, tuple(MORE)])
@pytest.mark.parametrize("default", ["allow", "block"])
def test_urls(spark, limit, rules, default):
    rows = [(i % 20, u) for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "h", "head", "rule", "hit", "verdict", "row")})
    want = sorted(((i, *plain_verdict(u, rules, default)) for i, u in rows), key=str)
    assert sorted(map(tuple, url_filter.judge(pages, rules, default, limit=limit).collect()), key=str) == want
    kept = url_filter.kept_pages(pages, rules, default, limit=limit)
    assert kept.columns == pages.columns and kept.count() == sum(w[-1] == "allow" for w in want)
    assert url_filter.judge(pages.limit(0), rules, limit=limit).collect() == []


def test_random_rules_as_a_table(spark):
    rng = random.Random(2)
    name = lambda n: ".".join(rng.choices(["a", "b", "c"], k=rng.randint(1, n)))
    path = lambda n: "".join(rng.choices(["/", "x", "y"], k=rng.randint(0, n)))
    rules = [(rng.choice(["allow", "block"]), name(3), path(5)) for _ in range(150)]
    rows = [(i, f"http://{name(4)}/{path(6)}") for i in range(400)]
    pages, table = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "verdict string, host string, path string")
    want = sorted(((i, *plain_verdict(u, rules)) for i, u in rows), key=str)
    for limit in (64 << 20, 0):
        assert sorted(map(tuple, url_filter.judge(pages, table, limit=limit).collect()), key=str) == want
    with pytest.raises(ValueError):
        url_filter.judge(pages, [("allow", "", "/")])
    with pytest.raises(ValueError):
        url_filter.judge(pages, [("allow", "", "/")], limit=0)


# Source audit


def plain_audit(rows, least=3, k=200):
    """rows: (text, lang, source)."""
    terms = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", terms.findall((t or "").translate(low))) for t, lang, source in rows]
    df, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, ts in docs:
        df[lang].update(set(ts))
        groups[lang, source].update(ts)
    f = lambda p, q: (p - q) * (p - q) // q
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)
        whole = sum((groups[lang, s] for s in sources), Counter())
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        q, p = shares(whole), {s: shares(groups[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            own = [(t, f(p[s][t], q[t])) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", own, k)):
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


def sources(seed, n=200, words=60, shared=30):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcé", k=rng.randint(1, 6))) + rng.choice(["", "ß", "日本"]) for _ in range(words)]
    vocabulary += ["x" * 40 + "".join(rng.choices("abcdé", k=3)) for _ in range(shared)]  # beginnings in common
    return [(" ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(vocabulary, k=rng.randint(0, 40))) + rng.choice(["", "1,2", "..."]), rng.choice(["en", "de"]), f"s{min(rng.randrange(9), 5)}") for _ in range(n)]


@pytest.mark.parametrize(("k", "slack"), [(200, 1000), (3, 0), (1, 0), (7, 2)])
def test_audit(spark, k, slack):
    rows = sources(4) + [("only here", "fr", "a"), ("", "fr", "b"), (None, None, None), ("12 34", "xx", "s"), ("w " * 3, "en", "s99")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).repartition(4).withColumns({c: F.lit("clash") for c in ("term", "n", "df", "sid", "p", "q", "value", "item", "digit")})
    assert sorted(map(tuple, source_audit.audit(docs, k=k, slack=slack).collect())) == plain_audit(rows, k=k)


def test_audit_of_equal_values(spark):
    """All values of a group are equal, so only bytes decide; items share beginnings and one is the beginning of others."""
    items = ["x" * 30 + t for t in ("", "a", "aa", "ab", "b", "é", "日", "z", "za", "\x7f")] + [f"x{i:03d}" for i in range(50)]
    values = saved(spark.createDataFrame([(g, t, 5 + (i == 3)) for g in ("a", "b") for i, t in enumerate(items)], "g string, item string, value long"), "equal")
    for k in (1, 2, 5, 12, 53, 60, 100):
        found = source_audit.top_by_radix(values, ["g"], k, 0).where("g = 'a'").collect()
        assert [r["item"] for r in sorted(found, key=lambda r: (-r["value"], r["item"].encode()))][:k] == [t for _, t in sorted((-(5 + (i == 3)), t) for i, t in enumerate(items))][:k]
        assert len(found) == min(k, len(items))


def test_audit_of_large_counts(spark):
    """Products beyond 64 bits."""
    n, total, v = 4 * 10**12, 9 * 10**15, 10**6
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(source_audit.share("n", "total", "v").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 1) // (total + v)


def test_audit_of_long_texts_and_empty_tables(spark, monkeypatch):
    long = ("abc " * 100_000 + "d" * 3_000_000 + " abc").encode()
    monkeypatch.setattr(source_audit, "SLICE", 1000)
    assert Counter(t for p in source_audit._pieces(long) for t in p) == Counter(long.split())
    assert source_audit.audit(spark.createDataFrame([], DOCS)).collect() == []
    monkeypatch.setattr(source_audit, "AT_ONCE", 7)
    rows = sources(9, 80, 20, 3)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS)
    assert sorted(map(tuple, source_audit.audit(docs).collect())) == plain_audit(rows)
