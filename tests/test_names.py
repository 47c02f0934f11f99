"""Containment by automata against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import names, resolve


def made(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 4))) for _ in range(400)]
    return sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(n)}), words, rng


def test_two_hundred_thousand_names(spark):
    known, words, rng = made(1, 230_000)
    known = known[:200_000]
    rng.shuffle(known)
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 12))) for _ in range(40)] + ["", "zz"]
    ranks = {n: i for i, n in enumerate(known)}
    want = {t: min((ranks[n], n) for n in known if n in t) for t in texts if any(n in t for n in known)}
    listed = spark.createDataFrame(list(ranks.items()), "name string, rank long")
    frame = spark.createDataFrame([(t,) for t in texts] * 2, "t string")
    assert names.shards(listed) > 1
    got = {r["text"]: (r["rank"], r["name"]) for r in names.best_contained(frame, "t", listed).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [names.SHARD_BYTES, 1000])
def test_both_ways(spark, limit):
    known, words, rng = made(2, 300)
    laws = [(n.upper() if i % 2 else n, f"s{i}", i) for i, n in enumerate(known)] + [(None, "none", -1), (known[3], "again", 500)]
    refs = [(i, r) for i, r in enumerate([*known[:20], *words[:60], *[f"x {n} y" for n in known[40:60]], "QQQ", None, known[5].upper(), "a"])]
    low = [(n.lower(), s, o) for n, s, o in laws if n is not None]

    def plain(name):
        if name is None:
            return None
        n = name.lower()
        exact = [(o, s) for law, s, o in low if law == n]
        loose = [(o, s) for law, s, o in low if law in n or n in law]
        return min(exact or loose or [(0, None)])[1]

    got = resolve.name_to_slug(spark.createDataFrame(refs, "ref int, name string"), spark.createDataFrame(laws, "name string, slug string, ord int"), limit).collect()
    assert {(r["ref"], r["slug"]) for r in got} == {(i, plain(n)) for i, n in refs}
    titles = [(i, t) for i, t in enumerate([f"de {n} y {known[-i - 1]}" for i, n in enumerate(known[:40])] + [None, "", "ZZ"])]
    best = lambda t: max(((len(n), -o, n) for n, _, o in laws if n is not None and n.upper() in t.upper()), default=(0, 0, None))[2] if t is not None else None
    found = resolve.longest_contained(spark.createDataFrame(titles, "i int, title string"), spark.createDataFrame(laws, "nm string, s string, o int").where("o >= 0"), "title", "nm", "o", limit)
    assert {(r["i"], r["related"]) for r in found.collect()} == {(i, best(t)) for i, t in titles}


def test_empty_names_and_tables(spark):
    none = spark.createDataFrame([], "name string, rank long")
    texts = spark.createDataFrame([("a",), (None,), ("",)], "t string")
    assert names.best_contained(texts, "t", none).collect() == []
    every = spark.createDataFrame([("", 5), ("a", 9)], "name string, rank long")
    assert {r["text"]: r["name"] for r in names.best_contained(texts, "t", every).collect()} == {"a": "", "": ""}
    assert {r["name"]: r["text"] for r in names.best_holder(every, "name", every.select(F.col("name").alias("text"), "rank")).collect()} == {"": "", "a": "a"}
