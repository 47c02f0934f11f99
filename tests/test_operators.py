"""Operators on small tables: graph, history, resolution, sinks, sources, vectors."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import analysis, catalog, dashboards, graph, history, resolve, search, vectors
from lexmill.plans import sinks
from lexmill.sources import readers


@pytest.fixture(scope="module")
def citations(spark):
    return spark.createDataFrame([("A", "B", 0.9)] * 3 + [("A", "C", 0.9), ("B", "C", 0.9), ("B", "C", 0.2), ("C", "C", 0.9), ("C", None, 0.9)], "source string, target string, confidence double")


def test_edges_and_weights(citations):
    e = graph.edges(citations)
    assert {(r["source"], r["target"], r["weight"]) for r in e.collect()} == {("A", "B", 3), ("A", "C", 1), ("B", "C", 2), ("C", "C", 1)}
    assert {tuple(r) for r in graph.node_weights(e).collect()} == {("A", 4), ("B", 5), ("C", 5)}  # the loop counts twice
    assert graph.edges(citations, min_confidence=0.5).where("source = 'B'").first()["weight"] == 1


def test_ego_cap_keeps_the_heaviest(citations):
    e = graph.edges(citations)
    assert {tuple(r) for r in graph.ego(e, "A", 1, "out", 2).collect()} == {("A", 0), ("B", 1)}
    assert {tuple(r) for r in graph.ego(e, "A", 2, "out").collect()} == {("A", 0), ("B", 1), ("C", 1)}
    assert {tuple(r) for r in graph.ego(e, "C", 1, "in").collect()} == {("C", 0), ("A", 1), ("B", 1)}


def test_orphans_and_hierarchy(spark, citations):
    laws = spark.createDataFrame([("A",), ("B",)], "slug string")
    assert graph.orphans(citations, laws).count() == 2 + 4
    tree = graph.hierarchy(spark.createDataFrame([(["T 10", "C 1"],), (["T 2", "C 1"],), (["T 2"],)], "path array<string>"), "path")
    assert [(r["parent"], r["label"]) for r in tree.collect()][:2] == [("", "T 2"), ("", "T 10")]


def test_back_fill_and_first_wins(spark):
    rows = spark.createDataFrame([("k", 1, "", "x"), ("k", 2, "a", None), ("k", 3, "b", "y")], "k string, o int, p string, q string")
    assert tuple(history.back_fill(rows, "k", [F.col("o")], ["p", "q"]).first()) == ("k", "a", "x")
    assert history.first_wins(rows, ["k"], [F.col("o")]).first()["o"] == 1


def test_gaps(spark):
    rows = spark.createDataFrame([("p", n) for n in (1, 2, 4)] + [("v", n) for n in (1, 9)], "k string, n int")
    assert {tuple(r) for r in history.gaps(rows, "k", "n").collect()} == {("p", 2, 4), ("v", 1, 9)}
    assert {tuple(r) for r in history.gaps(rows, "k", "n", 5).collect()} == {("v", 1, 9)}


def test_lists(spark):
    row = spark.createDataFrame([(["a", "b", "c"],)], "x array<string>")
    assert row.select(history.most_recent(F.col("x"), F.lit("c"), 2)).first()[0] == ["c", "a"]
    assert row.select(history.toggle(F.col("x"), F.lit("b"))).first()[0] == ["a", "c"]


def test_resolution(spark):
    laws = spark.createDataFrame([("Ley de Aguas Nacionales", "agua", 0), ("Ley de Amparo", "amparo", 1), ("Ley", "ley", 2)], "name string, slug string, ord int")
    refs = spark.createDataFrame([(1, "ley de amparo"), (2, "Ley de Aguas"), (3, "nada")], "ref int, name string")
    assert {(r["ref"], r["slug"]) for r in resolve.name_to_slug(refs, laws).collect()} == {(1, "amparo"), (2, "agua"), (3, None)}
    titles = spark.createDataFrame([("DECRETO QUE REFORMA LA LEY DE AMPARO",)], "title string")
    assert resolve.longest_contained(titles, laws, "title", "name", "ord").first()["related"] == "Ley de Amparo"
    got = resolve.new_titles(spark.createDataFrame([("LEY AMPARO",), ("Ley Nueva",)], "name string"), laws, "name")
    assert [r["name"] for r in got.collect()] == ["Ley Nueva"]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "id string, p string, q string")
    new = spark.createDataFrame([("b", "", "z"), ("c", "3", None)], "id string, p string, q string")
    once = sinks.upsert(old, new, ["id"], keep_given=True)
    assert {tuple(r) for r in once.collect()} == {("a", "1", "x"), ("b", "2", "z"), ("c", "3", None)}
    assert {tuple(r) for r in sinks.upsert(once, new, ["id"], keep_given=True).collect()} == {tuple(r) for r in once.collect()}
    assert {tuple(r) for r in sinks.upsert(old, new, ["id"]).collect()} == {("a", "1", "x"), ("b", "", "z"), ("c", "3", None)}
    keyed = sinks.upsert_by_id_or_key(old, spark.createDataFrame([("new-id", "2", "w")], "id string, p string, q string"), "id", "p")
    assert {tuple(r) for r in keyed.collect()} == {("a", "1", "x"), ("b", "2", "w")}


def test_gap_rows_and_insert(spark):
    report = spark.createDataFrame([("Jalisco", 150, 2), ("Colima", 5, 0)], "state_name string, permanent int, transient int")
    gaps = sinks.gap_rows(report, F.lit("2024-01-01").cast("date"))
    assert {(r["state"], r["gap_type"], r["priority"], str(r["next_action_date"])) for r in gaps.collect()} == {("Jalisco", "permanent", 2, "None"), ("Jalisco", "transient", 3, "2024-01-08"), ("Colima", "permanent", 3, "None")}
    assert sinks.insert_absent(gaps, gaps, ["state", "gap_type"]).count() == 3


def test_versioned_table(spark, tmp_path):
    store = sinks.VersionedTable(spark, f"file://{tmp_path}/t")
    for i in range(4):
        store.publish(spark.range(i + 1), f"2024010{i}", keep=2)
    assert store.read().count() == 4 and store.versions() == ["20240102", "20240103"]


def test_replace_partitions(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert {tuple(r) for r in sinks.replace_partitions(old, old.limit(0), "k").collect()} == {("a", 1), ("b", 2)}
    assert {tuple(r) for r in sinks.replace_partitions(old, old.limit(0), "k", old.where("k = 'a'").select("k")).collect()} == {("b", 2)}


def test_dumps(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"registro": "1"}, {"registro": "2"}]))
    (tmp_path / "b.ndjson").write_text('{"registro": "1"}\n{bad\n{"registro": "3"}\n')
    (tmp_path / "c.csv").write_text("registro\n7\n")
    read = lambda n: [r["registro"] for r in readers.bulk_dump(spark, str(tmp_path / n), "registro string").collect()]
    assert read("a.json") == ["1", "2"] and [x for x in read("b.ndjson") if x] == ["1", "3"] and read("c.csv") == ["7"]
    with pytest.raises(ValueError):
        read("d.txt")


def test_texts_drop_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"Ley General\xff\xfe vigente\x00 " + b"x" * 100)
    (tmp_path / "b.txt").write_bytes(b"short")
    rows = readers.text_files(spark, str(tmp_path / "*.txt")).collect()
    assert len(rows) == 1 and rows[0]["text"].startswith("Ley General vigente x")


def test_packs_of_texts(spark, tmp_path):
    texts = [b"Ley\nuno\xff " + b"x" * 100, b"short", b"", b"Ley dos\x00 \xef\xbf\xbd" + b"y" * 100]
    (tmp_path / "a.txt").write_bytes(b"\x1e".join(texts))
    (tmp_path / "b.txt").write_bytes(texts[0])
    got = sorted(r["text"] for r in readers.text_files(spark, str(tmp_path / "*.txt"), separator="\x1e").collect())
    assert got == ["Ley\nuno " + "x" * 100] * 2 + ["Ley dos \ufffd" + "y" * 100]


def test_invalid_bytes_without_python(spark):
    rng = random.Random(3)
    pieces = [b"\xef\xbf\xbd", b"\xef\xb7\x90", b"a", b"b", "ñ".encode(), "€".encode(), "😀".encode(), b"\xff", b"\xe2", b"\xed\xa0\x80", b"\xf0\x9f", b"\x80", b"\xc0\xaf", b"\xf4\x90", b"\xe0\x80"]
    raw = [b"", *(b"".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(2000))]
    rows = spark.createDataFrame([(bytearray(b),) for b in raw], "raw binary").select("raw", readers.drop_invalid(F.col("raw")).alias("text"))
    assert "Python" not in rows._jdf.queryExecution().toString()
    assert all(r["text"] == bytes(r["raw"]).decode("utf-8", errors="ignore") for r in rows.collect())


def test_links_under_headings(spark):
    page = spark.createDataFrame([(1, "<h2>Uno</h2><a href='/a'>A <b>b</b></a><h2>Dos</h2><p><a href=\"/c\">C")], "id int, html string")
    got = [tuple(r)[2:] for r in readers.html_links(page, "id", "html").collect()]
    assert got == [("Uno", "/a", "A b")]


def test_canonical(spark):
    rows = spark.createDataFrame([(" ", "B", "1"), (None, None, "2")], "nombre string, titulo string, id string")
    assert [tuple(r) for r in readers.canonical(rows, {"id": ["id"], "name": ["nombre", "titulo"], "url": ["enlace"]}).collect()] == [("1", "B", None)]


def test_search_ranks_rare_words_first(spark):
    docs = spark.createDataFrame([(1, "agua agua limpia", "x"), (2, "agua y energía", "y"), (3, "nada", "x")], "id int, text string, tier string")
    index, stats = search.inverted_index(docs, "id", ["text"], analysis.terms), search.field_stats(docs, ["text"], analysis.terms)
    find = lambda query, **more: search.search(docs, index, stats, "id", query, boosts={"text": 1.0}, **more)
    assert [r["id"] for r in find("agau limpia")[0].collect()] == [1]  # two edits in a word of four letters are too many
    assert [r["id"] for r in find("enerjia")[0].collect()] == [2]
    assert [r["id"] for r in find("agua", where=F.col("tier") == "y")[0].collect()] == [2]
    assert not find("")[0].collect()
    hits, facets = find("energía agua", facet_sizes={"tier": 5}, fuzzy=False)
    assert [r["id"] for r in hits.collect()] == [2, 1] and {(r["key"], r["n"]) for r in facets.collect()} == {("x", 1), ("y", 1)}


def test_analyser(spark):
    row = spark.createDataFrame([("Las legislaciones y la protección",)], "x string").select(analysis.terms(F.col("x")).alias("t")).first()["t"]
    assert "amparo"[:-1] in row and "la" not in row


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "id int, v array<double>")
    got = vectors.nearest(v.where("id < 4"), v.where("id = 1"), "id", "v", 1).first()
    assert got["id"] == 3 and abs(got["similarity"] - 0.5**0.5) < 1e-12
    assert v.where("id = 4").select(vectors.cosine(F.col("v"), F.col("v"))).first()[0] is not None
    assert math.isnan(v.where("id = 4").select(vectors.cosine(F.col("v"), F.col("v"))).first()[0])
    many = vectors.nearest(v, v, "id", "v", 3, block=2).collect()  # in blocks; the zero vector is near to nothing
    assert {(r["query_id"], r["id"]) for r in many} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}


def test_word_diff(spark):
    row = spark.createDataFrame([("a b c", "a x c")], "a string, b string").select(vectors.word_diff("a", "b").alias("d")).first()["d"]
    assert [tuple(x) for x in row] == [("equal", "a"), ("delete", "b"), ("insert", "x"), ("equal", "c")]


def test_pages_make_the_whole(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(20)], "a long, b long")
    after, seen = None, []
    while page := catalog.keyset_page(rows, ["a", "b"], after, 7).collect():
        seen += [tuple(r) for r in page]
        after = seen[-1]
    assert seen == sorted((i % 3, i) for i in range(20))


def test_dashboards(spark):
    rows = spark.createDataFrame([(True,), (False,)], "ok boolean")
    assert dashboards.phase_status(rows).first()["status"] == "partial"
    found, expected = spark.createDataFrame([("a", 60), ("b", 95)], "k string, found int"), spark.createDataFrame([(k, 100) for k in "abc"], "k string, expected int")
    assert {(r["k"], r["verdict"]) for r in dashboards.deviation(found, expected, "k").collect()} == {("a", "WARN"), ("b", "OK"), ("c", "FAIL")}


def test_gap_states_fold_as_gap_after(spark):
    import random

    from lexmill.functions import rules

    rng = random.Random(3)
    rows = [(k, i, rng.choice(("escalate", "escalate", "escalate", "wait", None) + ("resolve", "permanent") * (k % 3 > 0))) for k in range(60) for i in range(rng.randint(1, 12))]
    rows += [(None, 1, "escalate"), (None, 2, "resolve"), (None, 3, "escalate")]
    events = spark.createDataFrame(rows, "k long, i long, a string").repartition(3)
    lists = events.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda x: x.a).alias("x"))
    want = lists.select("k", rules.gap_after(F.lit(0), F.lit("open"), F.col("x")).alias("g")).select("k", "g.*").collect()
    got = dashboards.gap_states(events, "k", "i", "a").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want} and len(got) == 61


@pytest.mark.parametrize("name", ["N13_gap_states", "A25_nested"])
def test_no_key_is_gathered_in_a_row(spark, name):
    from lexmill import queries as reference

    plan = reference.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_failure_counts(spark):
    rows = spark.createDataFrame([("a", "HTTP 404"), ("a", "Not Found"), ("a", None), ("b", "timeout")], "s string, e string")
    assert {tuple(r) for r in dashboards.failure_counts(rows, "s", "e").collect()} == {("a", 2, 1), ("b", 0, 1)}
