"""One fixture for each layout of an index page, and the tree of broken markup."""

from lexmill.sources import gazette

BASE = "https://gazette.example.org"
HEADINGS = """<div class=c><h2>Primera  Sección</h2><h3>SECRETARIA DE GOBERNACION</h3><ul><li><a href="nota_detalle.php?codigo=1">Decreto <b>uno</b></a><li><a href='/nota_detalle.php?codigo=2'>Dos &amp; tres</a></ul>
<h3>Aviso</h3><a href="otra.php">no</a><a href="nota_detalle.php?codigo=9"> </a><h2>SEGUNDA SECCION</h2><strong>SECRETARIA DE SALUD</strong><a href="http://x.example/nota_to_doc.php">Tres</a></div>"""
ROWS = """<table><tr><td>PODER JUDICIAL<tr><td>1<td><a href="nota_detalle.php?codigo=5">TERCERA SECCIÓN aviso</a><tr><td>x</td></tr><tr><th>no</th></tr><tr><td>2</td><td><a href="nota_detalle.php?codigo=6">CUARTA SECCION <i>otro</i></a></table>"""
LINKS = """<body>QUINTA SECCION<div><p>AVISOS JUDICIALES<p>otro</div><div><span><a href="nota_to_doc.php?codnota=7">Segunda sección: siete</a></span></div>"""


def test_layouts():
    assert gazette.page_entries(HEADINGS, BASE) == [
        ("Decreto uno", "PRIMERA SECCION", "SECRETARIA DE GOBERNACION", f"{BASE}/nota_detalle.php?codigo=1", "headings"),
        ("Dos & tres", "PRIMERA SECCION", "SECRETARIA DE GOBERNACION", f"{BASE}/nota_detalle.php?codigo=2", "headings"),
        ("Tres", "SEGUNDA SECCION", "SECRETARIA DE SALUD", "http://x.example/nota_to_doc.php", "headings"),
    ]
    assert gazette.page_entries(ROWS, BASE) == [
        ("TERCERA SECCIÓN aviso", "TERCERA SECCION", "PODER JUDICIAL", f"{BASE}/nota_detalle.php?codigo=5", "rows"),
        ("CUARTA SECCION otro", "CUARTA SECCION", "PODER JUDICIAL", f"{BASE}/nota_detalle.php?codigo=6", "rows"),
    ]
    assert gazette.page_entries(LINKS, BASE) == [("Segunda sección: siete", "QUINTA SECCION", "", f"{BASE}/nota_to_doc.php?codnota=7", "links")]
    assert gazette.page_entries(LINKS.replace("<p>otro", "").replace("<div><p>AVISOS JUDICIALES</div>", "<p>AVISOS JUDICIALES</p>"), BASE)[0][2] == "AVISOS JUDICIALES"
    assert gazette.page_entries(None, BASE) == gazette.page_entries("", BASE) == gazette.page_entries("<p>nada", BASE) == []


def shape(e):
    return [(c.tag, shape(c)) if isinstance(c, gazette.Element) else c for c in e.children]


def test_broken_markup():
    assert shape(gazette.tree("<p>a<p>b<br>c<div>d</div>")) == [("p", ["a"]), ("p", ["b", ("br", []), "c"]), ("div", ["d"])]
    assert shape(gazette.tree("<ul><li>a<ul><li>b</ul><li>c</ul></b>x")) == [("ul", [("li", ["a", ("ul", [("li", ["b"])])]), ("li", ["c"])]), "x"]
    assert shape(gazette.tree("<table><tr><td>1<table><tr><td>2</table><td>3<tr><td>4</table>")) == [("table", [("tr", [("td", ["1", ("table", [("tr", [("td", ["2"])])])]), ("td", ["3"])]), ("tr", [("td", ["4"])])])]
    assert shape(gazette.tree("a<script>b</script><!-- c --><img src=x/>&eacute;")) == ["a", ("script", []), ("img", []), "é"]
    deep = gazette.tree("<i>" * 5000 + "x")
    assert deep.text() == "x" and sum(1 for _ in deep.walk()) == 5001


def test_pages(spark):
    rows = spark.createDataFrame([(1, HEADINGS), (2, ROWS), (3, LINKS), (4, None)], "id long, html string")
    got = gazette.entries(rows, "id", "html", BASE).collect()
    assert [(r["id"], r["position"], r["strategy"]) for r in got] == [(1, 0, "headings"), (1, 1, "headings"), (1, 2, "headings"), (2, 0, "rows"), (2, 1, "rows"), (3, 0, "links")]
