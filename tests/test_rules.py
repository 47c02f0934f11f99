"""Rules and text functions on fixed inputs with the answers that they must give, one for each branch."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import rules, text
from lexmill.operators import parse

CASES = {}


def cases(name, rule, *pairs):
    CASES[name] = rule, pairs


cases(
    "P7_derogations", rules.derogated, ("Se deroga.", True), ("(Derogado)", True), ("Queda derogada la fracción", True), ("Derogada.", True), ("Se abroga.", True),
    ("Se deroga " + "x" * 100, False), ("Sigue vigente", False), ("derogadas todas", False),
)
cases(
    "P8_legal_phrases", lambda c: F.round(rules.article_confidence(c), 6), ("Corto.", 0.9), ("corto sin punto", 0.7), ("EN TÉRMINOS de ley", 0.75), ("Conforme a derecho.", 0.95),
    ("de acuerdo con esto", 0.75), ("x" * 60, 0.8), ("lo dispuesto; " + "x" * 60, 1.0), ("x" * 60 + ".", 1.0),
)
cases(
    "P23_error_kinds", lambda c: rules.error_class(F.lit("Error"), F.substring_index(c, "|", 1), F.nullif(F.substring_index(c, "|", -1), F.lit(""))),
    ("HTTP 500|", "DOWNLOAD_ERROR"), ("x|extract", "EXTRACTION_ERROR"), ("no PDF|", "EXTRACTION_ERROR"), ("bad XML|", "PARSE_ERROR"), ("schema|", "VALIDATION_ERROR"),
    ("low quality|", "QUALITY_ERROR"), ("?|", "UNKNOWN_ERROR"), ("x|validate", "VALIDATION_ERROR"), ("xml|download", "DOWNLOAD_ERROR"),
)
cases(
    "P26_states_of_laws", rules.law_status, ("Ley Abrogada", "abrogada"), ("Ley (ABROGADO)", "abrogada"), ("Abrogación de la Ley", "abrogada"), ("Código derogado", "derogada"),
    ("Ley DEROGADA", "derogada"), ("Ley de Aguas", "vigente"), ("Ley abrogada y derogada", "abrogada"),
)
for _catalogue, _pairs in {
    "metadata": (("Constitución Política", "constitucion"), ("Código Civil", "codigo"), ("Ley Orgánica X", "ley_organica"), ("Ley X", "ley"), ("Reglamento X", "reglamento"), ("Decreto 1", "decreto"), ("Acuerdo 1", "acuerdo"), ("Bando", "otros")),
    "state": (("CONSTITUCION X", "Constitucion"), ("codigo penal", "Codigo"), ("Ley Organica X", "Ley Organica"), ("Ley X", "Ley"), ("Reglamento", "Reglamento"), ("Decreto", "Decreto"), ("Acuerdo", "Acuerdo"), ("Bando", "Otro")),
    "municipal": (("Reglamento de la Ley", "Reglamento"), ("Código X", "Código"), ("Ley X", "Ley"), ("Decreto", "Decreto"), ("Acuerdo", "Otro")),
    "municipal_congress": (("Ley de Ingresos 2024", "Ley de Ingresos"), ("Presupuesto de Egresos", "Presupuesto de Egresos"), ("Ley de Hacienda Municipal", "Ley de Hacienda Municipal"), ("Tabla de Valores", "Tabla de Valores"), ("Reglamento", "Reglamento"), ("Bando", "Otro")),
}.items():
    cases(f"P28_{_catalogue}", lambda c, k=_catalogue: rules.name_kind(c, k), *_pairs)
cases(
    "P28_regulations", lambda c: rules.regulation_kind(F.substring_index(c, "|", 1), F.substring_index(c, "|", -1)), ("Lineamientos|x", "lineamiento"), (" Resolución|x", "resolucion"), ("Reglas de Operación|x", "reglas"),
    ("|Manual de usos", "manual"), ("otro|AVISO general", "aviso"), ("|nada", "regulacion"), ("Otra|Reglas y normas", "norma"),
)
cases("P29_treaties", rules.treaty_kind, ("Convenio entre México y Perú", "bilateral"), ("Acuerdo bilateral", "bilateral"), ("Convención de Viena", "multilateral"), ("Pacto", "multilateral"), ("Carta de la ONU", "multilateral"), ("Protocolo entre A y B", "bilateral"), ("Otro", "unknown"))
cases(
    "P30_agencies", lambda c: rules.agency(c, {"SSA": "Salud", "SEMARNAT": "Ambiente", "SE": "Economia"}), ("NOM-001-SSA1-2010", "Salud"), ("nom-059-semarnat-2010", "Ambiente"), ("NOM-2-SE-1", "Economia"),
    ("NOM-3-SCFI-1", "SCFI"), ("NOM-1", ""), ("NOM-4-SEM-1", "Ambiente"),
)
cases("P30_standard_states", rules.standard_status, ("VIGENTE", "vigente"), ("En  vigor", "vigente"), ("Cancelado ", "cancelada"), ("En proyecto", "en_proyecto"), (" Otra ", "otra"))
cases("P31_subjects", rules.subject, (" Administrativo", "administrativa"), ("PENAL", "penal"), ("Común", "comun"), ("civil", "civil"), ("Laboral ", "laboral"), ("Constitucional", "constitucional"), ("x", "comun"))
cases("P33_failures", rules.failure_class, ("HTTP 404", "permanent"), ("HTTP 410", "permanent"), ("Not Found", "permanent"), ("GONE", "permanent"), ("timeout", "transient"), ("no encontrado", "transient"), (None, "transient"))
cases("P34_law_names", text.clean_law_name, ("Ley X (Abrogada)", "Ley X"), ("Ley_de_Aguas_TOMO_II", "Ley de Aguas"), ("Ley 12-03-2004 Y", "Ley Y"), ("Ley 2004-03-12 vigente", "Ley"), ("  Ley   Z ", "Ley Z"))
cases(
    "P32_places", lambda c: text.municipality_of(F.substring_index(c, "|", 1), F.substring_index(c, "|", -1), F.lit("Estado")), ("Ley del Municipio de San Pedro|http://x.mx/a", "San Pedro"), ("Ley|http://x.mx/san_luis/pdf", "San Luis"),
    ("Ley|http://x.mx/ley_1/doc", "Estado"), ("Ley|http://x.mx/Villa-Alta/ley.pdf", "Villa Alta"), ("Ley|", "Estado"),
)
cases("P13_ordinals", text.ordinal, ("PRIMERO", 1), ("segunda", 2), ("Séptimo", 7), ("décimo", 10), ("DÉCIMO SEGUNDO", 12), ("undécima", 11), ("vigésimo primera", 21), ("último", 999), ("otro", None))
cases("P14_fractions", parse.is_fraction, ("I. uno", True), ("xiv. no", False), ("a) dos", True), ("12) tres", True), ("nada", False), (" IV. más", True))
cases("P36_content_types", parse.content_type, ("<?xml version='1.0'?><a/>", "akn"), ("  <?xml?>", "akn"), ("x <akomaNtoso>", "akn"), ("Artículo 1", "text"), ("x" * 500 + "<akomaNtoso>", "text"))
cases(
    "P1_ordinal_headers", parse.ordinal_article_id, ("PRIMERO.- Uno", "art-1"), ("Segunda. Dos", "art-2"), ("DÉCIMO SEGUNDO. x", "art-12"), ("Décimo. x", "art-10"), ("VIGÉSIMO. x", "art-20"), ("Primeramente", None), ("nada", None),
)
cases("N11_signature", lambda c: text.signature("secret", c), ("", "f9e66e179b6747ae54108f82f8ade8b3c25d76fd30afde6c395822c530196169"), ("what do ya want for nothing?", "c5daeec9856a353b9f4635a856ff17650645391ccb1b4b4857ee362b88505271"))
cases("N11_durations", text.duration_text, (5, "5s"), (65, "1m 5s"), (3725, "1h 2m 5s"), (0, "0s"))
cases("N14_latex", text.escape_latex, ("a & b", "a \\& b"), ("50 %", "50 \\%"), ("x_y^2", "x\\_y\\textasciicircum{}2"), ("{~}", "\\{\\textasciitilde{}\\}"), ("a\\b", "a\\textbackslash{}b"))
cases("N7_file_names", text.file_name, ("a/b: c?.pdf", "ab_c.pdf"), ("  x   y ", "x_y"), ('"q" <z>|', "q_z"))
cases("N12_json_lists", lambda c: F.concat(text.json_has(c, F.lit("a")).cast("string"), text.json_append(c, F.lit("z"))), ('["a","b"]', 'true["a","b","z"]'), ("[]", 'false["z"]'), (None, 'false["z"]'))


@pytest.mark.parametrize("name", CASES)
def test_rule(spark, name):
    rule, pairs = CASES[name]
    kind = "int" if isinstance(pairs[0][0], int) else "string"
    given = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(pairs)], f"i int, x {kind}")
    got = [r.v for r in given.select("i", rule(F.col("x")).alias("v")).orderBy("i").collect()]
    assert got == [v for _, v in pairs]


def test_signature_of_any_text(spark):
    import hashlib
    import hmac

    texts, secrets = ["", "ñandú", "x" * 1000], ["s", "k" * 64, "k" * 65]
    for secret in secrets:
        got = [r.v for r in spark.createDataFrame(enumerate(texts), "i int, t string").select("i", text.signature(secret, F.col("t")).alias("v")).orderBy("i").collect()]
        assert got == [hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest() for t in texts]


_frbr = "".join(f"<{n}><FRBRthis/><FRBRuri/><FRBRdate/></{n}>" for n in ("FRBRWork", "FRBRExpression", "FRBRManifestation"))
_article = lambda n, t="x" * 30: f"<article id='a{n}'><num>Artículo {n}</num><content><p>{t}</p></content></article>"
_wrap = lambda body, meta=f"<meta>{_frbr}</meta>": f"<akomaNtoso><act>{meta}{body}</act></akomaNtoso>"
#: AKN documents and what is missing in each.
AKN_CASES = (
    (_wrap(f"<body>{_article(1)}{_article(2)}</body>"), ()),
    (_wrap(f"<body>{_article(1)}{_article(9)}</body>"), (("article_sequence", "gap 1-9"),)),
    (_wrap("<body></body>", "<meta><FRBRWork><FRBRthis/><FRBRuri/></FRBRWork></meta>"), (("article_sequence", "no articles"), ("frbr_metadata", "no FRBRDate"), ("frbr_metadata", "no FRBRExpression"), ("frbr_metadata", "no FRBRManifestation"))),
    (_wrap(_article(1), ""), (("frbr_metadata", "no meta"), ("hierarchy", "no body"))),
    (_wrap(f"<body><title><chapter><num>I</num></chapter><chapter><num>II</num>{_article(1, 'x' * 9)}</chapter></title></body>"), (("content_length", "1 short articles"), ("hierarchy", "fewer articles than chapters"), ("structure_elements", "title without num"))),
    (_wrap(f"<body>{_article(1, 'abc')}</body>"), (("content_length", "1 empty articles"), ("content_length", "1 short articles"))),
    ("<akomaNtoso>", (("parse_error", "not well-formed"),)),
)


def test_completeness_and_validity(spark):
    docs = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(AKN_CASES)], "k int, xml string")
    want = {(i, c, t.replace("FRBRDate", "FRBRdate in FRBRWork")) for i, (_, found) in enumerate(AKN_CASES) for c, t in found}
    assert {tuple(r) for r in parse.completeness(docs, "k", "xml").collect()} == want
    assert {tuple(r) for r in parse.schema_validity(docs, "k", "xml").collect()} == {(3, "no_meta"), (3, "no_body"), (6, "not_well_formed")}
