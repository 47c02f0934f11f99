"""Rules and text functions over whole columns of the test tables, with SQL that states each rule anew.

Laws' words are rare in the given texts, so a row's text is put behind or before one of a few beginnings and ends, chosen by its key; the rule
then reads the whole. Fixed inputs with fixed answers are unit tests (tests/test_rules.py)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules, text
from .law_queries import literal, pick
from .operators import parse
from .queries import query
from .sources.readers import table


def listed(values: Sequence) -> str:
    return f"[{', '.join(map(literal, values))}]"


def document_lines(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, i, t): each line of each document."""
    return table(s, d, "documents", ["doc_id", "text"]).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))


LINES = "ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10)))))::INT AS i FROM documents)"


def over_lines(name: str, rule: Callable[[Column], Column], sql: str, heads: Sequence[str], tails: Sequence[str] = ("",)) -> None:
    """A rule over every line of every document; ``sql`` gives v from x(doc_id, i, t)."""
    made = f"x AS (SELECT doc_id, i, {listed(heads)}[(doc_id + i) % {len(heads)} + 1] || t || {listed(tails)}[(doc_id + 2 * i) % {len(tails)} + 1] AS t FROM ls)"

    @query(name, f"WITH {LINES}, {made} SELECT doc_id, i, {sql} AS v FROM x")
    def _(s, d):
        k, i = F.col("doc_id"), F.col("i")
        return document_lines(s, d).select("doc_id", "i", rule(F.concat(pick(k + i, heads), F.col("t"), pick(k + 2 * i, tails))).alias("v"))


def over_texts(name: str, rule: Callable[[Column], Column], sql: str, heads: Sequence[str], tails: Sequence[str] = ("",)) -> None:
    """A rule over every whole text of documents; ``sql`` gives v from x(k, t, l, f): text, lower case, folded."""
    made = f"x AS (SELECT doc_id AS k, {listed(heads)}[doc_id % {len(heads)} + 1] || text || {listed(tails)}[doc_id % {len(tails)} + 1] AS t, lower(t) AS l, strip_accents(l) AS f FROM documents)"

    @query(name, f"WITH {made} SELECT k, {sql} AS v FROM x")
    def _(s, d):
        k = F.col("doc_id")
        return table(s, d, "documents", ["doc_id", "text"]).select(k.alias("k"), rule(F.concat(pick(k, heads), F.col("text"), pick(k, tails))).alias("v"))


def first_of(of: str, *rules_: tuple[str, str], default: str) -> str:
    """SQL: the first class of which one of the words, parted by |, occurs."""
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains({of}, '{w}')''' for w in words.split('|'))} THEN '{name}'" for name, words in rules_) + f" ELSE '{default}' END"


# Lines as paragraphs of articles

_token = "regexp_extract(regexp_replace(t, '^\\s+', ''), '^\\S+')"
over_lines(
    "P7_derogations", rules.derogated,
    "length(trim(t)) < 100 AND (regexp_matches(strip_accents(lower(t)), 'se\\s+deroga') OR regexp_matches(strip_accents(lower(t)), 'queda\\s+derogad[oa]') OR contains(lower(t), '(derogado)')"
    " OR contains(lower(t), '(derogada)') OR lower(t) IN ('derogado', 'derogada', 'derogado.', 'derogada.') OR regexp_full_match(lower(t), 'se\\s+abroga\\.?'))",
    ("Se deroga. ", "(Derogado) ", "Queda  derogada la fracción ", "", "Sigue vigente ", "derogadas todas ", "Derogada."), ("", " (DEROGADA)", "", " se abroga."),
)
over_lines(
    "P8_legal_phrases", lambda c: F.round(rules.article_confidence(c), 6),
    "round((least(greatest(1.0 - CASE WHEN length(t) < 50 THEN 0.1 ELSE 0.0 END - CASE WHEN contains(t, '.') OR contains(t, ';') OR contains(t, ':') THEN 0.0 ELSE 0.2 END"
    " + CASE WHEN contains(lower(t), 'en términos') OR contains(lower(t), 'conforme') OR contains(lower(t), 'de acuerdo') OR contains(lower(t), 'lo dispuesto') THEN 0.05 ELSE 0.0 END, 0.0), 1.0))::DOUBLE, 6)",
    ("", "EN TÉRMINOS de ley ", "", "Conforme a derecho ", "de acuerdo con ", "lo dispuesto; "),
)
over_lines(
    "P14_fractions", parse.is_fraction,
    f"length(regexp_replace(t, '^\\s+', '')) > length({_token}) AND (regexp_full_match({_token}, '[IVXLCDM]+\\.') OR regexp_full_match({_token}, '[a-z]\\)') OR regexp_full_match({_token}, '[0-9]+\\)'))",
    ("I. ", "xiv. ", "a) ", "12) ", "", " IV. ", "II.", "Z) ", "b)\t"),
)
_word = "regexp_extract(t, '^[\\pL\\pN_]+')"
_next = "regexp_extract(t, '^[\\pL\\pN_]+\\s+([\\pL\\pN_]+)', 1)"
_styled = lambda w: f"({w} = upper({w}) OR {w} = upper(left({w}, 1)) || lower(substring({w}, 2)))"
_plain = lambda w: f"regexp_replace(strip_accents(lower({w})), 'a$', 'o')"
over_lines(
    "P1_ordinal_headers", parse.ordinal_article_id,
    f"'art-' || CASE WHEN NOT {_styled(_word)} THEN NULL WHEN {_plain(_word)} = 'decimo' AND {_plain(_next)} IN ('primero', 'segundo', 'tercero') AND ({_word} = upper({_word})) = ({_next} = upper({_next}))"
    f" AND ({_next} = upper({_next}) OR {_next} = lower({_next})) THEN 10 + list_position(['primero', 'segundo', 'tercero'], {_plain(_next)})"
    f" ELSE [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 20][list_position(['primero', 'segundo', 'tercero', 'cuarto', 'quinto', 'sexto', 'septimo', 'octavo', 'noveno', 'decimo', 'undecimo', 'duodecimo', 'vigesimo'], {_plain(_word)})] END::INT::VARCHAR",
    ("PRIMERO.- ", "Segunda. ", "DÉCIMO SEGUNDO. ", "Décimo. ", "VIGÉSIMO. ", "Primeramente ", "", "Décima tercera. ", "Décimo SEGUNDO. ", "SéPTIMO. ", "Octava ", "Undécimo: "),
)

# Whole texts as names and titles

over_texts(
    "P26_states_of_laws", rules.law_status,
    "CASE WHEN list_has_any(string_split_regex(f, '[^a-z0-9_]+'), ['abrogada', 'abrogado', 'abrogacion']) THEN 'abrogada' WHEN list_has_any(string_split_regex(f, '[^a-z0-9_]+'), ['derogada', 'derogado']) THEN 'derogada' ELSE 'vigente' END",
    ("Ley ", "Abrogación de la Ley ", "Código derogado ", "Ley (ABROGADO) ", "Ley de Aguas "), ("", " abrogadas", " DEROGADA", " derogados", "", "", " abrogada y derogada"),
)
_names = ("", "Constitución Política ", "CONSTITUCION X ", "Código Civil ", "codigo penal ", "Ley Orgánica ", "LEY ORGANICA ", "Ley de Ingresos ", "Presupuesto de Egresos ", "Ley de Hacienda Municipal ", "Tabla de Valores ", "Reglamento ", "Decreto 1 ", "Acuerdo ", "Bando ")
for _catalogue, _sql in {
    "metadata": first_of("l", ("constitucion", "constitución|constitucional"), ("codigo", "código|codigo"), ("ley_organica", "ley orgánica|ley organica"), ("ley", "ley"), ("reglamento", "reglamento"), ("decreto", "decreto"), ("acuerdo", "acuerdo"), default="otros"),
    "state": first_of("l", ("Constitucion", "constitución|constitucion"), ("Codigo", "código|codigo"), ("Ley Organica", "ley orgánica|ley organica"), ("Ley", "ley"), ("Reglamento", "reglamento"), ("Decreto", "decreto"), ("Acuerdo", "acuerdo"), default="Otro"),
    "municipal": first_of("l", ("Reglamento", "reglamento"), ("Código", "código|codigo"), ("Ley", "ley"), ("Decreto", "decreto"), default="Otro"),
    "municipal_congress": first_of("l", ("Ley de Ingresos", "ley de ingresos"), ("Presupuesto de Egresos", "presupuesto de egresos"), ("Ley de Hacienda Municipal", "hacienda municipal"), ("Tabla de Valores", "tabla de valores"), ("Reglamento", "reglamento"), ("Código", "código|codigo"), ("Ley", "ley"), ("Decreto", "decreto"), default="Otro"),
}.items():
    over_texts(f"P28_{_catalogue}", lambda c, k=_catalogue: rules.name_kind(c, k), _sql, _names)
over_texts(
    "P29_treaties", rules.treaty_kind,
    "CASE WHEN regexp_matches(f, 'bilateral|(acuerdo|convenio|tratado|protocolo) entre') THEN 'bilateral' WHEN regexp_matches(f, 'multilateral|convencion|(protocolo|carta|estatuto) de|pacto') THEN 'multilateral' ELSE 'unknown' END",
    ("", "Convenio entre México y Perú ", "Acuerdo bilateral ", "Convención de Viena ", "Pacto ", "Carta de la ONU ", "Protocolo entre A y B ", "PROTOCOLO DE ", "Tratado "),
)
over_texts(
    "P34_law_names", lambda c: F.md5(text.clean_law_name(c)),
    "md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)[(\\[]?\\b(abrogada|abrogado|derogada|derogado|vigente)\\b[)\\]]?', ' ', 'g'), '(?i)_?tomo_?\\s*[\\pL\\pN_]+', ' ', 'g'),"
    " '\\b[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}\\b|\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b', ' ', 'g'), '_', ' ', 'g'), '\\s+', ' ', 'g')))",
    ("", "Ley X (Abrogada) ", "Ley_de_Aguas_TOMO_II ", "Ley 12-03-2004 Y ", "  Ley   Z "), ("", " [DEROGADO]", " 2004-03-12 vigente", "_tomo_3"),
)
over_texts(
    "P36_content_types", parse.content_type,
    "CASE WHEN regexp_matches(t, '^ *<\\?xml') AND length(t) - length(ltrim(t, ' ')) <= 495 OR strpos(t, '<akomaNtoso') BETWEEN 1 AND 490 THEN 'akn' WHEN t IS NULL THEN 'text' ELSE 'text' END",
    ("", "<?xml version='1.0'?><a/>", "  <?xml?>", "x <akomaNtoso>", "x" * 500 + "<akomaNtoso>", "x" * 489 + "<akomaNtoso>", "x" * 490 + "<akomaNtoso>"),
)
over_texts(
    "N7_file_names", text.file_name,
    "left(regexp_replace(trim(translate(regexp_replace(t, '[[:cntrl:]]', '', 'g'), '<>:\"/\\|?*', '')), '\\s+', '_', 'g'), 150)",
    ("", "a/b: c?.pdf ", "  x   y ", '"q" <z>| '),
)
over_texts(
    "N14_latex", lambda c: F.md5(text.escape_latex(c)),
    "md5(array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN contains('&%$#_{}', c) THEN '\\' || c WHEN c = '~' THEN '\\textasciitilde{}' WHEN c = '^' THEN '\\textasciicircum{}' WHEN c = '\\' THEN '\\textbackslash{}' ELSE c END), ''))",
    ("", "a & b ", "50 % ", "x_y^2 ", "{~} ", "a\\b "),
)
_pads = ["".join(f"\\x{k ^ pad:02X}" for k in b"secret".ljust(64, b"\0")) for pad in (0x36, 0x5C)]
over_texts("N11_signature", lambda c: text.signature("secret", c), f"sha256('{_pads[1]}'::BLOB || unhex(sha256('{_pads[0]}'::BLOB || encode(t))))", ("",))

# Columns of other tables

_kinds = ("lineamientos", " Resolución", "otro", "", "Reglas de Operacion ")
_by_name = first_of("f", *((k, k) for k in ("reglamento", "acuerdo", "decreto", "lineamiento", "norma", "circular", "manual", "aviso", "reglas", "estatuto", "convenio", "criterio", "resolucion")), default="regulacion")
_regulations = ("", "Manual de usos ", "AVISO general ", "Reglas y normas ", "nada ", "Estatuto ", "CRITERIO ")


@query("P28_regulations", f"WITH x AS (SELECT doc_id AS k, strip_accents(lower(trim({listed(_kinds)}[doc_id % {len(_kinds)} + 1]))) AS g, strip_accents(lower({listed(_regulations)}[doc_id % {len(_regulations)} + 1] || text)) AS f FROM documents) "
       f"SELECT k, CASE g WHEN 'lineamientos' THEN 'lineamiento' WHEN 'resolucion' THEN 'resolucion' WHEN 'reglas de operacion' THEN 'reglas' ELSE {_by_name} END AS v FROM x")
def _(s, d):
    k = F.col("doc_id")
    return table(s, d, "documents", ["doc_id", "text"]).select(k.alias("k"), rules.regulation_kind(pick(k, _kinds), F.concat(pick(k, _regulations), F.col("text"))).alias("v"))


_messages, _stages = ("HTTP 500 ", "no PDF ", "bad XML ", "schema ", "low quality ", "", "Downloaded "), (None, "validate", "", "download", None, "extract", "parse", None, "other")


@query("P23_error_kinds", f"WITH x AS (SELECT event_id, lower({listed(_messages)}[event_id % {len(_messages)} + 1] || event_type || ' ' || props) AS m, {listed(_stages)}[user_id % {len(_stages)} + 1] AS s, event_type = 'view' AND user_id % 2 = 0 AS asked FROM events) "
       "SELECT event_id, CASE WHEN s = 'download' OR m LIKE '%download%' OR m LIKE '%http%' OR asked THEN 'DOWNLOAD_ERROR' WHEN s = 'extract' OR m LIKE '%extract%' OR m LIKE '%pdf%' THEN 'EXTRACTION_ERROR' WHEN s = 'parse' OR m LIKE '%parse%' OR m LIKE '%xml%' THEN 'PARSE_ERROR' WHEN s = 'validate' OR m LIKE '%validat%' OR m LIKE '%schema%' THEN 'VALIDATION_ERROR' WHEN m LIKE '%quality%' OR m LIKE '%grade%' THEN 'QUALITY_ERROR' ELSE 'UNKNOWN_ERROR' END AS v FROM x")
def _(s, d):
    message = F.concat(pick(F.col("event_id"), _messages), "event_type", F.lit(" "), "props")
    kind = F.when((F.col("event_type") == "view") & (F.col("user_id") % 2 == 0), "RequestException").otherwise("Error")
    return table(s, d, "events").select("event_id", rules.error_class(kind, message, pick(F.col("user_id"), _stages)).alias("v"))


_failed = ("HTTP ", "Page Not Found after ", "timeout ", "GONE: ", "no encontrado ", "status=")


@query("P33_failures", f"WITH x AS (SELECT event_id, 400 + (props::JSON->>'k')::BIGINT AS code, event_id % {len(_failed)} AS i FROM events) SELECT event_id, CASE WHEN code IN (404, 410) OR i IN (1, 3) AND code IS NOT NULL THEN 'permanent' ELSE 'transient' END AS v FROM x")
def _(s, d):
    code = (F.get_json_object("props", "$.k").cast("long") + 400).cast("string")
    return table(s, d, "events").select("event_id", rules.failure_class(F.concat(pick(F.col("event_id"), _failed), code)).alias("v"))


_agencies = {"ECO": "Economia", "BRAND#1": "Uno", "BRAND#17": "Diecisiete", "STANDARD PLUS": "Normas", "BRAND#": "Marca"}
_listed = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(_agencies.items()))


@query("P30_agencies", f"WITH a(i, k, v) AS (VALUES {_listed}), x AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN upper(p_type) WHEN 4 THEN '' ELSE upper(p_brand) END AS g FROM part), "
       "h AS (SELECT p_partkey, g, max(CASE WHEN k = g THEN v END) AS same, arg_min(v, i) FILTER (starts_with(g, k) OR starts_with(k, g)) AS near FROM x, a GROUP BY ALL) SELECT p_partkey, CASE WHEN g = '' THEN '' ELSE coalesce(same, near, g) END AS v FROM h")
def _(s, d):
    k = F.col("p_partkey") % 5
    number = F.concat(F.lit("NOM-"), F.col("p_size").cast("string"), F.when(k == 4, "").otherwise(F.concat(F.lit("-"), F.when(k == 0, F.col("p_type")).otherwise(F.col("p_brand")), F.lit("-2010"))))
    return table(s, d, "part").select("p_partkey", rules.agency(number, _agencies).alias("v"))


_states = ("VIGENTE ", "En  vigor ", "Cancelado ", "En proyecto", " ", "Cancelación ")


@query("P30_standard_states", f"WITH x AS (SELECT o_orderkey, {listed(_states)}[o_orderkey % {len(_states)} + 1] || o_orderpriority AS t FROM orders) SELECT o_orderkey, CASE WHEN regexp_matches(lower(t), 'vigente|en\\s+vigor') THEN 'vigente' WHEN regexp_matches(lower(t), 'cancelad[ao]') THEN 'cancelada' WHEN contains(lower(t), 'proyecto') THEN 'en_proyecto' ELSE lower(trim(t)) END AS v FROM x")
def _(s, d):
    return table(s, d, "orders", ["o_orderkey", "o_orderpriority"]).select("o_orderkey", rules.standard_status(F.concat(pick(F.col("o_orderkey"), _states), F.col("o_orderpriority"))).alias("v"))


_subjects = {"building": "civil", "machinery": "laboral", "household": "administrativa"}


@query("P31_subjects", "SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'civil' WHEN 'machinery' THEN 'laboral' WHEN 'household' THEN 'administrativa' ELSE 'comun' END AS v FROM customer")
def _(s, d):
    raw = F.concat(pick(F.col("c_custkey"), ["", " ", "  "]), "c_mktsegment", F.lit(" "))
    return table(s, d, "customer").select("c_custkey", rules.subject(raw, _subjects).alias("v"))


_path = "string_split(regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '_', ' ', 'g'), '-', ' ', 'g'), '/')"
_able = f"list_filter(list_reverse({_path}), lambda p: length(p) > 3 AND NOT regexp_matches(p, '^(ley|decreto|acuerdo|ingreso|presupuesto|doc|archivo|download)') AND len(list_filter(string_split(p, ' '), lambda w: length(w) = 1)) = 0)"


@query("P32_places", f"WITH x AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Ley del Municipio de ' ELSE 'Ley ' END || regexp_extract(html, '<title>([^<]*)', 1) AS t, replace(replace(url, '/en/', '/villa_alta/'), '/de/', '/ley_de-x/san-luis/') AS u FROM pages) "
       f"SELECT page_id, coalesce(nullif(regexp_extract(t, '[Mm]unicipio\\s+de\\s+(\\p{{Lu}}\\p{{Ll}}+(?:\\s+\\p{{Lu}}\\p{{Ll}}+)*)', 1), ''), array_to_string(list_transform(string_split(({_able})[1], ' '), lambda w: upper(left(w, 1)) || substring(w, 2)), ' '), 'Estado') AS v FROM x")
def _(s, d):
    title = F.concat(F.when(F.col("page_id") % 3 == 0, "Ley del Municipio de ").otherwise("Ley "), F.regexp_extract("html", "<title>([^<]*)", 1))
    url = F.replace(F.replace(F.col("url"), F.lit("/en/"), F.lit("/villa_alta/")), F.lit("/de/"), F.lit("/ley_de-x/san-luis/"))
    return table(s, d, "pages").select("page_id", text.municipality_of(title, url, F.lit("Estado")).alias("v"))


_units, _tens = ("primero", "segundo", "tercero", "cuarto", "quinto", "sexto", "séptimo", "octavo", "noveno"), ("décimo", "vigésimo", "trigésimo", "cuadragésimo", "quincuagésimo")


@query("P13_ordinals", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 39 AND p_partkey % 7 > 0 THEN p_size END::INT AS v FROM part")
def _(s, d):
    """Sizes spelt as ordinals, in both genders and cases; a seventh of them followed by the part's name, which makes them none."""
    n, k = F.col("p_size"), F.col("p_partkey")
    unit, ten = F.get(F.array(*map(F.lit, _units)), n % 10 - 1), F.get(F.array(*map(F.lit, _tens)), F.floor(n / 10).cast("int") - 1)
    said = F.when((n == 11) & (k % 2 == 0), "undécimo").when((n == 12) & (k % 2 == 0), "duodécimo").otherwise(F.concat_ws(" ", ten, unit))
    said = F.when(k % 3 == 0, F.regexp_replace(said, r"o\b", "a")).otherwise(said)
    said = F.when(k % 5 == 0, F.upper(said)).otherwise(said)
    return table(s, d, "part").select(k, text.ordinal(F.when(k % 7 == 0, F.concat_ws(" ", said, "p_name")).otherwise(said)).alias("v"))


@query("N11_durations", "WITH x AS (SELECT o_orderkey, floor(o_totalprice / [1, 100, 10000][o_orderkey % 3 + 1])::BIGINT AS n FROM orders) SELECT o_orderkey, CASE WHEN n >= 3600 THEN (n // 3600) || 'h ' || (n // 60 % 60) || 'm ' || (n % 60) || 's' WHEN n >= 60 THEN (n // 60) || 'm ' || (n % 60) || 's' ELSE n || 's' END AS v FROM x")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", text.duration_text(F.floor(F.col("o_totalprice") / pick(F.col("o_orderkey"), [1, 100, 10000]))).alias("v"))


@query("N12_json_lists", "SELECT event_id, event_id % 7 > 0 AND event_type IN ('click', 'view') AND user_id % 2 = 0 OR event_id % 7 > 0 AND event_type = 'click' AS has, CASE WHEN event_id % 7 > 0 THEN '[\"' || event_type || '\",\"' || CASE WHEN user_id % 2 = 0 AND event_type = 'view' THEN 'click' ELSE user_id::VARCHAR END || '\",' ELSE '[' END || '\"' || user_id || '\"]' AS v FROM events")
def _(s, d):
    u = F.col("user_id").cast("string")
    second = F.when((F.col("user_id") % 2 == 0) & (F.col("event_type") == "view"), "click").otherwise(u)
    items = F.when(F.col("event_id") % 7 > 0, F.to_json(F.array("event_type", second)))
    return table(s, d, "events").select("event_id", text.json_has(items, F.lit("click")).alias("has"), text.json_append(items, u).alias("v"))


# Documents as acts: a line is an article; parts are missing by the document's key

_frbr = "".join(f"<{n}><FRBRthis/><FRBRuri/><FRBRdate/></{n}>" for n in ("FRBRWork", "FRBRExpression", "FRBRManifestation"))
_metas = (f"<meta>{_frbr}</meta>", "<meta><FRBRWork><FRBRthis/><FRBRuri/></FRBRWork></meta>", "", f"<meta>{_frbr}</meta>")
_levels = ("", "<chapter><num>I</num></chapter>" * 3, "<title><num/></title>", "<title><num>I</num></title>")


def acts(s: SparkSession, d: str) -> DataFrame:
    """(k, xml): every document as an act whose articles are its lines; numbers jump in each fifth, the root of each 13th is another, each 11th breaks off."""
    k = F.col("doc_id")
    lines = F.split(F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f]", ""), "\n")
    number = lambda i: (i + 1 + F.when((k % 5 == 0) & (i >= 2), 7).otherwise(0)).cast("string")
    article = lambda t, i: F.concat(F.lit("<article><num>Artículo "), number(i), F.lit("</num><content><p>"), text.escape_xml(t), F.lit("</p></content></article>"))
    inner = F.concat(pick(k, _levels), F.array_join(F.transform(lines, article), ""))
    body = F.when(k % 7 == 0, inner).otherwise(F.concat(F.lit("<body>"), inner, F.lit("</body>")))
    root = F.when(k % 13 == 0, "law").otherwise("akomaNtoso")
    xml = F.concat(F.lit("<"), root, F.lit("><act>"), pick(k, _metas), body, F.lit("</act>"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("</"), root, F.lit(">"))))
    return table(s, d, "documents", ["doc_id", "text"]).select(k.alias("k"), xml.alias("xml"))


ACTS = (
    "a AS (SELECT doc_id AS k, len(n) AS n, len(list_filter(n, lambda c: c < 20)) AS short, len(list_filter(n, lambda c: c < 5)) AS bare FROM (SELECT doc_id, list_transform(string_split(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f]', '', 'g'), chr(10)), lambda t: length(t)) AS n FROM documents)),"
    " w AS (SELECT * FROM a WHERE k % 11 <> 0 AND n IS NOT NULL)"
)


@query("P20_completeness", f"""WITH {ACTS} SELECT k, 'parse_error' AS "check", 'not well-formed' AS issue FROM a WHERE k % 11 = 0 OR n IS NULL
UNION ALL SELECT k, 'article_sequence', 'gap 2-10' FROM w WHERE k % 5 = 0 AND n >= 3 UNION ALL SELECT k, 'frbr_metadata', 'no meta' FROM w WHERE k % 4 = 2
UNION ALL SELECT k, 'frbr_metadata', unnest(['no FRBRdate in FRBRWork', 'no FRBRExpression', 'no FRBRManifestation']) FROM w WHERE k % 4 = 1
UNION ALL SELECT k, 'content_length', short || ' short articles' FROM w WHERE short * 20 > n UNION ALL SELECT k, 'content_length', bare || ' empty articles' FROM w WHERE bare > 0
UNION ALL SELECT k, 'hierarchy', 'no body' FROM w WHERE k % 7 = 0 UNION ALL SELECT k, 'hierarchy', 'fewer articles than chapters' FROM w WHERE k % 7 <> 0 AND k % 4 = 1 AND n < 3
UNION ALL SELECT k, 'structure_elements', 'title without num' FROM w WHERE k % 4 = 2""")
def _(s, d):
    return parse.completeness(acts(s, d), "k", "xml")


@query("P21_validity", f"WITH {ACTS} SELECT k, 'not_well_formed' AS issue FROM a WHERE k % 11 = 0 OR n IS NULL UNION ALL SELECT k, 'no_meta' FROM w WHERE k % 4 = 2 UNION ALL SELECT k, 'no_body' FROM w WHERE k % 7 = 0 UNION ALL SELECT k, 'wrong_root' FROM w WHERE k % 13 = 0")
def _(s, d):
    return parse.schema_validity(acts(s, d), "k", "xml")
