"""Rule functions as Column expressions: classification, quality, progressive rates, health, state machines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

#: Category rules, in order; patterns are over folded text.
CATEGORY_PATTERNS = {
    "Civil": ("codigo civil", "procedimientos civiles", "registro civil", "derecho civil"),
    "Penal": ("codigo penal", "procedimientos penales", "derecho penal", "ejecucion de penas", "sistema penitenciario"),
    "Fiscal": ("codigo fiscal", "ley de hacienda", "ley de ingresos", "presupuesto", "impuesto", "contribuciones"),
    "Electoral": ("codigo electoral", "ley electoral", "partidos politicos", "proceso electoral"),
    "Laboral": ("derecho del trabajo", "ley del trabajo", "trabajadores", "servicio civil", "burocracia"),
    "Administrativo": ("ley organica", "reglamento", "administracion publica", "procedimiento administrativo", "transparencia", "acceso a la informacion"),
    "Constitucional": ("constitucion", "reforma constitucional", "derechos humanos", "amparo"),
}
#: Gazette change classes in order of precedence, and instruments.
CHANGE_KEYWORDS = {
    "abrogation": ("DEROGA", "ABROGA"),
    "reform": ("REFORMA", "ADICIONA", "MODIFICA"),
    "new_law": ("EXPIDE", "SE CREA", "LEY GENERAL DE", "LEY FEDERAL DE"),
}
INSTRUMENTS = ("DECRETO", "LEY", "REGLAMENTO", "CODIGO", "CÓDIGO", "CONSTITUCIÓN", "CONSTITUCION", "ESTATUTO")
#: Monthly brackets of 2026: lower limit, fixed amount, rate.
BRACKETS = (
    ("0.01", "0.00", "0.0192"), ("10135.12", "194.59", "0.0640"), ("86022.12", "5051.37", "0.1088"), ("151176.20", "12140.13", "0.1600"),
    ("175735.67", "16069.64", "0.1792"), ("210403.70", "22282.14", "0.2136"), ("424353.98", "67981.92", "0.2352"), ("668840.15", "125485.07", "0.3000"),
    ("1276925.99", "307910.81", "0.3200"), ("1702567.98", "444057.91", "0.3400"), ("5107703.93", "1605679.59", "0.3500"),
)
DEGRADED_MS = 10_000
#: Phrases of legal language.
LEGAL_PHRASES = ("en términos", "conforme", "de acuerdo", "lo dispuesto")
#: Kinds of instruments by keywords of names, in order, as five catalogues say them; the last of each is the default.
NAME_KINDS = {
    "metadata": {
        "constitucion": ("constitución", "constitucional"), "codigo": ("código", "codigo"), "ley_organica": ("ley orgánica", "ley organica"), "ley": ("ley",),
        "reglamento": ("reglamento",), "decreto": ("decreto",), "acuerdo": ("acuerdo",), "otros": (),
    },
    "state": {
        "Constitucion": ("constitución", "constitucion"), "Codigo": ("código", "codigo"), "Ley Organica": ("ley orgánica", "ley organica"), "Ley": ("ley",),
        "Reglamento": ("reglamento",), "Decreto": ("decreto",), "Acuerdo": ("acuerdo",), "Otro": (),
    },
    "municipal": {"Reglamento": ("reglamento",), "Código": ("código", "codigo"), "Ley": ("ley",), "Decreto": ("decreto",), "Otro": ()},
    "municipal_congress": {
        "Ley de Ingresos": ("ley de ingresos",), "Presupuesto de Egresos": ("presupuesto de egresos",), "Ley de Hacienda Municipal": ("hacienda municipal",),
        "Tabla de Valores": ("tabla de valores",), "Reglamento": ("reglamento",), "Código": ("código", "codigo"), "Ley": ("ley",), "Decreto": ("decreto",), "Otro": (),
    },
}
#: Regulation types and their categories, in order.
REGULATION_KINDS = {
    "reglamento": "reglamento", "acuerdo": "acuerdo", "decreto": "decreto", "lineamiento": "lineamiento", "lineamientos": "lineamiento", "norma": "norma",
    "circular": "circular", "manual": "manual", "aviso": "aviso", "reglas": "reglas", "reglas de operacion": "reglas", "estatuto": "estatuto",
    "convenio": "convenio", "criterio": "criterio", "resolucion": "resolucion",
}
#: Kinds in work URIs by keywords of names, in order.
URI_KINDS = {"codigo": ("código", "codigo"), "reglamento": ("reglamento",), "decreto": ("decreto",)}
#: States of standards by keywords, in order.
STANDARD_STATES = {"vigente": ("vigente", "en vigor"), "cancelada": ("cancelada", "cancelado"), "en_proyecto": ("en proyecto", "proyecto")}
#: Treaty kinds in order; patterns are over folded text.
TREATIES = {
    "bilateral": ("bilateral", "acuerdo entre", "convenio entre", "tratado entre", "protocolo entre"),
    "multilateral": ("multilateral", "convencion", "protocolo de", "carta de", "pacto", "estatuto de"),
}
#: Subjects of judicial records; others are "comun".
SUBJECTS = {"civil": "civil", "penal": "penal", "administrativa": "administrativa", "administrativo": "administrativa", "laboral": "laboral", "constitucional": "constitucional"}


def safe_pct(have: Column, of: Column) -> Column:
    """Percentage with one decimal, at most 100; null without a universe."""
    return F.when(of > 0, F.bround(F.least(have / of * 100, F.lit(100.0)), 1))


def by_keywords(text: Column, rules: Mapping[str, Sequence[str]], default: str | None) -> Column:
    """The first class of which a keyword occurs."""
    out = None
    for name, keys in rules.items():
        hit = F.greatest(*[F.contains(text, F.lit(k)).cast("int") for k in keys], F.lit(0)) == 1
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default))


def best_category(text: Column, rules: Mapping[str, Sequence[str]] = CATEGORY_PATTERNS, default: str = "Otros", window: int = 5000) -> Column:
    """The class with most pattern hits in the first ``window`` characters; the earlier class on a tie."""
    low = fold(F.left(text, F.lit(window)))
    scores = F.array(*[
        F.struct(sum((F.contains(low, F.lit(p)).cast("int") for p in ps), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c"))
        for i, (c, ps) in enumerate(rules.items())
    ])
    best = F.array_max(scores)
    return F.when(best.n > 0, best.c).otherwise(F.lit(default))


def name_kind(name: Column, catalogue: str = "metadata") -> Column:
    """The kind of instrument that a name says, by the keywords of a catalogue."""
    rules = dict(NAME_KINDS[catalogue])
    default, _ = rules.popitem()
    return by_keywords(F.lower(name), rules, default)


def regulation_kind(kind: Column, name: Column) -> Column:
    """By the regulation's type, else by the first type that its name holds."""
    known = F.create_map(*[F.lit(x) for kv in REGULATION_KINDS.items() for x in kv])
    by_name = None
    for word, category in REGULATION_KINDS.items():
        hit = F.contains(fold(name), F.lit(word))
        by_name = F.when(hit, category) if by_name is None else by_name.when(hit, category)
    return F.coalesce(F.element_at(known, fold(F.trim(kind))), by_name.otherwise("regulacion"))


def standard_status(raw: Column) -> Column:
    """A standard's state; what isn't known stays, lower-cased and trimmed."""
    words = F.trim(F.regexp_replace(fold(raw), r"\s+", " "))
    return F.coalesce(by_keywords(words, STANDARD_STATES, None), F.lower(F.trim(raw)))


def law_status(name: Column) -> Column:
    """P26."""
    low = fold(name)
    return F.when(low.rlike(r"\babroga(d[ao]|cion)\b"), "abrogada").when(low.rlike(r"\bderogad[ao]\b"), "derogada").otherwise("vigente")


def change_class(title: Column) -> Column:
    """P25."""
    return by_keywords(F.upper(title), CHANGE_KEYWORDS, "other")


def is_instrument(title: Column) -> Column:
    return F.greatest(*[F.contains(F.upper(title), F.lit(k)).cast("int") for k in INSTRUMENTS]) == 1


def error_class(kind: Column, message: Column, stage: Column) -> Column:
    """Stage and message decide, in the order of the pipeline's stages."""
    m, k, s = F.lower(F.coalesce(message, F.lit(""))), F.lower(F.coalesce(kind, F.lit(""))), F.coalesce(stage, F.lit(""))
    return (
        F.when((s == "download") | m.contains("download") | k.contains("request") | m.contains("http"), "DOWNLOAD_ERROR")
        .when((s == "extract") | m.contains("extract") | m.contains("pdf"), "EXTRACTION_ERROR")
        .when((s == "parse") | m.contains("parse") | m.contains("xml"), "PARSE_ERROR")
        .when((s == "validate") | m.contains("validat") | m.contains("schema"), "VALIDATION_ERROR")
        .when(m.contains("quality") | m.contains("grade"), "QUALITY_ERROR")
        .otherwise("UNKNOWN_ERROR")
    )


def failure_class(message: Column, permanent: Sequence[str] = ("404", "410", "not found", "gone")) -> Column:
    """Permanent if the message says so, else transient."""
    return by_keywords(F.lower(F.coalesce(message, F.lit(""))), {"permanent": permanent}, "transient")


def health(status_code: Column, has_text: Column, elapsed_ms: Column) -> Column:
    """P24."""
    return (
        F.when(status_code.isNull() | (status_code != 200), "down").when(~has_text, "degraded")
        .when(elapsed_ms > DEGRADED_MS, "degraded").otherwise("healthy")
    )


def accuracy(found: Column, expected: Column, confidence: Column) -> Column:
    """Share of expected articles found, shrunk if more than 110 % were found, and confidence, 70 to 30; 0 where none is expected."""
    share = F.when(found > expected * 1.1, F.lit(0.95)).otherwise(F.least(F.try_divide(found, expected), F.lit(1.0)))
    return F.when(expected == 0, 0.0).otherwise(F.least((share * 0.7 + confidence * 0.3) * 100, F.lit(100.0)))


def completeness_score(articles: Column, structures: Column, transitory: Column, issues: Column) -> Column:
    """40 for articles, 20 each for titles or chapters, a transitory part and no issue; an issue takes 5 of the last 20."""
    has = lambda c, points: F.when(c > 0, points).otherwise(0)
    return (has(articles, 40) + has(structures, 20) + has(transitory, 20) + F.greatest(20 - 5 * issues, F.lit(0))).cast("double")


def overall_quality(accuracy_: Column, completeness: Column, schema: Column) -> Column:
    return accuracy_ * 0.5 + completeness * 0.3 + schema * 0.2


def grade(score: Column) -> Column:
    return F.when(score >= 95, "A").when(score >= 90, "B").when(score >= 80, "C").when(score >= 70, "D").otherwise("F")


def article_confidence(text: Column) -> Column:
    """Less for a short text and for one without punctuation, more for legal phrases; between 0 and 1."""
    c = (
        F.lit(1.0) - F.when(F.length(text) < 50, 0.1).otherwise(0.0) - F.when(~text.rlike("[.;:]"), 0.2).otherwise(0.0)
        + F.when(text.rlike(f"(?iu){'|'.join(LEGAL_PHRASES)}"), 0.05).otherwise(0.0)
    )
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def derogated(text: Column) -> Column:
    """A short text that says so."""
    low = fold(text)
    said = low.rlike(r"se\s+deroga|queda\s+derogad[oa]|\(derogad[oa]\)|(?m)^derogad[oa]\.?$|(?m)^se\s+abroga\.?$")
    return (F.length(F.trim(text)) < 100) & said


def must_pay(resident: Column, mexican_source: Column) -> Column:
    """X1."""
    return resident | (~resident & mexican_source)


def total_income(cash: Column, goods: Column) -> Column:
    return (cash + goods).cast("decimal(18,2)")


def tax(income: Column, reference_mode: bool = False) -> Column:
    """Fixed amount and rate above the bracket's lower limit, in exact decimals. An income of 0 owes 0; in
    ``reference_mode`` it falls to the last bracket."""
    d = income.cast("decimal(18,2)")
    out = F.lit(0).cast("decimal(22,6)") if not reference_mode else None
    lows = [F.lit(lo).cast("decimal(18,2)") for lo, _, _ in BRACKETS]
    made = [F.lit(f).cast("decimal(18,2)") + (d - low) * F.lit(r).cast("decimal(6,4)") for low, (_, f, r) in zip(lows, BRACKETS, strict=True)]
    case = None
    for low, m in reversed(list(zip(lows, made, strict=True))):
        case = F.when(d >= low, m) if case is None else case.when(d >= low, m)
    return case.otherwise(made[-1] if reference_mode else out).cast("decimal(18,4)")


def gap_after(tier: Column, status: Column, actions: Column) -> Column:
    """A gap's (tier, status) after a list of actions: escalate raises the tier to 4 at most and blocks there, resolve and
    permanent end it."""
    start = F.struct(tier.cast("int").alias("tier"), status.alias("status"))
    return F.aggregate(actions, start, lambda g, a: F.when(g.status.isin("resolved", "permanent"), g).when(
        a == "resolve", F.struct(g.tier.alias("tier"), F.lit("resolved").alias("status"))).when(
        a == "permanent", F.struct(g.tier.alias("tier"), F.lit("permanent").alias("status"))).when(
        (a == "escalate") & (g.tier >= 4), F.struct(g.tier.alias("tier"), F.lit("blocked").alias("status"))).when(
        a == "escalate", F.struct((g.tier + 1).alias("tier"), F.lit("in_progress").alias("status"))).otherwise(g))


def treaty_kind(title: Column) -> Column:
    """P29."""
    return by_keywords(fold(title), TREATIES, "unknown")


def agency(standard: Column, agencies: Mapping[str, str]) -> Column:
    """The agency of a standard's number (NOM-001-SSA1-2010) by its third part: exact, else the first in order that begins
    it or that it begins, else the part itself."""
    part = F.upper(F.get(F.split(standard, "-"), F.lit(2)))
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in agencies.items()])
    exact = F.get(F.filter(known, lambda a: a.k == part), F.lit(0)).v
    near = F.get(F.filter(known, lambda a: F.startswith(part, a.k) | F.startswith(a.k, part)), F.lit(0)).v
    return F.when(part.isNull() | (part == ""), "").otherwise(F.coalesce(exact, near, part))


def subject(raw: Column, subjects: Mapping[str, str] = SUBJECTS) -> Column:
    """P31."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in subjects.items() for x in kv]), fold(F.trim(raw))), F.lit("comun"))


def thesis_kind(raw: Column) -> Column:
    """P31."""
    return F.when(F.contains(F.lower(raw), F.lit("jurisprudencia")), "jurisprudencia").otherwise("tesis_aislada")
