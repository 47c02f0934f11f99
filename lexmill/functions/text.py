"""Text functions as Column expressions: normal forms, keys, slugs, numerals, ordinals, dates.

Patterns that meet Spanish text carry ``(?iuU)``: Java's classes and case folding are ASCII without it.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Accented letters and their base letters.
ACCENTED, PLAIN = "áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"
#: Words that a title key leaves out.
STOP_WORDS = ("de", "del", "la", "las", "los", "el", "en", "y", "a", "por", "para", "que", "con", "al", "se", "su", "una", "un", "es")
#: Months.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
#: Ordinals from 1; each also with final "a".
UNITS = ("primero", "segundo", "tercero", "cuarto", "quinto", "sexto", "septimo", "octavo", "noveno")
TENS = {"decimo": 10, "undecimo": 11, "duodecimo": 12, "vigesimo": 20, "trigesimo": 30}
LAST_ORDINAL = 999
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def strip_accents(c: Column) -> Column:
    """Accented Latin letters to base letters."""
    return F.translate(c, ACCENTED, PLAIN)


@F.pandas_udf(StringType())
def strip_marks(c: pd.Series) -> pd.Series:
    """N1 for any script: compatibility decomposition without combining marks. ``strip_accents`` does it for Latin letters without Python."""
    return c.map(lambda x: "".join(k for k in unicodedata.normalize("NFKD", x) if not unicodedata.combining(k)), na_action="ignore")


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return strip_accents(F.lower(c))


def title_words(c: Column) -> Column:
    """Words of a title, folded, punctuation as space, without stop words; repeats stay."""
    words = F.split(F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def title_key(c: Column) -> Column:
    """One key for the accent, punctuation and stop-word variants of a title."""
    return F.array_join(title_words(c), " ")


def alnum_key(c: Column) -> Column:
    """Folded letters and digits only."""
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def slug(c: Column, sep: str = "-", cap: int = 100, default: str = "") -> Column:
    """Folded words joined with ``sep``, at most ``cap`` characters."""
    made = F.substring(F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", sep), f"^{sep}+|{sep}+$", ""), 1, cap)
    return F.when(F.coalesce(made, F.lit("")) == "", F.lit(default)).otherwise(made)


def stable_id(prefix: str, scope: Column, name: Column) -> Column:
    """An id that only depends on scope and normal name."""
    return F.concat(F.lit(f"{prefix}-"), scope, F.lit("-"), F.substring(F.sha2(F.concat_ws(":", scope, alnum_key(name)), 256), 1, 12))


def session_id(*parts: Column) -> Column:
    """16 hex digits that only depend on the parts."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 16)


def file_name(c: Column, cap: int = 150) -> Column:
    """A name that any file system takes: reserved characters go, white space becomes one underscore."""
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "")), r"\s+", "_"), 1, cap)


def capped(c: Column, n: int) -> Column:
    """The first n characters."""
    return F.left(c, F.lit(n))


def parts_of(c: Column, sep: str) -> Column:
    """The number of parts between separators; 0 for null."""
    return F.when(c.isNull(), 0).otherwise(F.size(F.split(c, sep)))


def iso(c: Column) -> Column:
    """A time in ISO form; ``days_before`` and ``year_start`` are its arithmetic."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def days_before(c: Column, n: int) -> Column:
    return F.date_sub(F.to_date(c), n)


def year_start(c: Column, back: int = 0) -> Column:
    return F.make_date(F.year(c) - back, F.lit(1), F.lit(1))


def json_has(items: Column, item: Column) -> Column:
    """Whether a JSON list of strings has an item; a null list has none."""
    return F.coalesce(F.array_contains(F.from_json(items, "array<string>"), item), F.lit(False))


def json_append(items: Column, item: Column) -> Column:
    """The JSON list with an item at its end; a null list is empty."""
    return F.to_json(F.array_append(F.coalesce(F.from_json(items, "array<string>"), F.array().cast("array<string>")), item))


def signature(secret: str, body: Column) -> Column:
    """HMAC-SHA256 in hex. The padded keys are constants of the plan, so only its two digests are computed per row."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256)


def collapse(c: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    """Null and blank both mean absent."""
    return F.nullif(F.trim(c), F.lit(""))


def first_given(*cs: Column) -> Column:
    """The first of several spellings of a field that is given."""
    return F.coalesce(*map(blank_to_null, cs))


def escape_like(value: str) -> str:
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def icontains(c: Column, part: str) -> Column:
    """case-insensitive substring."""
    return c.ilike(f"%{escape_like(part)}%")


def natural_key(c: Column, width: int = 12) -> Column:
    """Sorts digit runs by value, the rest by lower-case text."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^\d"), F.lpad(t, width, "0")).otherwise(t)), "")


def roman(c: Column) -> Column:
    """Value of a roman numeral; 0 if it isn't one."""
    values = F.transform(
        F.filter(F.split(F.upper(c), ""), lambda x: x != ""),
        lambda x: F.element_at(F.create_map(*[F.lit(v) for kv in ROMAN.items() for v in kv]), x),
    )
    total = F.aggregate(
        values, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda acc, v: F.struct((acc.sum + v - F.when(acc.last < v, acc.last * 2).otherwise(0)).alias("sum"), v.alias("last")),
        lambda acc: acc.sum,
    )
    return F.when(F.upper(c).rlike("^[IVXLCDM]+$"), total).otherwise(F.lit(0))


def ordinal(c: Column) -> Column:
    """Value of a Spanish ordinal of one or two words; null if it isn't one."""
    table = {w: i for i, w in enumerate(UNITS, 1)} | TENS | {"ultimo": LAST_ORDINAL}
    values = F.create_map(*[F.lit(v) for w, n in table.items() for k in (w, f"{w[:-1]}a") for v in (k, n)])
    words = F.split(collapse(fold(c)), " ")
    return F.when(F.size(words) == 1, F.element_at(values, words[0])).when(
        (F.size(words) == 2) & (F.element_at(values, words[0]) % 10 == 0) & (F.element_at(values, F.get(words, F.lit(1))) < 10),
        F.element_at(values, words[0]) + F.element_at(values, F.get(words, F.lit(1))),
    )


def any_date(c: Column) -> Column:
    """The first date in a text as DateType: long Spanish form, ISO, or day first with slashes or dashes."""
    month = F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS, 1) for v in (m, i)])
    low = fold(c)
    words = [F.regexp_extract(low, r"(\d{1,2})o?\s+de\s+([a-z]+)\s+(?:de|del)\s+(\d{4})", i) for i in (1, 2, 3)]
    iso = [F.regexp_extract(low, r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", i) for i in (1, 2, 3)]
    day = [F.regexp_extract(low, r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b", i) for i in (1, 2, 3)]

    def made(y: Column, m: Column, d: Column) -> Column:
        year = y.try_cast("int")
        ok = year.between(1900, 2030)
        return F.when(ok, F.try_to_date(F.format_string("%04d-%02d-%02d", year, m.try_cast("int"), d.try_cast("int")), "yyyy-MM-dd"))

    return F.coalesce(made(words[2], F.element_at(month, words[1]).cast("string"), words[0]), made(iso[0], iso[1], iso[2]), made(day[2], day[1], day[0]))


def effective_date(c: Column) -> Column:
    """The date after a phrase that puts a law in force."""
    phrase = r"(?:entrara\s+en\s+vigor\s+(?:el\s+dia\s+)?|entra\s+en\s+vigor\s+a\s+partir\s+del?\s+|vigencia\s+a\s+partir\s+del?\s+)(\d{1,2}\s+de\s+[a-z]+\s+de\s+\d{4})"
    return any_date(F.regexp_extract(fold(c), phrase, 1))


def clean_law_name(c: Column) -> Column:
    """A law's name without dates, status words and volume marks."""
    bare = F.regexp_replace(c, r"(?iuU)[\(\[]?\b(abrogad[ao]|derogad[ao]|vigente)\b[\)\]]?", " ")
    bare = F.regexp_replace(bare, r"(?iuU)_?tomo_?\s*\w+", " ")
    bare = F.regexp_replace(bare, r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b", " ")
    return collapse(F.regexp_replace(bare, "_", " "))


def python_round(c: Column, places: int = 0) -> Column:
    """Half to even."""
    return F.bround(c, places)


def duration_text(seconds: Column) -> Column:
    """Hours, minutes and seconds."""
    s = seconds.cast("long")
    return F.when(s >= 3600, F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).when(
        s >= 60, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def cursor(*keys: Column) -> Column:
    """An opaque page cursor."""
    return F.base64(F.to_json(F.array(*[k.cast("string") for k in keys])).cast("binary"))


def escape_xml(c: Column) -> Column:
    """N14."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def escape_latex(c: Column) -> Column:
    """Characters that LaTeX reads as commands."""
    c = F.replace(c, F.lit("\\"), F.lit("\u0000"))
    for raw in "&%$#_{}":
        c = F.replace(c, F.lit(raw), F.lit(f"\\{raw}"))
    for raw, safe in (("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"), ("\u0000", "\\textbackslash{}")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def municipality(title: Column) -> Column:
    """The capitalised name after "municipio de"; null where there is none."""
    return F.nullif(F.regexp_extract(title, r"(?U)(?:[Mm]unicipio\s+de)\s+(\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+)*)", 1), F.lit(""))


#: Beginnings of path parts that name no place.
NO_PLACE = "^(ley|decreto|acuerdo|ingreso|presupuesto|doc|archivo|download)"


def municipality_of(title: Column, url: Column, default: Column) -> Column:
    """By the title, else by the last part of the url's path that may be a name, else the default."""
    path = F.lower(F.url_decode(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "pdf"))
    names = F.transform(F.reverse(parts), lambda p: F.translate(p, "_-", "  "))
    able = F.filter(names, lambda n: (F.length(n) > 3) & ~n.rlike(NO_PLACE) & ~F.exists(F.filter(F.split(n, r"\s+"), lambda w: w != ""), lambda w: F.length(w) <= 1))
    return F.coalesce(municipality(title), F.initcap(F.get(able, F.lit(0))), default)


def fiscal_year(title: Column) -> Column:
    """P32."""
    return F.regexp_extract(title, r"\b(20\d{2})\b", 1).try_cast("int")
