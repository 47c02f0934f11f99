"""The analyser of legal Spanish: words with positions, a graph of synonyms, stop words, the light stemmer, folded forms beside originals.

A text becomes a list of (term, at, span): ``at`` counts words, stop words included, and a term stands for ``span`` words from there. A word or phrase of a
synonym line stands where it occurs with all others of its line as alternatives over the same words, each phrase as one term (its folded words joined
by ``_``); of the members that begin at a word the longest counts. Words of a phrase stay beside it, so they are found alone too.

A phrase query is a path through the graph of its own words: of each alternative over the same words, a path takes one; in a document, a term must begin
where the one before ends, plus the stop words that the query has between them.

Defined cases: null gives null, a text without words an empty list; repeated terms at one place count once; long texts are one list, bounded by the text itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN

#: Words by the standard word-break rules for alphabets: runs of letters, marks, digits and low lines; an apostrophe, point, colon or middle dot
#: between letters, and a point, comma, semicolon or apostrophe between digits, don't part them.
WORDS = r"[\p{L}\p{M}\p{N}_]+(?:(?:(?<=\p{L})['’.:·](?=\p{L})|(?<=\p{N})['’.,;](?=\p{N}))[\p{L}\p{M}\p{N}_]+)*"

#: Words and phrases of one meaning.
SYNONYMS = (
    ("ley", "legislación", "ordenamiento"),
    ("amparo", "protección", "tutela"),
    ("constitución", "carta magna", "ley fundamental"),
    ("código", "codificación"),
    ("reglamento", "regulación", "normativa"),
    ("decreto", "disposición"),
    ("artículo", "numeral", "precepto"),
    ("tribunal", "juzgado", "corte"),
    ("juicio", "proceso", "litigio", "procedimiento"),
    ("demanda", "acción", "pretensión"),
    ("sentencia", "resolución", "fallo"),
    ("recurso", "impugnación", "medio de defensa"),
    ("nom", "norma oficial mexicana"),
    ("dof", "diario oficial de la federación"),
    ("cpeum", "constitución política de los estados unidos mexicanos"),
    ("lisr", "ley del impuesto sobre la renta"),
    ("liva", "ley del impuesto al valor agregado"),
    ("cff", "código fiscal de la federación"),
    ("lftr", "ley federal de telecomunicaciones y radiodifusión"),
    ("obligación", "deber"),
    ("derecho", "facultad", "potestad"),
    ("sanción", "multa", "penalidad"),
    ("contrato", "convenio", "acuerdo"),
    ("propiedad", "dominio", "posesión"),
)

#: Function words of the published Spanish stop list; its verb forms are made by ``_forms``.
FUNCTION_WORDS = (
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre "
    "también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo "
    "otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus ellas "
    "nosotras vosotros vosotras os mío mía míos mías tuyo tuya tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros nuestras vuestro vuestra "
    "vuestros vuestras esos esas"
).split()


def _forms() -> set[str]:
    """The forms of estar, haber, ser and tener that the stop list has: present, present and past subjunctives, future, conditional, imperfect, preterite, participles."""
    each = lambda stem, ends: [stem + e for e in ends.split()]
    out = "estoy estás está estamos estáis están he has ha hemos habéis han soy eres es somos sois son tengo tienes tiene tenemos tenéis tienen".split()
    out += "esté estés estemos estéis estén sea seas seamos seáis sean estad tened era eras éramos erais eran".split()
    for stem in ("hay", "teng"):
        out += each(stem, "a as amos áis an")
    for stem in ("estar", "habr", "ser", "tendr"):
        out += each(stem, "é ás á emos éis án ía ías íamos íais ían")
    for stem in ("hab", "ten"):
        out += each(stem, "ía ías íamos íais ían")
    out += each("estab", "a as ais an") + ["estábamos"] + each("fu", "i iste e imos isteis eron")
    for stem in ("estuv", "hub", "tuv"):
        out += each(stem, "e iste o imos isteis ieron iera ieras iéramos ierais ieran iese ieses iésemos ieseis iesen")
    out += each("fu", "era eras éramos erais eran ese eses ésemos eseis esen")
    for stem in ("est", "hab", "s", "ten"):
        out += [stem + ("ando" if stem == "est" else "iendo")]
    for stem in ("estad", "habid", "tenid"):
        out += each(stem, "o a os as")
    return {*out, "sido"}


STOPS = tuple(sorted({*FUNCTION_WORDS, *_forms()}))
#: Marks that the stemmer takes off.
_MARKED, _BARE = "àáâäòóôöèéêëùúûüìíîï", "aaaaooooeeeeuuuuiiii"
_UNMARK, _FOLD = str.maketrans(_MARKED, _BARE), str.maketrans(ACCENTED, PLAIN)


def words(text: Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def stem(word: Column) -> Column:
    """The published light Spanish stemmer: of words of five letters or more marks go, ``ces`` becomes ``z``, ``eses`` loses its last two letters, and plural and
    final vowels o, a, e go."""
    bare = F.translate(word, _MARKED, _BARE)
    last, two, n = F.right(bare, F.lit(1)), F.right(bare, F.lit(2)), F.length(bare)
    cut = lambda k: F.left(bare, n - k)
    ended = (
        F.when(last.isin("o", "a", "e"), cut(1)).when(last != "s", bare).when(F.right(bare, F.lit(4)) == "eses", cut(2))
        .when(F.right(bare, F.lit(3)) == "ces", F.concat(cut(3), F.lit("z"))).when(two.isin("os", "as", "es"), cut(2)).otherwise(bare)
    )
    return F.when(F.length(word) < 5, word).otherwise(ended)


def plain_stem(word: str) -> str:
    """``stem`` of one word, for the table of synonyms."""
    if len(word) < 5:
        return word
    word = word.translate(_UNMARK)
    if word[-1] in "oae":
        return word[:-1]
    if word.endswith("ces"):
        return word[:-3] + "z"
    return word[:-2] if word[-2:] in ("os", "as", "es") else word


def _folded(word: str) -> str:
    return word.translate(_FOLD)


def _members(lines: Sequence[Sequence[str]]) -> dict[str, tuple[int, list[str]]]:
    """Word or phrase of a synonym line: (words, terms of the line's members but the words that it is itself)."""
    out: dict[str, tuple[int, list[str]]] = {}
    for line in lines:
        for member in line:
            terms = []
            for other in line:
                if " " in other:
                    terms.append(_folded(other).replace(" ", "_"))
                elif other != member:
                    terms += [_folded(plain_stem(other)), plain_stem(other)]
            n, known = out.get(member, (len(member.split()), []))
            out[member] = (n, [*dict.fromkeys(known + terms)])
    return out


def analysed(text: Column, lines: Sequence[Sequence[str]] = SYNONYMS, stops: Sequence[str] = STOPS) -> Column:
    """Array of (term, at, span). Spark finds the words; a batch's distinct ones are stemmed once each."""
    members, left_out, kind = _members(lines), frozenset(stops), pa.list_(pa.struct([("term", pa.string()), ("at", pa.int32()), ("span", pa.int32())]))
    heads: dict[str, list[int]] = {}  # first words of members: lengths, the longest first
    for m, (n, _) in members.items():
        heads[m.split()[0]] = sorted({n, *heads.get(m.split()[0], ())}, reverse=True)

    @F.arrow_udf("array<struct<term:string,at:int,span:int>>")
    def tokens(ws: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(ws), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        coded = ws.flatten().dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        stems = [plain_stem(w) for w in names]
        made = [[] if w in left_out else [(t, 1) for t in dict.fromkeys((_folded(e), e))] for w, e in zip(names, stems, strict=True)]
        at, last = np.arange(len(codes)) - np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        places = np.flatnonzero(np.array([w in heads for w in names], bool)[codes])
        kinds, which = codes.astype(np.int64), {}  # a word that begins a member counts as one of its own, with the tokens of both
        for p, end in zip(places.tolist(), last[places].tolist(), strict=True):
            for n in heads[names[codes[p]]]:
                member = names[codes[p]] if n == 1 else " ".join([names[c] for c in codes[p : p + n]])
                if p + n <= end and member in members:
                    if member not in which:
                        which[member] = len(made)
                        made.append(list(dict.fromkeys([*made[codes[p]], *((t, n) for t in members[member][1])])))
                    kinds[p] = which[member]
                    break
        pool = {t: k for k, t in enumerate(dict.fromkeys(t for x in made for t, _ in x))}
        flat, wide = np.array([pool[t] for x in made for t, _ in x], np.int64), np.array([n for x in made for _, n in x], np.int32)
        each = np.array([len(x) for x in made], np.int64)
        count = each[kinds]
        upto = np.cumsum(count)
        pick = np.repeat((np.cumsum(each) - each)[kinds] - (upto - count), count) + np.arange(int(count.sum()))
        structs = pa.StructArray.from_arrays([pa.array(list(pool), pa.string()).take(pa.array(flat[pick])), pa.array(np.repeat(at, count).astype(np.int32)), pa.array(wide[pick])], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.append(0, upto)[ends]).astype(np.int32)), structs)

    return F.when(text.isNotNull(), tokens(words(text)))


def terms(text: Column) -> Column:
    """The terms alone, for an analyser that needs no positions."""
    return F.transform(analysed(text), lambda t: t.term)


def paths(tokens: Sequence[tuple[str, int, int]]) -> list[list[tuple[list[str], int]]]:
    """Ways through the graph of a phrase: each a list of (terms, any of which may stand there; words between it and the one before). Tokens
    are (term, at, span); the ways number the product of the synonyms of a phrase, which is short."""
    places = sorted({(at, span) for _, at, span in tokens})
    alike = {p: [t for t, at, span in tokens if (at, span) == p] for p in places}

    def walk(end: int | None) -> list[list[tuple[list[str], int]]]:
        ahead = [p for p in places if end is None or p[0] >= end]
        if not ahead:
            return [[]]
        first = min(p[0] for p in ahead)
        return [[(alike[p], 0 if end is None else p[0] - end), *rest] for p in ahead if p[0] == first for rest in walk(p[0] + p[1])]

    return walk(None)


def plain_analysed(text: str, lines: Sequence[Sequence[str]] = SYNONYMS, stops: Sequence[str] = STOPS) -> list[tuple[str, int, int]]:
    """``analysed`` of a query on the driver: a few words, the same result."""
    import regex

    ws, members = regex.findall(WORDS, text.lower()), _members(lines)
    longest = max((n for n, _ in members.values()), default=0)
    out = []
    for i, w in enumerate(ws):
        ends = plain_stem(w)
        found = [] if w in stops else [(_folded(ends), i, 1), (ends, i, 1)]
        for n in range(min(longest, len(ws) - i), 0, -1):
            if (m := members.get(" ".join(ws[i : i + n]))) is not None:
                found += [(t, i, m[0]) for t in m[1]]
                break
        out += dict.fromkeys(found)
    return out


def phrase_docs(postings: DataFrame, tokens: Sequence[tuple[str, int, int]]) -> DataFrame:
    """distinct ``doc`` that hold a phrase. ``postings`` are rows (doc, term, places: array of (at, span)), of which only those of the phrase's
    terms are read. A way through the phrase is a chain of equi-joins on (doc, place where the next term begins)."""
    ways = paths(tokens)
    if not tokens:
        return postings.select("doc").limit(0)
    rows = postings.where(F.col("term").isin(sorted({t for t, _, _ in tokens}))).select("doc", "term", F.inline("places"))
    found = None
    for way in ways:
        chain = None
        for alike, gap in way:
            here = rows.where(F.col("term").isin(alike)).select("doc", F.col("at").alias("begin"), (F.col("at") + F.col("span")).alias("end")).distinct()
            chain = here.select("doc", "end") if chain is None else chain.withColumn("begin", F.col("end") + gap).drop("end").join(here, ["doc", "begin"]).select("doc", "end")
        found = chain if found is None else found.unionByName(chain)
    return found.select("doc").distinct()
