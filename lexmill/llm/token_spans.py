"""Token counts by offset-mapped attribution.

A whole document is encoded once, its fields joined as one text; the tokens' character spans are then matched to the
sorted spans of its sections (fields, and within the text field its lines) by an interval join of two sorted lists, in
the task that holds the document. A token that crosses a section boundary goes to one section by an explicit rule:

* ``most`` (the default): the section with most of its characters, the earlier one on a tie;
* ``first``: the section of its first character;
* ``last``: the section of its last character.

So the counts of a document's sections add up to the tokens of the document. Defined cases: a null field is empty and
still a section; an empty line is a section of its line feed; a document without any character has sections with 0
tokens; repeated rows are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._encode import encoder, pieces_of

SCHEMA = "doc_id bigint, section int, field string, char_start int, char_end int, n_tokens int, n_crossing int"
RULES = ("most", "first", "last")


def choose(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary); bounds: sorted starts of sections, the first at or before
    all tokens, and the end of the last section as sentinel."""
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.maximum(np.searchsorted(bounds, np.maximum(ends - 1, starts), "right") - 1, first)
    crossing = last > first
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    out = first.copy()
    for i in np.flatnonzero(crossing):
        k = np.arange(first[i], last[i] + 1)
        share = np.minimum(bounds[k + 1], ends[i]) - np.maximum(bounds[k], starts[i])
        out[i] = k[np.argmax(share)]
    return out, crossing


def section_counts(docs: DataFrame, tokenizer: str, fields: Sequence[str] = ("lang", "source", "text"), rule: str = "most") -> DataFrame:
    """A row per document and section: its field, characters [char_start, char_end) in the joined text, and tokens.

    Fields are joined with a space, and with a line feed before the last; a separator belongs to the field before it."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    ends = ["\n" if i == len(fields) - 2 else " " for i in range(len(fields) - 1)]
    whole = F.concat(*[x for v, e in zip(values, [*ends, ""], strict=True) for x in (v, F.lit(e))])
    heads = F.array(*[F.length(v) + 1 for v in values[:-1]]) if len(fields) > 1 else F.array().cast("array<int>")
    names = np.array(fields, object)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer, True)
        for batch in (x for b in batches for x in pieces_of(b, "whole")):
            n, spans, chars = made.encode(batch.column("whole"), spans=True)
            base = np.concatenate(([0], np.cumsum(chars + 1)))  # a free character between texts
            feeds, owners = _line_starts(batch.column("whole"), base)
            head = np.vstack(batch.column("heads").to_pylist()).astype(np.int64).reshape(len(n), -1).cumsum(axis=1) if len(fields) > 1 else np.zeros((len(n), 0), np.int64)
            body = base[:-1] + (head[:, -1] if head.shape[1] else 0)
            keep = feeds > body[owners]
            bounds = np.concatenate((base[:-1], (base[:-1, None] + head).ravel(), feeds[keep]))
            doc = np.concatenate((np.arange(len(n)), np.repeat(np.arange(len(n)), head.shape[1]), owners[keep]))
            field = np.concatenate((np.zeros(len(n), int), np.tile(np.arange(1, head.shape[1] + 1), len(n)), np.full(keep.sum(), len(fields) - 1)))
            order = np.lexsort((np.arange(len(bounds)), field, bounds, doc))
            bounds, doc, field = bounds[order], doc[order], field[order]
            whose = np.repeat(np.arange(len(n)), n)
            section, crossing = choose(spans[:, 1] + base[whose], spans[:, 2] + base[whose], np.append(bounds, base[-1]), rule)
            ends = np.append(bounds[1:], base[-1])
            ends = np.where(np.append(doc[1:] != doc[:-1], True), base[doc + 1] - 1, ends) if len(doc) else ends
            first = np.searchsorted(doc, np.arange(len(n)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)), pa.array((np.arange(len(doc)) - first[doc]).astype(np.int32)), pa.array(names[field], pa.string()),
                    pa.array((bounds - base[doc]).astype(np.int32)), pa.array((ends - base[doc]).astype(np.int32)),
                    pa.array(np.bincount(section, minlength=len(doc)).astype(np.int32)), pa.array(np.bincount(section[crossing], minlength=len(doc)).astype(np.int32)),
                ],
                ["doc_id", "section", "field", "char_start", "char_end", "n_tokens", "n_crossing"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole.alias("whole"), heads.alias("heads")).mapInArrow(count, SCHEMA)


def _line_starts(texts: pa.Array, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters after a line feed, in the batch's running count, and the text of each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    at = np.flatnonzero(data[offsets[0] :] == 0x0A) + offsets[0]
    owner = np.searchsorted(offsets, at, "right") - 1
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    start = base[owner] + chars[at + 1] - chars[offsets[owner]]
    inside = at + 1 < offsets[owner + 1]
    return start[inside], owner[inside]
