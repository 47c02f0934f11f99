"""Whole texts to token ids by a tokenizers file, a column at a time.

A tokenizer whose pre-tokenizer parts text at white space gives a text the ids of its pieces, one after another. So a
batch is cut into pieces (a word with the space that belongs to it; ASCII punctuation behind an ASCII letter begins a
piece, and a letter behind punctuation, apostrophes apart), each distinct piece is encoded once by the library, and a
worker keeps what it has encoded, up to a bound, for later batches. A piece that is one run of letters, which normalizer
and pre-tokenizer leave as it is, goes to the library's model alone. Texts for which the cut isn't proven
the same (odd white space, the strings of added tokens) are encoded whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: 1: ASCII white space, 2: letters, 3: punctuation but the apostrophe; and what the library's patterns also take as white space, or Python does.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = 1
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 2
KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = 3
ODD = "[\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"

#: Byte-level vocabularies write a byte as a printable character: itself where it has one, else the next from 256.
_printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_others = [b for b in range(256) if b not in _printable]
BYTE_CHARS = {b: chr(b) for b in _printable} | {b: chr(256 + i) for i, b in enumerate(_others)}

_workers: dict[tuple, Encoder] = {}


def encoder(path: str, joined: bool, special_as_text: bool = False) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    key = (path, joined, special_as_text)
    if key not in _workers:
        _workers[key] = Encoder(*key)
    return _workers[key]


def expand(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes of the concatenated runs [start, start + len)."""
    total = int(lens.sum())
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(total)


def pieces_of(batch: pa.RecordBatch, column: str, size: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of a text column, so that what is made of a slice stays small."""
    text = batch.column(column)
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    at = 0
    while at < len(batch):
        take = max(1, int(np.searchsorted(ends, int(ends[at]) + size)) - at)
        yield batch.slice(at, take)
        at += take


class Encoder:
    """joined: the tokenizer puts a single space with the word after it (byte-level BPE); else it composes (NFC) and
    lower-cases text and drops white space."""

    def __init__(self, path: str, joined: bool, special_as_text: bool = False, limit: int = 32 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model  # without normalizer and pre-tokenizer
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([ODD, *map(re.escape, added)])
        self.joined, self.limit = joined, limit
        self.cache: dict[str, bytes] = {}
        self.held = 0  # bytes of the cache, about

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of pieces; texts begin a piece."""
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        if not len(data):
            return np.zeros(0, np.int64)
        kind = KIND[data]
        space, letter, mark = kind == 1, kind == 2, kind == 3
        before = np.concatenate(([False], space[:-1]))
        cut = ~space & before
        if self.joined:
            after = np.concatenate((space[1:], [False]))
            last = space & ~after & ~first[1:]  # last of a run with a word behind it
            begins = space & ~(before & ~first[:-1])
            plain = data == 0x20
            cut = begins | last | (cut & np.concatenate(([False], ~plain[:-1])))
        cut[1:] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        cut |= first[:-1]
        return np.flatnonzero(cut)

    def _plain(self, piece: str, spans: bool) -> str | None:
        """The piece as the model sees it, if it is a run of letters that is left as it is; else None."""
        if self.joined:
            word = piece[1:] if piece[:1] == " " else piece
        else:
            piece = word = piece.rstrip(" \t\n\v\f\r")
        if not word.isalpha():
            return None
        if word.isascii():
            return BYTE_CHARS[0x20] + word if len(word) < len(piece) else piece
        if spans or not (self.joined or (unicodedata.is_normalized("NFC", word) and word.lower() == word)):
            return None
        return piece.encode().decode("latin-1").translate(BYTE_CHARS)

    def _encode(self, pieces: list[str], spans: bool) -> list[bytes]:
        out: list[bytes | None] = [None] * len(pieces)
        hard = []
        tokenize = self.model.tokenize
        for i, piece in enumerate(pieces):
            if (plain := self._plain(piece, spans)) is None:
                hard.append(i)
            else:
                got = tokenize(plain)
                if spans:
                    wide = plain[0] == BYTE_CHARS[0x20]  # the model counts bytes, and that character has two
                    got = [x for t in got for x in (t.id, max(t.offsets[0] - wide, 0), t.offsets[1] - wide)]
                else:
                    got = [t.id for t in got]
                out[i] = array("i", got).tobytes()
        if hard:
            got = (self.tokenizer.encode_batch if spans else self.tokenizer.encode_batch_fast)([pieces[i] for i in hard], add_special_tokens=False)
            for i, e in zip(hard, got, strict=True):
                out[i] = (np.array([(t, *o) for t, o in zip(e.ids, e.offsets, strict=True)], np.int32) if spans else np.array(e.ids, np.int32)).tobytes()
        return out

    def encode(self, texts: pa.Array, spans: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens per text, ids or rows of id, first and last character + 1 in the text, characters per text)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.odd)
        if not self.joined:
            texts = pc.if_else(odd, texts, pc.ascii_lower(texts))
        elif texts.offset:
            texts = texts.take(pa.array(np.arange(len(texts))))
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1]
        buffer = texts.buffers()[2] or pa.py_buffer(b"")
        data = np.frombuffer(buffer, np.uint8)[: offsets[-1]]
        cuts = self._cuts(data, offsets)
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):  # one piece for the whole text
            cuts = cuts[(cuts <= offsets[i]) | (cuts >= offsets[i + 1])]
        pieces = pa.Array.from_buffers(pa.string(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int32)), buffer])
        coded = pieces.dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        get = self.cache.get
        known = [get(x) for x in names]
        new = [i for i, x in enumerate(known) if x is None]
        for k in range(0, len(new), 50_000):
            some = new[k : k + 50_000]
            for i, x in zip(some, self._encode([names[i] for i in some], spans), strict=True):
                known[i] = x
                if self.held < self.limit and len(x) < 400:
                    self.cache[names[i]] = x
                    self.held += len(names[i]) + len(x) + 160
        width = 3 if spans else 1
        lens = np.fromiter(map(len, known), np.int64, len(known)) // (4 * width)
        flat = np.frombuffer(b"".join(known), np.int32).reshape(-1, width)
        n = lens[codes]
        out = flat[expand((np.cumsum(lens) - lens)[codes], n)]
        done = np.concatenate(([0], np.cumsum(n)))
        at = np.searchsorted(cuts, offsets)
        per_text = np.diff(done[at])
        if not spans:
            return per_text, out[:, 0], None
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        out[:, 1:] += np.repeat(chars[cuts] - np.repeat(chars[offsets[:-1]], np.diff(at)), n)[:, None].astype(np.int32)
        return per_text, out, np.diff(chars[offsets])
