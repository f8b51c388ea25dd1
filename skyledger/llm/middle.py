"""Fill-in-the-middle transformation with a sparse index of multibyte characters.

Texts are cut as UTF-8 bytes. An index holds only the places and excess bytes of characters that take more than one
byte; a search in it converts between places in code points and in bytes, and spans of ASCII
between two such characters are plain arithmetic. A batch of texts shares one index.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents: those transformed, and of these the ones with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
PLAIN, PSM, SPM = "plain", "psm", "spm"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class SparseIndex:
    """Places of multibyte characters in some UTF-8 bytes: in bytes, in code points, and the excess bytes before each."""

    def __init__(self, raw: np.ndarray):
        self.bytes = np.flatnonzero(raw >= 0xC0)
        lead = raw[self.bytes]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.zeros(len(excess) + 1, np.int64)
        np.cumsum(excess, out=self.before[1:])
        self.points = self.bytes - self.before[:-1]

    def to_points(self, places: np.ndarray) -> np.ndarray:
        """Code points before some places in bytes, each the first byte of a character or the end."""
        return places - self.before[np.searchsorted(self.bytes, places)]

    def to_bytes(self, places: np.ndarray) -> np.ndarray:
        """Bytes before some places in code points."""
        return places + self.before[np.searchsorted(self.points, places)]


def _token_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where tokens begin, in bytes: runs of ASCII letters, and every other character alone."""
    letter = _LETTER[raw]
    begins = (raw & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[offsets[offsets < len(raw)]] = True
    return np.flatnonzero(begins)


def cuts(
    raw: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str = "tokens"
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: number of units, ends of prefix and middle in bytes from the text's start, and their code points.

    The prefix ends after the smaller of ``first % (n + 1)`` and ``second % (n + 1)`` units, the middle after the
    larger. Units are ``tokens`` (a run of ASCII letters or any other character) or ``points``.
    """
    index = SparseIndex(raw)
    if unit == "points":
        edges = index.to_points(offsets)
    else:
        starts = _token_starts(raw, offsets)
        edges = np.searchsorted(starts, offsets)
    n = np.diff(edges)
    a, b = first % (n + 1), second % (n + 1)
    low, high = edges[:-1] + np.minimum(a, b), edges[:-1] + np.maximum(a, b)
    if unit == "points":
        low, high = index.to_bytes(low), index.to_bytes(high)
    else:
        places = np.append(starts, len(raw))
        # A text that is cut at its end is cut where the next one begins.
        low, high = places[low], places[high]
    before = index.to_points(offsets[:-1])
    low_points, high_points = index.to_points(low), index.to_points(high)
    return n, low - offsets[:-1], high - offsets[:-1], low_points - before, high_points - low_points


def _draws(names: list[str], seed: str) -> np.ndarray:
    """Four unsigned 32-bit numbers per name: the first hexadecimal digits of SHA-256, eight each."""
    parts = [struct.unpack(">4I", hashlib.sha256((seed + x).encode()).digest()[:16]) for x in names]
    return np.array(parts, np.int64).reshape(-1, 4)


def fill_in_middle(
    docs: DataFrame, *, seed: str = "1:", unit: str = "tokens", transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """``docs`` (``doc_id, text``) with ``n, form, prefix_chars, middle_chars, output``.

    ``n`` counts the text's units. ``form`` is ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle, each after
    its mark) or ``spm`` (suffix first). A text that is empty or holds a mark is plain, as are those not
    drawn; null texts are empty. ``prefix_chars`` and ``middle_chars`` are null for plain ones. All draws hang on seed and doc_id
    alone, so equal doc_ids draw alike; a null doc_id draws as an empty name. Columns of ``docs`` that have
    one of the five names give way, others stay. No rows: no rows.
    """
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    schema = pa.struct([
        ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()),
    ])

    def transform(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, texts in columns:
            draws = _draws(names.to_pylist(), seed)
            raw, offsets = common.text_buffers(texts)
            parts = []
            for a, b in common.chunks(offsets):
                here, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                n, low, high, prefix, middle = cuts(here, at, draws[a:b, 0], draws[a:b, 1], unit)
                data, forms, outputs = here.tobytes(), [], []
                drawn, turned = draws[a:b, 2] % 100 < transformed, draws[a:b, 3] % 100 < suffix_first
                for k, (start, end) in enumerate(zip(at.tolist(), at[1:].tolist())):
                    text = data[start:end]
                    if not text or not drawn[k] or any(m in text for m in marks):
                        forms.append(PLAIN)
                        outputs.append(text)
                        continue
                    head, body, tail = text[: low[k]], text[low[k] : high[k]], text[high[k] :]
                    if turned[k]:
                        forms.append(SPM)
                        outputs.append(b"".join((marks[1], tail, marks[0], head, marks[2], body)))
                    else:
                        forms.append(PSM)
                        outputs.append(b"".join((marks[0], head, marks[1], tail, marks[2], body)))
                plain = np.array([f == PLAIN for f in forms], bool)
                parts.append(pa.StructArray.from_arrays(
                    [
                        pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64(), mask=plain),
                        pa.array(middle, pa.int64(), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    fields=list(schema),
                ))
            yield pa.concat_arrays(parts) if parts else pa.array([], schema)

    made = F.arrow_udf(transform, "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    found = common.spare(docs, "found")
    name = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit(""))
    picked = ("n", "form", "prefix_chars", "middle_chars", "output")
    return docs.withColumn(found, made(name, F.coalesce(F.col("text"), F.lit("")))).select(
        *common.others(docs, *picked), *[F.col(f"{found}.{c}").alias(c) for c in picked]
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of some form was made of, by its marks alone.

    Neither part of a transformed text holds a mark, so each mark is found at its first place. Null for a null output or form.
    """
    at = {m: F.instr(output, m) for m in (PREFIX, SUFFIX, MIDDLE)}
    width = len(PREFIX)

    def between(mark: str, following: str) -> Column:
        return F.substring(output, at[mark] + width, at[following] - at[mark] - width)

    body = F.substring(output, at[MIDDLE] + width, F.char_length(output))
    return (
        F.when(form == PSM, F.concat(between(PREFIX, SUFFIX), body, between(SUFFIX, MIDDLE)))
        .when(form == SPM, F.concat(between(PREFIX, MIDDLE), body, between(SUFFIX, PREFIX)))
        .when(form == PLAIN, output)
    )
