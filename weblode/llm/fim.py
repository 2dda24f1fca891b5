"""Fill-in-the-middle documents through a piece table.

A document's text is never rewritten.  It is a list of descriptors (buffer, start, length) over two immutable
buffers: the text's own bytes, as Arrow holds them, and the sentinels.  Two cuts split the one descriptor of a whole
text into prefix, middle and suffix; an arrangement permutes those and puts a sentinel's descriptor before each;
hashing walks the descriptors without building the arranged text.  Going back, the sentinels' places cut the arranged
text into descriptors again and the inverse permutation puts them in order.

Cuts and form depend on a hash of seed and id only, so they are the same in every run and for every partitioning.
Each row is worked on where it lies: no shuffle.

Defined cases.  A null text is empty; an empty text, or one that holds a sentinel, stays plain.  A null id hashes like
an empty one.  Repeated rows give repeated results.  An empty table gives an empty result.  Of the columns given, one
named like ``into`` is replaced; all others stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


PREFIX, MIDDLE, SUFFIX = 0, 1, 2
#: The order of the three parts in each form.
ARRANGEMENTS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: One sentinel per part, by part number.
SENTINELS = ("<P>", "<M>", "<S>")
TEXT, MARKS = 0, 1

ARRANGED = (
    "struct<n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, output string>"
)
RESTORED = "struct<text string, sha256 string>"


def _marks(sentinels: Sequence[str]) -> tuple[bytes, list[tuple[int, int, int]]]:
    """The sentinel buffer, and each sentinel's descriptor in it."""
    data = [s.encode() for s in sentinels]
    starts = np.cumsum([0, *map(len, data)]).tolist()
    return b"".join(data), [(MARKS, start, len(d)) for start, d in zip(starts, data)]


def unit_ends(data: np.ndarray, unit: str) -> np.ndarray:
    """Where the units of UTF-8 bytes end: lines with their line feed, or single code points."""
    if unit == "line":
        ends = np.flatnonzero(data == 10) + 1
    else:
        ends = np.flatnonzero((data & 0xC0) != 0x80)[1:]
    return ends if not len(data) or (len(ends) and ends[-1] == len(data)) else np.append(ends, len(data))


def split(piece: tuple[int, int, int], *places: int) -> list[tuple[int, int, int]]:
    """A descriptor cut at ascending offsets from its start."""
    buffer, start, length = piece
    bounds = [0, *places, length]
    return [(buffer, start + a, b - a) for a, b in zip(bounds, bounds[1:])]


def permute(parts: Sequence, order: Sequence[int]) -> list:
    return [parts[k] for k in order]


def inverse(order: Sequence[int]) -> list[int]:
    back = [0] * len(order)
    for place, part in enumerate(order):
        back[part] = place
    return back


def streamed(pieces: Iterable[tuple[int, int, int]], buffers: Sequence[memoryview]) -> str:
    """SHA-256 of what the descriptors stand for, read piece by piece."""
    digest = hashlib.sha256()
    for buffer, start, length in pieces:
        digest.update(buffers[buffer][start : start + length])
    return digest.hexdigest()


def written(pieces: Iterable[tuple[int, int, int]], buffers: Sequence[memoryview]) -> bytes:
    return b"".join(buffers[buffer][start : start + length] for buffer, start, length in pieces)


def _points(data: np.ndarray) -> int:
    """Code points in UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _views(texts: pa.Array) -> Iterable[memoryview]:
    """Each text's bytes within Arrow's own buffer."""
    for text in texts:
        yield memoryview(text.as_buffer() if text.is_valid else b"")


def arranged(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 7,
    rate: int = 100,
    spm: int = 50,
    unit: str = "line",
    sentinels: Sequence[str] = SENTINELS,
    into: str = "fim",
) -> DataFrame:
    """``docs`` with a struct ``into``: ``n, form, prefix_chars, middle_chars, output_sha256, output``.

    ``rate`` of a hundred documents are rearranged, ``spm`` of a hundred of those with the suffix first.  ``n`` counts
    the units of the text; the cuts fall after units chosen by hash.
    """
    if unit not in ("line", "character"):
        raise ValueError("unit must be line or character")
    # So no sentinel can arise across the border of a text piece and a sentinel: each is found exactly where it was put.
    if any(not s or t.find(s[0], 1) >= 0 for s in sentinels for t in sentinels) or len(set(sentinels)) < 3:
        raise ValueError("sentinels must differ, and their first characters stand nowhere else in them")
    marks, marked = _marks(sentinels)
    names = [s.encode() for s in sentinels]

    @F.arrow_udf(ARRANGED)
    def rearrange(draws: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for draw, view in zip(draws.to_pylist(), _views(texts)):
            h1, h2, h3, h4 = (int(draw[k : k + 8], 16) for k in range(0, 32, 8))
            data = np.frombuffer(view, np.uint8)
            ends = unit_ends(data, unit)
            n = len(ends)
            whole, buffers = (TEXT, 0, len(data)), (view, memoryview(marks))
            raw = bytes(view)
            if not n or h3 % 100 >= rate or any(s in raw for s in names):
                out.append((n, "plain", None, None, streamed([whole], buffers), raw))
                continue
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            parts = split(whole, *(int(ends[k - 1]) if k else 0 for k in (low, high)))
            form = "spm" if h4 % 100 < spm else "psm"
            pieces = [p for k in ARRANGEMENTS[form] for p in (marked[k], parts[k])]
            sizes = [_points(data[start : start + length]) for _, start, length in parts[:2]]
            out.append((n, form, *sizes, streamed(pieces, buffers), written(pieces, buffers)))
        columns = list(zip(*out)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        arrays[5] = arrays[5].cast(pa.string())
        return pa.StructArray.from_arrays(arrays, ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "output"])

    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    return docs.withColumn(into, rearrange(F.sha2(named, 256), F.col(f"`{text}`")))


def restored(frame: DataFrame, output: str, form: str, sentinels: Sequence[str] = SENTINELS, into: str = "restored") -> DataFrame:
    """``frame`` with a struct ``into``: the ``text`` before arranging, and its ``sha256``; from ``output`` and ``form`` alone.

    A null output is empty.  An output whose form promises sentinels that it doesn't hold is an error.
    """
    names = [s.encode() for s in sentinels]

    @F.arrow_udf(RESTORED)
    def restore(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        texts, digests = [], []
        for view, kind in zip(_views(outputs), forms.to_pylist()):
            pieces = [(TEXT, 0, len(view))]
            if kind in ARRANGEMENTS:
                order, raw, at = ARRANGEMENTS[kind], bytes(view), 0
                bounds = []
                for k in order:
                    at = raw.index(names[k], at)
                    bounds += [at, at + len(names[k])]
                    at = bounds[-1]
                # Cut at both ends of every sentinel; what follows a sentinel is its part.
                pieces = permute(split(pieces[0], *bounds)[2::2], inverse(order))
            texts.append(written(pieces, [view]))
            digests.append(streamed(pieces, [view]))
        return pa.StructArray.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())], ["text", "sha256"])

    return frame.withColumn(into, restore(F.col(output), F.col(form)))


def fim_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: ``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``."""
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    both = restored(arranged(narrow, **options), "fim.output", "fim.form")
    return both.select(
        "doc_id",
        "fim.n",
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        "fim.output_sha256",
        F.col("restored.sha256").alias("restored_sha256"),
    )
