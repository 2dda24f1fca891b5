"""Pack tokenised documents into sequences of a fixed length by bounded-space best fit.

Documents become token ids plus an end-of-text id; only those longer than a sequence are cut, the first piece
taking the remainder so that all others are full.  Pieces are packed per task: a fixed number of bins is open, a
bitset has one bit per amount of free space for which some open bin exists, a piece goes to the bin with the
least space that still holds it, and when too many bins are open the fullest closes.  Each task sees its pieces
from long to short, so short pieces fill what long ones leave.

Defined cases.  A null or empty text is one piece holding only the end id.  Rows that repeat a document are packed
once each.  An empty table gives an empty result.  Working memory per task is one Arrow batch of texts, and the
open bins.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblode.llm.common import tasks_for
from weblode.session import materialize

LENGTH = 2048
OPEN_BINS = 16_384
PIECES_PER_TASK = 20_000
#: Sequence numbers of one task; more than the pieces any task can hold.
SPAN = 1 << 40

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _piece_bounds(total: int, length: int) -> list[tuple[int, int]]:
    first = total % length or length
    return [(0, first)] + [(s, s + length) for s in range(first, total, length)]


class BestFit:
    """Bounded-space best fit; ``place`` gives (sequence, offset) for a piece."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.limit = length, open_bins
        self.free = 0  # bit f is set while an open bin has f free places
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        number = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.open -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.length, self.made
            self.made += 1
        left = space - size
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
            if self.open > self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
        return number, self.length - space


class Encoder:
    """Ids of whole texts, followed by id 0.

    The ranks of the same vocabulary are used where they lie beside the tokenizer's file (a faster reader of the
    same byte pairs); a text that holds one of the vocabulary's special strings goes through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(path.removesuffix(".json") + ".tiktoken")

    @staticmethod
    def _ranked(path: str):
        if not os.path.exists(path):
            return None
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.ranked is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        return np.array(self.ranked.encode_ordinary(text) + [0], dtype="<u4")


def tokenized_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoder.ids(text or "")
                for i, (a, b) in enumerate(_piece_bounds(len(ids), length)):
                    rows.append((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(cut, PIECES)


def pack(
    docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, open_bins: int = OPEN_BINS
) -> DataFrame:
    """Every piece with its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = materialize(tokenized_pieces(docs, tokenizer or default_tokenizer(), length), "pack-pieces")
    tasks = tasks_for(pieces.count(), PIECES_PER_TASK)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        bins, base = BestFit(length, open_bins), TaskContext.get().partitionId() * SPAN
        for batch in batches:
            placed = [bins.place(n) for n in batch["length"].tolist()]
            batch["sequence_id"] = [base + p[0] for p in placed]
            batch["offset"] = [p[1] for p in placed]
            yield batch.astype({"doc_id": "Int64"})

    order = [F.desc("length"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    return (
        pieces.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32"))
        .sortWithinPartitions(*order)
        .mapInPandas(fit, PIECES + ", sequence_id bigint, offset bigint")
    )
