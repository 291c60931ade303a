"""Packing of tokenized documents into sequences of balanced attention cost."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.common import documents, text_or_empty
from ledgertide.llm.tokens import crc32, encoder, vocabulary_path

SEQUENCE = 2048
#: Tokens that one task holds and packs together: 16 MB of ids.
BLOCK_TOKENS = 1 << 22
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n^2.
LINEAR, QUADRATIC = 1.0, 1 / 1024
#: Room for a task's sequences in their numbers.
TASK_BITS = 40

SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def capacities(total: int, sequence: int = SEQUENCE) -> list[int]:
    """Full sequences, and for what is left sequences of powers of two, which need no padding."""
    full, rest = divmod(total, sequence)
    return [sequence] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(lengths: list[int], sequence: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece.

    Pieces go, longest first, to the sequence of lowest cost that has room; what exceeds its room is cut off and goes
    back among the pieces. Ties go to the earlier document and sequence.
    """
    room = capacities(sum(lengths), sequence)
    filled = [0] * len(room)
    open_sequences = [(0.0, k) for k in range(len(room))]
    pieces = [(-min(sequence, n - at), d, at) for d, n in enumerate(lengths) for at in range(0, n, sequence)]
    heapq.heapify(pieces)
    placed = []
    while pieces:
        size, d, at = heapq.heappop(pieces)
        cost, k = heapq.heappop(open_sequences)
        take = min(-size, room[k])
        placed.append((d, at, take, k, filled[k]))
        room[k] -= take
        filled[k] += take
        if room[k]:
            heapq.heappush(open_sequences, (cost + linear * take + quadratic * take * take, k))
        if take < -size:
            heapq.heappush(pieces, (size + take, d, at + take))
    return placed


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length), one row for each piece.

    Each task tokenizes its own rows and packs them in blocks of BLOCK_TOKENS, so nothing is shuffled, no task holds
    more than a block and its longest text. A task that is run again over files gives the same rows; after a shuffle their
    order, and so the sequences, may differ, but each id still lies in one piece. Null and empty texts are their end id
    alone; null ids stay null. Repeated rows are packed each by itself; an empty table gives no pieces, and columns other
    than the two named have no effect.
    """
    path = vocabulary or vocabulary_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        number = TaskContext.get().partitionId() << TASK_BITS
        held: list[tuple[object, np.ndarray]] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number
            placed = assign([len(ids) for _, ids in held], sequence)
            used = capacities(size, sequence)
            columns = zip(*((held[d][0], at, n, crc32(held[d][1][at : at + n]), len(held[d][1]), number + k, offset, used[k]) for d, at, n, k, offset in placed), strict=True)
            number += len(used)
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, [id_type, *[pa.int64()] * 7], strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for k, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py(), end_id)
                held.append((k.as_py(), ids))
                size += len(ids)
                if size >= BLOCK_TOKENS:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return rows.mapInArrow(run, SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()))


def op2_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of SEQUENCE tokens, without padding."""
    return pack(documents(spark, sf_dir))
