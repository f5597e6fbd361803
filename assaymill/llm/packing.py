"""Packing of tokenised documents into sequences of a fixed length.

First-fit decreasing over a tournament tree of bin capacities, run on its own in each of many
randomised groups of documents, so that no task ever holds more than one group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import pick, rows_of
from assaymill.llm.tokens import encoder, vocabulary

LENGTH = 2048
GROUP_DOCS = 512
END_ID = 1
VOCABULARY = "word_bpe_49k.json"

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


class Tournament:
    """Bins in the order they were opened; finds the first with room enough in log(n) steps.

    Leaf ``i`` holds the room of bin ``i``, an unopened bin is empty, and each inner node holds the
    larger of its two children, so the descent goes left whenever the left half has room.
    """

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts an item in the first bin that fits; returns the bin and the room it had."""
        room, node = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node = 2 * node if room[2 * node] >= size else 2 * node + 1
        had = room[node]
        bin_ = node - self.leaves
        room[node] = had - size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return bin_, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """For each size, its bin and its offset there. Ties go in the order given."""
    tree = Tournament(len(sizes), capacity)
    out = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        bin_, had = tree.place(sizes[i])
        out[i] = (bin_, capacity - had)
    return out


def encode_documents(docs: DataFrame, vocabulary_path: str, end_id: int) -> DataFrame:
    """doc_id, n_ids and ids (little-endian unsigned, 16-bit where all fit, else 32-bit) of each row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = encoder(vocabulary_path)
        end = make.pack([end_id])
        for batch in batches:
            ids = [make.coded(text) + end for (text,) in rows_of(batch, "text")]
            counts = np.fromiter(map(len, ids), "i8", len(ids)) // make.width
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(ids, pa.binary())], names=["doc_id", "n_ids", "ids"]
            )

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_ids long, ids binary")


def pack_group(
    docs: list[tuple[int | None, int, bytes]], length: int
) -> Iterator[tuple[int | None, int, int, bytes, int, int, int]]:
    """Pieces of one group; sequences are numbered from 0.

    A document of more than ``length`` ids is cut at multiples of it; what is left over is packed.
    """
    sequence = 0
    rests = []
    for doc_id, n, raw in docs:
        ids = raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
        whole = n // length * length
        for start in range(0, whole, length):
            yield doc_id, start, length, ids[4 * start : 4 * (start + length)], n, sequence, 0
            sequence += 1
        if n > whole:
            rests.append((doc_id, whole, n - whole, ids[4 * whole :], n))
    for (doc_id, start, size, ids, n), (bin_, offset) in zip(
        rests, first_fit_decreasing([r[2] for r in rests], length), strict=True
    ):
        yield doc_id, start, size, ids, n, sequence + bin_, offset


def pack_documents(
    docs: DataFrame,
    vocabulary_path: str | None = None,
    end_id: int = END_ID,
    length: int = LENGTH,
    group_docs: int = GROUP_DOCS,
) -> DataFrame:
    """Every id of every row of ``docs`` (doc_id, text), cut and packed into sequences.

    One row per piece: doc_id, start (ids of the document before the piece), length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens (ids of the document with its end id), sequence_id
    and offset in the sequence. Pieces fill a sequence from 0 without gaps.

    A null or empty text is the end id alone. Rows that repeat (the same doc_id, the same text) are
    packed once for each time they occur. A null doc_id stays null. An empty table gives no rows.
    Other columns are ignored. Equal sizes keep the order of doc_id. Rows are dealt to groups by a hash
    of their doc_id and their place in the input, so many rows of one doc_id make no large group; other
    files or splits of the same rows give other groups. A group is packed in runs of at most four times
    ``group_docs`` documents, and a run ends early once it holds 16 million ids, so memory is bounded
    by that and the longest document.
    """
    path = vocabulary_path or vocabulary(VOCABULARY)
    rows = pick(docs, doc_id="long", text="string")
    groups = max(1, math.ceil(rows.count() / group_docs))
    coded = encode_documents(rows, path, end_id).withColumn(
        "grp", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    )
    dealt = coded.repartition("grp").sortWithinPartitions("grp", "doc_id", "n_ids", "ids")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs() -> Iterator[tuple[int, int, list]]:
            group, run, held, part = None, [], 0, 0
            for batch in batches:
                for g, doc_id, n, ids in rows_of(batch, "grp", "doc_id", "n_ids", "ids"):
                    if run and (g != group or len(run) >= 4 * group_docs or held >= 1 << 24):
                        yield group, part, run
                        part = part + 1 if g == group else 0
                        run, held = [], 0
                    group = g
                    run.append((doc_id, n, ids))
                    held += n
            if run:
                yield group, part, run

        def batch_of(out: list) -> pa.RecordBatch:
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names
            )

        out, held, base, last = [], 0, 0, None
        for group, part, run in runs():
            if group != last:
                base, last = 0, group
            most = -1
            for piece in pack_group(run, length):
                most = max(most, piece[5])
                out.append((*piece[:5], (group << 32) + base + piece[5], piece[6]))
                held += len(piece[3])
                if held >= 1 << 23:
                    yield batch_of(out)
                    out, held = [], 0
            base += most + 1
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(pack, PIECES)


def op8_pack_sequences(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`pack_documents` over all of ``documents``."""
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
