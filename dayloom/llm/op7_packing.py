"""Best-fit packing by the sum of squares (operator 7)."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import chunks, read, release, texts
from dayloom.session import materialise

MODEL, SPECIAL, END, SIZE = "byte_bpe_50k.tiktoken", "<|endoftext|>", 0, 2048
BLOCK = 40_000  # pieces packed together in a task

_ENCODERS: dict[str, Encoder] = {}  # in a worker, for the batches of a task


class Encoder:
    """Ids of texts as the tokenizers file gives them; a special string in a text is its special id.

    The same vocabulary as ranks, in the faster of the installed libraries; a
    test holds both against each other.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})

    def __call__(self, strings: list[str]) -> list[np.ndarray]:
        return [self.bpe.encode_to_numpy(s, allowed_special="all") for s in strings]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, model_path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every document and its end id.

    A document longer than ``size`` is cut into pieces of ``size``, the first
    of which may be shorter. Null and empty texts give the end id alone.
    """

    def run(batches):
        encode, tail = encoder(model_path), np.array([end], "<u4").tobytes()
        for b in chunks(batches, 2 << 20):
            row, piece, start, length, ids = [], [], [], [], []
            for r, x in enumerate(encode(b.column(1).to_pylist())):
                x = x.astype("<u4").tobytes() + tail
                n = len(x) // 4
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    row.append(r)
                    piece.append(i)
                    start.append(a)
                    length.append(z - a)
                    ids.append(x[4 * a:4 * z])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"])
        del encode
        _ENCODERS.clear()  # the next stage's tasks run in the same workers
        release()

    d = texts(docs)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the gap of each bin, by the sum of squares.

    Each length, longest first, goes where the sum over all gaps of the squared
    number of open bins with that gap becomes smallest; of equal sums the
    smallest gap is taken. A bin is opened only for a length that fits nowhere.
    """
    bins, offsets, gaps = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    count, waiting = np.zeros(size + 1, np.int64), [[] for _ in range(size + 1)]
    none = np.int64(1) << 60
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        have, then = count[s:size], count[:size - s]
        cost = np.where(have > 0, 2 * (then - have) + 2, none)
        if s < size and count[s]:
            cost[0] = 1 - 2 * count[s]  # it fills the bin; full bins do not count
        at = int(np.argmin(cost)) if s < size else 0
        if s < size and cost[at] < none:
            g = at + s
            b = waiting[g].pop()
            count[g] -= 1
        else:
            g, b = size, len(gaps)
            gaps.append(size)
        bins[i], offsets[i], gaps[b] = b, size - g, g - s
        if g - s:
            count[g - s] += 1
            waiting[g - s].append(b)
    return bins, offsets, np.array(gaps, np.int64)


def _packer(size: int, turn: int, last: bool):
    """Packs one block; unless it is the last, one bin in sixteen, the emptiest, is given up again."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row", ignore_index=True)
        bins, offset, gaps = place(pdf["length"].to_numpy(), size)
        worst = np.zeros(len(gaps), bool)
        if not last:
            worst[np.argsort(-gaps, kind="stable")[:max(1, len(gaps) // 16)]] = True
        return pdf.drop(columns="_part").assign(sequence_id=(turn << 56) + (int(key[0]) << 24) + bins, offset=offset, again=worst[bins])

    return run


def pack(lengths: DataFrame, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """``lengths`` (column ``length``, 1 to ``size``) with ``sequence_id`` and the gapless ``offset`` in that sequence.

    Blocks of rows are packed side by side. What lies in the emptiest bins of
    each block, one in sixteen, is packed again in fewer blocks, until one is
    left; so open bins are wasted once, not once a block. A row of ``size``
    tokens is a sequence of its own. The other columns stay as they are.
    """
    spark, fields = lengths.sparkSession, lengths.columns
    rows = materialise(lengths.withColumn("_row", F.monotonically_increasing_id()), "lengths")
    done = [rows.where(F.col("length") == size).select(*fields, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    todo, n, turn = rows.where(F.col("length") < size), None, 0
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long, again boolean"
    while True:
        n = todo.count()
        if not n:
            break
        blocks = -(-n // block)

        out = materialise(todo.withColumn("_part", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(blocks)).cast("int"))
                          .groupBy("_part").applyInPandas(_packer(size, turn, blocks == 1), types), "packed")
        done.append(out.where("not again").select(*fields, "sequence_id", "offset"))
        if blocks == 1:
            break
        todo, turn = out.where("again").drop("sequence_id", "offset", "again"), turn + 1
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole


def pack_documents(docs: DataFrame, model_path: str, size: int = SIZE) -> DataFrame:
    """The pieces of all documents without their ids, but with the ids' CRC-32, and their places."""
    cut = pieces(docs, model_path, size).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut, size)


def query(spark, sf_dir):
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
