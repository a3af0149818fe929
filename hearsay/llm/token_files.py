"""Operator 7: token ids in files of patched frame-of-reference blocks.

A file image holds whole documents in ascending id order: a header, a table of
documents (id and where its ids end), an index of where each block starts, and
the blocks. A block of ``BLOCK`` ids subtracts its minimum, packs the differences
at the width of the percentile that makes the block smallest, and lists the ids
beyond that width as exceptions (place, value). Images are the rows of a Parquet
table below the given folder, so they go through Spark's committer and can lie in
any store; one image is the whole content of one ``.tok`` file.

Documents are dealt by range of id, so each task writes ascending images and no
task gathers more than its range. Where an image starts among all ids is the sum
of the partitions before it: a sum per partition, then a running sum over one
row per partition.

Cases: NULL text is empty; an empty document has the end id alone. Rows that
repeat an id follow each other (order: text). NULL ids come first. An empty table
gives no image. Further columns are not read. A document longer than an image
makes a longer image; documents are never cut. With ``added_tokens`` the ids are those
of the tokenizers library on the whole text at its defaults: the vocabulary's added
tokens, such as ``<|endoftext|>``, are matched in the text first and only what lies
between them is cut into pieces. Without, texts are all plain text.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearsay.llm.common import slices
from hearsay.llm.pieces import PieceCoder

MAGIC = b"TOKPFOR1"
BLOCK = 1024
LANES = 64
EXCEPTION_BITS = 16 + 32
IMAGE_IDS = 1 << 20
HEADER = struct.Struct("<8sIIQ")  # magic, documents, blocks, ids
BLOCK_HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("spare", "u1"), ("exceptions", "<u2")])


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values below 2**width as rows of 64-bit words: lane i of 64 lies at bit i * width."""
    m = len(values)
    lanes = values.reshape(m, BLOCK // LANES, LANES)
    words = np.zeros((m, BLOCK // LANES, width), dtype=np.uint64)
    for i in range(LANES if width else 0):
        word, shift = divmod(i * width, 64)
        words[:, :, word] |= lanes[:, :, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, :, word + 1] |= lanes[:, :, i] >> np.uint64(64 - shift)
    return words.reshape(m, -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    m = len(words)
    out = np.zeros((m, BLOCK // LANES, LANES), dtype=np.uint64)
    words = words.reshape(m, BLOCK // LANES, width)
    mask = np.uint64((1 << width) - 1)
    for i in range(LANES if width else 0):
        word, shift = divmod(i * width, 64)
        lane = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            lane = lane | (words[:, :, word + 1] << np.uint64(64 - shift))
        out[:, :, i] = lane & mask
    return out.reshape(m, BLOCK)


def write_image(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One file image of documents whose ids end at ``ends`` in ``ids``."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.zeros((blocks, BLOCK), dtype=np.uint64)
    full.reshape(-1)[:n] = ids
    if n % BLOCK:
        full[-1, n % BLOCK:] = full[-1, : n % BLOCK].min()
    least = full.min(axis=1)
    rest = full - least[:, None]
    # Bits that each value needs, then the cheapest width of each block.
    need = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    counts = np.bincount((np.arange(blocks)[:, None] * 33 + need).reshape(-1), minlength=blocks * 33).reshape(blocks, 33)
    beyond = BLOCK - counts.cumsum(axis=1)
    width = (np.arange(33) * BLOCK + beyond * EXCEPTION_BITS).argmin(axis=1)
    outliers = need > width[:, None]
    n_out = outliers.sum(axis=1)
    head = np.zeros(blocks, dtype=BLOCK_HEAD)
    head["least"], head["width"], head["exceptions"] = least, width, n_out
    at_block, places = np.nonzero(outliers)
    values = rest[at_block, places].astype("<u4")
    places = places.astype("<u2")
    out_ends = np.cumsum(n_out)
    parts: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        rows = np.nonzero(width == w)[0]
        packed = pack(rest[rows] & np.uint64((1 << w) - 1), w).astype("<u8")
        for row, words in zip(rows.tolist(), packed, strict=True):
            lo, hi = int(out_ends[row] - n_out[row]), int(out_ends[row])
            parts[row] = head[row].tobytes() + words.tobytes() + places[lo:hi].tobytes() + values[lo:hi].tobytes()
    starts = np.cumsum([0, *map(len, parts)])[:-1].astype("<u8")
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    names = np.array([d or 0 for d in doc_ids], dtype="<i8")
    return b"".join(
        [HEADER.pack(MAGIC, len(doc_ids), blocks, n), known.tobytes(), names.tobytes(),
         np.asarray(ends, dtype="<u8").tobytes(), starts.tobytes(), *parts]
    )


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, the ends of their ids, and all ids of one image."""
    magic, docs, blocks, n = HEADER.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size
    known = np.frombuffer(image, np.uint8, docs, at)
    names = np.frombuffer(image, "<i8", docs, at := at + docs)
    ends = np.frombuffer(image, "<u8", docs, at := at + 8 * docs).astype(np.int64)
    starts = np.frombuffer(image, "<u8", blocks, at := at + 8 * docs).astype(np.int64) + (at := at + 8 * blocks)
    raw = np.frombuffer(image, np.uint8)
    head = raw[starts[:, None] + np.arange(BLOCK_HEAD.itemsize)].view(BLOCK_HEAD).reshape(-1) if blocks else np.zeros(0, BLOCK_HEAD)
    out = np.zeros((blocks, BLOCK), dtype=np.uint64)
    for w in np.unique(head["width"]).tolist():
        rows = np.nonzero(head["width"] == w)[0]
        size = w * BLOCK // 8
        where = starts[rows] + BLOCK_HEAD.itemsize
        words = np.empty((len(rows), size), np.uint8)
        for k, begin in enumerate(where.tolist()):
            words[k] = raw[begin:begin + size]
        out[rows] = unpack(words.view("<u8"), w)
    for row in np.nonzero(head["exceptions"])[0].tolist():
        k = int(head["exceptions"][row])
        begin = int(starts[row]) + BLOCK_HEAD.itemsize + int(head["width"][row]) * BLOCK // 8
        out[row, np.frombuffer(image, "<u2", k, begin)] = np.frombuffer(image, "<u4", k, begin + 2 * k)
    out += head["least"].astype(np.uint64)[:, None]
    doc_ids = [int(d) if ok else None for d, ok in zip(names, known, strict=True)]
    return doc_ids, ends, out.reshape(-1)[:n].astype("<u4")


@lru_cache(maxsize=4)
def library_coder(path: str) -> PieceCoder:
    """Pieces encoded by the tokenizers library, each distinct piece once while it is cached."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode_many(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = [], []
        for at in range(0, len(some), 1000):
            part = [x.decode("utf-8", "surrogatepass") for x in some[at:at + 1000]]
            coded = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(coded.ids, dtype=np.uint32))
            counts.append(np.bincount(np.array(coded.word_ids, dtype=np.int64), minlength=len(part)))
        return np.concatenate(flat), np.concatenate(counts)

    return PieceCoder(encode_many)


class AddedTokens:
    """Encodes texts around the added tokens of a vocabulary as the library does: leftmost first, then longest."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            tokens = json.load(file)["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in tokens):
            raise ValueError("added tokens that match more or less than their own text are not supported")
        self.coder = library_coder(path)
        self.ids = {t["content"]: t["id"] for t in tokens}
        longest_first = sorted(self.ids, key=len, reverse=True)
        self.pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if tokens else None

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where the ids of each text end."""
        # Plain stretches and added tokens take turns; a text starts and ends with a stretch.
        parts = [self.pattern.split(t) if self.pattern and t else [t] for t in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        if counts.sum() == len(texts):
            return self.coder.encode(texts)
        ids, ends = self.coder.encode([x for p in parts for x in p[::2]])
        # Each added token has the place where the stretch before it ends.
        last = np.cumsum((counts + 1) // 2)
        follows = np.ones(len(ends), bool)
        follows[last - 1] = False
        added = np.array([self.ids[x] for p in parts for x in p[1::2]], ids.dtype)
        return np.insert(ids, ends[follows], added), ends[last - 1] + np.cumsum(counts // 2)


def write_token_files(
    docs: DataFrame, folder: str, path: str, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text", image_ids: int = IMAGE_IDS, added_tokens: bool = False,
) -> None:
    """Encode whole texts, end each with ``end_id`` and write images in ascending id order below ``folder``."""
    ranged = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    ranged = ranged.repartitionByRange("_id").sortWithinPartitions(F.col("_id").asc_nulls_first(), F.col("_text").asc_nulls_first())
    rows = ranged.select(F.spark_partition_id().alias("_part"), "_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = AddedTokens(path) if added_tokens else library_coder(path)
        stop = struct.pack("<I", end_id)
        names: list[int | None] = []
        texts: list[bytes] = []
        held = seq = part_no = 0

        def image() -> pa.RecordBatch:
            ends = np.cumsum([len(t) // 4 for t in texts])
            data = write_image(names, ends, np.frombuffer(b"".join(texts), "<u4"))
            cells = [[part_no], [seq], [len(names)], [int(ends[-1])], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)],
                                              ["part", "seq", "n_docs", "n_ids", "image"])

        for piece in slices(batches, 2):
            part_no = piece.column(0)[0].as_py()
            ids, ends = mine.encode(piece.column(2).to_pylist())
            begin = 0
            for name, end in zip(piece.column(1).to_pylist(), ends.tolist(), strict=True):
                names.append(name)
                texts.append(ids[begin:end].tobytes() + stop)
                held += end - begin + 1
                begin = end
                if held >= image_ids:
                    yield image()
                    names, texts, held, seq = [], [], 0, seq + 1
        if names:
            yield image()

    rows.mapInArrow(run, "part int, seq int, n_docs long, n_ids long, image binary").write.parquet(folder)


def image_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (part, seq, first): how many ids all images before this one hold. Reads no image."""
    sizes = spark.read.parquet(folder).select("part", "seq", "n_ids")
    per_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(parts, "part").select(
        "part", "seq", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("first")
    )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, ids) read back from the images; ``ids`` as little-endian unsigned 32-bit integers."""
    rows = spark.read.parquet(folder).join(image_starts(spark, folder), ["part", "seq"]).select("first", "image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names, ends, ids = read_image(batch.column(1)[row].as_py())
                starts = np.concatenate(([0], ends[:-1]))
                first = batch.column(0)[row].as_py()
                for at in range(0, len(names), 2048):
                    some = range(at, min(at + 2048, len(names)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[i] for i in some], pa.int64()), pa.array([first + int(starts[i]) for i in some], pa.int64()),
                         pa.array([ids[starts[i]:ends[i]].tobytes() for i in some], pa.binary())],
                        ["doc_id", "start", "ids"],
                    )

    return rows.mapInArrow(run, "doc_id long, start long, ids binary")


def export_images(folder_rows: DataFrame, to: str) -> None:
    """Copy images out as plain files ``part-seq.tok`` of a folder that the driver can write, one at a time."""
    os.makedirs(to, exist_ok=True)
    for row in folder_rows.select("part", "seq", "image").toLocalIterator():
        with open(os.path.join(to, f"{row['part']:06d}-{row['seq']:06d}.tok"), "wb") as out:
            out.write(row["image"])

