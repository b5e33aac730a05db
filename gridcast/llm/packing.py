"""Packing documents into training sequences: best-fit decreasing over a segment tree of remaining capacities.

Each document becomes its token ids followed by one separator. Documents longer than a window are first cut
into full windows; what is left of each document (shorter than a window) is packed by best-fit decreasing:
pieces in falling length go to the open window with the tightest sufficient room. Open windows are stacked by
remaining capacity, and a segment tree whose leaf ``r`` says whether a window with ``r`` free places is open
finds the smallest sufficient ``r`` in log2(window) steps.

Tokenising runs in Arrow batches next to the scan, text never shuffles. Pieces (a few integers each) are dealt
into groups of about ``group_rows`` documents by a hash of the document, its input partition and its repeat there: neither equal ids nor
equal texts concentrate, and a task that is run again, in whatever order its rows come, deals the same pieces to the same groups. Each group is packed on its own. A group leaves one partly filled window or a few, under a
thousandth of its windows. Sequence ids interleave the groups and are unique.

Nulls: a null text is an empty document (one separator). A null id is carried through. Repeated rows are
packed like any others. Very long texts are tokenised whole and cut into full windows. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 1024
GROUP_ROWS = 20_000
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: The vocabulary's special string, which the tokenizer turns into one id.
SPECIAL = "<|endoftext|>"
#: Letters, punctuation and spaces on whose character classes both libraries' tables agree.
SETTLED = re.compile("[^\\x00-\u024f\u2010-\u2027\u20ac]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Token ids of whole texts, as ``tokenizers`` gives them.

    The vocabulary also comes as a rank file for ``tiktoken``, which yields the same ids several times faster; it is used where
    the text holds neither the special string nor characters outside ``SETTLED``.
    """

    def __init__(self, path: str | None = None, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        self.fast = None
        if path is None or ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks or tokenizer_path(RANKS), "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.fast is None or SPECIAL in text or not text.isascii() and SETTLED.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece of 1 to ``window`` tokens."""
    size = 1 << window.bit_length()
    tree = bytearray(2 * size)  # node: is a window open with a free capacity below it?
    stacks: list[list[int]] = [[] for _ in range(window + 1)]
    where, offset, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def at_least(need: int) -> int:
        node = size + need
        if tree[node]:
            return need
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < size:
                    node = 2 * node + (not tree[2 * node])
                return node - size
            node >>= 1
        return -1

    def put(free: int, number: int) -> None:
        stacks[free].append(number)
        node = size + free
        while node and not tree[node]:
            tree[node] = 1
            node >>= 1

    def pop(free: int) -> int:
        number = stacks[free].pop()
        if not stacks[free]:
            node = size + free
            tree[node] = 0
            node >>= 1
            while node and not (tree[2 * node] or tree[2 * node + 1]):
                tree[node] = 0
                node >>= 1
        return number

    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        free = at_least(need)
        if free < 0:
            number, free, opened = opened, window, opened + 1
        else:
            number = pop(free)
        where[i], offset[i] = number, window - free
        if free > need:
            put(free - need, number)
    return where, offset


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _group int"


def pieces(docs: DataFrame, groups: int, window: int = WINDOW, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: full windows, then the rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part_id = Encoder(path), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + b"\0\0\0\0"
                name = f"{doc.as_py()}/{zlib.crc32(ids)}/{len(ids)}"
                key = zlib.crc32(name.encode())
                again = seen[key] = seen.get(key, -1) + 1
                group = zlib.crc32(f"{name}/{part_id}/{again}".encode()) % groups
                for at in range(0, len(ids), 4 * window):
                    part = ids[at : at + 4 * window]
                    out.append((doc.as_py(), at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, group))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.int32()], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_group"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, window: int = WINDOW, group_rows: int = GROUP_ROWS, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset for every piece."""
    groups = max(1, -(-docs.count() // group_rows))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "length", "ids_crc32"], kind="stable", na_position="first")
        where, offset = best_fit_decreasing(frame["length"].to_numpy(), window)
        return frame.assign(sequence_id=where * groups + frame["_group"].to_numpy(np.int64), offset=offset).drop(columns="_group")

    cut = pieces(docs, groups, window, path, id_col, text_col)
    return cut.groupBy("_group").applyInPandas(fit, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
