"""Packing of token sequences into fixed windows by best-fit decreasing.

Documents longer than a window are first cut into full windows; what is left
over, and every shorter document, is one piece. Pieces are dealt by a hash
into groups of bounded size. Within a group they are placed in order of
decreasing length, each into the open window with the least room that still
holds it; a segment tree over remaining room finds that window in
O(log window) steps.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import bounded_batches, chunk_encoder, given_back, id_texts, read_text, text_slices


MEMO_CHUNKS = 300_000  # chunks whose ids a worker keeps


class RoomTree:
    """Segment tree indexed by remaining room; each leaf holds the open windows with that room."""

    def __init__(self, window: int):
        self.base = 1 << (window + 1).bit_length()
        self.open = [0] * (2 * self.base)
        self.windows: dict[int, list[int]] = {}

    def _count(self, room: int, by: int) -> None:
        node = self.base + room
        while node:
            self.open[node] += by
            node >>= 1

    def add(self, room: int, window: int) -> None:
        self.windows.setdefault(room, []).append(window)
        self._count(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out (room, window) with the least room >= length."""
        node, tree = self.base + length, self.open
        if not tree[node]:
            while node & 1 or not tree[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.base:
                node *= 2
                if not tree[node]:
                    node += 1
        room = node - self.base
        self._count(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; ``lengths`` is in decreasing order."""
    tree = RoomTree(window)
    place = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    windows = 0
    for i, n in enumerate(lengths.tolist()):
        found = tree.tightest(n) if n < window else None
        if found is None:
            room, number = window, windows
            windows += 1
        else:
            room, number = found
        place[i], offset[i] = number, window - room
        if room > n:
            tree.add(room - n, number)
    return place, offset


def token_pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = 2_000_000) -> DataFrame:
    """Every whole text as ids with ``end_id`` after it, cut into full windows and a remainder.

    Returns (id, start, length, doc_tokens, ids, __copy): ``start`` is the number of
    the document's ids before the piece, ``ids`` its little-endian unsigned
    32-bit ids, ``__copy`` the number of equal rows before it in its task. A null text is an
    empty text: one piece with the end id. The text of an added token of the file
    gives that token's id, as the library does.
    """
    vocabulary = read_text(tokenizer)
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, kind),
            *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens")),
            T.StructField("ids", T.BinaryType()),
            T.StructField("__copy", T.LongType()),
        ]
    )

    end, step = end_id.to_bytes(4, "little"), 4 * window

    def cut(batches):
        encoder, copies = chunk_encoder(vocabulary, spaced=False, max_memo=MEMO_CHUNKS), Counter()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for rows, texts in text_slices(*id_texts(batch), slice_chars):
                out = []
                for row, raw in zip(rows, encoder.encode_all(texts), strict=True):
                    raw += end
                    copy = copies[same := hash((row, raw))]
                    copies[same] += 1
                    out += [(row, a // 4, min(step, len(raw) - a) // 4, len(raw) // 4, raw[a : a + step], copy) for a in range(0, len(raw), step)]
                types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

    bounded_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(given_back(cut), schema)


def pack(pieces: DataFrame, window: int, n_groups: int) -> DataFrame:
    """Adds (sequence_id, offset) to pieces that have ``start``, ``length`` and ``ids``.

    A piece's group depends on its content and, for equal rows, on their count within
    a task (``__copy``, dropped here), so a lost task deals the same pieces again; equal rows are
    interchangeable, and many of them are spread over the groups. A long document's
    pieces are dealt one by one. Sequence ids are unique over groups. No rows: no rows.
    """
    id_col = pieces.columns[0]
    salt = [c for c in ("__copy",) if c in pieces.columns]
    grouped = pieces.withColumn("__group", F.pmod(F.xxhash64(id_col, "start", "length", "ids", *salt), F.lit(n_groups))).drop(*salt)
    schema = T.StructType([*grouped.drop("__group").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(table: pa.Table) -> pa.Table:
        group = table.column("__group")[0].as_py()
        table = table.drop_columns(["__group"]).sort_by([("length", "descending"), (id_col, "ascending"), ("start", "ascending")])
        number, offset = best_fit(table.column("length").to_numpy(), window)
        return table.append_column("sequence_id", pa.array((group << 32) + number)).append_column("offset", pa.array(offset))

    return grouped.groupBy("__group").applyInArrow(place, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", docs_per_group: int = 4096, bytes_per_group: int = 1 << 23
) -> DataFrame:
    """Tokenize and pack all documents; the number of groups follows the number of documents and the bytes of their texts."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).first()
    n_groups = max(1, math.ceil(size["n"] / docs_per_group), math.ceil(size["bytes"] / bytes_per_group))
    return pack(token_pieces(docs, tokenizer, window, end_id, id_col, text_col), window, n_groups)
