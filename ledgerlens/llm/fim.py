"""Fill-in-the-middle transformation by in-place block rotation.

A text is cut at two code points into prefix, middle and suffix. The work is
done on one bytearray of its UTF-8 bytes: a scan over leading bytes finds the
places of the cuts, the three sentinels are inserted there, and neighbouring
blocks are exchanged by three reversals each. Restoring finds the sentinels,
undoes the rotation by the opposite one and takes the sentinels out.

A text that holds a sentinel's string stays plain, so the sentinels of an
output are always found again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import text_slices

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
PLAIN, PSM, SPM = "plain", "psm", "spm"
BLOCK = 1 << 16  # bytes exchanged or scanned at a time
SLICE_CHARS = 4_000_000


def reverse(view: np.ndarray, a: int, b: int) -> None:
    """Reverse bytes a .. b - 1 in place, with a bounded buffer."""
    while b - a > 1:
        n = min(BLOCK, (b - a) // 2)
        left = view[a : a + n].copy()
        view[a : a + n] = view[b - n : b][::-1]
        view[b - n : b] = left[::-1]
        a, b = a + n, b - n


def rotate(view: np.ndarray, a: int, m: int, b: int) -> None:
    """Exchange the neighbouring segments a .. m - 1 and m .. b - 1 in place."""
    if a < m < b:
        reverse(view, a, m)
        reverse(view, m, b)
        reverse(view, a, b)


def byte_places(view: np.ndarray, points: list[int]) -> list[int]:
    """Byte offsets of some code points (ascending), found by one scan over the leading bytes."""
    out, seen, at = [], 0, 0
    for point in points:
        place = len(view)
        while at < len(view):
            leading = (view[at : at + BLOCK] & 0xC0) != 0x80
            n = int(np.count_nonzero(leading))
            if seen + n > point:
                place = at + int(np.flatnonzero(leading)[point - seen])
                break
            seen, at = seen + n, at + BLOCK
        out.append(place)
    return out


def arrange(text: str, low: int, high: int, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text with its blocks in the order of ``form``; cuts before code points ``low`` <= ``high``."""
    if form == PLAIN:
        return text
    p, s, m = (x.encode("utf-8") for x in sentinels)
    buf = bytearray(text, "utf-8")
    low, high = (low, high) if len(buf) == len(text) else byte_places(np.frombuffer(buf, np.uint8), [low, high])
    buf[high:high] = s
    buf[low:low] = m
    buf[0:0] = p
    middle, suffix = low + len(p), high + len(p) + len(m)
    # <P> prefix <M> middle <S> suffix
    rotate(np.frombuffer(buf, np.uint8), middle if form == PSM else 0, suffix, len(buf))
    return buf.decode("utf-8")


def rebuild(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The exact text behind an output of ``arrange``."""
    if form == PLAIN:
        return output
    p, s, m = (x.encode("utf-8") for x in sentinels)
    buf = bytearray(output, "utf-8")
    first, cut = (buf.find(s), buf.find(m)) if form == PSM else (0, buf.find(p))
    if min(first, cut) < 0 or form not in (PSM, SPM):
        raise ValueError(f"not an output of form {form!r}")
    rotate(np.frombuffer(buf, np.uint8), first, cut, len(buf))
    suffix = first + len(buf) - cut
    del buf[suffix : suffix + len(s)]
    middle = buf.find(m)
    del buf[middle : middle + len(m)]
    del buf[: len(p)]
    return buf.decode("utf-8")


def plan(text: str, row_id: str, seed: str, plain_percent: int, spm_percent: int, sentinels: tuple[str, str, str]) -> tuple[int, int, str]:
    """Both cuts and the form of a text, drawn from the hash of the seed and the row's id."""
    digest = hashlib.sha256(f"{seed}:{row_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    cuts = sorted(x % (len(text) + 1) for x in h[:2])
    if not text or h[2] % 100 >= 100 - plain_percent or any(x in text for x in sentinels):
        return cuts[0], cuts[1], PLAIN
    return cuts[0], cuts[1], SPM if h[3] % 100 < spm_percent else PSM


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    seed: str = "1",
    plain_percent: int = 10,
    spm_percent: int = 20,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """One row per row: the carried columns (by default the id), then n, form, prefix_chars, middle_chars and output.

    ``n`` counts code points; ``prefix_chars`` and ``middle_chars`` are null for
    plain rows. A null text is empty, and an empty text is plain. Without an
    id the draw is that of the empty id. Repeated rows and equal ids are drawn
    alike. Texts of any length are handled whole, one at a time. A carried
    column with the name of a new one is replaced. An empty table
    gives an empty result.
    """
    new = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    kept = [c for c in (carry if carry is not None else [id_col]) if c not in {f.name for f in new}]
    schema = T.StructType([*(docs.schema[c] for c in kept), *new])
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")), *kept)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for some, part in text_slices(ids, texts, SLICE_CHARS):
                plans = [plan(t, i, seed, plain_percent, spm_percent, sentinels) for i, t in zip(some, part, strict=True)]
                cut = [(None, None) if form == PLAIN else (low, high - low) for low, high, form in plans]
                columns = [
                    *(c.slice(at, len(some)) for c in batch.columns[2:]),
                    pa.array(map(len, part), pa.int64()),
                    pa.array([form for _, _, form in plans], pa.string()),
                    pa.array([a for a, _ in cut], pa.int64()),
                    pa.array([b for _, b in cut], pa.int64()),
                    pa.array([arrange(t, *p, sentinels) for t, p in zip(part, plans, strict=True)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                at += len(some)

    return rows.mapInArrow(run, schema)


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``rows`` with the exact texts behind their outputs, from output and form alone.

    A null output gives null, a null form counts as plain. An output that lacks
    the sentinels of its form raises. A column called ``name`` is replaced.
    """
    kept = [c for c in rows.columns if c != name]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(name, T.StringType())])

    def run(batches):
        for batch in batches:
            outputs, forms = batch.column(output_col).to_pylist(), batch.column(form_col).to_pylist()
            at = 0
            for some, part in text_slices(forms, outputs, SLICE_CHARS):
                texts = [None if t is None else rebuild(t, f or PLAIN, sentinels) for t, f in zip(part, some, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(some)) for c in batch.columns), pa.array(texts, pa.string())], names=schema.names)
                at += len(some)

    return rows.select(*kept).mapInArrow(run, schema)
