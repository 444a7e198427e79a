"""Helpers shared by the corpus operators: shared-folder tables, hashing, memoised tokenizing."""

from __future__ import annotations

import json
import os
import re
import string
import sys
import types
import uuid
from array import array
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import checkpoint_dir

U64 = np.uint64
KEPT = 4  # things that a worker keeps; models and memos of earlier jobs are let go
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads these files. The schema is
    given, so an empty table is read back as an empty table.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of about 4 MB, unless it has been given a limit of its own.

    A batch is held several times on its way: as Arrow buffers and as the stream's bytes
    in the executor, then as buffers and as strings in the worker. Spark's own limits,
    10,000 rows and 64 MB, let whole texts fill these. Results do not depend on it.
    """
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def given_back(run: Callable) -> Callable:
    """``run`` over the batches of a task, after which Arrow returns the memory it no longer needs to the system."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker.

    Functions of this package are pickled by value, so module globals are new
    in each task; parsed vocabularies are kept here instead.
    """
    module = sys.modules.setdefault("_ledgerlens_worker_cache", types.ModuleType("_ledgerlens_worker_cache"))
    return module.__dict__.setdefault("items", {})


def cached(key, make: Callable):
    """``make()``, kept for the worker's later tasks; the least recently used things go first."""
    store = worker_cache()
    item = store.pop(key) if key in store else make()
    while len(store) >= KEPT:
        store.pop(next(iter(store)))
    store[key] = item
    return item


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


HASH_BLOCK = 1 << 20  # bytes hashed at a time
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n - 1 of an odd number and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    size = max(HASH_BLOCK, 1 << (n - 1).bit_length())

    def make():
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        return tuple(out)

    # a single word beyond a block has powers of its own, which are not kept
    up, down = cached(("powers", size), make) if size == HASH_BLOCK else make()
    return up[:n], down[:n]


def hash_words(texts: list[str], strip: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes (above 15) of the words ``[^\\x20\\x09-\\x0D]+`` of some texts, and each text's number of words.

    A-Z count as a-z. With ``strip``, those ASCII marks are left off both ends
    of a word that has other bytes. All words of a block are hashed at once: a
    word's hash is the mixed difference of two running sums of
    byte value times a power of the place, brought back to its start.
    """
    out, sizes, _, _, _ = placed_words(texts, strip, fold=True)
    return out, sizes


def placed_words(texts: list[str], strip: bytes = b"", fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and numbers of words as of ``hash_words`` (A-Z count as a-z if ``fold``), the texts' bytes, and each word's start and end in them."""
    raw = [t.encode("utf-8") for t in texts]
    buf = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    values = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    if fold:
        values[65:91] = values[97:123]
    white = WHITE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white])))
    starts, ends = edge[::2], edge[1::2]
    bounds = offsets_of(np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw)))
    sizes = np.diff(np.searchsorted(starts, bounds))
    if strip and len(starts):
        core = np.flatnonzero(~(white | np.isin(np.arange(256), list(strip))[buf]))
        first, last = np.searchsorted(core, starts), np.searchsorted(core, ends)
        some = last > first
        starts, ends = starts.copy(), ends.copy()
        starts[some], ends[some] = core[first[some]], core[last[some] - 1] + 1
    out = np.zeros(len(starts), dtype=U64)
    a = 0
    while a < len(starts):  # blocks of whole words
        low = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, low + HASH_BLOCK, "right")))
        part = values[buf[low : ends[b - 1]]]
        up, down = _powers(len(part) + 1)
        part *= up[: len(part)]
        total = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum(part, dtype=U64, out=total[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(U64))
        a = b
    return np.maximum(out, U64(16)), sizes, buf, starts, ends


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(s, s + n)`` for each pair."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two ascending arrays as one, without sorting again."""
    return np.insert(a, np.searchsorted(a, b), b)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def text_slices(ids: list, texts: list, max_chars: int) -> Iterator[tuple[list, list]]:
    """Consecutive slices of a batch with at most ``max_chars`` characters, or one long text."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and size + n > max_chars:
            yield ids[a:i], texts[a:i]
            a, size = i, 0
        size += n
    if a < len(texts):
        yield ids[a:], texts[a:]


def id_texts(batch: pa.RecordBatch) -> tuple[list, list]:
    """The first two columns of a batch: row ids and texts (null text: empty)."""
    return batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets_of(lengths), pa.int32()), pa.array(values, kind))


ENDINGS = ".,;:!?"
MARKS = "".join(c for c in string.punctuation if c != "'")  # a run of them after letters is one pre-token
TWO_SPACES = re.compile(r"\s\s")


def spaced_marked(text: str) -> str | None:
    """A text with a NUL where no byte-level pre-token can lie across a cut, or None if it holds one.

    Before each space and around each line break if no two white-space
    characters meet, before each space if no two spaces do; else the text is
    left whole.
    """
    if "\0" in text:
        return None
    if not TWO_SPACES.search(text):
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ")
    return text if "  " in text else text.replace(" ", "\0 ")


def spaced_chunks(text: str) -> list[str]:
    """The chunks of ``spaced_marked``."""
    marked = spaced_marked(text)
    return [text] if marked is None else marked.split("\0")


def lower_marked(text: str) -> str:
    """A text with a space where a vocabulary that drops white space has no token across the cut: at spaces and line breaks.

    Lower-cased first where that commutes with composing the text, as it does
    but for a few scripts' special cases.
    """
    if text.isascii():
        text = text.lower()
    elif "\u03a3" not in text and is_normalized("NFC", text) and is_normalized("NFC", low := text.lower()):
        text = low
    return text.replace("\n", " ")


def word_and_marks(chunk: str) -> tuple[str, str] | None:
    """Splits letters, perhaps after one space, from end marks after them; None for chunks of another kind.

    The word and the marks are one pre-token each in both pre-tokenizers.
    """
    word = chunk.rstrip(ENDINGS)
    return (word, chunk[len(word) :]) if word.removeprefix(" ").isalpha() else None


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for the code points from 256 on, in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class ChunkIds(dict):
    """Ids of chunks as little-endian u32 bytes, each distinct chunk encoded once.

    Letters and end marks go to the library's BPE model part by part, any
    other chunk through its whole pipeline.
    """

    def __init__(self, tokenizer_json: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.letters, self.spaced = byte_letters(), spaced

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(MARKS)
        bare = word[1:] if word[:1] == " " else word
        if not chunk:
            ids = b""
        elif bare.isalpha() and (self.spaced or (chunk.islower() if chunk.isascii() else chunk == chunk.lower() and is_normalized("NFC", chunk))):
            if len(word) < len(chunk):
                ids = self[word] + self[chunk[len(word) :]]
            else:
                if not word.isascii():
                    word = word.encode("utf-8").decode("latin-1").translate(self.letters)
                elif bare is not word:
                    word = self.letters[32] + bare
                ids = array("I", [t.id for t in self.tokenize(word)]).tobytes()
        else:
            ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= 100:
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """Encodes whole texts with a tokenizer file, each distinct chunk once per worker.

    ``spaced`` names the pre-tokenizer: byte-level, where one space may lead a
    token, or one that drops white space and lower-cases. Texts that may hold one of the
    file's added tokens go through the library whole. The memo is emptied
    when it passes ``max_memo`` chunks; that never changes a result.
    """

    def __init__(self, tokenizer_json: str, spaced: bool, max_memo: int = 600_000):
        self.known, self.max_memo = ChunkIds(tokenizer_json, spaced), max_memo
        self.marked, self.mark = (spaced_marked, "\0") if spaced else (lower_marked, " ")
        added = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens") or []]
        self.first = {c for t in added for c in (t[0], t[0].lower(), t[0].upper())}
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None

    def whole(self, text: str) -> bytes:
        """Ids of a text by the library alone, which finds the added tokens as well."""
        library = self.known.tokenizer  # the same one, as another would hold the vocabulary again
        library.encode_special_tokens = False
        try:
            return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
        finally:
            library.encode_special_tokens = True

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian u32 bytes."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian u32 bytes; a chunk that comes often in them is looked up once."""
        marked, alone = [], {}
        for i, text in enumerate(texts):
            if self.added and any(c in text for c in self.first) and self.added.search(text):
                alone[i] = self.whole(text)
            elif (cut := self.marked(text)) is None:
                alone[i] = self.known[text]
            marked.append(None if i in alone else cut)
        chunks = pc.split_pattern(pa.array(marked, pa.large_string()), self.mark)
        coded = chunks.flatten().dictionary_encode()
        if len(self.known) > self.max_memo:
            self.known.clear()
        found = list(map(self.known.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        first, ids = offsets_of(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4), np.frombuffer(b"".join(found), "<u4")
        code = coded.indices.to_numpy()
        sizes = first[code + 1] - first[code]
        raw = ids[ranges(first[code], sizes)].tobytes()
        ends = offsets_of(sizes)[offsets_of(chunks.value_lengths().fill_null(0).to_numpy())] * 4
        out = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for i, own in alone.items():
            out[i] = own
        return out


def chunk_encoder(tokenizer_json: str, spaced: bool, max_memo: int = 600_000) -> ChunkEncoder:
    """The worker's encoder for this vocabulary text."""
    return cached(("encoder", hash(tokenizer_json), spaced), lambda: ChunkEncoder(tokenizer_json, spaced, max_memo))


def read_text(path: str) -> str:
    """A vocabulary file of fixed size, read once on the driver and shipped with the task."""
    with open(path, encoding="utf-8") as f:
        return f.read()
