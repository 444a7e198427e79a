"""Byte-level BPE by a global shuffle of distinct words.

Encoding runs in three steps:

1. Documents are split into pre-tokens; each task gives out its distinct ones,
   and they are shuffled by their hash.
2. The shards of that shuffle encode every distinct word of the table once, by
   merging ranks (usual words in the tokenizer library), and write (hash, ids) as sorted arrays to the shared folder.
3. Documents are split again, position by position; the ids of a task's
   distinct words are joined back from the mapped arrays, and each document
   is reassembled in the order of its positions.

Only distinct words are shuffled, never one row per occurrence, so a very
frequent word costs one row a task. Decoding gathers from the token-byte
table, whose size is the vocabulary's.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import U64, cached, id_texts, list_column, offsets_of, ranges, shared_path, spaced_chunks, text_slices, word_and_marks
from ledgerlens.llm.hash_tables import MappedFiles, put_file, shard_bits, shards_of, sorted_shards, unsigned

SLICE_CHARS = 1_000_000
LONG_WORD = 200  # characters above which a word is merged by a heap
MEMO_BYTES = 128_000_000  # of the chunks that a worker keeps


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_ranks(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair with the lowest rank (leftmost on a tie) merges first.

    A heap of candidate pairs over a linked list of parts: n log n in the
    length of the word.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # the part that starts at i ends here; 0: merged into an earlier one
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class WordEncoder:
    """Ids of one pre-token: the library's merges, whose time grows with the square of a word's length; long words by ``merge_ranks``."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.ranks = ranks
        self.whole = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, word: str) -> list[int]:
        return self.whole(word) if len(word) <= LONG_WORD else merge_ranks(word.encode("utf-8"), self.ranks)


def pre_tokens(chunk: str, find) -> list[str]:
    parts = word_and_marks(chunk)
    return find(chunk) if parts is None else [p for p in parts if p]


def word_keys(words: list[str]) -> np.ndarray:
    """The hash by which words are shuffled: Spark's xxhash64 of the string."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8"), seed=42) for w in words), dtype=U64, count=len(words))


def held_bytes(names) -> int:
    """About what a memo's entries for some strings take."""
    return sum(map(len, names)) + 200 * len(names)


def distinct_words(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text", most: int = MEMO_BYTES) -> DataFrame:
    """(word): the pre-tokens of all whole texts, each at most once a task or per ``most`` bytes of words."""

    def split(batches):
        import regex

        find, chunks, words, held = regex.compile(pattern).findall, set(), set(), 0

        def flush():
            some = list(words)
            for a in range(0, len(some), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(some[a : a + 50_000], pa.string())], names=["word"])
            words.clear()
            chunks.clear()

        for batch in batches:
            for t in id_texts(batch)[1]:
                new = set(spaced_chunks(t)) - chunks
                for c in new:
                    words.update(pre_tokens(c, find))
                chunks |= new
                held += held_bytes(new)
                if held > most:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.select(id_col, text_col).mapInArrow(split, "word string")


def write_words(words: DataFrame, ranks_path: str, folder: str, n_shards: int) -> int:
    """Encode each distinct word once and write the shards of the word table; returns the number of words.

    Words with one hash are left out; they are encoded where they are met.
    """
    ranks = words.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # as large as the vocabulary file

    def put(shard: int, rows: pa.Table):
        keys, words = unsigned(rows.column("key")), rows.column("word")
        same = pc.equal(words.slice(1), words.slice(0, max(0, len(words) - 1))).to_numpy(zero_copy_only=False) if len(words) > 1 else np.zeros(0, dtype=bool)
        keep = np.flatnonzero(np.r_[True, ~same.astype(bool)][: len(words)])  # of equal words, one becomes a string
        keys, names = keys[keep], words.take(pa.array(keep)).to_pylist()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        differ = np.r_[True, keys[1:] != keys[:-1], True]
        alone = differ[:-1][: len(keys)] & differ[1:][: len(keys)]
        encoder = cached(("word encoder", folder), lambda: WordEncoder(ranks.value))
        ids = [encoder.ids(names[i]) for i in order[alone]]
        put_file(folder, f"{shard:06d}.key", keys[alone].astype("<u8").tobytes())
        put_file(folder, f"{shard:06d}.start", offsets_of(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))).astype("<u4").tobytes())
        put_file(folder, f"{shard:06d}.ids", np.fromiter((x for some in ids for x in some), dtype="<u4").tobytes())
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(keep)], pa.int64())})

    done = sorted_shards(words, F.xxhash64("word"), shard_bits(n_shards), ["word"], put, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class WordTable:
    """The mapped word table: ids of many words at once."""

    def __init__(self, folder: str, n_shards: int):
        self.files, self.bits = MappedFiles(folder), shard_bits(n_shards)

    def ids(self, words: list[str]) -> list[bytes | None]:
        """Ids of each word as little-endian u32 bytes; None for a word that the table lacks."""
        keys = word_keys(words)
        out: list[bytes | None] = [None] * len(words)
        order = np.argsort(keys, kind="stable")
        shard = shards_of(keys[order], self.bits)
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            s = int(shard[a])
            known, start, pool = (self.files.get(s, kind, t) for kind, t in (("key", "<u8"), ("start", "<u4"), ("ids", "<u4")))
            if len(known):
                some = keys[order[a:b]]
                at = np.minimum(np.searchsorted(known, some), len(known) - 1)
                hit = known[at] == some
                first, last = start[at], start[at + 1]
                for i, ok, x, y in zip(order[a:b].tolist(), hit.tolist(), first.tolist(), last.tolist(), strict=True):
                    if ok:
                        out[i] = pool[x:y].tobytes()
        return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", docs_per_shard: int = 8000, max_memo: int = MEMO_BYTES, decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) of every whole text; a null text is empty (no ids).

    With ``decoded``, a column of that name holds the bytes that ``decode`` gives for the
    ids, looked up in the token-byte table within the same pass.

    Rows are handled one by one, so repeated or null row ids each keep their row.
    Texts of any length are encoded whole; an empty table gives no rows. A worker's
    memo of chunks is emptied when it passes ``max_memo`` bytes.
    """
    folder = shared_path(docs.sparkSession, "bpe-words")
    n_shards = max(1, docs.count() // docs_per_shard)
    write_words(distinct_words(docs, pattern, id_col, text_col), ranks_path, folder, n_shards)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    bytes_of = docs.sparkSession.sparkContext.broadcast(TokenBytes.of(read_ranks(ranks_path))) if decoded else None
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.BinaryType())] if decoded else [])])

    def reassemble(batches):
        import regex

        back = TokenBytes(*bytes_of.value) if decoded else None

        find, known = regex.compile(pattern).findall, cached(("chunk ids", folder), dict)
        table = cached(("words", folder), lambda: WordTable(folder, n_shards))
        for batch in batches:
            id_type = batch.schema.field(0).type
            for rows, texts in text_slices(*id_texts(batch), SLICE_CHARS):
                if known.get(None, 0) > max_memo:
                    known.clear()
                chunks = [spaced_chunks(t) for t in texts]
                new = {c: pre_tokens(c, find) for some in chunks for c in some if c not in known}
                words = list({w for some in new.values() for w in some})
                joined = {w: merged(w, ranks.value) if ids is None else ids for w, ids in zip(words, table.ids(words), strict=True)}
                known |= {c: b"".join(map(joined.__getitem__, some)) for c, some in new.items()}
                known[None] = known.get(None, 0) + held_bytes(new) + sum(len(known[c]) for c in new)
                raw = [b"".join(map(known.__getitem__, some)) for some in chunks]
                lengths = np.fromiter((len(r) // 4 for r in raw), dtype=np.int64, count=len(raw))
                flat = np.frombuffer(b"".join(raw), "<i4")
                more = [pa.array(back.texts(flat, lengths), pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([pa.array(rows, id_type), list_column(flat, lengths, pa.int32()), *more], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(reassemble, schema)


def merged(word: str, ranks: dict[bytes, int]) -> bytes:
    return np.array(merge_ranks(word.encode("utf-8"), ranks), dtype="<u4").tobytes()


def token_bytes(spark: SparkSession, ranks_path: str) -> DataFrame:
    """The token-byte table (id, token)."""
    rows = [(i, bytearray(t)) for t, i in sorted(read_ranks(ranks_path).items(), key=lambda x: x[1])]
    return spark.createDataFrame(rows, "id int, token binary")


class TokenBytes:
    """The token-byte table by id: where each token's bytes are in one byte string."""

    def __init__(self, length: np.ndarray, joined: bytes):
        self.length, self.pool, self.start = length, np.frombuffer(joined, np.uint8), offsets_of(np.maximum(length, 0))[:-1]

    @staticmethod
    def of(ranks: dict[bytes, int]) -> tuple[np.ndarray, bytes]:
        table = sorted((i, t) for t, i in ranks.items())
        length = np.full(table[-1][0] + 1, -1, dtype=np.int64)
        length[[i for i, _ in table]] = [len(t) for _, t in table]
        return length, b"".join(t for _, t in table)

    def texts(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of consecutive lists of ids; an id without an entry raises."""
        n = np.where((ids >= 0) & (ids < len(self.length)), self.length[np.clip(ids, 0, len(self.length) - 1)], -1)
        if (n < 0).any():
            raise ValueError("an id has no entry in the vocabulary")
        at = offsets_of(sizes)
        return [self.pool[ranges(self.start[ids[a:b]], n[a:b])].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary) to rows with an array of ids; null ids give null, an unknown id raises.

    The token-byte table is joined in place: it has one row a vocabulary entry,
    is shipped to the workers as one byte string, and every id gathers from it.
    A column called ``decoded`` is replaced; an empty table gives no rows.
    """
    shipped = tokens.sparkSession.sparkContext.broadcast(TokenBytes.of(read_ranks(ranks_path)))  # as large as the vocabulary file
    schema = T.StructType([*[f for f in tokens.schema.fields if f.name != "decoded"], T.StructField("decoded", T.BinaryType())])
    rows = tokens.drop("decoded")
    at = rows.columns.index(ids_col)

    def join(batches):
        table = TokenBytes(*shipped.value)
        for batch in batches:
            ids = batch.column(at)
            texts = table.texts(ids.flatten().to_numpy(), pc.fill_null(pc.list_value_length(ids), 0).to_numpy())
            out = [None if null else t for t, null in zip(texts, ids.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return rows.mapInArrow(join, schema)
