"""Interpolated modified Kneser-Ney bigram model.

Counting is a Spark job: each task counts the word pairs of its documents
before the shuffle, pairs meet by the hash of their context, and the task of a
context shard writes the shard's sorted hash arrays: pairs with their counts,
contexts with their totals and numbers of successors seen once, twice and more.
From each shard, every word's count and number of distinct predecessors are
summed into the word shards. Scoring workers map the arrays.

    p(w | h) = max(n(h,w) - D(n), 0) / n(h) + g(h) p(w)
    p(w)     = max(k(w) - D'(k), 0) / K + g' / (V + 1)

with k(w) the number of distinct predecessors of w, K their sum, D and D' the
three discounts of each order from its counts of counts, and g, g' the mass
that the discounts free. A word outside the training tokens has k = 0.
Every text starts after a context of its own and ends in an end token.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import U64, cached, hash_words, id_texts, mix64, offsets_of, shared_path, text_slices
from ledgerlens.llm.hash_tables import MappedFiles, put_file, run_starts, shard_bits, shards_of, sorted_shards, unsigned

BEGIN, END = U64(1), U64(2)  # hashes of the two marks; words hash elsewhere
SLICE_CHARS = 4_000_000
TASK_TOKENS = 2_500_000  # tokens of a task that are counted together
RARE = 255  # a pair's count up to here takes one byte


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of some texts, an end after each, and each text's number of tokens."""
    words, sizes = hash_words(texts)
    out = np.full(len(words) + len(sizes), END, dtype=U64)
    keep = np.ones(len(out), dtype=bool)
    keep[np.cumsum(sizes + 1) - 1] = False
    out[keep] = words
    return out, sizes + 1


def contexts(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token; the begin mark before a text's first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[offsets_of(sizes)[:-1]] = BEGIN
    return before


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(context * U64(0x9E3779B97F4A7C15) + word)


def discounts(counts_of_counts: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of types seen 1 to 4 times; a fixed half a count and so on where those are too few."""
    n1, n2, n3, n4 = counts_of_counts
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]


def discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


@dataclass
class KneserNey:
    """Where the arrays lie, and the model's totals."""

    folder: str
    n_shards: int
    tokens: int  # N
    types: int  # V
    pairs: int  # K
    pair_discounts: list[float]
    word_discounts: list[float]
    word_classes: list[int]  # words with one, two, and more predecessors


def count_pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, w, n): pairs counted within slices of a task, in order of (h, w), before any shuffle."""

    def count(batches):
        held, size = [], 0

        def flush():
            h, w = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            order = np.lexsort((w, h))
            h, w = h[order], w[order]
            first = run_starts(h, w)
            n = np.diff(np.r_[first, len(h)])
            for a in range(0, len(first), 200_000):
                b = first[a : a + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(h[b].view(np.int64)), pa.array(w[b].view(np.int64)), pa.array(n[a : a + 200_000], pa.int32())], names=["h", "w", "n"])

        for batch in batches:
            for _, texts in text_slices(*id_texts(batch), SLICE_CHARS):
                tokens, sizes = token_hashes(texts)
                held.append((contexts(tokens, sizes), tokens))
                size += len(tokens)
                if size > TASK_TOKENS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.select(id_col, text_col).mapInArrow(count, "h long, w long, n int")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs_per_shard: int = 2000) -> KneserNey:
    """Count all texts (null text: empty) and write the model to the shared folder."""
    spark = docs.sparkSession
    folder = shared_path(spark, "kneser-ney")
    n_shards = max(1, docs.count() // docs_per_shard)
    bits = shard_bits(n_shards)

    def put_contexts(shard: int, rows: pa.Table):
        h, w, n = unsigned(rows.column("h")), unsigned(rows.column("w")), rows.column("n").to_numpy().astype(np.int64)
        first = run_starts(h, w)
        h, w, n = h[first], w[first], np.add.reduceat(n, first)
        start = run_starts(h)
        totals = np.add.reduceat(n, start)
        stats = [np.add.reduceat(x.astype(np.int64), start) for x in (n == 1, n == 2, n > 2)]
        order = np.argsort(h[start], kind="stable")
        put_file(folder, f"{shard:06d}.context", h[start][order].astype("<u8").tobytes())
        put_file(folder, f"{shard:06d}.total", totals[order].astype("<u8").tobytes())
        put_file(folder, f"{shard:06d}.stats", np.stack([x[order] for x in stats], axis=1).astype("<u4").tobytes())
        g = pair_hash(h, w)
        order = np.argsort(g, kind="stable")
        n_sorted = n[order]
        put_file(folder, f"{shard:06d}.pair", g[order].astype("<u8").tobytes())
        put_file(folder, f"{shard:06d}.count", np.minimum(n_sorted, RARE).astype(np.uint8).tobytes())
        often = np.flatnonzero(n_sorted >= RARE)
        put_file(folder, f"{shard:06d}.often", np.stack([often, n_sorted[often]], axis=1).astype("<u8").tobytes())
        by_word = np.argsort(w, kind="stable")
        begin = run_starts(w[by_word])
        words = pa.array(w[by_word][begin].view(np.int64))
        k, c = np.diff(np.r_[begin, len(w)]), np.add.reduceat(n[by_word], begin)
        coc = [int((n == i).sum()) for i in (1, 2, 3, 4)]
        put_file(f"{folder}/totals", f"pairs-{shard:06d}.json", json.dumps([*coc, len(n)]).encode())
        yield pa.RecordBatch.from_arrays([words, pa.array(k), pa.array(c)], names=["w", "k", "c"])

    pairs = sorted_shards(count_pairs(docs, id_col, text_col), F.col("h"), bits, ["w"], put_contexts, "w long, k long, c long")

    def put_words(shard: int, rows: pa.Table):
        w, k, c = unsigned(rows.column("w")), rows.column("k").to_numpy(), rows.column("c").to_numpy()
        first = run_starts(w)
        w, k, c = w[first], np.add.reduceat(k, first), np.add.reduceat(c, first)
        order = np.argsort(w, kind="stable")
        put_file(folder, f"{shard:06d}.word", w[order].astype("<u8").tobytes())
        put_file(folder, f"{shard:06d}.before", k[order].astype("<u4").tobytes())
        put_file(folder, f"{shard:06d}.uses", c[order].astype("<u8").tobytes())
        sums = [*((k == i).sum() for i in (1, 2, 3, 4)), (k > 2).sum(), len(w), k.sum(), c.sum()]
        yield pa.RecordBatch.from_pydict({"sums": pa.array([[int(x) for x in sums]], pa.list_(pa.int64()))})

    words = sorted_shards(pairs, F.col("w"), bits, [], put_words, "sums array<long>")
    got = words.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    sums = {r["i"]: r["x"] for r in got.collect()}  # eight numbers
    total = [sums.get(i, 0) for i in range(8)]
    coc = spark.read.text(f"{folder}/totals") if total[5] else None
    pair_counts = [0] * 5
    if coc is not None:
        parsed = coc.select(F.from_json("value", "array<long>").alias("x")).select(F.posexplode("x").alias("i", "x"))
        for r in parsed.groupBy("i").agg(F.sum("x").alias("x")).collect():  # five numbers
            pair_counts[r["i"]] = r["x"]
    return KneserNey(folder, n_shards, total[7], total[5], total[6], discounts(pair_counts[:4]), discounts(total[:4]), [total[0], total[1], total[4]])


class Scorer:
    """The model's arrays as one worker has mapped them."""

    def __init__(self, model: KneserNey):
        self.m, self.bits = model, shard_bits(model.n_shards)
        self.files = MappedFiles(model.folder)
        gamma = sum(d * n for d, n in zip(model.word_discounts, model.word_classes, strict=True))
        self.floor = gamma / max(1, model.pairs) / (model.types + 1) if model.pairs else 1.0

    def _array(self, shard: int, kind: str, dtype, columns: int = 1) -> np.ndarray:
        a = self.files.get(shard, kind, dtype)
        return a.reshape(-1, columns) if columns > 1 else a

    def _find(self, keys: np.ndarray, shards: np.ndarray, kind: str, value, columns: int) -> np.ndarray:
        """Rows of values of the keys (zeros where missing); keys are visited shard by shard in sorted order."""
        out = np.zeros((len(keys), columns), dtype=np.int64)
        order = np.lexsort((keys, shards))
        cuts = [0, *(np.flatnonzero(np.diff(shards[order])) + 1).tolist(), len(order)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                s = int(shards[order[a]])
                known = self._array(s, kind, "<u8")
                if len(known):
                    some = keys[order[a:b]]
                    at = np.minimum(np.searchsorted(known, some), len(known) - 1)
                    hit = np.flatnonzero(known[at] == some)
                    out[order[a:b][hit]] = value(s, at[hit])
        return out

    def _word_counts(self, shard: int, at: np.ndarray) -> np.ndarray:
        return np.stack([self._array(shard, "before", "<u4")[at].astype(np.int64), self._array(shard, "uses", "<u8")[at].astype(np.int64)], axis=1)

    def _context_counts(self, shard: int, at: np.ndarray) -> np.ndarray:
        return np.concatenate([self._array(shard, "total", "<u8")[at].astype(np.int64)[:, None], self._array(shard, "stats", "<u4", 3)[at].astype(np.int64)], axis=1)

    def _pair_counts(self, shard: int, at: np.ndarray) -> np.ndarray:
        n = self._array(shard, "count", np.uint8)[at].astype(np.int64)
        if (n == RARE).any():
            often = self._array(shard, "often", "<u8", 2)
            full = np.flatnonzero(n == RARE)
            n[full] = often[np.searchsorted(often[:, 0], at[full]), 1]
        return n[:, None]

    def score(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: count in training, log10 base probability, log10 model probability."""
        m = self.m
        before = contexts(tokens, sizes)
        words, which = np.unique(tokens, return_inverse=True)
        uses = self._find(words, shards_of(words, self.bits), "word", self._word_counts, 2)
        lower = (discounted(uses[:, 0], m.word_discounts) / max(1, m.pairs) + self.floor)[which]
        g, first, pair = np.unique(pair_hash(before, tokens), return_index=True, return_inverse=True)
        n = self._find(g, shards_of(before[first], self.bits), "pair", self._pair_counts, 1)[:, 0]
        context, of = np.unique(before, return_inverse=True)
        stats = self._find(context, shards_of(context, self.bits), "context", self._context_counts, 4)
        total = np.maximum(stats[:, 0], 1)
        back = np.where(stats[:, 0] > 0, stats[:, 1:] @ np.array(m.pair_discounts) / total, 1.0)
        p = discounted(n, m.pair_discounts)[pair] / total[of] + back[of] * lower
        c = uses[which, 1]
        return c, np.log10((c + 0.5) / (m.tokens + 0.5 * (m.types + 1))), np.log10(p)


def score(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every whole text; a null text is its end token alone."""
    spark: SparkSession = docs.sparkSession
    shipped = spark.sparkContext.broadcast(asdict(model))  # a path and a few numbers
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scorer = cached(("kneser-ney", shipped.value["folder"]), lambda: Scorer(KneserNey(**shipped.value)))
        for batch in batches:
            for rows, texts in text_slices(*id_texts(batch), SLICE_CHARS):
                tokens, sizes = token_hashes(texts)
                c, base, own = scorer.score(tokens, sizes)
                at = offsets_of(sizes)[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows, batch.schema.field(0).type),
                        pa.array(sizes),
                        pa.array(np.add.reduceat((c > 0).astype(np.int64), at)),
                        pa.array(np.full(len(rows), scorer.m.tokens)),
                        pa.array(np.add.reduceat(base, at)),
                        pa.array(np.add.reduceat(own, at)),
                    ],
                    names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_split(id_col: str, of: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of)) == remainder, F.lit(False))
