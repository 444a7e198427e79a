"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The likelihood of a text is the sum over all its segmentations into pieces. No
piece spans white space, so that sum is a product over words; a forward
pass computes one word for all languages at once.

Each distinct word of the table is scored once: tasks give out their distinct
words, a shuffle by hash brings equal ones together, and every shard writes the
scores of its words as one sorted array file. Documents are read a second time;
the scores of a slice's distinct words are looked up in the mapped files and
added up by document.

The probabilities are fitted by expectation-maximisation in Spark: distinct
words of the training texts with their counts, expected piece counts by a
forward-backward pass per word, summed by piece and language.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import U64, bounded_batches, cached, given_back, merged, offsets_of, placed_words, shared_path, text_slices, written
from ledgerlens.llm.hash_tables import MappedFiles, put_file, run_starts, shard_bits, shards_of, sorted_shards, unsigned

MARK = "▁"  # stands before each word in the vocabulary
UNDETERMINED = "und"
HELD_WORDS = 1_000_000  # hashes of words that a task keeps, so as not to give a word out twice
DOCS_PER_SHARD = 4000
LATTICE_WORDS = 5_000  # short words that are scored together
LONG_WORD = 40  # from this length on a word is computed alone, with scaling
SLICE_CHARS = 1_000_000
TINY = 1e-150


@dataclass
class LanguageModel:
    """Pieces and their probability per language (rows: pieces), with log priors.

    Its size is the vocabulary's times the number of languages.
    """

    languages: list[str]
    pieces: dict[str, int]
    prob: np.ndarray
    log_prior: np.ndarray

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)


def read_pieces(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece model, without control pieces and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    words = [sp.id_to_piece(i) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {w: i for i, w in enumerate(words)}


def edges(word: str, pieces: dict[str, int], longest: int) -> list[list[tuple[int, int]]]:
    """For each end position, (start, piece) of the pieces that end there; -1: a character in no piece."""
    n = len(word)
    ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for a in range(n):
        single = False
        for b in range(a + 1, min(n, a + longest) + 1):
            if (p := pieces.get(word[a:b])) is not None:
                ends[b].append((a, p))
                single = single or b == a + 1
        if not single:
            ends[a + 1].append((a, -1))
    return ends


def forward(ends: list[list[tuple[int, int]]], prob: np.ndarray, unknown: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Scaled forward sums per position, and the log scale at each position.

    Position i holds sum * exp(-scale[i]), so long words neither under- nor overflow.
    """
    n_lang = prob.shape[1]
    alpha, scale = [np.ones(n_lang)], np.zeros(len(ends))
    for b in range(1, len(ends)):
        base = scale[b - 1]
        total = np.zeros(n_lang)
        for a, p in ends[b]:
            step = alpha[a] * prob[p] if p >= 0 else alpha[a] * unknown
            total += step if scale[a] == base else step * math.exp(scale[a] - base)
        if (top := total.max()) < TINY:
            total = total / top
            base += math.log(top)
        scale[b] = base
        alpha.append(total)
    return alpha, scale


def word_scores(word: str, model: LanguageModel, unknown: float) -> np.ndarray:
    """Natural log of the sum over all segmentations of a word, per language."""
    alpha, scale = forward(edges(MARK + word, model.pieces, model.longest), model.prob, unknown)
    return np.log(np.maximum(alpha[-1], 1e-300)) + scale[-1]


def expected_pieces(word: str, prob: np.ndarray, pieces: dict[str, int], longest: int, unknown: float) -> tuple[list[int], list[float]]:
    """Pieces of a word with their expected number over its segmentations, for one language (prob: one column)."""
    ends = edges(MARK + word, pieces, longest)
    alpha, scale = forward(ends, prob, unknown)
    n = len(ends) - 1
    beta = np.zeros(n + 1)  # sum * exp(-scale_b)
    beta_scale = np.zeros(n + 1)
    beta[n] = 1.0
    starts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for b in range(1, n + 1):
        for a, p in ends[b]:
            starts[a].append((b, p))
    for a in range(n - 1, -1, -1):
        base = beta_scale[a + 1]
        total = sum(beta[b] * (prob[p, 0] if p >= 0 else unknown) * math.exp(beta_scale[b] - base) for b, p in starts[a])
        if total < TINY:
            base += math.log(max(total, 1e-300))
            total /= max(total, 1e-300)
        beta[a], beta_scale[a] = total, base
    whole = math.log(max(alpha[n][0], 1e-300)) + scale[n]
    found, weight = [], []
    for b in range(1, n + 1):
        for a, p in ends[b]:
            if p >= 0 and (mass := alpha[a][0] * prob[p, 0] * beta[b]) > 0:
                found.append(p)
                weight.append(math.exp(math.log(mass) + scale[a] + beta_scale[b] - whole))
    return found, weight


class Trie:
    """The pieces as a tree of characters whose steps are looked up for many words at once."""

    def __init__(self, pieces: dict[str, int]):
        index, keys, child, piece = {"": 0}, [], [], [-1]
        for w, p in pieces.items():
            for i in range(1, len(w) + 1):
                if w[:i] not in index:
                    index[w[:i]] = len(index)
                    keys.append(index[w[: i - 1]] << 21 | ord(w[i - 1]))
                    child.append(index[w[:i]])
                    piece.append(-1)
            piece[index[w]] = p
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys, self.child = np.array(keys, dtype=np.int64)[order], np.array(child, dtype=np.int64)[order]
        self.piece = np.array(piece, dtype=np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes after one more character, and which of the steps exist."""
        key = node << 21 | char
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        if not len(self.keys):
            return node, np.zeros(len(node), dtype=bool)
        return self.child[at], self.keys[at] == key


class Lattice:
    """Edges of many words at once: word, start, end and piece (-1: a character in no piece)."""

    def __init__(self, words: list[str], trie: Trie):
        sizes = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words))
        first = offsets_of(sizes)
        chars = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        stop = first[1:][owner]
        single = np.zeros(len(chars), dtype=bool)
        at, node, found = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64), []
        n = 0
        while len(at):  # all starts at once, one more character each time
            inside = at + n < stop[at]
            at, node = at[inside], node[inside]
            node, exists = trie.step(node, chars[at + n])
            at, node, n = at[exists], node[exists], n + 1
            piece = trie.piece[node]
            some = piece >= 0
            found.append((at[some], np.full(int(some.sum()), n), piece[some]))
            if n == 1:
                single[at[some]] = True
        alone = np.flatnonzero(~single)
        found.append((alone, np.ones(len(alone), dtype=np.int64), np.full(len(alone), -1)))
        starts, lengths, self.piece = (np.concatenate(x) for x in zip(*found, strict=True))
        self.word = owner[starts]
        self.start = starts - first[self.word]
        self.end = self.start + lengths
        self.length = sizes

    def sums(self, weight: np.ndarray, backward: bool = False) -> np.ndarray:
        """Forward sums (word, position, column), or backward sums; weight: (edge, column)."""
        n_words, n, cols = len(self.length), int(self.length.max(initial=0)), weight.shape[1]
        out = np.zeros((n_words, n + 1, cols))
        at, other = (self.start, self.end) if backward else (self.end, self.start)
        if backward:
            out[np.arange(n_words), self.length] = 1.0
        else:
            out[:, 0] = 1.0
        order = np.lexsort((self.word, at))
        bounds = np.searchsorted(at[order], np.arange(n + 2))
        for i in range(n - 1, -1, -1) if backward else range(1, n + 1):
            e = order[bounds[i] : bounds[i + 1]]
            if len(e):
                w = self.word[e]
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                out[w[first], i] = np.add.reduceat(out[w, other[e]] * weight[e], first, axis=0)
        return out


def with_prefixes(pieces: dict[str, int]) -> Trie:
    """The pieces with all their prefixes."""
    return Trie(pieces)


def edge_weights(lattice: Lattice, prob: np.ndarray, unknown: float) -> np.ndarray:
    return np.where(lattice.piece[:, None] >= 0, prob[lattice.piece], unknown)


def scores_of(words: list[str], model: LanguageModel, prefixes: Trie, unknown: float) -> np.ndarray:
    """word_scores of many words: short ones together, long ones one by one."""
    out = np.zeros((len(words), len(model.languages)))
    short = [i for i, w in enumerate(words) if len(w) < LONG_WORD]
    for i in range(0, len(short), LATTICE_WORDS):
        some = short[i : i + LATTICE_WORDS]
        lattice = Lattice([words[k] for k in some], prefixes)
        total = lattice.sums(edge_weights(lattice, model.prob, unknown))
        out[some] = np.log(total[np.arange(len(some)), lattice.length])
    for i, w in enumerate(words):
        if len(w) >= LONG_WORD:
            out[i] = word_scores(w, model, unknown)
    return out


SEPARATORS = re.compile("[\x1c-\x1f]")


def spaced(text: str | None) -> str:
    """The text with only ASCII white space between its words."""
    text = text or ""
    return text if text.isascii() and not SEPARATORS.search(text) else " ".join(text.split())


def distinct_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(hash, word): the words of all whole texts, each about once a task."""

    def split(batches):
        seen = np.zeros(0, dtype=U64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for _, some in text_slices(texts, texts, SLICE_CHARS):
                hashes, _, buf, starts, ends = placed_words([spaced(t) for t in some])
                keys, first = np.unique(hashes, return_index=True)
                if len(seen):
                    at = np.minimum(np.searchsorted(seen, keys), len(seen) - 1)
                    keys, first = keys[seen[at] != keys], first[seen[at] != keys]
                raw = buf.tobytes()
                for a in range(0, len(keys), 50_000):
                    part = first[a : a + 50_000]
                    words = [raw[x:y].decode() for x, y in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 50_000].view(np.int64)), pa.array(words, pa.string())], names=["hash", "word"])
                seen = merged(seen, keys) if len(seen) < HELD_WORDS else keys

    bounded_batches(docs.sparkSession)
    return docs.select(text_col).mapInArrow(given_back(split), "hash long, word string")


def write_scores(docs: DataFrame, model: LanguageModel, text_col: str, shipped) -> tuple[str, int]:
    """Score each distinct word of the texts once; the folder of the score files and the bits of their shards.

    A shard is one file: its sorted hashes, then their scores by language. Every
    shard has a file, so a missing one is a lost one. Of two words with one hash (one
    pair in some 10**10 words) the lesser one's scores stand for both.
    """
    spark = docs.sparkSession
    folder, bits, token = shared_path(spark, "langid-scores"), shard_bits(max(1, docs.count() // DOCS_PER_SHARD)), uuid.uuid4().hex

    def put(shard: int, rows: pa.Table):
        model = cached(("model", token), lambda: LanguageModel(**shipped.value))
        trie = cached(("trie", token), lambda: with_prefixes(model.pieces))
        first = run_starts(unsigned(rows.column("key")))  # of equal words, one becomes a string
        keys = unsigned(rows.column("key"))[first]
        scores = scores_of(rows.column("word").take(pa.array(first)).to_pylist(), model, trie, unknown_weight(model.pieces))
        order = np.argsort(keys, kind="stable")
        put_file(folder, f"{shard:06d}.scores", keys[order].astype("<u8").tobytes() + scores[order].astype("<f8").tobytes())
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(keys)], pa.int64())})

    done = sorted_shards(distinct_words(docs, text_col), F.col("hash"), bits, ["word"], put, "n long")
    done.agg(F.sum("n")).first()
    return folder, bits


class ScoreFiles:
    """Look-ups in the files of ``write_scores``."""

    def __init__(self, folder: str, bits: int, languages: int):
        self.files, self.bits, self.languages = MappedFiles(folder), bits, languages

    def shard(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        whole = self.files.get(s, "scores", "<u8")
        n = len(whole) // (1 + self.languages)
        return whole[:n], whole[n:].view("<f8").reshape(n, self.languages)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Scores of ascending hashes; each must be in its file."""
        out = np.zeros((len(keys), self.languages))
        shard = shards_of(keys, self.bits)
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                known, scores = self.shard(int(shard[a]))
                at = np.searchsorted(known, keys[a:b])
                if not len(known) or (known[np.minimum(at, len(known) - 1)] != keys[a:b]).any():
                    raise ValueError("a word of the texts has no score")
                out[a:b] = scores[at]
        return out


def text_sums(texts: list[str], table: ScoreFiles) -> np.ndarray:
    """Log likelihood of each text per language: its words' scores added up."""
    hashes, sizes, _, _, _ = placed_words([spaced(t) for t in texts])
    keys, place = np.unique(hashes, return_inverse=True)
    scores = table.get(keys)
    out = np.zeros((len(texts), table.languages))
    some = np.flatnonzero(sizes)
    if len(some):
        for k in range(table.languages):
            out[some, k] = np.add.reduceat(scores[:, k][place], offsets_of(sizes)[some])
    return out


def unknown_weight(pieces: dict[str, int]) -> float:
    """Weight of a character that is in no piece, the same for every language."""
    return 1.0 / max(1, len(pieces)) / 100


def training_words(docs: DataFrame, id_col: str, text_col: str, lang_col: str, usable: Column, max_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) of the training sample, and (lang, docs) of all usable rows.

    The sample is at most ``max_docs`` documents a language, the first in hash
    order of the row id, then of the text: a documented bound on the rows a model is
    fitted on, also where ids are null or repeated. Their texts are used whole.
    """
    rows = docs.where(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("docs"))
    order = Window.partitionBy("lang").orderBy("h", "id")
    # the rank runs over narrow rows; texts are fetched for the chosen ones only
    narrow = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(id_col, F.lit(7)).alias("h"))
    chosen = narrow.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max_docs).select("id").distinct()
    sample = rows.join(chosen, F.col(id_col).eqNullSafe(F.col("id")), "left_semi").select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    # rows that share an id, or have none, are chosen alike: the bound holds again among them
    again = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(7)), "id", F.xxhash64("text"))
    sample = sample.withColumn("r", F.row_number().over(again)).where(F.col("r") <= max_docs)

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, n in Counter(text.split()).items():
                    found[lang, w] += n
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([k[0] for k in found], pa.string()), "word": pa.array([k[1] for k in found], pa.string()), "n": pa.array(list(found.values()), pa.int64())}
            )

    words = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return words, counts


def fit(
    docs: DataFrame,
    vocabulary: str,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_docs: int = 200,
    rounds: int = 2,
    smoothing: float = 0.05,
) -> LanguageModel:
    """Piece probabilities per language from the usable rows with a text and a language.

    The first round starts from equal probabilities that fall with the length
    of a piece's share in the vocabulary (all equal); every round replaces them
    by smoothed expected counts. Without usable rows the model has no language
    and every text is undetermined.
    """
    pieces = read_pieces(vocabulary)
    longest = max(map(len, pieces))
    words, counts = training_words(docs, id_col, text_col, lang_col, usable, max_docs)
    words = written(words, "langid-words")
    per_lang = {r["lang"]: r["docs"] for r in counts.collect()}  # one row a language
    languages = sorted(per_lang)
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces), 0)), np.zeros(0))
    prob = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    unknown = unknown_weight(pieces)
    sc = docs.sparkSession.sparkContext
    for _ in range(rounds):
        shipped = sc.broadcast((pieces, prob))  # vocabulary times languages

        def expect(batches):
            known, now = shipped.value  # noqa: B023
            prefixes = with_prefixes(known)
            for batch in batches:
                total = np.zeros(now.shape)
                langs, names, counts = (batch.column(i).to_pylist() for i in range(3))
                column = np.array([languages.index(x) for x in langs])
                short = np.array([i for i, w in enumerate(names) if len(w) < LONG_WORD], dtype=np.int64)
                if len(short):
                    lattice = Lattice([names[i] for i in short], prefixes)
                    k, n = column[short], np.array(counts, dtype=float)[short]
                    weight = np.where(lattice.piece >= 0, now[lattice.piece, k[lattice.word]], unknown)[:, None]
                    alpha, beta = lattice.sums(weight)[:, :, 0], lattice.sums(weight, backward=True)[:, :, 0]
                    whole = alpha[np.arange(len(short)), lattice.length]
                    w = lattice.word
                    mass = alpha[w, lattice.start] * weight[:, 0] * beta[w, lattice.end] / whole[w] * n[w]
                    some = lattice.piece >= 0
                    np.add.at(total, (lattice.piece[some], k[w[some]]), mass[some])
                for i, word in enumerate(names):
                    if len(word) >= LONG_WORD:
                        c = column[i]
                        for p, x in zip(*expected_pieces(word, now[:, c : c + 1], known, longest, unknown), strict=True):
                            total[p, c] += x * counts[i]
                p, k = np.nonzero(total)
                yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "p": pa.array(p, pa.int32()), "w": pa.array(total[p, k])})

        sums = words.select("lang", "word", "n").repartition(F.col("word")).mapInArrow(expect, "k int, p int, w double").groupBy("k", "p").agg(F.sum("w").alias("w"))
        got = np.full(prob.shape, smoothing)
        for r in sums.toLocalIterator():  # at most vocabulary times languages
            got[r["p"], r["k"]] += r["w"]
        prob = got / got.sum(axis=0)
    docs_per = np.array([per_lang[x] for x in languages], dtype=float)
    return LanguageModel(languages, pieces, prob, np.log(docs_per / docs_per.sum()))


def predict(docs: DataFrame, model: LanguageModel, carry: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The carried columns of every row, its predicted language and score.

    ``score`` is the language's share of the posterior over the whole text. A
    text that is null or has no letter, and any text if no language was
    learned, is ``und`` with score 0. Ties go to the first language in
    alphabetical order. Texts of any length count whole; repeated rows are each
    given. A carried column with the name of a new one is replaced. An empty
    table gives no rows.
    """
    carry = [c for c in carry if c not in names]
    kept = [docs.schema[c] for c in carry]
    schema = T.StructType([*kept, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    if not model.languages:
        return docs.select(*carry, F.lit(UNDETERMINED).alias(names[0]), F.lit(0.0).alias(names[1]))
    plain = {"languages": model.languages, "pieces": model.pieces, "prob": model.prob, "log_prior": model.log_prior}
    shipped = docs.sparkSession.sparkContext.broadcast(plain)  # vocabulary times languages; plain values, as workers may lack this package
    folder, bits = write_scores(docs, model, text_col, shipped)
    languages, log_prior = model.languages, model.log_prior

    def score(batches):
        table = ScoreFiles(folder, bits, len(languages))  # unmapped when the task ends
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            at = 0
            for some, part in text_slices(texts, texts, SLICE_CHARS):
                total = text_sums(part, table) + log_prior
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                lettered = np.array([any(map(str.isalpha, t or "")) for t in part], dtype=bool)
                preds = [languages[k] if ok else UNDETERMINED for k, ok in zip(odds.argmax(axis=1).tolist(), lettered.tolist(), strict=True)]
                rows = batch.slice(at, len(some))
                columns = [*[rows.column(c) for c in carry], pa.array(preds, pa.string()), pa.array(np.where(lettered, 1.0 / odds.sum(axis=1), 0.0))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                at += len(some)

    return docs.select(*dict.fromkeys([text_col, *carry])).mapInArrow(given_back(score), schema)
