"""Near-duplicate detection by improved consistent weighted sampling.

A text is the weighted set of its word shingles: term frequency times an
inverse document frequency that is clipped, idf = ln(1 + 1 / max(df/N, theta)).
Only shingles in more than a share theta of the documents differ from the rest,
and there are at most (mean distinct shingles a document) / theta of those,
however large the corpus. They are found exactly: such a shingle is above
theta in at least one task's documents, so the first pass proposes and the
second counts.

Consistent weighted samples of each set agree with the probability of the
weighted Jaccard similarity. Samples are banded; texts that share a band are
candidates; candidates are verified on whole texts by their weighted Jaccard
similarity. Equal texts are one node from the start. In a band's bucket every
text is compared with the few best connected ones; the classes so found are
joined, and only texts of one bucket in different classes are compared
further, in cells of bounded size that give out no pairs but the links that
join two classes. No class is split, and no pairs of a group are listed.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import U64, bounded_batches, cached, given_back, hash_words, id_texts, mix64, offsets_of, ranges, shared_path, text_slices, written
from ledgerlens.llm.hash_tables import mapped_table, write_table

WORDS, SIMILARITY, THETA = 5, 0.8, 0.01
BANDS, ROWS = 14, 4
LEADERS = 3  # best connected texts of a bucket that all its texts are compared with first
SLICE_CHARS = 2_000_000
VERIFY_CHARS = 1_000_000  # of candidate texts held as shingles at a time
FEW_DOCS, HELD_KEYS = 500, 2_000_000  # slices of fewer documents are counted together, up to that many shingles
MARKS = string.punctuation.encode()
STEP = 1 << 12  # entries of the tables of random variates
ESTIMATE = 0.6  # share of agreeing samples below which a pair is not verified: 3.8 standard errors under 0.8


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of ``words`` words, and each text's number of them.

    Words are what white space separates, in lower case and without the ASCII
    marks around them. A text with fewer words has one shingle of all its words; a
    text without words has none.
    """
    hashes, sizes = hash_words([t.lower() for t in texts], MARKS)
    counts = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    at = offsets_of(sizes)
    n = len(hashes)
    run = hashes.copy()
    for j in range(1, words):  # short texts are done below
        nxt = np.zeros(n, dtype=U64)
        nxt[: max(0, n - j)] = hashes[j:]
        run = run * U64(0x9E3779B97F4A7C15) + nxt
    keep = np.zeros(n, dtype=bool)
    ends = np.repeat(at[1:], sizes)
    keep[np.arange(n) + words <= ends] = True
    for i in np.flatnonzero((sizes > 0) & (sizes < words)):
        whole = U64(sizes[i])
        for h in hashes[at[i] : at[i + 1]]:
            whole = mix64(np.array([whole ^ h], dtype=U64))[0]
        run[at[i]], keep[at[i]] = whole, True
    return mix64(run[keep]), counts


def weighted_sets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text in ascending order, with their term frequencies."""
    flat, counts = shingles(texts)
    at = offsets_of(counts)
    return [np.unique(flat[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]


class Weights:
    """Clipped idf: exact for the frequent shingles of the table, the same for all others."""

    def __init__(self, folder: str | None, n_docs: int, theta: float):
        self.table = mapped_table(folder, 1) if folder else None
        self.n_docs, self.rare = max(1, n_docs), math.log1p(1 / theta)

    def idf(self, keys: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.full(len(keys), self.rare)
        df = self.table.get(keys)
        return np.where(df > 0, np.log1p(self.n_docs / np.maximum(df, 1)), self.rare)


def gamma_quantiles() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of STEP equal parts, by Newton's method."""
    p = (np.arange(STEP) + 0.5) / STEP
    x = np.sqrt(2 * p) + p
    for _ in range(40):
        x = np.maximum(x - (1 - np.exp(-x) * (1 + x) - p) / (x * np.exp(-x)), x / 8)
    return x


class ConsistentSampler:
    """K consistent weighted samples of a set.

    Of element s with weight w, with r, c ~ Gamma(2, 1) and b ~ U(0, 1) drawn
    from the hash of (k, s): t = floor(u) for u = ln w / r + b, and
    ln a = ln c - r (t - b) - r, which is ln c - ln w - r (1 - (u - t)). The
    sample is the (s, t) with the least a.
    """

    def __init__(self, n_samples: int = BANDS * ROWS):
        q = gamma_quantiles()
        self.r, self.log_c = q.astype(np.float32), np.log(q).astype(np.float32)
        self.factors = (mix64(np.arange(1, n_samples + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1))[:, None]

    def samples(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit value a sample; equal for two sets with the probability of their weighted Jaccard similarity."""
        log_w = np.log(weights).astype(np.float32)
        k = len(self.factors)
        best, out, every = np.full(k, np.inf, dtype=np.float32), np.zeros(k, dtype=U64), np.arange(k)
        for a in range(0, len(keys), 1024):
            some, lw = keys[a : a + 1024], log_w[a : a + 1024]
            h = some[None, :] * self.factors
            h ^= h >> U64(29)
            h *= U64(0xBF58476D1CE4E5B9)
            r = self.r.take((h >> U64(52)).view(np.int64), mode="clip")
            low = self.log_c.take(((h >> U64(40)) & U64(STEP - 1)).view(np.int64), mode="clip")
            b = ((h >> U64(16)) & U64(0xFFFFFF)).astype(np.float32)
            b *= np.float32(2.0**-24)
            u = lw / r
            u += b
            t = np.floor(u)
            u -= t
            u -= np.float32(1)
            u *= r
            low += u
            low -= lw
            at = low.argmin(axis=1)
            least = low[every, at]
            chosen = mix64(some[at] ^ (t[every, at].astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15)))
            better = least < best
            best[better], out[better] = least[better], chosen[better]
        return out


def frequent_shingles(docs: DataFrame, n_docs: int, theta: float = THETA) -> str | None:
    """Folder of the table of document frequencies above ``theta * n_docs``; None if there are none."""

    def frequencies(batches):
        """Document frequencies within each slice of a task, with the slice's number of documents."""
        for batch in batches:
            for _, texts in text_slices(*id_texts(batch), SLICE_CHARS):
                sets = weighted_sets(texts)
                yield (*np.unique(np.concatenate([k for k, _ in sets]) if sets else np.zeros(0, dtype=U64), return_counts=True), len(texts))

    def given(keys, n):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "value"])

    def propose(batches):
        """Shingles above theta in a slice; a task's slices of few, long documents are put together first."""
        held, docs_held = [], 0

        def flush():
            keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(where, np.concatenate([x for _, x in held]), len(keys)).astype(np.int64)
            return given(keys[n > theta * docs_held], n[n > theta * docs_held])

        for keys, n, size in frequencies(batches):
            held.append((keys, n))
            docs_held += size
            if docs_held >= FEW_DOCS or sum(len(k) for k, _ in held) > HELD_KEYS:
                yield flush()
                held, docs_held = [], 0
        if held:
            yield flush()

    folder = shared_path(docs.sparkSession, "frequent")
    proposed = docs.mapInArrow(given_back(propose), "key long, value long").groupBy("key").agg(F.sum("value").alias("value"))
    # every text is counted in one proposal, so a share above theta overall is above it in some proposal
    n_shards = max(1, n_docs // 50_000)
    if not write_table(proposed, f"{folder}/proposed", n_shards):
        return None

    def count(batches):
        """One count a proposed shingle and task."""
        known = mapped_table(f"{folder}/proposed", n_shards)
        all_keys, sums = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        for keys, n, _ in frequencies(batches):
            some = known.get(keys) >= 0
            all_keys, where = np.unique(np.concatenate([all_keys, keys[some]]), return_inverse=True)
            sums = np.bincount(where, np.concatenate([sums, n[some]]), len(all_keys)).astype(np.int64)
        yield given(all_keys, sums)

    exact = docs.mapInArrow(given_back(count), "key long, value long").groupBy("key").agg(F.sum("value").alias("value")).where(F.col("value") > theta * n_docs)
    return f"{folder}/exact" if write_table(exact, f"{folder}/exact", 1) else None


def signatures(docs: DataFrame, folder: str | None, n_docs: int, theta: float = THETA) -> DataFrame:
    """(id, text_key, bands, samples) of rows (id, text, text_key); a text without words has no bands."""

    def sign(batches):
        sampler, weights = cached("sampler", ConsistentSampler), Weights(folder, n_docs, theta)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bands, samples = [], []
            for _, some in text_slices(texts, texts, SLICE_CHARS):
                for keys, tf in weighted_sets(some):
                    if not len(keys):
                        bands.append([])
                        samples.append(b"")
                        continue
                    own = sampler.samples(keys, tf * weights.idf(keys))
                    band = np.arange(BANDS, dtype=U64)
                    for row in own.reshape(BANDS, ROWS).T:
                        band = mix64(band ^ row)
                    bands.append(band.view(np.int64))
                    samples.append(own.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bands, pa.list_(pa.int64())), pa.array(samples, pa.binary())], names=["id", "text_key", "bands", "samples"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", "text_key").mapInArrow(given_back(sign), f"id {kind}, text_key string, bands array<long>, samples binary")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets (keys ascending)."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][ia], b[1][ib]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low)) if len(a[0]) and len(b[0]) else 0.0


def likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of (a, b) pairs, those whose samples agree often enough to be verified."""
    with_samples = pairs.join(texts.select(F.col("text_key").alias("a"), F.col("samples").alias("sa")), "a").join(
        texts.select(F.col("text_key").alias("b"), F.col("samples").alias("sb")), "b"
    )

    def agree(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for c in ("sa", "sb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= ESTIMATE))

    return with_samples.mapInArrow(agree, "a string, b string")


def verified(pairs: DataFrame, whole: DataFrame, folder: str | None, n_docs: int, theta: float = THETA, at_least: float = SIMILARITY) -> DataFrame:
    """Of distinct (a, b) pairs, those whose whole texts are similar; ``whole`` is (text_key, text)."""
    both = pairs.join(whole.select(F.col("text_key").alias("a"), F.col("text").alias("text_a")), "a").join(
        whole.select(F.col("text_key").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def compare(batches):
        weights = Weights(folder, n_docs, theta)

        def weighted(texts):
            return [(k, tf * weights.idf(k)) for k, tf in weighted_sets(texts)]

        for batch in batches:
            b, text_a, text_b = (batch.column(c).to_pylist() for c in ("b", "text_a", "text_b"))
            keep, at = np.zeros(len(b), dtype=bool), 0
            last, last_set = None, None
            for _, some in text_slices(text_a, text_a, VERIFY_CHARS):
                for i, x in enumerate(weighted(some), at):
                    if b[i] != last:  # pairs of one text follow each other
                        last, last_set = b[i], weighted([text_b[i]])[0]
                    keep[i] = similarity(x, last_set) >= at_least
                at += len(some)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(given_back(compare), "a string, b string").distinct()


def components(links: DataFrame) -> DataFrame:
    """(text_key, class_key) of the linked texts: the least key of each connected component.

    Each round every node points to its least neighbour, pointers are followed
    to their ends by doubling, and links are drawn anew between the ends; a
    round at least halves the nodes with links. All tables are narrow and
    written between the steps.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    mapping = None
    while not edges.isEmpty():
        up = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up"))
        up = written(up, "pointers")
        while True:  # two doublings a step
            twice = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"))
            upper = twice.select(F.col("node").alias("up"), F.col("up").alias("top"))
            step = written(twice.join(upper, "up").select("node", F.col("top").alias("new"), (F.col("top") != F.col("up")).alias("moved")), "pointers")
            up = step.select("node", F.col("new").alias("up"))
            if step.where("moved").isEmpty():
                break
        if mapping is None:
            mapping = up.select(F.col("node").alias("text_key"), F.col("up").alias("class_key"))
        else:
            later = up.select(F.col("node").alias("class_key"), "up")
            mapping = written(mapping.join(later, "class_key", "left").select("text_key", F.coalesce("up", "class_key").alias("class_key")), "classes")
        first, second = (up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in ("a", "b"))
        edges = written(edges.join(first, "a").join(second, "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).where("a <> b").distinct(), "links")
    return mapping if mapping is not None else links.select(F.col("a").alias("text_key"), F.col("b").alias("class_key")).limit(0)


def cell_similarities(sets: list[tuple[np.ndarray, np.ndarray]]):
    """A function of a weighted set that gives its weighted Jaccard similarity to each of ``sets``."""
    sizes = np.fromiter((len(k) for k, _ in sets), dtype=np.int64, count=len(sets))
    keys = np.concatenate([k for k, _ in sets])
    order = np.argsort(keys, kind="stable")
    keys, owner, weight = keys[order], np.repeat(np.arange(len(sets)), sizes)[order], np.concatenate([w for _, w in sets])[order]
    total = np.array([w.sum() for _, w in sets])

    def similar(one: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        first, last = np.searchsorted(keys, one[0]), np.searchsorted(keys, one[0], "right")
        at = ranges(first, last - first)
        low = np.bincount(owner[at], np.minimum(weight[at], np.repeat(one[1], last - first)), len(total))
        return low / np.maximum(total + one[1].sum() - low, 1e-300)

    return similar


def across_classes(members: DataFrame, folder: str | None, n_docs: int, theta: float = THETA, at_least: float = SIMILARITY, cell_rows: int = 1024, slot_rows: int = 4096) -> DataFrame:
    """(a, b) links between texts that share a bucket but not a class, enough of them to join their classes.

    ``members`` is (bucket, text_key, class_key, leader_class, text), buckets of more than one class
    only. Every text outside the class of the bucket's leader is compared with all texts of the
    bucket on their whole texts. Both sides are cut into cells of bounded size. A cell of more
    than a few rows is loaded by itself, small cells share slots whose number follows the
    rows they hold. A slot gives out a link only if it joins two classes that its earlier links did not.
    """
    outside = F.col("class_key") != F.col("leader_class")
    n, rest = F.count(F.lit(1)), F.count_if(outside)
    sizes = (
        members.groupBy("bucket").agg(n.alias("n"), rest.alias("rest"), F.ceil(n / cell_rows).cast("int").alias("all_cells"), F.ceil(rest / cell_rows).cast("int").alias("rest_cells"))
        .withColumn("load", F.col("rest") * F.col("all_cells") + F.col("n") * F.col("rest_cells"))  # rows once they are replicated to the cells
        .withColumn("alone", F.col("load") > F.col("all_cells").cast("long") * F.col("rest_cells") * (slot_rows // 16))
        .drop("n", "rest")
    )
    sizes = written(sizes, "sizes")
    pooled = sizes.where(~F.col("alone")).agg(F.sum("load")).first()[0] or 0
    slots = max(1, math.ceil(pooled / slot_rows))
    members = members.join(sizes.drop("load"), "bucket")

    def slotted(df: DataFrame, own: str, other: str, side: str) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("text_key"), F.col(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        df = df.withColumn("cell", F.xxhash64("bucket", "all_cells", "rest_cells"))
        df = df.withColumn("slot", F.when(F.col("alone"), F.col("cell")).otherwise(F.pmod("cell", F.lit(slots))))
        return df.select(*[F.col(c).alias(f"{c}_{side}") for c in ("slot", "cell", "text_key", "class_key", "text")])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[str, str]] = []
        if left.num_rows and right.num_rows:
            weights, root = Weights(folder, n_docs, theta), {}

            def find(x: str) -> str:
                while x in root:
                    x = root[x]
                return x

            left, right = left.sort_by("cell_l"), right.sort_by("cell_r")
            cells_l, cells_r = left.column("cell_l").to_numpy(), right.column("cell_r").to_numpy()
            for cell in np.unique(cells_l):
                parts = []
                for table, cells, side in ((left, cells_l, "l"), (right, cells_r, "r")):
                    lo, hi = np.searchsorted(cells, cell), np.searchsorted(cells, cell, "right")
                    key, of, text = (table.column(f"{c}_{side}").slice(lo, hi - lo).to_pylist() for c in ("text_key", "class_key", "text"))
                    parts.append((key, of, [(k, tf * weights.idf(k)) for k, tf in weighted_sets(text)]))
                (key_l, of_l, sets_l), (key_r, of_r, sets_r) = parts
                if not key_r:
                    continue
                similar = cell_similarities(sets_r)
                for x, c, one in zip(key_l, of_l, sets_l, strict=True):
                    for j in np.flatnonzero(similar(one) >= at_least).tolist():
                        p, q = find(c), find(of_r[j])
                        if p != q:
                            root[max(p, q)] = min(p, q)
                            out.append((min(x, key_r[j]), max(x, key_r[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.string()), "b": pa.array([y for _, y in out], pa.string())})

    rest = slotted(members.where(outside), "rest_cells", "all_cells", "l")
    every = slotted(members, "all_cells", "rest_cells", "r")
    return rest.groupBy("slot_l").cogroup(every.groupBy("slot_r")).applyInArrow(compare, "a string, b string").distinct()


def _verify(pairs: DataFrame, texts: DataFrame, whole: DataFrame, folder: str | None, n_docs: int) -> DataFrame:
    """Links among candidate pairs, the lesser key first."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return verified(likely(pairs, texts), whole, folder, n_docs)


def _mixed(members: DataFrame, leaders: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one class, with their and their bucket's leading class."""
    leading = leaders.join(found.select(F.col("text_key").alias("leader"), F.col("class_key").alias("leader_class")), "leader", "left")
    placed = (
        members.join(found, "text_key", "left")
        .join(leading.select("bucket", F.coalesce("leader_class", "leader").alias("leader_class")), "bucket")
        .select("bucket", "text_key", F.coalesce("class_key", "text_key").alias("class_key"), "leader_class")
    )
    mixed = placed.groupBy("bucket").agg(F.min("class_key").alias("x"), F.max("class_key").alias("y")).where("x <> y").select("bucket")
    return placed.join(mixed, "bucket")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text_key, class_key, class_id, class_texts, class_rows, first_id, links): every distinct text with its class.

    ``class_id`` is the least id of the class, ``class_texts`` and ``class_rows`` count its distinct
    texts and rows, ``first_id`` is the least id of the text, ``links`` the number of its verified
    links that were needed to find the classes. Null texts are no part of it; the empty text is one text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").withColumn("text_key", F.md5(F.col("text").cast("binary")))
    n_docs = docs.count()
    bounded_batches(docs.sparkSession)
    folder = frequent_shingles(rows.select("id", "text"), n_docs)
    signed = signatures(rows, folder, n_docs)
    texts = written(
        signed.groupBy("text_key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands"), F.first("samples").alias("samples")), "texts"
    )

    # candidates: in each bucket of more than one text, all against those that share most buckets
    entries = texts.select("text_key", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = entries.join(buckets, "bucket")
    degree = shared.groupBy("text_key").agg(F.sum("n").alias("degree"))
    members = written(shared.select("bucket", "text_key").join(degree, "text_key"), "members")
    by_degree = Window.partitionBy("bucket").orderBy(F.desc("degree"), "text_key")
    leaders = members.withColumn("r", F.row_number().over(by_degree)).where(F.col("r") <= LEADERS).select("bucket", F.col("text_key").alias("leader"), "r")
    needed = members.select("text_key").distinct().join(texts.select("text_key", "id"), "text_key")
    # joined by text and id together, so that copies of one text are spread by their ids
    parts = [F.col("id").isNull().alias("no_id"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id_text")]
    some = rows.select("text_key", "text", *parts).join(needed.select("text_key", *parts), ["text_key", "no_id", "id_text"], "left_semi")
    whole = written(some.select("text_key", "text").dropDuplicates(["text_key"]), "candidates")  # repeated rows and copies without an id are one
    pairs = members.join(leaders, "bucket").where("text_key <> leader").select(F.col("text_key").alias("a"), F.col("leader").alias("b"))
    links = written(_verify(pairs, texts, whole, folder, n_docs), "verified")
    found = components(links)

    # texts that share a bucket but not yet a class
    mixed = written(_mixed(members, leaders.where("r = 1"), found).join(whole, "text_key"), "mixed")
    if not mixed.isEmpty():
        links = written(links.union(across_classes(mixed, folder, n_docs)).distinct(), "verified")
        found = components(links)

    n_links = links.select(F.explode(F.array("a", "b")).alias("text_key")).groupBy("text_key").agg(F.count(F.lit(1)).alias("links"))
    placed = texts.select("text_key", "id", "rows").join(found, "text_key", "left").withColumn("class_key", F.coalesce("class_key", "text_key"))
    summary = placed.groupBy("class_key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_texts"), F.sum("rows").alias("class_rows"))
    return (
        placed.join(summary, "class_key")
        .join(n_links, "text_key", "left")
        .select("text_key", "class_key", "class_id", "class_texts", "class_rows", F.col("id").alias("first_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def document_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, class_id, class_rows, links, kept).

    ``kept`` marks the row with the class's least id. A null text is a class of its own.
    """
    found = classes(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.col(text_col).cast("binary")).alias("text_key"))
    joined = rows.join(found, "text_key", "left")
    own = F.col("text_key").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(own, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_rows", F.lit(1)).alias("class_rows"),
        F.coalesce("links", F.lit(0)).alias("links"),
        (own | F.col("id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each class: the one with the least id (nulls last).

    Equal rows count once. Rows with a null text are kept. Columns are unchanged.
    The kept rows' hashes are looked up in a mapped table as documents are
    read, so no text is shuffled again.
    """
    keep, spark = docs.columns, docs.sparkSession
    found = written(classes(docs, id_col, text_col), "classes")
    parts = {
        "__key": F.md5(F.col(text_col).cast("binary")),
        "__no_id": F.col(id_col).isNull(),
        "__id": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
    }
    keyed = docs.where(F.col(text_col).isNotNull()).withColumns(parts).withColumn("__hash", F.xxhash64(*parts))
    # of the class's texts, the one that has the least id; ties go to the least text key
    best = found.groupBy("class_key").agg(F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "text_key")).alias("m"))
    chosen = best.select(F.col("m.text_key").alias("__key"), F.col("m.no_id").alias("__no_id"), F.coalesce(F.col("m.first_id").cast("string"), F.lit("")).alias("__id"))
    copies = keyed.groupBy("__hash", *parts).agg(F.count(F.lit(1)).alias("value")).join(chosen, list(parts), "left_semi")
    folder, n_shards = shared_path(spark, "kept"), max(1, docs.count() // 50_000)
    write_table(copies.groupBy("__hash").agg(F.max("value").alias("value")), folder, n_shards, "__hash")
    schema = T.StructType([*keyed.schema.fields, T.StructField("__n", T.LongType())])

    def look_up(batches):
        table = mapped_table(folder, n_shards)
        for batch in batches:
            n = table.get(batch.column("__hash").to_numpy().view(U64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names=schema.names).filter(pa.array(n > 0))

    kept = keyed.mapInArrow(given_back(look_up), schema)
    once = kept.where("__n = 1").unionByName(kept.where("__n > 1").dropDuplicates(list(parts)))
    return once.select(*keep).unionByName(docs.where(F.col(text_col).isNull()).select(*keep))
