"""Packing, the token store and byte-level BPE against the tokenizer libraries."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import bpe, common, dac, langid, neardup, packing, pii, queries

from .conftest import SF001, TEXTS

WORD, BYTE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def library(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,;!?'’aAéÉΣσİß½²1٣漢́  \x1c<|>"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_chunk_encoder_equals_library(texts):
    for path, spaced in ((WORD, False), (BYTE, True)):
        enc, lib = common.chunk_encoder(common.read_text(path), spaced), library_of(path)
        for t in texts:
            assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib(t)


LIBRARY = {}


def library_of(path):
    return LIBRARY.setdefault(path, library(path))


def test_texts_encoded_together_equal_the_library():
    texts = ["one, two### x&&& end. 's it's", "", "a  b\n\nc", "x\0y", "<|endoftext|> and", "Ünï ÀÉ!? ΣΑΣ", "", "tail_", " (y)  ", "\n"]
    for path, spaced in ((WORD, False), (BYTE, True)):
        enc = common.ChunkEncoder(common.read_text(path), spaced)
        for some in (texts, texts[::-1], texts[3:4], [""], []):
            assert [np.frombuffer(ids, "<u4").tolist() for ids in enc.encode_all(some)] == [library_of(path)(t) for t in some]


def test_repeated_chunks_of_a_slice_are_looked_up_once():
    enc, looked_up = common.ChunkEncoder(common.read_text(WORD), False), []

    class Known(type(enc.known)):
        def __getitem__(self, chunk):
            looked_up.append(chunk)
            return super().__getitem__(chunk)

    enc.known.__class__ = Known
    enc.encode_all(["the cat and the dog " * 100, "the end"])
    assert sorted(looked_up) == ["", "and", "cat", "dog", "end", "the"]


def test_marks_after_a_word_spare_the_pipeline():
    for path, spaced in ((WORD, False), (BYTE, True)):
        known = common.ChunkIds(common.read_text(path), spaced)
        known["###"] = np.array(library_of(path)("###"), dtype="<u4").tobytes()
        known.tokenizer = None  # words and their marks go to the model alone
        assert np.frombuffer(known["word###"], "<u4").tolist() == library_of(path)("word###")


def test_groups_hold_few_megabytes(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("repeat('one two ', 120000)").alias("text"))
    groups = packing.pack_documents(docs, WORD).select((F.col("sequence_id") / (1 << 32)).cast("long").alias("g"), F.octet_length("ids").alias("b"))
    assert groups.groupBy("g").agg(F.sum("b").alias("b")).agg(F.max("b")).first()[0] < 1 << 25


def test_memo_overflow_keeps_results():
    enc = common.ChunkEncoder(common.read_text(BYTE), True, max_memo=3)
    for t in ["a b c d e f", "f e d c b a", "a b c"] * 2:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == library_of(BYTE)(t)


def test_best_fit_takes_the_tightest_window():
    lengths = np.array([9, 7, 6, 4, 3, 1])
    place, offset = packing.best_fit(lengths, 10)
    # 9 | 7 | 6 | 4 goes to the window with 6 | 3 to that with 7 | 1 to that with 9
    assert place.tolist() == [0, 1, 2, 2, 1, 0]
    assert offset.tolist() == [0, 0, 0, 6, 7, 9]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_fit_against_a_list_scan(lengths):
    lengths = sorted(lengths, reverse=True)
    rooms, used = [], []
    for n in lengths:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits)[1]
            rooms[i] -= n
        else:
            rooms.append(64 - n)
    place, offset = packing.best_fit(np.array(lengths, dtype=np.int64), 64)
    got = Counter()
    for p, o, n in zip(place, offset, lengths, strict=True):
        assert o == got[p]
        got[p] += n
    assert sorted(64 - v for v in got.values()) == sorted(rooms)
    del used


def check_pieces(rows, texts_of_id, window):
    lib = library_of(WORD)
    for r in rows:
        assert r.length <= window and r.offset + r.length <= window
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for some in by_seq.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    want, got = Counter(), Counter()
    for i, t in texts_of_id:
        ids = [*lib(t), 1]
        for a in range(0, len(ids), window):
            want[i, a, crc(ids[a : a + window]), len(ids)] += 1
    for r in rows:
        got[r.doc_id, r.start, zlib.crc32(r.ids), r.doc_tokens] += 1
    assert got == want


def test_packing_edge_cases(spark, dirty, empty):
    rows = packing.pack_documents(dirty, WORD, window=64).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in dirty.collect()], 64)
    assert packing.pack_documents(empty, WORD).count() == 0


def test_packing_query(spark, small_docs):
    rows = queries.op1_packing(spark, SF001).toPandas()
    lib = library_of(WORD)
    total = 0
    for i, t in zip(small_docs.doc_id, small_docs.text, strict=True):
        ids = [*lib(t), 1]
        total += len(ids)
        mine = rows[rows.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        assert [crc(ids[a : a + n]) for a, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
    assert total / (2048 * rows.sequence_id.nunique()) > 0.95


def test_packing_groups_are_deterministic(spark, dirty):
    pieces = packing.token_pieces(dirty.where("doc_id is not null").dropDuplicates(["doc_id"]), WORD, 64, 1)
    one = {(r.doc_id, r.start): (r.sequence_id, r.offset) for r in packing.pack(pieces, 64, 3).collect()}
    two = {(r.doc_id, r.start): (r.sequence_id, r.offset) for r in packing.pack(pieces.repartition(5), 64, 3).collect()}
    assert one == two and len({s >> 32 for s, _ in one.values()}) == 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_codes_give_any_id_back(ids):
    reader = dac.DacReader(dac.dac_encode(np.array(ids, dtype=np.uint32)))
    assert len(reader) == len(ids)
    for i in range(0, len(ids), 7):
        assert reader[i] == ids[i]
    for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids), len(ids))):
        assert reader.span(a, b - a).tolist() == ids[a:b]


def test_codes_reject_other_data_and_places():
    with pytest.raises(ValueError):
        dac.DacReader(b"nope" + bytes(20))
    with pytest.raises(IndexError):
        dac.DacReader(dac.dac_encode(np.array([1], dtype=np.uint32)))[1]


def test_store_round_trip(spark, dirty, empty):
    path = common.shared_path(spark, "test-store")
    dac.write_store(dirty, BYTE, 2, path, shard_ids=50)
    rows = dac.read_store(spark, path).orderBy("start").collect()
    lib = library_of(BYTE)
    source = sorted(((r.doc_id, r.text) for r in dirty.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    at, flat = 0, []
    for r, (i, t) in zip(rows, source, strict=True):
        ids = [*lib(t), 2]
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (i, at, len(ids), crc(ids))
        at += len(ids)
        flat += ids
    asked = [0, 1, 5, 5, len(flat) - 1, len(flat), -1, None]
    got = dac.tokens_at(spark, path, spark.createDataFrame([(x,) for x in asked], "position long")).collect()
    assert sorted((r.position, r.id) for r in got) == sorted((x, flat[x]) for x in [0, 1, 5, 5, len(flat) - 1])
    assert dac.encode_documents(empty, BYTE).count() == 0


def test_codes_are_read_without_a_shuffle(spark, dirty):
    path = common.shared_path(spark, "test-store")
    dac.write_store(dirty, BYTE, 2, path, shard_ids=50)
    read = dac.read_store(spark, path)
    assert "hashpartitioning" not in read._jdf.queryExecution().executedPlan().toString()
    assert read.count() == dirty.count()


def test_store_query(spark, small_docs):
    rows = {r.doc_id: r for r in queries.op4_token_store(spark, SF001).collect()}
    lib, at = library_of(BYTE), 0
    for i, t in sorted(zip(small_docs.doc_id, small_docs.text, strict=True)):
        ids = [*lib(t), 2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.binary(max_size=30))
def test_merges_equal_the_library(text, raw):
    ranks, enc = LIBRARY.setdefault("ranks", bpe.read_ranks(RANKS)), LIBRARY.setdefault("tik", tik())
    find = regex.compile(P.PATTERN).findall
    words = [w for c in common.spaced_chunks(text) for w in bpe.pre_tokens(c, find)]
    assert words == find(text)
    assert [i for w in words for i in bpe.merge_ranks(w.encode(), ranks)] == enc.encode_ordinary(text)
    if raw:
        assert bpe.merge_ranks(raw, ranks) == enc._encode_single_piece(raw)


def test_long_word_is_merged_right():
    word = ("abcdefgh" * 700).encode()
    assert bpe.merge_ranks(word, bpe.read_ranks(RANKS)) == tik()._encode_single_piece(word)


def test_bpe_edge_cases(spark, dirty, empty):
    enc = tik()
    tokens = bpe.encode(dirty, RANKS, P.PATTERN)
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in bpe.decode(tokens, RANKS).collect())
    want = Counter((r.doc_id, tuple(enc.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in dirty.collect())
    assert got == want
    assert bpe.encode(empty, RANKS, P.PATTERN).count() == 0


def test_decode_nulls_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, [], "y"), (3, [72], "z")], "k int, ids array<int>, decoded string")
    assert {r.k: r.decoded for r in bpe.decode(df, RANKS).collect()} == {1: None, 2: bytearray(b""), 3: bytearray(tik().decode_bytes([72]))}
    with pytest.raises(Exception, match="no entry"):
        bpe.decode(spark.createDataFrame([(1, [50256])], "k int, ids array<int>"), RANKS).collect()
    assert bpe.token_bytes(spark, RANKS).where(F.col("id") == 72).first().token == bytearray(tik().decode_bytes([72]))


def test_words_with_one_hash_are_encoded_where_they_are_met(spark, monkeypatch):
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "word string")
    assert bpe.write_words(keys, RANKS, common.shared_path(spark, "words"), 4) == 3
    got = keys.distinct().select("word", F.xxhash64("word").alias("k")).collect()
    assert [np.int64(k) for k in bpe.word_keys([r.word for r in got]).view(np.int64)] == [r.k for r in got]
    ranks = bpe.read_ranks(RANKS)
    assert bpe.merged("c", ranks) == np.array([ranks[b"c"]], "<u4").tobytes()


def test_bpe_query(spark, small_docs):
    enc = tik()
    rows = {r.doc_id: r for r in queries.op5_byte_bpe(spark, SF001).collect()}
    assert len(rows) == len(small_docs)
    for i, t in zip(small_docs.doc_id, small_docs.text, strict=True):
        ids = enc.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_texts_are_whole():
    assert any(len(t or "") > 10_000 for t in TEXTS)


def test_added_tokens_in_texts_get_the_ids_of_the_library():
    texts = ["a <|endoftex b", "a <|endoftext|> b", "x<|endoftext|><|startoftext|>", "<|ENDOFTEXT|> <|endoftext|", "<|startoftext|>  A\n É"]
    for path, spaced in ((WORD, False), (BYTE, True)):
        enc, unmodified = common.chunk_encoder(common.read_text(path), spaced), Tokenizer.from_file(path)
        for t in texts:
            assert np.frombuffer(enc.encode(t), dtype="<u4").tolist() == unmodified.encode(t, add_special_tokens=False).ids
    assert 50256 in unmodified.encode(texts[1], add_special_tokens=False).ids


def test_words_are_encoded_alike_by_the_library_and_the_heap():
    ranks = bpe.read_ranks(RANKS)
    encoder = bpe.WordEncoder(ranks)
    for word in [" word", "Ünïcödé", "", "\n\n\n", "漢字仮名", "x" * 199, "xy" * 150, " \x00"]:
        assert encoder.ids(word) == bpe.merge_ranks(word.encode(), ranks) if word else encoder.ids(word) == []


def test_repeated_rows_are_spread_over_the_groups(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    got = packing.pack_documents(rows, WORD, window=64, docs_per_group=500).select("sequence_id", "length").collect()
    assert sum(r.length for r in got) == 20_000 * got[0].length and len(got) == 20_000
    groups = Counter(r.sequence_id >> 32 for r in got)
    assert len(groups) > 30 and max(groups.values()) < 1500


def test_texts_reach_python_in_bounded_batches(spark, dirty):
    long = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([batch.nbytes], pa.int64())})

    def largest():
        return long.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0]

    before = spark.conf.get(common.BATCH_CONF, None)
    try:
        for plan in (
            lambda: packing.pack_documents(dirty, WORD),
            lambda: pii.pseudonymize(dirty, "key"),
            lambda: langid.distinct_words(dirty, "text"),
            lambda: neardup.classes(dirty.select("doc_id", "text")),
        ):
            spark.conf.unset(common.BATCH_CONF)
            plan()
            assert largest() < 2 * common.BATCH_BYTES
        spark.conf.set(common.BATCH_CONF, "16m")
        packing.pack_documents(dirty, WORD)
        assert spark.conf.get(common.BATCH_CONF) == "16m"
    finally:
        spark.conf.unset(common.BATCH_CONF) if before is None else spark.conf.set(common.BATCH_CONF, before)
