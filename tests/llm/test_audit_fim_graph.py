"""Filter audit, fill-in-the-middle and graph near-duplicates against brute force."""

import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import filter_audit, fim, graph_dedup, hnsw, queries

from .conftest import SF001

# ---- fill in the middle


def plain_fim(doc_id, text, seed="1"):
    """By slicing, as the contract states it."""
    t, x = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    if h4 % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fim_of_dirty_rows(spark, dirty):
    more = [(100 + i, t) for i, t in enumerate(["<P>", "a<S>b", "<<P", "P><S", "<M" * 50, "é🙂" * 70_000, "x" * 300_000 + "é", "\n", "🙂"])]
    docs = dirty.select("doc_id", "text", F.lit("clash").alias("form"), F.lit(1).alias("output"), "source").unionByName(
        spark.createDataFrame(more, "doc_id long, text string").withColumns({"form": F.lit("clash"), "output": F.lit(1), "source": F.lit(None).cast("string")})
    )
    out = fim.restore(fim.transform(docs, carry=docs.columns)).collect()
    want = sorted(((r.doc_id, *plain_fim(r.doc_id, r.text), r.text or "", r.source) for r in docs.collect()), key=str)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored, r.source) for r in out), key=str)
    assert got == want
    assert {"plain", "psm", "spm"} <= {w[2] for w in want}


def test_fim_of_no_rows_and_wrong_outputs(spark, empty):
    assert fim.restore(fim.transform(empty)).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert fim.restore(fim.transform(empty)).count() == 0
    rows = spark.createDataFrame([(None, "psm"), ("text", None)], "output string, form string")
    assert sorted((r.output or "", r.restored or "") for r in fim.restore(rows).collect()) == [("", ""), ("text", "text")]
    with pytest.raises(ValueError):
        fim.rebuild("no sentinel", "psm")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>PSMé🙂a", max_size=40), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["psm", "spm"]))
def test_fim_round_trip(text, a, b, form):
    if any(x in text for x in fim.SENTINELS):
        return
    low, high = sorted((min(a, len(text)), min(b, len(text))))
    output = fim.arrange(text, low, high, form)
    pre, mid, suf = text[:low], text[low:high], text[high:]
    assert output == (f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}")
    assert fim.rebuild(output, form) == text


def test_rotation_over_many_blocks(monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 7)
    for n, m in itertools.product((0, 1, 2, 13, 14, 15, 100), (0, 1, 5, 14, 50)):
        view = np.arange(n, dtype=np.uint8)
        fim.rotate(view, 0, min(m, n), n)
        assert view.tolist() == [*range(min(m, n), n), *range(min(m, n))]
    text = "aé🙂" * 20
    view = np.frombuffer(text.encode(), np.uint8)
    assert fim.byte_places(view, [0, 1, 30, 59, 60]) == [len(text[:k].encode()) for k in (0, 1, 30, 59, 60)]


# ---- filter audit


def failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
    return out | ({"D"} if re.search(r"[#$%&*|]", text) else set())


def plain_audit(rows, labels):
    """Every order applied to every row."""
    texts = [(i, t or "", lang or "") for i, t, lang in rows]
    fails = []
    for i, t, _ in texts:
        later = i is not None and any(j is not None and j < i and t == u for j, u, _ in texts)
        fails.append(failed(t) | ({"E"} if later else set()))
    out, shapley = {}, {}
    for part in {p for _, _, p in texts}:
        mine = [(i, f) for (i, _, p), f in zip(texts, fails, strict=True) if p == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                lost = [sum((i, c) in labels for i, _ in gone) for c in ("good", "toxic")]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
                out[part, "".join(order), step, x] = (len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine), *lost)
    return {k: (*v, shapley[k[0], k[3]]) for k, v in out.items()}


def audit_rows(df):
    return {(r.part, r.filter_order, r.step, r.filter): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


LABELS = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "quality", "toxic")])


def marked(labels):
    return {(r.doc_id, c) for r in labels.collect() for c, v in (("good", r.quality), ("toxic", r.toxic)) if v == 1 and r.doc_id is not None}


def test_audit_of_dirty_rows(spark, dirty):
    labels = spark.createDataFrame([(0, 1, None), (0, 0, 1), (1, 1, 0), (2, None, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1)], LABELS)
    docs = dirty.withColumn("done", F.lit("x")).withColumn("n", F.lit("y"))
    got = audit_rows(filter_audit.audit(docs, labels, filter_audit.text_filters(F.coalesce("text", F.lit(""))), "E"))
    want = plain_audit([(r.doc_id, r.text, r.lang) for r in dirty.collect()], marked(labels))
    assert got == want and len(got) == 2 * 600


def test_audit_of_small_table(spark):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    got = audit_rows(queries.op11_filter_audit(spark, SF001))
    assert got == plain_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], marked(labels))
    assert any(v[3] for v in got.values()) and any(v[2] for v in got.values())


def test_audit_of_no_rows_and_of_two_filters(spark, empty, dirty):
    labels = spark.createDataFrame([], LABELS)
    filters = filter_audit.text_filters(F.coalesce("text", F.lit("")))
    assert filter_audit.audit(empty, labels, filters, "E").count() == 0
    two = filter_audit.audit(dirty, labels, {"x": F.col("text").isNull()}, "later", part_col="source").collect()
    assert {r.filter_order for r in two} == {"xlater", "laterx"} and all(r.part in ("", "a", "b") for r in two)
    with pytest.raises(ValueError):
        filter_audit.audit(dirty, labels, {str(i): F.lit(True) for i in range(9)}, "E")


# ---- near-duplicate embeddings


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("h", T.StringType()), T.StructField("n_links", T.StringType()), T.StructField("key", T.StringType())])


def plain_links(rows, at_least=0.9):
    """(n_links, component) of each (id, vector): all pairs."""
    ok = [i for i, (one, v) in enumerate(rows) if one is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    by_vector = sorted({(rows[i][0], tuple(rows[i][1])) for i in ok})
    unit = [np.array(v) / max(map(abs, v)) for _, v in by_vector]
    unit = [u / np.linalg.norm(u) for u in unit]
    near = {i: {j for j in range(len(unit)) if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= at_least} for i in range(len(unit))}
    least = {}
    for i in range(len(unit)):
        if i not in least:
            seen, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            least.update(dict.fromkeys(seen, min(by_vector[j][0] for j in seen)))
    place = {x: i for i, x in enumerate(by_vector)}
    out = []
    for n, (one, v) in enumerate(rows):
        i = place.get((one, tuple(v))) if n in set(ok) else None
        out.append((one, 0, one, True) if i is None else (one, len(near[i]), least[i], least[i] == one))
    return sorted(out, key=str)


def got_links(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def test_links_of_odd_vectors_in_many_shards(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(0, 300)]
    crowd = rng.standard_normal(6)
    rows += [(1000 - i, (crowd + 0.05 * rng.standard_normal(6)).tolist()) for i in range(150)]  # a crowd of near copies
    rows += [(2000 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(200)]  # equal vectors
    rows += [(-5, [2e300, 4e300, 0.0, 0.0, 0.0, 2e300]), (3000, [1e-300, 2e-300, 0.0, 0.0, 0.0, 1e-300])]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 6), (4003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (4004, [float("nan")] * 6), (4005, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(None, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]), (None, None), (4006, [1.0, 2.0]), (4007, [1.0, 2.0]), (4008, [-1.0, -2.0]), (4009, [3.0])]
    rows += [rows[0], rows[0], (1, rows[0][1]), (1, (-np.array(rows[0][1])).tolist())]  # repeated rows, an id with three vectors
    table = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], VECTORS)
    got = got_links(graph_dedup.near_duplicates(table, shard_numbers=6 * 256, query_rows=100))
    assert got == plain_links(rows)
    assert graph_dedup.near_duplicates(table.limit(0)).count() == 0


def test_links_of_near_copies_among_random_directions(spark):
    """The registered parameters but for smaller shards; copies lie in several shards."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64)).astype(np.float32)
    for a, size in ((0, 400), (1000, 40), (2000, 2)):
        x[a : a + size] = x[a] + 0.1 * rng.standard_normal((size, 64))
    x[3000:3100] = x[3000] + 0.3 * rng.standard_normal((100, 64))  # around the bound
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    table = spark.createDataFrame([(i, v, None, None, None) for i, v in rows], VECTORS)
    got = {r[0]: r for r in got_links(graph_dedup.near_duplicates(table, shard_numbers=64 * 1024))}
    want = {r[0]: r for r in plain_links(rows)}
    found, true = sum(r[1] for r in got.values()), sum(r[1] for r in want.values())
    assert 0.999 * true <= found <= true  # none below the bound, hardly any missed
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(got[i][2] == want[i][2] for i in want) >= 0.999 * len(want)


def test_beams_are_widened_until_the_audit_passes():
    rng = np.random.default_rng(4)
    x = hnsw.units(rng.standard_normal((1500, 48)))
    graph = hnsw.Graph.build(x, 0.9)
    assert graph.audit(0.9, 0) >= 0.995 and graph.beam >= hnsw.FIRST_BEAM
    graph.beam = 1
    narrow = graph.audit(0.9, 0)
    copy, more = hnsw.Graph.load(graph.dump(extra=np.arange(3)))
    assert copy.audit(0.9, 0) == narrow < 0.995 and more["extra"].tolist() == [0, 1, 2]
    crowd = hnsw.units(x[0] + 0.01 * rng.standard_normal((800, 48)))
    graph = hnsw.Graph.build(np.concatenate([x, crowd])[rng.permutation(2300)], 0.9)
    found = sum(int(m.sum()) for _, _, m in graph.similar(crowd[:50], 0.9))
    assert found == 50 * 801 and len(np.unique(graph.owner)) < 1600  # the crowd is few nodes


def test_a_lost_graph_file_raises(tmp_path):
    with pytest.raises(FileNotFoundError):
        graph_dedup.read_file(str(tmp_path), "64-0.npz")


def test_least_ids_are_read_back_from_keys(spark):
    ids = [-(2**63), -7, -1, 0, 5, 2**63 - 1]
    rows = spark.createDataFrame([(i, f"{n:032x}", [float(n)]) for n, i in enumerate(ids)], "vec_id long, h string, v array<double>")
    keyed = graph_dedup.distinct_vectors(rows)
    assert [r.id for r in keyed.orderBy("key").select(graph_dedup.first_id(F.col("key")).alias("id")).collect()] == ids
