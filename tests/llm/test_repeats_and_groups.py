import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sluice.llm import near_dedup, packing, substring_dedup
from sluice.llm.components import components
from sluice.llm.near_dedup import Rule
from tests_llm_helpers import brute_near, plain_pieces


def brute_repeats(rows, length):
    """Rows with one doc_id are one document; NULL ids come first."""
    key = lambda d: (d is not None, d or 0)
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - length + 1):
            at = (*key(d), s)
            k = tuple(w[s:s + length])
            first[k] = min(first.get(k, at), at)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        covered = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s:s + length])] != (*key(d), s):
                covered[s:s + length] = [True] * length
        kept = b" ".join(x for x, c in zip(w, covered) if not c)
        out.append((d, len(w), sum(covered), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def same_repeats(docs, length):
    got = sorted(map(tuple, substring_dedup.cut_repeats(docs, length).collect()), key=str)
    assert got == brute_repeats([(r.doc_id, r.text) for r in docs.collect()], length)
    return got


def test_repeats_equal_brute_force(odd_docs, small_docs, spark):
    assert sum(g[2] for g in same_repeats(small_docs, 20)) > 0
    same_repeats(odd_docs.filter("doc_id not in (6, 7)"), 8)
    assert substring_dedup.cut_repeats(odd_docs.limit(0)).count() == 0
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"], 60)) for _ in range(40)]
    shared = " ".join(f"w{i}" for i in range(30))
    texts += [f"{texts[i % 7]} {shared} {texts[(i * 3) % 11]}" for i in range(30)] + ["x " * 100, "x " * 90]
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    for length in (8, 20):
        assert sum(g[2] for g in same_repeats(docs, length)) > 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        same_repeats(docs, 20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_windows_of_a_scan_task_give_the_same_verdicts(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    rows = [(i, 0, " ".join(rng.choice(["a", "b"], 40)).encode()) for i in range(40)]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows)], names=["doc", "twin", "text"])

    def verdicts():
        found = [r for b in substring_dedup._seeds(10)(iter([batch])) for r in b.to_pylist()]
        order = sorted(found, key=lambda r: (r["slot"], r["done"], r["extent"], r["doc"], r["start"]))
        out = [pa.RecordBatch.from_pylist(order[i:i + 7], schema=substring_dedup._RUN) for i in range(0, len(order), 7)]
        judged = [r for b in substring_dedup._judge(iter(out)) for r in b.to_pylist()]
        return {(r["doc"], r["start"]) for r in judged if not r["ask"]}, {(r["doc"], r["start"]) for r in judged if r["ask"]}

    whole = verdicts()
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 50)
    monkeypatch.setattr(substring_dedup, "WINDOW_RUNS", 20)
    assert verdicts() == whole and whole[0] and whole[1]


def test_kept_texts(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"one {passage} two"), (2, f"three {passage} four"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in substring_dedup.cut_repeats(docs, texts=True).collect()} == {1: f"one {passage} two", 2: "three four", 3: ""}


def same_groups(docs, rule):
    got = sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs, rule).collect()], key=str)
    assert got == brute_near([(r.doc_id, r.text) for r in docs.collect()], rule)
    return got


@pytest.mark.parametrize("rule", [near_dedup.OP3, near_dedup.STAGE])
def test_groups_equal_brute_force(small_docs, rule):
    assert any(not g[3] for g in same_groups(small_docs, rule))


@pytest.mark.parametrize("cells", [3_000_000, 900])
def test_groups_of_odd_rows_and_families(odd_docs, spark, monkeypatch, cells):
    monkeypatch.setattr(near_dedup, "GROUP_CELLS", cells)
    same_groups(odd_docs.filter("doc_id <> 8 or doc_id is null and text is not null"), near_dedup.OP3)
    assert near_dedup.near_groups(odd_docs.limit(0), near_dedup.OP3).count() == 0
    rng = np.random.default_rng(6)
    rows = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(120)]
        for member in range(25):  # copies that are linked through the original only
            words = list(base)
            for at in rng.integers(0, 120, member % 5):
                words[at] = f"x{rng.integers(1 << 30)}"
            rows.append((int(rng.integers(1 << 40)), " ".join(words)))
    got = same_groups(spark.createDataFrame(rows, "doc_id long, text string"), near_dedup.OP3)
    assert len({g[2] for g in got}) < 40
    kept = near_dedup.drop_near_copies(odd_docs, near_dedup.STAGE)
    assert kept.columns == odd_docs.columns


def test_repeated_and_missing_ids_over_different_texts(spark):
    def text(name, changed=0):
        return " ".join([f"x{name}{changed}"] * bool(changed) + [f"{name}{i}" for i in range(bool(changed), 100)])

    clean = text("z")  # neither the least nor the greatest text of doc_id 5
    rows = [(3, text("m")), (5, text("m", 1)), (5, clean), (5, text("a")), (7, text("a", 1)), (7, text("q")), (8, clean + " end"),
            (None, text("n")), (None, text("n", 1)), (None, text("n", 2)), (None, text("n", 2)), (9, text("n", 3)),
            (None, text("o")), (None, text("o")), (2, text("r", 1)), (2, text("r", 2)), (None, " "), (None, None), (None, "")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, kept int, _doc string").repartition(3)
    for rule in (near_dedup.OP3, near_dedup.STAGE):
        got = Counter((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in near_dedup.near_groups(docs, rule).collect())
        dropped = {k[:3]: n for k, n in got.items() if not k[3]}
        # One document each of m, a, q, z, n, r; the two rows of o are one document.
        assert sum(n for k, n in got.items() if k[3] and k[1]) in (8, 9) and sum(n for k, n in got.items() if not k[1]) == 3
        assert dropped[5, True, 3] == 1 and dropped[7, True, 5] == 1 and dropped[8, True, 5] == 1
        assert dropped[9, True, None] == 1 and dropped[None, True, None] in (2, 3) and dropped[2, True, 2] == 1
        stay = [(r.doc_id, r.text) for r in near_dedup.drop_near_copies(docs.drop("kept", "_doc"), rule).collect()]
        assert Counter((i, t.split()[-1][0] if (t or "").split() else None) for i, t in stay) == {
            (3, "m"): 1, (5, "z"): 1, (5, "a"): 1, (7, "q"): 1, (None, "n"): 1, (None, "o"): 1, (2, "r"): 1, (None, None): 3}


def test_chunks_guarantee_the_distance():
    for rule in (Rule(3, 85), Rule(5, 80), Rule(5, 95)):
        assert rule.chunks * (near_dedup.ERRORS + 1) > rule.distance
        from itertools import chain
        parts = np.array_split(np.arange(near_dedup.PARTS), rule.chunks)
        assert sorted(chain(*parts)) == list(range(near_dedup.PARTS)) and min(map(len, parts)) > near_dedup.ERRORS
        rng = np.random.default_rng(7)
        for _ in range(200):
            wrong = set(rng.choice(near_dedup.PARTS, rule.distance, replace=False))
            assert any(len(wrong.intersection(p)) <= near_dedup.ERRORS for p in parts)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and got[202] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def check_packing(rows, capacity, docs):
    pieces = plain_pieces(docs, capacity)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str) == sorted(pieces, key=str)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    rooms, best = [], 0
    for length in sorted((p[3] for p in pieces), reverse=True):
        i = bisect.bisect_left(rooms, length)
        room = rooms.pop(i) if i < len(rooms) else capacity
        best += room == capacity and True
        if room - length:
            bisect.insort(rooms, room - length)
    return len(sequences), best


@pytest.mark.parametrize("capacity", [4096, 300])
def test_packing(odd_docs, small_docs, capacity):
    for docs in (odd_docs, small_docs):
        ours, best = check_packing(packing.packed(docs, capacity).collect(), capacity, [(r.doc_id, r.text) for r in docs.collect()])
        assert ours <= best * 1.02 + 1


def test_packing_nothing_and_many_ties(spark, odd_docs):
    assert packing.packed(odd_docs.limit(0)).count() == 0
    sizes = spark.range(3000).selectExpr("id AS uid", "CAST(CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN 700 ELSE 1400 END AS BIGINT) AS length")
    got = packing.assign(sizes, 4096).join(sizes, "uid").collect()
    used = defaultdict(int)
    for r in got:
        used[r.sequence_id] += r.length
    assert len(got) == 3000 and max(used.values()) <= 4096 and len(used) <= 603  # five units of 700 fit into one


def test_sequences_hold_the_ids(small_docs):
    from test_exact_and_tokens import plain_ids

    got = packing.sequences(small_docs.limit(20), 256).collect()
    ids = [i for t in plain_ids([r.text for r in small_docs.limit(20).collect()]) for i in t]
    assert sorted(x for r in got for x in np.frombuffer(bytes(r.ids), "<u4").tolist()) == sorted(ids)


def test_texts_of_equal_short_hash_without_ids(spark):
    """Two texts that a 32-bit hash does not tell apart, both without doc_id; each keeps what is its own."""
    from pyspark.sql import functions as F

    shared = " ".join(f"w{i}" for i in range(30))
    many = spark.range(300_000).select(F.concat(F.lit(shared + " x"), F.col("id"), F.repeat(F.lit(" y"), (F.col("id") % 7).cast("int"))).alias("text"))
    pair = many.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("texts")).filter("size(texts) > 1").first()["texts"][:2]
    # Unlike the other tests, rows without an id are documents of their own here: their texts differ.
    docs = spark.createDataFrame([(None, pair[0]), (None, pair[1]), (1, shared)], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.cut_repeats(docs).collect()}
    assert sum(got.values()) > 0 and {k[1] for k in got} == {len(t.split()) for t in (*pair, shared)}


def test_many_identical_rows_give_one_list(spark):
    """What is cut from rows that repeat a document grows with their number, not with its square."""
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text)] * 3000 + [(1, text + " end")], "doc_id long, text string").repartition(6)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.cut_repeats(docs).collect())
    assert sum(got.values()) == 3001 and got[1, 41, 40] == 1
    found = spark.createDataFrame([(1, 2, 0, 3, False)] * 3000, "doc long, twin long, start int, more int, ask boolean")
    assert [len(r["starts"]) for r in substring_dedup._lists(found).collect()] == [1]


def test_contract_column_of_near_groups(spark, tmp_path):
    """Linked texts under one doc_id: kept says whether doc_id is the component's; chosen, which of them stays."""
    from sluice.llm.queries import QUERIES

    base = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(base)), (1, " ".join(base[:119] + ["x"])), (2, " ".join(base[:119] + ["y"])), (3, "other words only here"), (None, "alone too")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.component_id, r.kept, r.chosen) for r in QUERIES["op3_minhash_near_dedup"](spark, str(tmp_path)).collect()]
    assert all(kept == (doc == component) for doc, component, kept, _ in got)
    assert sorted(k for d, _, k, _ in got if d == 1) == [True, True] and sum(c for d, _, _, c in got if d == 1) == 1
