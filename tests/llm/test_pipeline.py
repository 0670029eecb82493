"""Each stage of the pipeline against a brute-force version on its own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from sluice.llm.near_dedup import STAGE
from test_mixing import level
from tests_llm_helpers import brute_near, plain_pieces

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = [tuple(r) for r in docs.collect()]
    for (name, stage), check in zip(corpus_pipeline.STAGES, (accepted, unequal, apart, mixed, packed), strict=True):
        out = stage(spark, docs, FOLDER)
        assert name == "best-fit packing" or out.columns == COLUMNS
        rows = [tuple(r) for r in out.collect()] if out.columns == COLUMNS else [r.asDict() for r in out.collect()]
        check(before, rows)
        if out.columns == COLUMNS:
            before, docs = rows, spark.createDataFrame(rows, docs.schema)


def accepted(before, rows):
    assert Counter(rows) <= Counter(before) and len(rows) >= 0.97 * len(before)


def unequal(before, rows):
    first = {}
    for r in sorted(before):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r[1] or ""), r)
    assert sorted(rows) == sorted(first.values())


def apart(before, rows):
    kept = {r[0] for r in brute_near([(r[0], r[1]) for r in before], STAGE) if r[3]}
    assert sorted(rows) == sorted(r for r in before if r[0] in kept)


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def mixed(before, rows):
    copies = Counter(rows)
    assert set(copies) <= set(before) and max(copies.values()) <= 3
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r[3]] += words(r[1])
        taken[r[3]] += copies[r] * words(r[1])
        largest[r[3]] = max(largest[r[3]], words(r[1]))
    for source, target in level(sizes).items():
        assert abs(taken[source] - target) <= 2 * largest[source]


def packed(before, rows):
    wanted = plain_pieces([(r[0], r[1]) for r in before], 4096)
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(wanted)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.02 * sum(r["length"] for r in rows) / 4096 + 1


def test_run_reads_no_other_table(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert {"row", "doc_id", "piece", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, FOLDER).columns)
