import hashlib
import re
import struct
import zlib

import pyarrow as pa
import pytest
from sluice.llm import exact_dedup, token_output
from sluice.llm.tokens import vocabulary_path
from sluice.session import scratch_path


def brute_groups(rows):
    norm = {}
    for i, (_, text) in enumerate(rows):
        norm.setdefault(re.sub("[\x20\x09-\x0d]+", " ", text or ""), []).append(i)
    out = []
    for text, members in norm.items():
        ids = [rows[i][0] for i in members]
        keep = min((x for x in ids if x is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(x, keep, len(ids), x == keep, sha) for x in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("capacity", [1 << 26, 64])
def test_groups_of_odd_rows(odd_docs, capacity):
    got = exact_dedup.exact_groups(odd_docs, capacity)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == brute_groups(rows)


def test_groups_of_small_windows(small_docs, monkeypatch):
    got = exact_dedup.exact_groups(small_docs, 4096)
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == brute_groups(rows)


def test_directory_covers_all_hashes_once(spark):
    entries = spark.createDataFrame([(i * 7919 << 40, 10) for i in range(-300, 300)] + [(5 << 44, 10)] * 50, "h long, size long")
    buckets = [(r.prefix << 64 - r.bits, (r.prefix + 1 << 64 - r.bits) - 1, r.size) for r in exact_dedup.directory(entries, 100).collect()]
    hashes = [(r.h, r.size) for r in entries.collect()]
    assert all(sum(low <= h <= high for low, high, _ in buckets) == 1 for h, _ in hashes)
    for low, high, size in buckets:
        inside = [(h, s) for h, s in hashes if low <= h <= high]
        assert size == sum(s for _, s in inside) and (size <= 100 or len({h for h, _ in inside}) == 1)
    assert max(len({h for h, _ in hashes if low <= h <= high}) for low, high, _ in buckets) > 1


def test_owners_get_whole_buckets(spark):
    from pyspark.sql import functions as F

    entries = spark.createDataFrame([(i * 7919 << 40, 10) for i in range(-300, 300)] + [(5 << 44, 10)] * 50, "h long, size long")
    buckets = exact_dedup.directory(entries, 100)
    at = exact_dedup._owned(entries, buckets).withColumn("task", F.spark_partition_id()).collect()
    assert len(at) == 650
    for r in buckets.collect():
        assert len({x.task for x in at if x.h >> 64 - r.bits == r.prefix}) <= 1


@pytest.mark.parametrize("merge", [2, 3])
def test_many_chains_of_one_text_are_merged_in_steps(spark, monkeypatch, merge):
    """Every task sends the hot texts; owners take a few of these chains at a time, in several steps."""
    monkeypatch.setattr(exact_dedup, "MERGE", merge)
    rows = [(i, ["hot  one", "hot one", "hot two", f"cold {i // 2}"][i % 4]) for i in range(800)] + [(None, "hot one"), (None, "cold 9")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, lead long").repartition(20)
    assert sorted(map(tuple, exact_dedup.exact_groups(docs).collect()), key=str) == brute_groups(rows)
    kept = exact_dedup.drop_copies(docs).collect()
    first = {}
    for r in sorted((tuple(r) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(re.sub(" +", " ", r[1]), r)
    assert sorted(map(tuple, kept)) == sorted(first.values())


def test_equal_hashes_are_told_apart_by_bytes():
    import pyarrow as pa

    batch = pa.record_batch({"h": [1, 1, 1, 2], "lead": [10, 11, 12, 13], "low": [5, 4, 3, 2], "n": [1, 1, 2, 1],
                             "body": [b"x", b"y", b"x", b"x"]})
    got = [r for b in exact_dedup._own(iter([batch])) for r in b.to_pylist()]
    assert {r["lead"]: (r["keep_id"], r["group_size"]) for r in got} == {10: (3, 3), 12: (3, 3), 11: (4, 1), 13: (2, 1)}


def test_dropping_copies_keeps_columns_and_one_of_each(odd_docs):
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == 8
    assert (exact_dedup.exact_groups(odd_docs.limit(0)).count(), exact_dedup.drop_copies(odd_docs.limit(0)).count()) == (0, 0)


def plain_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    return [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def brute_digests(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    start, out = 0, []
    for (doc_id, _), ids in zip(rows, plain_ids([t or "" for _, t in rows])):
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 28, 3000])
def test_round_trip(spark, odd_docs, small_docs, shard_bytes):
    for docs in (odd_docs, small_docs):
        manifest = token_output.write_tokens(docs, scratch_path(spark, "t"), shard_bytes=shard_bytes)
        got = sorted(map(tuple, token_output.token_digests(manifest).collect()), key=lambda r: r[1])
        assert got == brute_digests([(r.doc_id, r.text) for r in docs.collect()])


def test_no_documents(spark, odd_docs):
    manifest = token_output.write_tokens(odd_docs.limit(0), scratch_path(spark, "t"))
    assert token_output.token_digests(manifest).count() == 0


def test_shuffled_read_and_damage(spark, small_docs):
    manifest = token_output.write_tokens(small_docs, scratch_path(spark, "t"))
    path = manifest.first().path
    straight = {(d, b): i.tobytes() for d, b, i in token_output.read_shard(path)}
    mixed = [(d, b, i.tobytes()) for d, b, i in token_output.read_shuffled(path, 3)]
    assert {(d, b): i for d, b, i in mixed} == straight and [m[1] for m in mixed] != sorted(m[1] for m in mixed)
    place = path.removeprefix("file:") + ".bin"
    data = bytearray(open(place, "rb").read())
    data[40] ^= 1
    open(place, "wb").write(data)
    with pytest.raises(ValueError):
        list(token_output.read_shard(path))


def test_words_equal_the_tokenizer():
    from sluice.llm.tokens import encode, words_of

    texts = ["Don't stop. it's; we'll?! J̌.  A.B,C;; 12.5, Œuvre».. É.", "İ ΣΑΣ. ﬁx \x1c a\x85b <b>hi.</b>;", "x" * 200 + ".", ""]
    words = words_of(vocabulary_path())
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in (encode(words, t.encode()) for t in texts)] == plain_ids(texts)


def test_random_texts_equal_the_tokenizer():
    """50,000 texts of letters that change in lower case, marks, punctuation, added tokens in any case, odd blanks."""
    import random

    from sluice.llm import tokens

    r = random.Random(11)
    parts = ["İ", "i̇", "GÜVENLİĞİ", "ß", "ẞ", "Σ", "ς", "ΑΣ", "é", "e\u0301", "\u0301", "ﬁ", "Ǆ", "ⓐ", "ª", "ʰ", "ℵ", "中文", "ไทย", "हिन्दी", "9", "²", "Ⅷ", "a", "The",
             "thonen", "ING", "don't", "'s", "'RE", ".", ",", "...", "?!", ";:", "<", "|", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>",
             "<|startoftext|>", "\x00", "\x1c", "\x85", "\u00a0", "\u3000", "\u200b", "_", "-", "(", "😀", "\ufeff", "ǰ", "K"]
    texts = ["".join(r.choice(parts) if r.random() < 0.75 else r.choice(" \t\n\x0b\x0c\r") for _ in range(r.randrange(1, 14))) for _ in range(50_000)]
    words = tokens.words_of(vocabulary_path())
    for some in (texts, [t for t in texts if "<|" not in t]):
        got = [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in tokens.encoded(words, pa.array([t.encode() for t in some], pa.binary()))]
        wrong = [(t, g, w) for t, g, w in zip(some, got, plain_ids(some)) if g != w]
        assert not wrong, wrong[:3]


def test_texts_longer_than_a_batch_are_cut_between_words(monkeypatch):
    from sluice.llm import tokens

    monkeypatch.setattr(tokens, "BATCH_BYTES", 50)
    texts = ["Thonen İ. edst, " * 30, "x" * 300 + " y", " a ", "", "b" * 60, "c d."]
    words = tokens.words_of(vocabulary_path())
    got = [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in tokens.encoded(words, pa.array([t.encode() for t in texts], pa.binary()))]
    assert got == plain_ids(texts)
