import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import lm_scoring, license_scan, language_id, topk_search

NAN, INF = float("nan"), float("inf")


def brute_top(rows, asks, k):
    sound = [(i, v, [math.floor(64 * x) for x in v]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (qid, _, q) in enumerate(sound):
        if qid is None or not asks(qid):
            continue
        scores = [(-sum(a * b for a, b in zip(q, c)), -math.inf if i is None else i, i) for m, (i, _, c) in enumerate(sound) if m != n]
        out += [(qid, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [3, 40])
def test_top_k_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(topk_search, "QUERIES_PER_COPY", 4)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(5, rows[5][1]), (None, rows[6][1]), (200, None), (201, [1.0, None]), (202, [NAN, 1.0]), (203, [INF]), (204, []), (205, [0.5, -0.5]),
             (206, [1e9] * 6), (207, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, row long, cell int")
    got = topk_search.top_k(df, F.col("vec_id") % 5 == 0, k)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, lambda i: i % 5 == 0, k)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 5 == 0, k).count() == 0


def test_bounds_are_never_below_the_score():
    rng = np.random.default_rng(2)
    m = np.floor(rng.normal(size=(300, 12)) * 50)
    pivot = m[:5]
    import pyarrow as pa

    batch = pa.record_batch({"vec_id": np.arange(300), "v": pa.array(list(m))})
    t = topk_search._arrays(next(iter(topk_search._tabulate(pivot)(iter([batch])))))
    bounds = topk_search.upper_bounds(t, t)
    assert (bounds >= m @ m.T).all() and (bounds < np.linalg.norm(m, axis=1)[:, None] * np.linalg.norm(m, axis=1) + 1).all()
    assert (bounds[:5] - (m @ m.T)[:5]).max() < 1


def brute_license(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_license_base(odd_docs, small_docs):
    for docs in (odd_docs, small_docs):
        got = sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan_licenses(docs).collect()], key=str)
        assert got == sorted([(r.doc_id, *brute_license(r.text)) for r in docs.collect()], key=str)
    assert license_scan.scan_licenses(odd_docs.limit(0)).count() == 0


def test_license_rules(spark):
    texts = {1: "Licensed under the Apache License, Version 2.0 (the License)", 2: "SPDX-License-Identifier: MIT License",
             3: "GNU Lesser General Public License", 4: "nothing here", 5: "mit license mit license mit license", 6: "CC-BY-SA 4.0 and CC BY",
             7: "This work is under cc by. " * 3, 8: "GNU GNU General Public License v3"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert len(license_scan.rules()[0]) > 300
    assert got[1].labels == "apache,apache-2.0" and got[1].base_labels == "apache" and [d.label for d in got[1].detections] == ["apache-2.0"]
    assert got[2].labels == "mit" and got[2].score == 1.0
    assert got[3].labels == "lgpl" and got[3].n_base == 0
    assert (got[4].labels, got[4].score) == ("", 0.0)
    assert (got[5].n_base, got[5].first_word, got[5].last_word) == (3, 0, 4)
    assert got[6].labels == "cc-by,cc-by-sa" and got[8].first_word == 1
    for r in got.values():
        spans = [(d.first_word, d.first_word + d.words) for d in r.detections]
        assert not any(a != b and a[0] <= b[0] and b[1] <= a[1] for a in spans for b in spans) and 0 <= r.score <= 1


def brute_base(rows):
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens]
    c = Counter(w for (_, ws), h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (i, ws), h in zip(tokens, held)]


def check_scores(docs, block_bytes):
    got = docs.sparkSession.createDataFrame(lm_scoring.score_texts(docs, block_bytes, 400).collect(), "doc_id long, held_out boolean, n_tokens long, "
                                            "n_known long, train_tokens long, base_score double, score double, bits_per_byte double").collect()
    key = lambda r: (str(r[0]), r[2], r[5])
    wanted = sorted(brute_base([(r.doc_id, r.text) for r in docs.collect()]), key=key)
    got = sorted(map(tuple, got), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in wanted]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in wanted])
    assert all(g[6] < 0 and g[7] > 0 for g in got)
    return got


def test_language_model(odd_docs, small_docs):
    check_scores(odd_docs, 1000)
    got = check_scores(small_docs, 100_000)
    assert got == check_scores(small_docs, 100_000)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) / sum(g[2] for g in held) > -6.5
    assert lm_scoring.score_texts(odd_docs.limit(0)).count() == 0


def brute_model(spark, docs, learner_words):
    """Scores by a model that learns from every training word, counted and mixed here; words are dealt to learners as in Spark."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in docs.collect()]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    counts = np.zeros((lm_scoring.CONTEXTS * lm_scoring.SLOTS, 2))
    for w, n in c.items():
        _, _, slots, bit = lm_scoring._bits([w])
        for at in slots:
            np.add.at(counts, (at, bit), n)
    learners = -(-len(c) // learner_words)
    dealt = (spark.createDataFrame([(w,) for w in c], "word binary")
             .selectExpr(f"pmod(xxhash64(word), {learners}) l", "xxhash64(1, word) place", "word").orderBy("l", "place").collect())
    mixer, seen = lm_scoring.Mixer(counts.astype(np.float32)), 0
    for learner in range(learners):
        mixer.weights = np.full_like(mixer.weights, lm_scoring.WEIGHT)
        seen = seen + mixer.learn([bytes(r.word) for r in dealt if r.l == learner])
    cells = 2 * len(lm_scoring.MAP)
    assert seen[:, -cells:-cells // 2].sum() == 8 * sum(len(w) + 1 for w in c)  # a visit for every bit of every training word
    for gate, row in enumerate(seen):
        mixer.settle(gate, row)
    words, n = list(c), np.array(list(c.values()), float)
    total = n.sum() + len(c)
    u, b = np.where(n > 1, n / total, 0), 10 ** mixer.scores(words, n > 0)[1]
    share = max(s / 1024 for s in range(11, 1014) if (n * (u - b) / (s / 1024 * u + (1 - s / 1024) * b)).sum() > 0)
    every = sorted({w for _, ws in tokens for w in ws})
    log = {w: math.log10(share * (c[w] and (c[w] + 1) / (total + 1)) + (1 - share) * 10 ** x) for w, x in zip(every, mixer.log10(every))}
    return sorted([(i, len(ws), sum(log[w] for w in ws)) for i, ws in tokens], key=str)


@pytest.mark.parametrize("learner_words", [1 << 17, 700])
def test_weights_and_share_come_from_all_training_words(spark, small_docs, learner_words):
    got = sorted([(r.doc_id, r.n_tokens, r.score) for r in lm_scoring.score_texts(small_docs, 100_000, learner_words).collect()], key=str)
    wanted = brute_model(spark, small_docs, learner_words)
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in wanted])


def test_bit_model_is_a_distribution():
    """Over all bytes that may follow a history, probabilities add up to one."""
    mixer = lm_scoring.Mixer(np.random.default_rng(3).integers(0, 5, (lm_scoring.CONTEXTS * lm_scoring.SLOTS, 2)).astype(np.float32))
    prefix = mixer.log10([b"ab" + bytes([i]) for i in range(256)])  # each with a blank behind it
    blank = np.array([_last_byte(mixer, b"ab" + bytes([i]) + b" ") for i in range(256)])
    two = _last_byte(mixer, b"ab", 2)
    assert (10.0 ** (prefix - blank - two)).sum() == pytest.approx(1.0)


def _last_byte(mixer, data, whole=None):
    """log10 probability of the last byte of ``data`` (or of its first ``whole`` bytes)."""
    owner, number, slots, bit = lm_scoring._bits([data])
    x, gate = mixer.inputs(slots, number)
    p, _, _ = mixer.probability(x, gate)
    logs = np.log10(np.where(bit == 1, p, 1 - p))
    return logs[:8 * whole].sum() if whole else logs[8 * (len(data) - 1):8 * len(data)].sum()


def test_language_id(spark, odd_docs, small_docs):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    labelled = small_docs.select("lang", "text")
    got = language_id.identify(language_id.page_rows(pages), labelled, language_id.visible).collect()
    urls = {r.page_id: r.url for r in pages.collect()}
    right = [r.language == re.search(r"example\.\w+/(\w\w)/", urls[r.id])[1] for r in got]
    assert len(got) == pages.count() and sum(right) >= 0.95 * len(right)
    odd = language_id.identify(odd_docs.select(F.col("doc_id").alias("id"), "text", "source", F.lit(None).cast("string").alias("declared"),
                                               F.col("source").alias("host"), F.lit("x").alias("suffix")), labelled)
    assert odd.count() == odd_docs.count()
    assert all(not r.accepted for r in odd.collect() if r.id in (3, 4, 5))
    assert language_id.accepted_documents(small_docs).count() >= 0.97 * small_docs.count()
    assert language_id.accepted_documents(odd_docs.limit(0)).count() == 0
    assert language_id.accepted_documents(odd_docs).columns == odd_docs.columns


def test_every_language_of_the_labels_is_known_at_any_size(spark):
    rare = {name: " ".join(f"{name}{i % 7}" for i in range(30)) for name in ("fi", "et", "is", "mt", "ga")}
    rows = [("en", f"the word {i} and the number {i * i}") for i in range(3000)] + [("en", "qqqq " * 50)] * 3000 + list(rare.items())
    labelled = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    names, tables = language_id.fit(labelled, 100)
    assert names == ["en", "et", "fi", "ga", "is", "mt", "und"]
    for name, text in rare.items():
        assert names[int(tables[:, language_id.grams(text.encode())].sum(axis=1).argmax())] == name
    # About 100 different texts, of which the repeated one is one at most.
    share = np.exp(tables[0][language_id.grams(b"the the the")]).mean()
    assert share > np.exp(tables[0][language_id.grams(b"qqqqq")][1])
    drawn = language_id.fit(labelled.filter("text not like 'q%'"), 100)[1][0]
    assert np.exp(drawn).sum() == pytest.approx(1.0)


def test_other_evidence_decides_where_the_text_does_not(spark, small_docs):
    base = small_docs.filter("lang in ('en', 'fr')").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"),
                                                            F.concat("lang", F.lit(".site")).alias("host"), F.lit("org").alias("suffix"))
    vague = spark.createDataFrame([(1001, "on", None, "fr.site", "org"), (1002, "on", "fr", None, None), (1003, "on", "en", "en.site", "org"),
                                   (1004, "zq 0x7f %% ## @@ 0x8f}{|~ 0x0 ][ ^^ ~~", None, None, None)],
                                  "id long, text string, declared string, host string, suffix string")
    got = {r.id: r for r in language_id.identify(base.union(vague), small_docs.select("lang", "text")).collect()}
    assert (got[1001].language, got[1002].language, got[1003].language) == ("fr", "fr", "en")
    assert not got[1004].accepted


def test_visible_text():
    page = b"<html lang=de><script>var a='</p>';</script><!-- x --><p>Gr\xc3\xbc&szlig;e <b>an</b> alle</p>"
    assert language_id.visible(page).split() == [b"Gr\xc3\xbc", b"e", b"an", b"alle"]


@pytest.mark.parametrize("text, label", [
    ("This is GPL v3 code", "gpl-3.0"), ("under the GNU General Public License v2", "gpl-2.0"), ("Apache License v2.0 applies", "apache-2.0"),
    ("GPL version 3", "gpl-3.0"), ("SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: ISC", "isc"),
    ("SPDX-License-Identifier: Zlib", "zlib"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("Mozilla Public License v2.0", "mpl-2.0"),
])
def test_versions_and_identifiers(spark, text, label):
    row = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert label in row["labels"].split(",")
