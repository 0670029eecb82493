"""Language identification by Bayesian evidence fusion.

log posterior(language) = text + declared + prior, up to a constant:

* text: byte-trigram log likelihoods of the lower-cased text under one table per language, scaled down to ``EVIDENCE`` trigrams for longer
  texts, since neighbouring trigrams are not independent.  One more class, ``und``, gives all trigrams the same probability; what is not
  written in any known language is likelier there.
* declared: how often the declared language (markup attribute or column) occurs with each language.
* prior: languages of the host, smoothed towards those of its address suffix, these towards those of the table.

The declared table and the priors are grouped aggregates of the text posteriors over all rows; a row's own share is taken out again, so that no row
confirms itself.  They are joined back by key: no host, suffix or declared value is collected.  The trigram tables are fitted on about
``SAMPLE`` different texts of each language of the labels, or all where there are fewer, chosen by hash; they are of fixed size.

A row is accepted when its best language is not ``und`` and reaches ``CONFIDENCE``.  NULL and empty texts have no trigrams and are not accepted.  A missing
declared value, host or suffix says nothing.  Without any labelled row only ``und`` is known and nothing is accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluice.llm.base import as_batch, kept, query, slices, table, text_bytes

SAMPLE = 4000
SLOTS = 1 << 16
# Texts are drawn by their hash's place among so many.
PLACES = 1 << 40
EVIDENCE = 60.0
CONFIDENCE = 0.5
# Rows that a coarser level weighs in a finer one.
WEIGHT = 5.0
UNKNOWN = "und"
# Bytes whose trigrams are looked up together.
TOGETHER = 2 << 20

_GRAMS = pa.schema([("lang", pa.string()), ("slots", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


def grams(text: bytes) -> np.ndarray:
    """Slots of the byte trigrams of the lower-cased words, each between blanks."""
    data = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    whole = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    return ((whole * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            table_ = found.setdefault(lang, np.zeros(SLOTS, np.int64))
            table_ += np.bincount(grams(text), minlength=SLOTS)
    for lang, counts in found.items():
        slots = np.flatnonzero(counts)
        yield as_batch(_GRAMS, [lang], [slots.astype(np.int32)], [counts[slots]])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages with ``und`` last, log probability of each slot under each) from rows (lang, text)."""
    sound = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    sound = sound.withColumn("_hash", F.xxhash64("text"))
    sizes = sound.select("lang", "_hash").distinct().groupBy("lang").count().collect()  # one row a language
    pairs = [F.lit(x) for r in sizes for x in (r["lang"], -(-sample * PLACES // max(sample, r["count"])))]
    limit = F.create_map(*pairs)[F.col("lang")] if pairs else F.lit(0)
    drawn = sound.filter(F.pmod("_hash", F.lit(PLACES)) < limit).groupBy("lang", "_hash").agg(F.min("text").alias("text"))
    counts: dict[str, np.ndarray] = {}
    parts = drawn.select("lang", text_bytes().alias("text")).mapInArrow(_count, "lang string, slots array<int>, counts array<long>")
    for row in parts.toLocalIterator():  # of a bounded sample for each language
        counts.setdefault(row["lang"], np.zeros(SLOTS))[np.array(row["slots"], int)] += row["counts"]
    names = sorted(counts)
    tables = [np.log(counts[n] + 0.1) - np.log(counts[n].sum() + 0.1 * SLOTS) for n in names]
    return [*names, UNKNOWN], np.stack([*tables, np.full(SLOTS, -np.log(SLOTS))])


_SCORED = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("declared", pa.string()), ("host", pa.string()), ("suffix", pa.string()),
                     ("grams", pa.int64()), ("text_log", pa.list_(pa.float64())), ("share", pa.list_(pa.float64()))])
_SCORED_DDL = ("id long, text_hash long, declared string, host string, suffix string, grams long, text_log array<double>, share array<double>")


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _likelihood(model, clean):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.value.T.copy()
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            logs, sizes = np.zeros((len(texts), tables.shape[1])), np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                slots = grams(clean(text) if clean else text)
                sizes[i] = len(slots)
                for a in range(0, len(slots), TOGETHER):
                    logs[i] += tables[slots[a:a + TOGETHER]].sum(axis=0)
            logs *= np.minimum(1.0, EVIDENCE / np.maximum(sizes, 1))[:, None]
            if len(texts):
                yield as_batch(_SCORED, *(batch.column(n) for n in ("id", "text_hash", "declared", "host", "suffix")), sizes, list(logs), list(_softmax(logs)))

    return score


def _summed(scored: DataFrame, keys: list[str], classes: int, name: str) -> DataFrame:
    """Sum of the text posteriors of the rows with words, by key."""
    sums = [F.sum(F.element_at("share", i + 1)).alias(f"s{i}") for i in range(classes)]
    rows = scored.filter("grams > 0")
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    total = rows.groupBy(*keys).agg(*sums) if keys else rows.agg(*sums)
    return total.select(*keys, F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(classes)]).alias(name))


_JUDGED = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("language", pa.string()), ("confidence", pa.float64()),
                     ("text_language", pa.string()), ("accepted", pa.bool_())])
_JUDGED_DDL = "id long, text_hash long, language string, confidence double, text_language string, accepted boolean"


def _fuse(names: list[str], everything: np.ndarray, floor: float):
    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = len(names)
        for batch in slices(batches):
            n = batch.num_rows
            if not n:
                continue

            def matrix(name: str) -> np.ndarray:
                return np.array([r if r is not None else [0.0] * known for r in batch.column(name).to_pylist()], float).reshape(n, known)

            sizes = batch.column("grams").to_numpy()
            own = matrix("share") * (sizes > 0)[:, None]
            text = matrix("text_log")
            total = np.maximum(everything - own, 0.0) + 1e-3
            prior = total / total.sum(axis=1, keepdims=True)
            for level in ("suffix", "host"):
                there = np.array([x is not None for x in batch.column(level).to_pylist()])
                counts = np.maximum(matrix(f"{level}_sum") - own * there[:, None], 0.0)
                prior = (counts + WEIGHT * prior) / (counts.sum(axis=1, keepdims=True) + WEIGHT)
            there = np.array([x is not None for x in batch.column("declared").to_pylist()])
            pairs = np.maximum(matrix("declared_sum") - own * there[:, None], 0.0)
            # P(declared | language), smoothed towards how common the declared value is.
            common = (pairs.sum(axis=1, keepdims=True) + 1e-3) / (total.sum(axis=1, keepdims=True) + 1.0)
            declared = np.where(there[:, None], np.log((pairs + WEIGHT * common) / (total + WEIGHT)), 0.0)
            post = _softmax(text + np.log(prior) + declared)
            best = post.argmax(axis=1)
            sure = post[np.arange(n), best]
            accepted = (best < known - 1) & (sure >= floor) & (sizes > 0)
            yield as_batch(_JUDGED, batch.column("id"), batch.column("text_hash"), [names[i] for i in best], sure,
                           [names[i] for i in text.argmax(axis=1)], accepted)

    return fuse


def identify(rows: DataFrame, labelled: DataFrame, clean=None, sample: int = SAMPLE, floor: float = CONFIDENCE) -> DataFrame:
    """id, text_hash, language, confidence, text_language, accepted for rows (id, text, declared, host, suffix).

    ``labelled`` (lang, text) fits the trigram tables; ``clean`` turns stored bytes into text, as ``visible`` does for pages.
    """
    spark = rows.sparkSession
    names, tables = fit(labelled, sample)
    model = spark.sparkContext.broadcast(tables)  # languages x SLOTS
    scored = kept(rows.select(F.col("id").cast("bigint").alias("id"), F.xxhash64("text").alias("text_hash"), "declared", "host", "suffix",
                              text_bytes().alias("text")).mapInArrow(_likelihood(model, clean), _SCORED_DDL), "likelihoods")
    everything = np.array(_summed(scored, [], len(names), "s").first()["s"])
    joined = scored
    for key in ("declared", "suffix", "host"):
        sums = _summed(scored, [key], len(names), f"{key}_sum").withColumnRenamed(key, f"_{key}")
        joined = joined.join(sums, F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")
    return joined.mapInArrow(_fuse(names, everything, floor), _JUDGED_DDL)


_HIDDEN = re.compile(rb"<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->", re.I | re.S)
_TAG = re.compile(rb"<[^>]*>")
_ENTITY = re.compile(rb"&#?\w{1,31};")


def visible(html: bytes) -> bytes:
    """Text of a page without markup, scripts and styles; entities become blanks."""
    return _ENTITY.sub(b" ", _TAG.sub(b" ", _HIDDEN.sub(b" ", html)))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def page_rows(pages: DataFrame) -> DataFrame:
    """(id, text, declared, host, suffix) of web pages (page_id, url, html)."""
    attribute = F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    host = host_of(F.col("url"))
    return pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.nullif(F.lower(attribute), F.lit("")).alias("declared"),
                        host.alias("host"), F.nullif(F.regexp_extract(host, r"([^.]+)$", 1), F.lit("")).alias("suffix"))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source) that are written in one of the languages of its labels.

    The lang column labels the sample and is the declared language; source stands for the host.
    """
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.lower("lang").alias("declared"), F.col("source").cast("string").alias("host"),
                       F.lit(None).cast("string").alias("suffix"))
    out = identify(rows, docs.select(F.lower("lang").alias("lang"), "text")).filter("NOT accepted")
    gone = out.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    marked = docs.withColumn("_own", F.xxhash64("text"))
    return marked.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left_anti").select(*docs.columns)


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(page_rows(table(spark, sf_dir, "pages")), table(spark, sf_dir, "documents").select("lang", "text"), visible)
    return found.withColumnRenamed("id", "page_id").drop("text_hash")
