"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Two distributions over hashed n-grams (pre-tokens and pairs of successive ones) are counted, one
over target documents and one over all. A document's log weight is the sum over its n-grams of the
log ratio of the two; with a Gumbel variable added that its id decides, the k largest are a sample
without replacement in proportion to the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import byte_groups, lean, saved, ship, utf8
from basalt.llm.pretokens import pretokens
from basalt.llm.words import mix, odd

BUCKETS = 1 << 16
GROUP_BYTES = 1 << 20
#: Pseudo-counts of the target model, in all, spread as the raw model is: an n-gram unseen in a small
#: target counts against a document a little, one unseen in a large target a lot.
PRIOR = BUCKETS / 2
#: Ids of target documents are broadcast up to so many, else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
BINS = 4096


def ngrams(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts and, for each, the number of its text. A pair of equal
    pre-tokens counts as the n-gram "repeated", whatever is repeated."""
    words, index, bounds = pretokens(data, at)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in words.to_pylist()), np.uint64, len(words))
    own = hashes[index]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first, second = odd(2, seed=21)
    pairs = mix(own[:-1] * first + own[1:] * second)
    pairs[index[:-1] == index[1:]] = np.uint64(12345)
    inside = row[:-1] == row[1:]
    mask = np.uint64(BUCKETS // 2 - 1)
    buckets = np.concatenate([own & mask, (pairs[inside] & mask) + np.uint64(BUCKETS // 2)]).astype(np.int64)
    return buckets, np.concatenate([row, row[:-1][inside]])


def counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the column `text`, summed over each partition before a shuffle
    of at most BUCKETS rows a partition."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for a, b in byte_groups(batch.column(0), GROUP_BYTES):
                total += np.bincount(ngrams(*utf8(batch.column(0).slice(a, b - a)))[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    found = texts.where("text is not null").select("text").mapInArrow(lean(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


def log_weights(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, log_weight and n_ngrams for each row of docs. target_ids: a table of the ids (first column)
    of target documents."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    wanted = target_ids.select(F.col(target_ids.columns[0]).alias("id")).where("id is not null").distinct()
    wanted = F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted
    target, raw = counts(texts.join(wanted, "id", "left_semi")), np.maximum(counts(texts), 1e-9)
    ratio = np.zeros(BUCKETS)
    for s in (slice(BUCKETS // 2), slice(BUCKETS // 2, None)):  # pre-tokens and pairs have a distribution each
        p = raw[s] / raw[s].sum()
        ratio[s] = np.log((target[s] + PRIOR * p) / (target[s].sum() + PRIOR)) - np.log(p)

    def weigh(batches):
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            for a, b in byte_groups(column, GROUP_BYTES):
                buckets, row = ngrams(*utf8(column.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.bincount(row, ratio[buckets], b - a)), pa.array(np.bincount(row, minlength=b - a), pa.int64())], names=["id", "log_weight", "n_ngrams"])

    kind = texts.schema[0].dataType.simpleString()
    return texts.mapInArrow(lean(weigh), f"id {kind}, log_weight double, n_ngrams long")


def gumbel(id_, seed: int = 0):
    """A standard Gumbel variable that the id decides."""
    u = (F.pmod(F.xxhash64(id_, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def largest(rows: DataFrame, k: int) -> DataFrame:
    """The k rows of largest `key`, ties by `id` (nulls last). Histograms of BINS bins close in on
    the k-th key, so nothing is sorted but the rows of its last bin."""
    if k <= 0:
        return rows.limit(0)
    low, high, n = rows.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
    if k >= n:
        return rows
    rest = k  # to take among keys in [low, high]; keys above are taken
    while n > 10_000 and low < high:
        width = (high - low) / BINS
        if low + width <= low:
            break
        inside = rows.where(F.col("key").between(low, high))
        bin_ = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1))
        found = inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for b in sorted(found, key=lambda b: -b["bin"]):
            if rest <= b["n"]:
                break
            rest -= b["n"]
        if (b["low"], b["high"]) == (low, high):
            break
        low, high, n = b["low"], b["high"], b["n"]
    above = rows.where(F.col("key") > high)
    return above.unionByName(rows.where(F.col("key").between(low, high)).orderBy(F.desc("key"), F.col("id").asc_nulls_last()).limit(rest))


def resample(docs: DataFrame, target_ids: DataFrame, share: float, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """The sample: the id, log_weight, key (log_weight plus Gumbel noise) and kept (true) of
    round(share * rows) rows of docs.

    Null and empty texts have log weight 0; null ids share one draw; repeated rows draw alike; an
    empty table gives an empty one; other columns are ignored. Without target documents all
    log weights are 0. Counts cover all documents.
    """
    rows = log_weights(docs, target_ids, id_col, text_col)
    rows = saved(rows.withColumn("key", F.col("log_weight") + gumbel(F.col("id"), seed)), "weights")
    found = largest(rows, round(share * rows.count()))
    return found.select(F.col("id").alias(id_col), "log_weight", "n_ngrams", "key", F.lit(True).alias("kept"))
