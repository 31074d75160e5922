"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed letter trigrams, counted over all labelled texts. A
document is a mixture of languages: expectation-maximisation estimates their proportions from its
trigrams. Sets of the languages with the largest proportions are then tried in turn, and one more
language is accepted only while it raises the likelihood by more than a penalty. The largest
proportion under the chosen set decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import byte_groups, lean, ship
from basalt.llm.pretokens import LETTER, classes

BUCKETS = 1 << 14
GROUP_BYTES = 1 << 20
SMOOTHING = 0.5
ROUNDS = 12
#: Languages whose counts a task holds at a time while it learns.
HELD = 256
PENALTY = 4.0  # times log(1 + trigrams), for each language after the first


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram around each letter, and the number of them before each text (one
    more than texts). Other characters, and the ends of a text, count as one blank."""
    low = [t.lower() for t in texts]
    cps = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "replace"), np.uint32)
    letter = classes()[cps] == LETTER
    flat = np.where(letter, cps, 32).astype(np.uint32)
    middle = np.flatnonzero(letter)
    with np.errstate(over="ignore"):
        h = flat[middle - 1] * np.uint32(0x9E3779B1) + flat[middle] * np.uint32(0x85EBCA77) + flat[middle + 1] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low))) + 1
    return (h >> np.uint32(18)).astype(np.int64), np.searchsorted(middle, np.concatenate([[1], ends]))


class Model:
    """What is learned of each language: how often trigrams of each bucket occur in it. Counts are kept
    by bucket and only where they aren't 0, so a language takes at most 12 bytes a bucket it has; none is left out."""

    def __init__(self, names: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        self.names = names
        order = np.argsort(bucket, kind="stable")
        self.lang, self.n = lang[order].astype(np.int32), n[order].astype(np.float64)
        self.begin = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        self.total = np.bincount(lang, n, len(names)) + SMOOTHING * BUCKETS

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The probability of each bucket of `at` in each language."""
        lengths = self.begin[at + 1] - self.begin[at]
        ends = np.cumsum(lengths)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[at] - (ends - lengths), lengths)
        out = np.full((len(self.names), len(at)), SMOOTHING)
        out[self.lang[where], np.repeat(np.arange(len(at)), lengths)] += self.n[where]
        return out / self.total[:, None]


def learn(labelled: DataFrame) -> Model:
    """The model of all languages of rows text, lang (not null) that have a letter in a text. Counts are summed over each
    partition before they are shuffled; the driver gets at most BUCKETS numbers a language."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, b in byte_groups(batch.column(0), GROUP_BYTES):
                buckets, bounds = trigrams(batch.column(0).slice(a, b - a).to_pylist())
                coded = batch.column(1).slice(a, b - a).dictionary_encode()
                lang = np.repeat(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds))
                order = np.argsort(lang, kind="stable")
                cuts = np.searchsorted(lang[order], np.arange(len(coded.dictionary) + 1))
                for i, name in enumerate(coded.dictionary.to_pylist()):
                    if cuts[i] < cuts[i + 1]:
                        counts = np.bincount(buckets[order[cuts[i] : cuts[i + 1]]], minlength=BUCKETS)
                        held[name] = held[name] + counts if name in held else counts
                if len(held) > HELD:
                    yield from rows(held)
                    held.clear()
        yield from rows(held)

    def rows(held):
        for name, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "at", "n"])

    found = labelled.where("text is not null").select("text", "lang").mapInArrow(lean(count), "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").unique().to_pylist()))
    number = {name: i for i, name in enumerate(names)}
    coded = found.column("lang").combine_chunks().dictionary_encode()
    lang = np.array([number[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if names else np.zeros(0, np.int64)
    return Model(names, lang, found.column("at").to_numpy().astype(np.int64), found.column("n").to_numpy())


def proportions(p: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Mixture proportions of the languages (rows of p) and the likelihood they reach."""
    share = np.full(len(p), 1 / len(p))
    n = counts.sum()
    for _ in range(rounds):
        share = share * (p @ (counts / (share @ p))) / n
    return share, float(counts @ np.log(share @ p))


def infer(model: Model, buckets: np.ndarray) -> tuple[int, float, int]:
    """The language of most of a text, its proportion, and the number of languages in its set."""
    counts = np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    counts, p = counts[at].astype(np.float64), model.rows(at)
    order = np.argsort(-proportions(p, counts)[0], kind="stable") if len(p) > 1 else np.zeros(1, np.int64)
    share, chosen = np.ones(1), order[:1]
    reached = float(counts @ np.log(p[order[0]]))
    cost = PENALTY * np.log1p(counts.sum())
    for size in range(2, len(order) + 1):
        s, value = proportions(p[order[:size]], counts)
        if value - reached <= cost:
            break
        share, chosen, reached = s, order[:size], value
    top = int(np.argmax(share))
    return int(chosen[top]), float(min(1.0, share[top])), len(chosen)


def identify(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each input row: the id, lang_pred, score (the proportion of that language) and
    n_langs (languages in the chosen set). learn_from: a condition on docs; of the rows it is true
    for, those with a language and a letter in their text are learned from. Every such language is learned; a
    language without a letter in any text isn't.

    Null texts and texts without a letter get `und`, score 0 and n_langs 0, and so does every text
    if there is nothing to learn from. Null ids and repeated rows stay; an empty table gives an
    empty one; other columns are ignored. Whole texts are used. Ties go to the first language.
    """
    ship(docs.sparkSession)
    model = learn(docs.where(learn_from).where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")))
    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = source.schema[0].dataType.simpleString()

    def predict(batches):
        for batch in batches:
            pred, score, n = verdicts(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int32())], names=[id_col, "lang_pred", "score", "n_langs"])

    return source.mapInArrow(lean(predict), f"`{id_col}` {kind}, lang_pred string, score double, n_langs int")


def verdicts(texts: pa.Array, model: Model) -> tuple[list, list, list]:
    """Language, score and number of languages of each text."""
    rows = []
    texts = pc.fill_null(texts, "")
    for a, b in byte_groups(texts, GROUP_BYTES):
        buckets, bounds = trigrams(texts.slice(a, b - a).to_pylist())
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if i == j or not model.names:
                rows.append(("und", 0.0, 0))
            else:
                lang, score, n = infer(model, buckets[i:j])
                rows.append((model.names[lang], score, n))
    return tuple(map(list, zip(*rows, strict=True))) if rows else ([], [], [])


def identified(docs: DataFrame, learn_from: Column, least_score: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, whose language identify() can tell: not `und`, and a language
    with a proportion of at least least_score. Null texts and texts without a letter go; rows with null ids and
    repeated rows stay or go by their text; an empty table gives an empty one; other columns may have any
    names. Whole texts are used; no shuffle but for learning."""
    ship(docs.sparkSession)
    model = learn(docs.where(learn_from).where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")))
    at = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            pred, score, _ = verdicts(batch.column(at), model)
            yield batch.filter(pa.array([p != "und" and s >= least_score for p, s in zip(pred, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)


def held_out(id_: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 5, is 0, or the id is null."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(True))
