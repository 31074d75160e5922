"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import byte_groups, lean, ship, slices, utf8
from basalt.llm.pretokens import starts

GROUP_BYTES = 1 << 20
CACHE_WORDS = 300_000  # in each of two generations
#: Between a word character and ASCII white space no match of the pattern goes on, and no look-around sees across.
SAFE = re.compile(r"(?<=\w)(?=[ \n\t\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def safe_pieces(text: str, limit: int) -> list[str]:
    """Pieces of about `limit` characters whose token counts add up to those of the text. Where
    a text has no safe boundary for longer than that, its piece is longer."""
    pieces, begin = [], 0
    while len(text) - begin > limit:
        m = SAFE.search(text, begin + limit)
        if not m:
            break
        pieces.append(text[begin : m.start()])
        begin = m.start()
    return [*pieces, text[begin:]]


class ByteLevelCounter:
    """Counts of a byte-level BPE tokenizer (.json) without normalizer. Each batch is cut at
    pre-token boundaries, and each distinct pre-token of the batch is encoded once."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.special = [str(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.cut = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def lengths(self, words: pa.Array) -> np.ndarray:
        words = words.to_pylist()
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = [w for w in words if w not in known]
        known.update((w, older[w]) for w in missing if w in older)
        missing = [w for w in missing if w not in older]
        for i in range(0, len(missing), 8192):
            part = missing[i : i + 8192]
            encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in part], add_special_tokens=False)
            known.update(zip(part, map(len, encoded), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def counts(self, data: bytes, at: np.ndarray) -> np.ndarray:
        extra = np.zeros(len(at) - 1, np.int64)
        if self.cut is not None and (found := [m.span() for m in self.cut.finditer(data)]):
            begin, end = np.array(found, np.int64).T
            row = np.searchsorted(at, begin, "right") - 1
            inside = end <= at[row + 1]  # not across two texts
            begin, end, row = begin[inside], end[inside], row[inside]
            np.add.at(extra, row, 1)
            keep = np.ones(len(data) + 1, np.int8)
            edges = np.sort(np.concatenate([at, begin, end]))
            for b, e in zip(begin, end, strict=True):
                keep[b:e] = 0
        else:
            edges, keep = at, None
        begin = starts(data, edges)
        coded = slices(data, begin).dictionary_encode()
        sizes = self.lengths(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        if keep is not None:
            sizes = sizes * keep[begin[:-1]]
        total = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.searchsorted(begin, at)
        return total[bounds[1:]] - total[bounds[:-1]] + extra


class WholeTextCounter:
    """Counts of any other tokenizer: whole texts, as its normalizer may look across any boundary."""

    def __init__(self, encode):
        self.encode = encode

    def counts(self, data: bytes, at: np.ndarray) -> np.ndarray:
        texts = [data[a:b].decode("utf-8") for a, b in zip(at[:-1], at[1:], strict=True)]
        return np.array(self.encode(texts), np.int64).reshape(len(texts))


@functools.cache  # a worker that is used again keeps its tokenizer and the words it knows
def counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return WholeTextCounter(lambda texts: [len(x) for x in model.encode(texts, num_threads=1)])
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    spec = json.loads(tokenizer.to_str())
    before = spec.get("pre_tokenizer") or {}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec.get("added_tokens", []))
    if not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and plain:
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return ByteLevelCounter(tokenizer)
    return WholeTextCounter(lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    path: a tokenizer file (.json of the tokenizers library or .model of sentencepiece) that each
    worker can open. Null texts count as empty (0 bytes, 0 tokens); null ids and repeated rows are
    kept as they are; an empty table gives an empty one; other columns are ignored, whatever their
    names. Special strings inside texts are matched as the library does by default.

    Narrow: no shuffle. Each Arrow batch is split into groups of about GROUP_BYTES bytes and a text
    longer than that into pieces at boundaries that no token crosses, so memory doesn't depend on
    the longest text. The cache of known words is bounded.
    """
    ship(docs.sparkSession)

    def run(batches):
        count = counter(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            sizes, tokens = [], []
            for a, b in byte_groups(texts, GROUP_BYTES):
                data, at = utf8(texts.slice(a, b - a))
                sizes.append(np.diff(at))
                if b - a == 1 and len(data) > GROUP_BYTES and isinstance(count, ByteLevelCounter) and not (count.cut and count.cut.search(data)):
                    pieces = (p.encode("utf-8") for p in safe_pieces(data.decode("utf-8"), GROUP_BYTES))
                    tokens.append(np.array([sum(int(count.counts(p, np.array([0, len(p)]))[0]) for p in pieces)], np.int64))
                else:
                    tokens.append(count.counts(data, at))
            sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(lean(run), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
