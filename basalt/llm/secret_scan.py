"""Secrets: base patterns, and strings of a sensitive context that a primed compressor can't shorten.

The second way measures novelty. A compressor primed with a dictionary of identifiers first takes a
candidate's surroundings, then the same with the candidate; the bytes it adds, against its length,
tell whether it repeats what stands around it or in the dictionary. Random keys don't. The dictionary
holds a few common words and, above all, the identifiers that stand near sensitive words in the most
documents of the whole table.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import lean, ship

KINDS = ("assign", "access", "hex", "novel")
#: Fixed patterns of the three base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a longest run of 32 or more

SENSITIVE = re.compile(r"passw|pwd|secret|token|api_?key|credential|private_?key|access_?key|authorization|bearer", re.IGNORECASE | re.ASCII)
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
LEAST, REACH, AROUND, NOVEL = 12, 40, 200, 0.7
#: Identifiers have no digits, so that no key can be one. The dictionary has so many of them; so many are counted at a time.
IDENTIFIER = re.compile(r"[A-Za-z_]{4,40}")
IDENTIFIERS, HELD = 4096, 1 << 17
#: Texts without a match of this hold nothing to report; RE2 folds case over more letters, so it finds no less.
WORTH_A_LOOK = r"(?i:passw|pwd|secret|token|api_?key|credential|private_?key|access_?key|authorization|bearer)|AKIA[A-Z0-9]|[0-9a-f]{32}"
COMMON = (
    "password passwd secret token api_key apikey credential private_key access_key authorization bearer username user_name "
    "client_id client_secret session_id request response header content_type application json localhost 127.0.0.1 example.com "
    "http:// https:// www. .com .org index.html function return import export default const static public private protected "
    "string integer boolean double value key name path file size length count index config settings environment variable "
    "placeholder changeme your_password_here your_token_here your_api_key_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef 2024-01-01T00:00:00Z sha256 md5 base64 utf-8 true false null none"
).encode()


class Novelty:
    """Added compressed bytes a byte of a candidate, against its surroundings and the dictionary."""

    def __init__(self, identifiers: bytes = COMMON):
        primed = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=3)
        self.size = lambda x: len(primer.compress(x))
        primer = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False)

    def __call__(self, before: str, candidate: str, after: str) -> float:
        around = f"{before}\n{after}\n".encode("utf-8", "replace")
        own = candidate.encode()
        return (self.size(around + own) - self.size(around)) / len(own)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, number of the kind, end of each base match, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str):
    """Start and end of the strings to be judged, in order: runs of LEAST characters or more of which a part
    begins at most REACH after a sensitive word. A run that holds such words begins after the last
    that leaves it long enough. Each run is met once, so this is linear in the text."""
    done = 0
    for word in SENSITIVE.finditer(text):
        at = max(word.end(), done)
        while at <= word.end() + REACH and (m := RUN.search(text, at, word.end() + REACH + 1)):
            begin, done = m.start(), RUN.match(text, m.start()).end()
            for inner in SENSITIVE.finditer(text, begin, done):
                if done - inner.end() >= LEAST:
                    begin = inner.end()
            if done - begin >= LEAST:
                yield begin, done
            at = done


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Candidates with letters and digits that no base span touches and that don't compress."""
    out, at = [], 0
    for start, end in candidates(text):
        while at < len(base) and base[at][2] <= start:
            at += 1
        own = text[start:end]
        if at < len(base) and base[at][0] < end or not (any(c.isdigit() for c in own) and any(c.isalpha() for c in own)):
            continue
        if novelty(text[max(0, start - AROUND) : start], own, text[end : end + AROUND]) >= NOVEL:
            out.append((start, 3, end))
    return out


def near_words(text: str) -> set[str]:
    """The identifiers at most AROUND from a sensitive word of a text."""
    out, at = set(), 0
    for word in SENSITIVE.finditer(text):
        at, end = max(at, word.start() - AROUND), word.end() + AROUND
        if at < end:
            out.update(IDENTIFIER.findall(text, at, end))
            at = end
    return out


def dictionary(docs: DataFrame, text_col: str) -> bytes:
    """COMMON and, the most frequent last, the IDENTIFIERS identifiers that stand near sensitive words in the most
    documents (ties by name). All documents are counted; counts are summed over each
    partition before the shuffle, and the driver gets IDENTIFIERS short strings."""
    source = docs.select(F.col(f"`{text_col}`").cast("string"))

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for i in worth_a_look(batch.column(0)):
                held.update(near_words(batch.column(0)[i].as_py()))
                if len(held) > HELD:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, kinds)
                    held.clear()
        yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, kinds)

    kinds = pa.schema([("word", pa.string()), ("n", pa.int64())])
    most = source.mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(IDENTIFIERS).collect()
    return b" ".join([COMMON, *(r["word"].encode() for r in reversed(most))])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id and `spans`, an array of kind, start and end (code points,
    end exclusive), by start and then kind (assign, access, hex, novel).

    Null and empty texts have no spans; null ids and repeated rows stay; an empty table gives an
    empty one; other columns are ignored. Whole texts are scanned, in time linear in their length. Narrow:
    only the counts of the dictionary's words are shuffled.
    """
    ship(docs.sparkSession)
    identifiers = dictionary(docs, text_col)
    source = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    kind = source.schema[0].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        novelty = Novelty(identifiers)
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in found(batch.column(1), novelty)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], names=[id_col, "spans"])

    return source.mapInArrow(lean(run), f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long>>")


def worth_a_look(texts: pa.Array) -> list[int]:
    return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, WORTH_A_LOOK), False)).to_pylist()


def found(texts: pa.Array, novelty: Novelty) -> list[list[tuple[int, int, int]]]:
    """start, number of the kind, end of each span of each text."""
    rows: list[list] = [[] for _ in range(len(texts))]
    for i in worth_a_look(texts):
        text = texts[i].as_py()
        base = base_spans(text)
        rows[i] = sorted(base + novel_spans(text, base, novelty))
    return rows


def without_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in whose text scan() finds nothing.

    Null and empty texts stay, and so do rows with null ids and repeated rows, if nothing is found; an empty table gives
    an empty one; any column names will do. Linear in the texts, however long.
    """
    ship(docs.sparkSession)
    identifiers = dictionary(docs, text_col)
    at = docs.columns.index(text_col)

    def keep(batches):
        novelty = Novelty(identifiers)
        for batch in batches:
            yield batch.filter(pa.array([not spans for spans in found(batch.column(at), novelty)], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)
