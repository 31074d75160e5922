"""Operators on each text by itself: tokens, secrets, languages."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basalt.llm import bpe, language, registry, secret_scan, token_counts, words
from basalt.llm.common import utf8
from basalt.llm.pretokens import classes, pretokens, pretokens_of
from tests.llm.helpers import components, frame, odd_rows, prose, rng, shingles  # noqa: F401

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = [*"ab strelvmd''  \n\t019é!?.-ñ 　中²½𝔸🙂́\x1c", "<|endoftext|>", "<|end", "oftext|>"]


def random_texts(r, n=6, length=25):
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, length))) for _ in range(r.randint(1, n))]


def test_pretokens_match_the_pattern():
    pattern, r = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"[^\p{White_Space}", r"[^\p{White_Space}")), rng(1)
    for _ in range(1500):
        texts = random_texts(r)
        found, index, bounds = pretokens(*utf8(pa.array(texts, pa.string())))
        found = [w.decode() for w in found.to_pylist()]
        assert [[found[i] for i in index[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [pattern.findall(t) for t in texts]


def test_counts_match_the_library():
    library, count, r = Tokenizer.from_file(JSON), token_counts.counter(JSON), rng(2)
    for _ in range(500):
        texts = random_texts(r)
        want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        assert count.counts(*utf8(pa.array(texts, pa.string()))).tolist() == want
        whole = "".join(t for t in texts if "end" not in t and "oftext" not in t)
        pieces = token_counts.safe_pieces(whole, 7)
        assert "".join(pieces) == whole
        assert sum(len(library.encode(p, add_special_tokens=False).ids) for p in pieces) == len(library.encode(whole, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    texts = ["Hello  there, World 12!", "", "été\n中"]
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)]
    else:
        want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]
    got = token_counts.token_counts(frame(spark, list(enumerate(texts))), path).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == want


def test_token_counts_of_odd_rows(spark, monkeypatch):
    rows = odd_rows(rng(3))
    got = token_counts.token_counts(frame(spark, rows), JSON).collect()
    library = Tokenizer.from_file(JSON)
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows]
    want = [(i, len((t or "").encode()), k, k > 512) for (i, t, *_), k in zip(rows, n, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(frame(spark, []), JSON).collect() == []


def test_bpe_buckets_follow_the_bytes(spark, monkeypatch):
    r = rng(8)
    rows = [(i, " ".join(r.choices(["a", "the", "naïve", "x1", "  ", "\n"], k=r.randrange(40)))) for i in range(60)] + [(60 + i, "") for i in range(30)]
    want = sorted(map(tuple, registry.bpe_digests(frame(spark, rows)).collect()))
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 1 << 9)  # also chunks of empty texts alone
    monkeypatch.setattr(bpe, "BUCKET_BYTES", 1 << 6)
    monkeypatch.setattr(bpe, "TASK_BYTES", 1 << 8)
    assert sorted(map(tuple, registry.bpe_digests(frame(spark, rows)).collect())) == want
    one = bpe.encode(frame(spark, rows), RANKS, public_tokenizers.PATTERN, buckets=1)
    assert one.count() == len(rows)


def test_bpe_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 1 << 16)
    r = rng(4)
    rows = odd_rows(r) + [(100 + i, t, "en", "a") for i in range(40) for t in random_texts(r, 1, 60)]
    encode = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={}).encode_ordinary
    want = []
    for i, t, *_ in rows:
        ids, raw = encode(t or ""), (t or "").encode()
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    docs = frame(spark, rows).repartition(3)
    assert sorted(map(tuple, registry.bpe_digests(docs).collect()), key=repr) == sorted(want, key=repr)
    assert registry.bpe_digests(frame(spark, [])).collect() == []
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe.decode(nulls, RANKS).first().decoded is None


def test_pack():
    r = np.random.default_rng(0)
    arrays = [r.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 1, 1000)]
    back, tail = bpe.unpack(bpe.pack(*arrays, tail=b"rest"))
    assert tail == b"rest" and all(np.array_equal(a, b) for a, b in zip(arrays, back, strict=True))


def plain_base(text):
    """The base rules, one after another, from their wording."""
    found = []
    for m in re.finditer(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(found)


def test_secrets(spark):
    r = rng(5)
    parts = ["password", "PassWD=", ' token: "', "api_key", "APIkey'= ", "secret", "=", " : ", "AKIA", "ABCDEFGH12", "0123456789abcdef" * 2, "fff", "é", " ", "\n", "x9" * 6, "ſecret=12345678", "toKen=12345678"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(300)]
    texts += ["bearer Zx81kQp0vT77wLmN2rYe and more", "secret aaaaaaaaaaaaaaa1 aaaaaaaaaaaaaaa1", "the token ofuncommonlength is public", "authorization x\n" * 3 + "q8Zt5LmP0xVw3RyK"]
    rows = odd_rows(r) + [(1000 + i, t, "en", "a") for i, t in enumerate(texts)]
    got = registry.secret_digests(secret_scan.scan(frame(spark, rows))).collect()
    want = []
    for i, t, *_ in rows:
        base = plain_base(t or "")
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((i, *(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((tuple(g)[:5] for g in got), key=repr) == sorted(want, key=repr)
    by = {g.doc_id: g for g in got}
    assert by[1300].spans == "novel:7:27" and by[1303].n_novel == 1
    assert by[1301].n_novel == 0 and by[1302].n_novel == 0
    for g in got:  # base spans stay among all spans
        assert len([s for s in g.spans.split(",") if s and not s.startswith("novel")]) == g.n_assign + g.n_access + g.n_hex
    kept = {x.doc_id for x in secret_scan.without_secrets(frame(spark, rows)).collect()}
    assert kept == {g.doc_id for g in got if not g.spans}
    assert secret_scan.scan(frame(spark, [])).collect() == []


SYLLABLES = {"en": "th er on an re he in ed nd ha at en".split(), "de": "sch ung ein keit ch be ver zu ö ä".split(), "fr": "eau que ment tion oi eux é è".split()}


def spoken(r, lang, n=60):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_language(spark):
    r = rng(6)
    rows = [(i, spoken(r, lang, r.randint(5, 80)), lang, "a") for i in range(300) for lang in [r.choice(list(SYLLABLES))]]
    mixtures = [(1000 + i, spoken(r, "de", 90) + " " + spoken(r, "fr", 30), "de", "a") for i in range(10)]
    odd = [(2000 + i if x[0] is not None else None, x[1], None, None) for i, x in enumerate(odd_rows(r))]
    docs = frame(spark, rows + mixtures + odd)
    held = language.held_out(F.col("doc_id"))
    got = language.identify(docs, ~held).join(docs.select("doc_id", "text", F.col("lang").alias("true"), held.alias("held")), "doc_id").collect()
    own = [g for g in got if g.true is not None and g.held and g.doc_id < 1000]
    assert len(own) > 30 and sum(g.lang_pred == g.true for g in own) >= 0.97 * len(own)
    two = [g for g in got if 1000 <= g.doc_id < 2000]
    assert all(g.lang_pred == "de" and 0.55 < g.score < 0.95 and g.n_langs == 2 for g in two)
    for g in got:
        assert 0 <= g.score <= 1
        assert (g.lang_pred == "und") == (not any(c.isalpha() for c in g.text or ""))
    assert all(g.held == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    assert {x.lang_pred for x in language.identify(docs, F.lit(False)).collect()} == {"und"}
    assert language.identify(frame(spark, []), F.lit(True)).collect() == []
    kept = language.identified(docs, ~held)
    assert kept.columns == docs.columns and kept.count() == language.identify(docs, ~held).where("lang_pred <> 'und' and score >= 0.5").count()


def test_language_ignores_the_label(spark):
    r = rng(7)
    rows = [(i, spoken(r, lang), lang, "a") for i in range(100) for lang in [r.choice(list(SYLLABLES))]]
    learned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    docs = frame(spark, rows)
    other = docs.withColumn("lang", F.when(learned, F.col("lang")))
    a, b = (sorted(map(tuple, language.identify(d, learned).collect())) for d in (docs, other))
    assert a == b


def test_shingles():
    r = random.Random(8)
    texts = ["", " ", "a", "A b c D", "a b c d e", *(" ".join(r.choice(["ab", "AB", "c d", "é", "x"]) for _ in range(r.randrange(40))) for _ in range(200))]
    got = list(words.shingle_sets(*utf8(pa.array(texts))))
    assert [len(g) for g in got] == [len(shingles(t)) for t in texts]
    seen = {}
    for t, g in zip(texts, got, strict=True):
        assert seen.setdefault(shingles(t), g.tobytes()) == g.tobytes()


def plain_trigrams(text):
    """The hash bucket of each letter with its neighbours, one after another."""
    low = " " + text.lower() + " "
    out = []
    for i, c in enumerate(low):
        if regex.match(r"\p{L}", c):
            a, b, d = (ord(x) if regex.match(r"\p{L}", x) else 32 for x in (low[i - 1], c, low[i + 1]))
            h = (a * 0x9E3779B1 + b * 0x85EBCA77 + d * 0xC2B2AE3D) % 2**32
            h ^= h >> 15
            out.append((h * 0x2C1B3C6D % 2**32) >> 18)
    return out


def plain_language(text, learned):
    """EM and the choice of the language set, in loops over single trigrams. learned: lang -> texts."""
    tables = {}
    for lang, texts in learned.items():
        counts = {}
        for x in texts:
            for g in plain_trigrams(x):
                counts[g] = counts.get(g, 0) + 1
        if counts:
            total = sum(counts.values()) + 0.5 * 16384
            tables[lang] = lambda g, c=counts, t=total: (c.get(g, 0) + 0.5) / t
    grams = plain_trigrams(text or "")
    if not grams or not tables:
        return "und", 0.0, 0

    def em(langs):
        share = {x: 1 / len(langs) for x in langs}
        for _ in range(12):
            new = dict.fromkeys(langs, 0.0)
            for g in grams:
                whole = sum(share[x] * tables[x](g) for x in langs)
                for x in langs:
                    new[x] += share[x] * tables[x](g) / whole / len(grams)
            share = new
        return share, sum(math.log(sum(share[x] * tables[x](g) for x in langs)) for g in grams)

    share, _ = em(sorted(tables))
    order = sorted(sorted(tables), key=lambda x: -share[x])
    chosen, reached = em(order[:1])
    for size in range(2, len(order) + 1):
        s, value = em(order[:size])
        if value - reached <= 4.0 * math.log(1 + len(grams)):
            break
        chosen, reached = s, value
    top = max(chosen, key=lambda x: chosen[x])
    return top, chosen[top], len(chosen)


def test_language_against_a_plain_version(spark):
    r = rng(41)
    rows = [(i, spoken(r, lang, r.randint(3, 25)), lang, "a") for i in range(60) for lang in [r.choice(list(SYLLABLES))]]
    rows += [(100 + i, spoken(r, "de", 20) + " " + spoken(r, r.choice(["fr", "en"]), r.randint(2, 20)) + " 7'x \u00c9", None, "a") for i in range(15)]
    rows += [(200, "", "xx", "a"), (201, None, "xx", "a"), (202, "12 34", "yy", "a"), (203, "zzz", None, None), (204, "q", None, None)]
    docs = frame(spark, rows)
    held = language.held_out(F.col("doc_id"))
    got = {g.doc_id: g for g in language.identify(docs, ~held).collect()}
    learned = {}
    for i, text, lang, _ in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 5:
            learned.setdefault(lang, []).append(text or "")
    assert {"xx", "yy"} & set(learned)  # languages without a letter, which can't be predicted
    for i, text, *_ in rows:
        lang, score, n = plain_language(text, learned)
        assert (got[i].lang_pred, got[i].n_langs) == (lang, n) and got[i].score == pytest.approx(score, abs=1e-9), i


def test_many_languages(spark):
    """Every label is learned, however many there are."""
    r = rng(42)
    alphabets = ["".join(r.sample("abcdefghijklmnopqrstuvwxyz", 5)) for _ in range(400)]
    rows = [(1000 * k + i, " ".join("".join(r.choice(x) for _ in range(6)) for _ in range(30)), f"l{k:03}", "a") for k, x in enumerate(alphabets) for i in range(3)]
    docs = frame(spark, rows)
    got = language.identify(docs, F.col("doc_id") % 1000 != 0).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").collect()
    assert len({g.lang_pred for g in got}) == 400 and sum(g.lang_pred == g.true for g in got) >= 0.95 * len(got)


def plain_novel(text, base, novelty):
    """Every sensitive word with every run of characters, in the words of the rule."""
    out = set()
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        words = [w.end() for w in secret_scan.SENSITIVE.finditer(text)]
        before, inside = any(m.start() - secret_scan.REACH <= e <= m.start() for e in words), [e for e in words if m.start() < e < m.end()]
        if not before and not inside:
            continue
        begin = max([m.start() if before else min(inside), *(e for e in inside if m.end() - e >= 12)])
        own = text[begin : m.end()]
        if len(own) >= 12 and any(c.isdigit() for c in own) and any(c.isalpha() for c in own) and not any(s < m.end() and begin < e for s, _, e in base):
            if novelty(text[max(0, begin - 200) : begin], own, text[m.end() : m.end() + 200]) >= secret_scan.NOVEL:
                out.add((begin, 3, m.end()))
    return sorted(out)


def test_novel_spans_against_a_plain_version():
    r = rng(43)
    novelty = secret_scan.Novelty()
    key = lambda: "".join(r.choice("ABCDEFGHijklmnop0123456789") for _ in range(r.randint(8, 30)))
    parts = ["token", "secret ", "Bearer ", "the ", "=", " : ", "\n", "x" * 45, " " * 39, ".", '"', "password=", "0123456789abcdef" * 2]
    n = 0
    for _ in range(2000):
        text = "".join(key() if r.random() < 0.3 else r.choice(parts) for _ in range(r.randrange(1, 14)))
        base = secret_scan.base_spans(text)
        got = secret_scan.novel_spans(text, base, novelty)
        assert got == plain_novel(text, base, novelty), text
        n += len(got)
    assert n > 300


def test_secrets_in_very_long_texts(spark):
    texts = ["token of the day. " * 550_000, "token" * 400_000, "secret " + "aB3" * 500_000, "AKIA" * 500_000, "token" + " " * 2_000_000 + "= x"]
    start = time.perf_counter()
    for t in texts:
        secret_scan.novel_spans(t, secret_scan.base_spans(t), secret_scan.Novelty())
    assert time.perf_counter() - start < 60
    docs = frame(spark, list(enumerate(texts)))
    assert secret_scan.scan(docs).count() == 5 and secret_scan.without_secrets(docs).count() <= 5


def test_dictionary_of_the_corpus(spark):
    docs = frame(spark, [(i, f"my_vault_name token: q8Zt5LmP0xVw{i} other_{'abcdef'[i % 6]}") for i in range(30)] + [(100, None), (101, "far_away words")])
    found = secret_scan.dictionary(docs, "text")
    assert found.endswith(b"token my_vault_name") or b"my_vault_name" in found[-60:]
    assert b"q8Zt5" not in found and b"far_away" not in found and secret_scan.dictionary(frame(spark, []), "text") == secret_scan.COMMON


def test_bpe_has_one_python_worker_a_task(spark):
    docs = frame(spark, odd_rows(rng(3)))
    plan = registry.bpe_digests(docs)._jdf.queryExecution().executedPlan().toString()
    last = plan[: plan.index("Exchange")]
    assert len(re.findall("InArrow", last)) == 1
    one = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded_col="text")
    two = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, out_col="text")
    assert one.schema == two.schema and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_bpe_takes_little_memory_at_a_time():
    r = rng(31)
    texts = [prose(r, 300, 50_000) for _ in range(1400)]
    column = pa.chunked_array([pa.array(texts[:900]), pa.array([], pa.string()), pa.array(texts[900:])])
    words_, index, bounds = pretokens_of(column)
    found, at, ends = pretokens(*utf8(column))
    assert words_.equals(found) and np.array_equal(index, at) and np.array_equal(bounds, ends)
    assert [len(x) for x in pretokens_of(pa.chunked_array([], pa.string()))] == [0, 0, 1]
    tracemalloc.start()
    bpe.ranked(column)
    assert tracemalloc.get_traced_memory()[1] < 10 * column.nbytes
    tracemalloc.stop()
    classes.cache_clear()
    tracemalloc.start()
    classes()
    assert tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()

    ids = [None, b"", np.arange(200_000, dtype="<u4").tobytes(), *[np.arange(i % 50, dtype="<u4").tobytes() for i in range(9000)]]
    table = [b"%d " % i for i in range(200_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ids))), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
    parts = list(bpe.decoded([batch, batch.slice(0, 0), batch.slice(1, 2)], table, 1, ["doc_id", "ids", "decoded"]))
    assert all(p.num_rows == 1 or sum(map(len, filter(None, p.column(1).to_pylist()))) <= bpe.DECODE_BYTES for p in parts)
    want = [(i, x if x is None else b"".join(table[j] for j in np.frombuffer(x, "<u4"))) for i, x in enumerate(ids)]
    assert [p for q in parts for p in zip(q.column(0).to_pylist(), q.column(2).to_pylist(), strict=True)] == want + want[1:3]
