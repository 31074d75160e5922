"""Operators on whole tables: vectors, mixing, resampling, near-duplicates, passages, the pipeline."""

import hashlib
import itertools
import math
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from basalt.llm import ann, blocks, bpe, components as comps, language, minhash, mixing, passages, registry, resample, topk, words
from tests.llm.helpers import LOWER, WORD, components, families, frame, odd_rows, prose, rng
from tests.llm.test_text import RANKS, plain_base, spoken


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(r.normal(size=(260, 16)))]
    rows += [(1000 + i, rows[7][1]) for i in range(120)]  # one common vector
    rows += [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [1.0, None]), (2080, [float("nan")] * 16), (2100, [math.inf]), (2120, [0.5, -0.5]), (2140, rows[7][1]), (2140, rows[7][1]), (None, [1.0] * 16)]
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, v string"), rows


def plain_top(rows, every, k, score, zero):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    out = []
    for q, x in sorted({(i, tuple(v)) for i, v in ok if i % every == 0}):
        found = sorted((-score(x, v), i) for i, v in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


def inner(x, y):
    total = 0.0
    for a, b in zip(x, y, strict=False):
        total += a * b
    return total


@pytest.mark.parametrize("block", [64, 4096])
def test_nearest(vectors, monkeypatch, block):
    frame_, rows = vectors
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(ann, "best", lambda *a: blocks.best(*a, block=block))
    got = ann.nearest(frame_, F.col("id") % 20 == 0, 20).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, 20, 20, inner, False)


@pytest.mark.parametrize("block", [64, 4096])
def test_top_k(vectors, monkeypatch, block):
    frame_, rows = vectors
    monkeypatch.setattr(topk, "best", lambda *a: blocks.best(*a, block=block))
    got = topk.top_k(frame_, F.col("id") % 50 == 0, 5).collect()
    whole = lambda x, y: sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(x, y, strict=False))
    assert sorted(map(tuple, got)) == plain_top(rows, 50, 5, whole, True)


def test_vectors_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(none, F.col("id") % 20 == 0).collect() == [] and topk.top_k(none, F.col("id") % 50 == 0).collect() == []
    one = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(one, F.col("id") % 20 == 0).collect() == []


def test_error_bounds():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(50, 16)) * 10.0 ** r.integers(-3, 4, (50, 1)), r.normal(size=(60, 16))
    (xq, xs, xl, xe), (yq, ys, _, ye) = ann.quantised(x), ann.quantised(y)
    off = np.abs(x @ y.T - (xq @ yq.T) * xs[:, None] * ys)
    assert (off <= np.outer(xl, ye) + np.outer(xe, np.sqrt((y**2).sum(axis=1))) + 1e-9).all() and np.abs(xq).max() <= 127


def mix_rows():
    r = rng(11)
    return odd_rows(r) + [(100 + i, prose(r, min(5000, int(10 / (r.random() + 0.003)))), "en", r.choice(["a", "a", "a", "b", "c", None, "\U0001f642"])) for i in range(400)]


def plain_targets(sizes):
    """Share by weight; cap what is above three times its source's size, and share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), float(sum(sizes.values()))
    while left > 1e-9 and len(full) < len(names):
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        share = {s: target[s] + left * weight[s] / total for s in open_}
        left = 0.0
        for s in open_:
            target[s] = min(share[s], 3.0 * sizes[s])
            if share[s] >= 3.0 * sizes[s]:
                full.add(s)
                left += share[s] - target[s]
    return target


def test_mixing(spark):
    rows = mix_rows()
    docs = frame(spark, rows)
    got = mixing.taken(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.taken(docs.repartition(5)).collect()), key=repr)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    target = plain_targets(sizes)
    assert sorted(((g.doc_id, g.size) for g in got), key=repr) == sorted(((r[0], len(WORD.findall(r[1] or ""))) for r in rows), key=repr)
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    taken = dict.fromkeys(sizes, 0)
    for g in got:
        assert 0 <= g.taken <= 3 * g.size
        if g.doc_id is not None:
            assert g.source_size == sizes[source[g.doc_id]] and g.target == pytest.approx(target[source[g.doc_id]])
        taken[source.get(g.doc_id, "a")] += g.taken if g.doc_id is not None else 0
    largest = {}
    for r in rows:
        largest[r[3]] = max(largest.get(r[3], 0), len(WORD.findall(r[1] or "")))
    near = [s for s in sizes if 0 < largest[s] < 0.2 * target[s]]  # elsewhere one document more or less decides
    assert {"a", "b", None} <= set(near)
    for s in near:
        assert taken[s] == pytest.approx(target[s], rel=0.05)
    emitted = {}
    for m in mixing.mixed(docs).collect():
        emitted[m.doc_id] = emitted.get(m.doc_id, 0) + len(WORD.findall(m.text or ""))
        assert m.asDict().keys() == set(docs.columns)
    want = {}
    for g in got:
        want[g.doc_id] = want.get(g.doc_id, 0) + g.taken
    assert all(emitted.get(i, 0) == n for i, n in want.items())
    assert mixing.taken(frame(spark, [])).collect() == [] and mixing.mixed(frame(spark, [])).collect() == []


def test_mixing_sql(spark, tmp_path):
    docs = frame(spark, mix_rows())
    docs.select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(mixing.SQL).fetchall()
    assert sorted(map(tuple, mixing.taken(docs).collect()), key=repr) == sorted(want, key=repr)


def test_resampling(spark):
    r = rng(12)
    good = [(i, prose(r, r.randint(20, 200)), "en", "a") for i in range(200)]
    bad = [(1000 + i, " | ".join(prose(r, r.randint(20, 80)).split()), "en", "a") for i in range(60)]
    bad += [(2000 + i, "buy now " * r.randint(10, 60), "en", "a") for i in range(20)]
    docs = frame(spark, good + bad)
    target = spark.createDataFrame([(i,) for i in range(0, 200, 3)] + [(None,)], "doc_id long")
    got = resample.resample(docs, target, 200 / 280).collect()
    assert len(got) == 200 and sum(g.doc_id < 1000 for g in got) >= 195 and all(g.kept for g in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, resample.resample(docs.repartition(3), target, 200 / 280).collect()))
    odd = frame(spark, odd_rows(r))
    assert resample.resample(odd, target, 1.0).count() == odd.count() and resample.resample(odd, target.limit(0), 0.5).count() == 7
    assert resample.resample(frame(spark, []), target, 0.5).collect() == []


def test_largest(spark):
    r = np.random.default_rng(3)
    keys = [*r.normal(size=30_000).tolist(), *[0.25] * 15_000, 1e9, -1e9]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key double").repartition(4)
    order = sorted(range(len(keys)), key=lambda i: (-keys[i], i))
    for k in (0, 1, 9_000, 20_000, 44_999, 50_000):
        assert sorted(x.id for x in resample.largest(rows, k).collect()) == sorted(order[:k])


def test_gumbel(spark):
    found = spark.range(20_000).select(resample.gumbel(F.col("id")).alias("g")).agg(F.avg("g"), F.var_samp("g")).first()
    assert found[0] == pytest.approx(0.5772, abs=0.03) and found[1] == pytest.approx(math.pi**2 / 6, abs=0.1)


def test_components(spark):
    r = rng(13)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, 400 + k) for k in range(50)] + [(r.randrange(600, 700), r.randrange(600, 700)) for _ in range(60)] + [(9, 9), (3, 2), (2, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = comps.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
    assert comps.components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent):
    rows = families(rng(14)) + [(i, t, None, None) for i, t, *_ in odd_rows(rng(15))[:9]]
    want = components(rows, percent)
    docs = frame(spark, [*rows, rows[0], (None, rows[1][1]), (None, None)]).repartition(5)
    got = minhash.near_duplicates(docs, percent=percent).collect()
    assert len(got) == len(rows) + 3
    for g in got:
        if g.doc_id is not None:
            assert (g.n_shingles, g.component_id) == want[g.doc_id] and g.kept == (g.doc_id == g.component_id)
    assert sorted((g.n_shingles, g.component_id, g.kept) for g in got if g.doc_id is None and g.n_shingles) == [(want[rows[1][0]][0], want[rows[1][0]][1], False)]
    kept = minhash.without_copies(docs, percent=percent).collect()
    assert sorted(k.doc_id for k in kept if k.doc_id is not None) == sorted({c for _, c in want.values()})


def test_near_duplicates_without_rows(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []
    assert [tuple(r) for r in minhash.near_duplicates(frame(spark, [(3, None), (4, "a b")])).orderBy("doc_id").collect()] == [(3, 0, 3, True), (4, 1, 4, True)]
    with pytest.raises(ValueError):
        minhash.near_duplicates(frame(spark, []), percent=70)


def test_bucket_keys_rarely_miss():
    r = np.random.default_rng(5)
    for n in (7, 40, 400):
        for _ in range(200):
            union = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            drop = int(0.15 * n)
            a, b = union[r.permutation(n)[: n - drop // 2]], union[: n - (drop - drop // 2)]
            assert (minhash.bucket_keys(np.sort(a), 64, 8) == minhash.bucket_keys(np.sort(b), 64, 8)).any()


def test_passages(spark):
    r = rng(16)
    shared = [prose(r, 70).split() for _ in range(4)]
    rows, want = [], {}
    for i in range(60):
        w, at = prose(r, r.randint(30, 200), 100_000).split(), r.randint(0, 20)
        if i % 2 == 0:
            p = list(shared[i // 2 % 4])
            if i % 3 == 0:
                p[33] = "changed"
                del p[50]
            w[at:at] = p
            want[i] = (at, at + len(p))
        rows.append((i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    long = prose(r, 20_000, 100_000)
    rows += [(100, long), (101, long), (102, None), (103, ""), (104, "one two"), (105, " ".join(["again"] * 500)), (106, " ".join(["again"] * 400)), (None, long), (100, "short"), (1, prose(r, 3))]
    got = passages.repeated_passages(frame(spark, rows).repartition(4)).collect()
    spans = {}
    for g in got:
        assert g.end_word - g.start_word >= 50 <= g.matched and g.doc_id != g.other_id
        spans.setdefault(g.doc_id, []).append((g.start_word, g.end_word))
    assert set(spans) == set(want) | {100, 101, 105, 106}
    for i, (a, b) in want.items():
        assert any(abs(x - a) <= 3 and abs(y - b) <= 3 for x, y in spans[i]), (i, a, b, spans[i])
    assert spans[101] == [(0, 20_000)]
    assert passages.repeated_passages(frame(spark, [])).collect() == []


def passage_seeds(text):
    hashes = words.words(text.encode(), np.array([0, len(text.encode())]))[0]
    return set(passages.seeds(hashes)[0].tolist())


def test_passages_of_one_match(spark):
    """Two copies whose other seeds an earlier text has too, and copies whose edits leave one shared seed."""
    r, rows, want = rng(18), [], set()
    while len(want) < 4:
        p, i = prose(r, 60, 100_000).split(), 10 * len(want)
        first, b, c = (" ".join([prose(r, 30, 100_000), " ".join(w), prose(r, 30, 100_000)]) for w in (p[:49], p, p))
        if len(passage_seeds(b) & passage_seeds(c) - passage_seeds(first)) == 1:
            rows += [(i, first), (i + 1, b), (i + 2, c)]
            want |= {i + 1, i + 2}
    while len(want) < 8:
        p, i = prose(r, 64, 100_000).split(), 10 * len(want)
        q = [f"edit{i}x{j}" if j % 8 == 3 and j not in (27, 35) else w for j, w in enumerate(p)]
        b, c = (" ".join([prose(r, 30, 100_000), " ".join(w), prose(r, 30, 100_000)]) for w in (p, q))
        if len(passage_seeds(b) & passage_seeds(c)) == 1:
            rows += [(i, b), (i + 1, c)]
            want |= {i, i + 1}
    got = passages.repeated_passages(frame(spark, rows)).collect()
    assert {g.doc_id for g in got} == want


def test_passages_beyond_partial_copies(spark):
    """Copies all of whose seeds first occur in earlier texts that hold too little of the passage, in one
    earlier text for each end or in several."""
    r, rows, want = rng(19), [], set()
    for i, times in enumerate([1, 1, 1, 4]):
        while True:
            p = prose(r, 80, 100_000).split()
            texts = [" ".join([prose(r, 30, 100_000), " ".join(w), prose(r, 30, 100_000)]) for w in [p[:48], p[-48:]] * times + [p, p]]
            b, c = map(passage_seeds, texts[-2:])
            if b & c and not b & c - set().union(*map(passage_seeds, texts[:-2])):
                break
        rows += [(100 * i + j, t) for j, t in enumerate(texts)]
        want |= {100 * i + len(texts) - 2, 100 * i + len(texts) - 1}
    got = passages.repeated_passages(frame(spark, rows)).collect()
    assert {g.doc_id for g in got} == want
    assert all((g.start_word, g.end_word, g.matched) == (30, 110, 80) for g in got)


def best_chain(x, y):
    order = sorted(zip(x, y, strict=True))
    score = []
    for i, (a, b) in enumerate(order):
        before = [score[j] - passages.GAP_COST * (a - c + b - d) for j, (c, d) in enumerate(order[:i]) if c < a and d < b]
        score.append(passages.K + max([0, *before]))
    return max(score)


def test_chains_are_best(monkeypatch):
    monkeypatch.setattr(passages, "MAX_GAP", 1000)  # whole chains, not cut at long gaps
    r = np.random.default_rng(6)
    for _ in range(200):
        pairs = np.unique(r.integers(0, 60, (r.integers(1, 25), 2)), axis=0)
        x, y = pairs.T
        found = passages.chains(x, y)
        assert sorted((a, b) for c in found for a, b in zip(*map(np.ndarray.tolist, c), strict=True)) == sorted(map(tuple, pairs.tolist()))
        worth = [passages.K * len(c[0]) - passages.GAP_COST * ((c[0][-1] - c[0][0]) + (c[1][-1] - c[1][0])) for c in found]
        assert max(worth) == pytest.approx(best_chain(x.tolist(), y.tolist()))
        assert all((np.diff(c[0]) > 0).all() and (np.diff(c[1]) > 0).all() for c in found)


def test_pipeline(spark, tmp_path):
    """run() against plain versions of its stages, the language stage's verdicts apart."""
    r = rng(17)
    rows = [(i, f"{spoken(r, lang, r.randint(30, 60))}", lang, r.choice("abc")) for i in range(120) for lang in [r.choice(["en", "de"])]]
    rows += [(200 + i, rows[i][1] + " more", rows[i][2], "a") for i in range(15)]
    rows += [(300 + i, f"{spoken(r, 'en', 40)} password=Zk39fjLQ8ty", "en", "b") for i in range(10)] + [(400, "12345 67", "en", "a"), (401, None, None, None), (402, "", "en", "a")]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    spoken_ids = {x.doc_id for x in language.identify(docs, ~language.held_out(F.col("doc_id"))).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert spoken_ids == {x[0] for x in rows if any(c.isalpha() for c in x[1] or "")}
    left = [x for x in rows if x[0] in spoken_ids]
    same = components(left, 80)
    left = [x for x in left if same[x[0]][1] == x[0] and not plain_base(x[1])]
    sizes, factors = {}, mixing.multipliers()
    for x in left:
        sizes[x[3]] = sizes.get(x[3], 0) + len(WORD.findall(x[1]))
    want = []
    encode = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={}).encode_ordinary
    for s, target in plain_targets(sizes).items():
        rate, own = target / sizes[s], [x for x in left if x[3] == s]
        draw = lambda i, k: ((int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % (mixing.PRIME - 1) + 1) * factors[k] % mixing.PRIME) / mixing.PRIME
        part = rate - math.floor(rate)
        extra = lambda k: sum(len(WORD.findall(x[1])) for x in own if draw(x[0], k) < part)  # noqa: B023, E731
        seed = min(range(mixing.SEEDS), key=lambda k: (abs(math.floor(rate) * sizes[s] + extra(k) - target), k))
        for x in own:
            ids = encode(x[1])
            digests = (x[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(x[1].encode()).hexdigest())
            want += [digests] * (math.floor(rate) + (draw(x[0], seed) < part))
    assert sorted(map(tuple, got)) == sorted(want)


def test_words_agree():
    from basalt.llm import words
    from basalt.llm.common import utf8
    import pyarrow as pa

    texts = ["", " a\x1cb c\n D\td ", "\x0b\x0c", "É é"]
    hashes, _, bounds = words.words(*utf8(pa.array(texts)))
    assert np.diff(bounds).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))) for t in texts]


def test_sql_of_vectors(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    for name in ("op1_nearest_neighbours", "op3_exact_top_k"):
        frame_ = registry.QUERIES[name](spark, sf)
        want = con.execute(f"SELECT {', '.join(frame_.columns)} FROM ({registry.SQL[name]})").fetchall()
        assert sorted(map(tuple, frame_.collect())) == sorted(want)


def test_sql_of_near_duplicates(spark, tmp_path):
    rows = families(rng(21), 4, 8) + [(i, t, None, None) for i, t, *_ in odd_rows(rng(22))[:5]]
    frame(spark, rows).select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = components(rows, 85)
    got = con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({registry.SQL['op10_minhash_near_dedup']})").fetchall()
    assert sorted(got) == sorted((i, n, c, i == c) for i, (n, c) in want.items())


@pytest.mark.parametrize("in_a_task", [0, 5, 40, 1 << 20])
def test_components_whoever_does_the_work(spark, in_a_task):
    r = rng(31)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(90)] + [(1000, 1000 - k) for k in range(60)] + [(2000 + i, 2001 + i) for i in range(40)]
    want = {}
    for u, v in edges:
        if u != v:
            a, b = want.get(u, {u}), want.get(v, {v})
            whole = a | b
            want |= {x: whole for x in whole}
    got = comps.components(spark.createDataFrame(edges, "u long, v long").repartition(6), in_a_task).collect()
    assert sorted(map(tuple, got)) == sorted((x, min(s)) for x, s in want.items())


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """Links that stars miss, compared in many blocks; sets that share a passage only stay apart."""
    r = rng(32)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    rows = families(r, 6, 14)
    passage = prose(r, 150)
    rows += [(5000 + i, f"{passage} {prose(r, r.randrange(1, 40))}", None, None) for i in range(30)]
    want = components(rows, 85)
    got = minhash.near_duplicates(frame(spark, rows).repartition(3)).collect()
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == want


def test_without_copies_by_row(spark):
    """Different texts with one id both stay, equal rows stay once, names of columns don't matter."""
    r = rng(33)
    a, b = prose(r, 60), prose(r, 60)
    rows = [(1, a), (1, b), (2, a + " more"), (2, prose(r, 50)), (3, b), (3, b), (4, None), (4, None), (None, a), (None, "alone here"), (5, ""), (5, "")]
    docs = spark.createDataFrame([(t, i, "k") for i, t in rows], "`te.xt` string, `an id` long, `root` string").repartition(3)
    got = minhash.without_copies(docs, "an id", "te.xt")
    assert got.columns == docs.columns
    left = sorted(((x[1], x[0]) for x in got.collect()), key=repr)
    assert left == sorted([(1, a), (1, b), (2, rows[3][1]), (4, None), (None, "alone here"), (5, "")], key=repr)
    assert minhash.without_copies(frame(spark, [])).collect() == []


def test_passages_quoted_before(spark):
    """A passage of two texts, each piece of which short texts with smaller ids quote."""
    r = rng(51)
    p = prose(r, 200, 100_000).split()
    rows = [(i, " ".join([prose(r, 20, 100_000), *p[a : a + 10], prose(r, 20, 100_000)])) for i, a in enumerate([*range(0, 190, 4), *range(2, 190, 27)])]
    rows += [(500 + i, " ".join([prose(r, 30, 100_000), *p, prose(r, 30, 100_000)])) for i in range(2)]
    got = passages.repeated_passages(frame(spark, rows)).collect()
    assert {(g.doc_id, g.start_word, g.end_word, g.other_id) for g in got} == {(500, 30, 230, 501), (501, 30, 230, 500)}


def test_fuzzy_passages_quoted_before(spark):
    """Two fuzzy copies, each seed of which short texts with smaller ids have too, and a text that quotes pieces of
    a passage before it has it whole."""
    r = rng(54)
    p = prose(r, 100, 100_000).split()
    q = [f"edit{j}" if j % 13 == 12 else w for j, w in enumerate(p)]
    rows = [(i, " ".join([prose(r, 20, 100_000), *p[a : a + 12], prose(r, 20, 100_000)])) for i, a in enumerate(range(0, 92, 2))]
    rows += [(500 + i, " ".join([prose(r, 30, 100_000), *w, prose(r, 30, 100_000)])) for i, w in enumerate((p, q))]
    assert not passage_seeds(" ".join(p)) & passage_seeds(" ".join(q)) - set().union(*(passage_seeds(t) for _, t in rows[:-2]))
    p = prose(r, 60, 100_000).split()
    pieces = [" ".join([*p[a : a + 12], prose(r, 20, 100_000)]) for a in range(0, 52, 2)]
    rows += [(600, " ".join([*pieces, *p])), (601, " ".join([prose(r, 30, 100_000), *p]))]
    got = passages.repeated_passages(frame(spark, rows)).collect()
    assert {(g.doc_id, g.start_word, g.end_word, g.other_id) for g in got} == {(500, 30, 130, 501), (501, 30, 130, 500), (600, 830, 890, 601), (601, 30, 90, 600)}


def test_passages_beside_unlike_words(spark):
    """Equal passages in a chain with seeds beyond many changed words, and before a weak end."""
    r, rows = rng(57), []
    for i in range(6):
        p, q = prose(r, 60, 100_000), prose(r, 10, 100_000)
        ends = [f"{prose(r, 38, 100_000)} {q}" for _ in range(2)]
        tail = prose(r, 60, 100_000).split()
        weak = [" ".join(w if k % 8 in (5, 6, 7) else f"v{i}{j}{k}" for k, w in enumerate(tail)) for j in range(2)]
        rows += [(10 * i + j, " ".join([prose(r, 30, 100_000), p, weak[j] if i % 3 else ends[j]])) for j in range(2)]
    got = passages.repeated_passages(frame(spark, rows)).collect()
    assert {(g.doc_id, g.other_id) for g in got} >= {(10 * i + j, 10 * i + 1 - j) for i in range(6) for j in range(2)}
    assert all(g.matched >= 50 and g.matched >= 0.8 * (g.end_word - g.start_word) for g in got)


def test_copies_of_unlike_texts_keep_their_links(spark):
    """Text 3 is like 0 and 2, and 2 like 1, each in the same place; others aren't like each other."""
    r = rng(55)
    while True:
        edit = lambda w, first, name: [f"{name}{j}" if j >= first and (j - first) % 18 < 3 else x for j, x in enumerate(w)]
        p = prose(r, 100, 100_000).split()
        b = edit(p, 10, "b")
        texts = [edit(b, 16, "a"), edit(p, 16, "e"), p, b]
        has = [passage_seeds(" ".join(t)) for t in texts]
        if has[3] & has[0] and has[3] & has[2] and has[2] & has[1]:
            break
    rows = [(i, " ".join([prose(r, 30, 100_000), *t, prose(r, 30, 100_000)])) for i, t in enumerate(texts)]
    got = passages.repeated_passages(frame(spark, rows)).collect()
    links = {tuple(sorted((g.doc_id, g.other_id))) for g in got}
    assert links == {(0, 3), (2, 3), (1, 2)}


def test_likely_texts_against_all_pairs():
    r = np.random.default_rng(56)

    def in_common(a, b):
        return sum((Counter(a) & Counter(b)).values())

    some = 0
    for _ in range(30):
        base = [r.integers(0, 300, 90, dtype=np.uint32) for _ in range(3)]
        around = [np.where(r.random(90) < r.choice([0.6, 0.8, 0.95]), base[i % 3], r.integers(0, 60, 90, dtype=np.uint32)).astype(np.uint32) for i in range(24)]
        ids, open_, at = r.integers(0, 20, 24).tolist(), (r.random(24) < 0.6).tolist(), (40 + r.integers(0, 2, 24)).tolist()
        got = {(i, j) for i, others in passages.likely(ids, at, open_, [a.tobytes() for a in around], 50, 0.8) for j in others}
        side = lambda i, j, k: (j >= at[i]) + (j >= at[i] + k)
        lists = [[(side(i, j, 6), w) for j, w in enumerate(a.tolist())] for i, a in enumerate(around)]
        pairs = [[(side(i, j, 5), *two) for j, two in enumerate(zip(a.tolist(), a[1:].tolist()))] for i, a in enumerate(around)]
        want = {(i, j) for i in range(24) for j in range(24) if open_[i] and ids[i] != ids[j] and in_common(lists[i], lists[j]) >= 50 and in_common(pairs[i], pairs[j]) >= 25}
        assert got == want
        some += len(want)
    assert some > 100 and passages.least_pairs(50, 0.8) == 25


def test_common_lines_stay_linear(spark, monkeypatch):
    """A short line in very many texts gives no passage and no pairs beyond a star."""
    r = rng(52)
    line = prose(r, 35, 100_000)
    rows = [(i, f"{prose(r, 60, 100_000)} {line} {prose(r, 60, 100_000)}") for i in range(300)]
    seen, saved = [], passages.saved
    monkeypatch.setattr(passages, "saved", lambda df, name, **k: (out := saved(df, name, **k), name == "chains" and seen.append(out.count()))[0])
    assert passages.repeated_passages(frame(spark, rows)).collect() == []
    assert sum(seen) <= 300 * 20


def test_like_surroundings_of_no_passage_stay_linear(spark, monkeypatch):
    """Many texts with a line between the same words in other orders, and two of them with a passage around it: no
    pairs of whole texts but a star and those with a passage."""
    r = rng(58)
    line, before, after = prose(r, 32, 100_000), prose(r, 40, 100_000).split(), prose(r, 40, 100_000).split()
    shuffled = lambda blocks: " ".join(r.sample(blocks, len(blocks)))
    rows = [(i, f"{prose(r, 120, 100_000)} {shuffled(before)} {line} {shuffled(after)} {prose(r, 120, 100_000)}") for i in range(60)]
    whole = f"{' '.join(before)} {line} {' '.join(after)}"
    rows += [(100 + i, f"{prose(r, 30 + 70 * i, 100_000)} {whole} {prose(r, 120, 100_000)}") for i in range(2)]
    seen, saved = [], passages.saved
    monkeypatch.setattr(passages, "saved", lambda df, name, **k: (out := saved(df, name, **k), name == "chains" and seen.append(out.count()))[0])
    got = passages.repeated_passages(frame(spark, rows)).collect()
    assert {(g.doc_id, g.start_word, g.end_word, g.other_id) for g in got} >= {(100, 30, 142, 101), (101, 100, 212, 100)}
    assert len(got) < 10 and sum(seen) <= 2 * 62, (len(got), seen)


def test_passages_beside_a_match():
    """Around a match: passages within these words and beyond them, and words in another order."""
    r = np.random.default_rng(59)
    new = lambda n: r.integers(0, 2**32, n, dtype=np.uint32)
    seed, p, q = new(6), new(40), new(40)
    a, b = (np.concatenate([new(60), p, seed, q, new(60)]) for _ in range(2))
    assert passages.beside(a, b, 100, 100, 50, 0.8) == ((60, 146, 60, 146, 86), False)
    changed = np.where(np.arange(40) % 9 == 8, new(40), q)
    b = np.concatenate([new(60), p[:20], new(2), p[20:], seed, changed, new(60)])[2:]
    (x0, x1, y0, y1, same), on = passages.beside(a, b, 100, 100, 50, 0.8)
    assert (x0, y0, same) == (60, 58, 82) and 142 <= x1 <= 146 and same >= 0.8 * (y1 - y0) and not on
    mixed = np.concatenate([new(60), p[30:], p[20:30], p[10:20], p[:10], seed, q[30:], q[20:30], q[10:20], q[:10], new(60)])
    assert passages.beside(a, mixed, 100, 100, 50, 0.8) == (None, False)
    rough = np.concatenate([np.where(np.arange(100) % 15 < 9, a[:100], new(100)), seed, np.where(np.arange(100) % 15 < 9, a[106:], new(100))])
    assert passages.beside(a, rough, 100, 100, 50, 0.8) == (None, True)
    texts = [np.tile(new(24), 9)[:206]] * 30  # a text that repeats itself, in two texts
    rows = passages.tries(1, [0] * 15 + [1] * 15, [100 + 24 * i for i in range(15)] * 2, [True] * 30, [t.tobytes() for t in texts], 0, 4, 50, 0.8)
    assert len({(a, x) for _, a, _, x, *_ in rows}) == 15 and all(row[-2] >= 50 for row in rows)


@pytest.mark.parametrize("n,identity,least", [(100, 0.95, 0.98), (100, 0.9, 0.95), (70, 0.9, 0.9), (100, 0.85, 0.9)])
def test_recall_of_fuzzy_passages(n, identity, least):
    """Copies with evenly likely changed words, from seeds to alignment, against the words that stayed."""
    r, found, trials = np.random.default_rng(53), 0, 0
    while trials < 200:
        p = r.integers(0, 2**63, n, dtype=np.uint64)
        q = np.where(r.random(n) < identity, p, r.integers(0, 2**63, n, dtype=np.uint64))
        if not 50 <= (p == q).sum() or (p == q).mean() < 0.8:
            continue
        trials += 1
        a, b = (np.concatenate([r.integers(0, 2**63, 40, dtype=np.uint64), w, r.integers(0, 2**63, 40, dtype=np.uint64)]) for w in (p, q))
        (ha, xa), (hb, xb) = passages.seeds(a), passages.seeds(b)
        _, i, j = np.intersect1d(ha, hb, return_indices=True)
        for x, y in passages.chains(xa[i], xb[j]) if len(i) else []:
            got = passages.align(a, b, x, y)
            if got and got[4] >= 50 and got[4] >= 0.8 * max(got[1] - got[0], got[3] - got[2]):
                found += 1
                break
    assert found >= least * trials, found / trials


def test_survivors_take_bounded_memory():
    """Nearly equal vectors, all of which the bounds let through."""
    import tracemalloc

    r = np.random.default_rng(61)
    base = r.normal(size=768)
    c, q = (base + 1e-9 * r.normal(size=(n, 768)) for n in (1500, 64))
    tracemalloc.start()
    rows_, cols, scores = ann.tile(np.arange(64) + 10_000, q, np.arange(1500), c, 20)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    for i in (0, 63):
        want = sorted(((-float(ann.inner(q[i : i + 1], c[j : j + 1])[0]), j) for j in range(1500)))[:20]
        assert [(-s, j) for s, j in zip(scores[rows_ == i].tolist(), cols[rows_ == i].tolist(), strict=True)] == want


def test_one_row_many_times(spark, monkeypatch):
    """Repeated rows are candidates each, and blocks stay small."""
    rows = [(7, [1.0, 2.0])] * 500 + [(i, [float(i % 5), 1.0]) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(docs, F.col("id") == 100, 5).orderBy("rank").collect()
    assert len(got) == 5 and {g.vec_id for g in got} == {7} and {g.score for g in got} == {2 * 65536}
    near = ann.nearest(docs, F.col("id") == 104, 3).orderBy("rank").collect()
    assert [(g.vec_id, g.score) for g in near] == [(109, 17.0), (114, 17.0), (119, 17.0)]


def test_small_results_share_batches():
    found = list(passages.batched(([(i, "x")] * (i % 3) for i in range(9000)), {"a": pa.int64(), "b": pa.string()}))
    assert len(found) == 9
    assert [i for b in found for i in b.column(0).to_pylist()] == [i for i in range(9000) for _ in range(i % 3)]


def test_common_words_against_a_plain_version():
    r = rng(41)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for w in a:
            row = [0, *itertools.accumulate((max(row[j + 1], row[j] + 1 if w == v else 0) for j, v in enumerate(b)), max)]
        assert passages.common(np.array(a, np.uint32), np.array(b, np.uint32)) == row[-1]


def words_beside(r, word, before, after):
    """Stretches of said-again words, of which one holds the match."""
    other = lambda: [int(r.integers(10, 10**9))] * int(r.integers(14, 60))
    left, right = [word] * before, [word] * after
    while len(left) < passages.REACH:
        left = other() + left
    while len(right) < passages.REACH:
        right += other()
    return np.array([*left[-passages.REACH :], *[word] * passages.K, *right[: passages.REACH]], np.uint32)


def test_words_said_again_are_ruled_out():
    """Stretches that share one word, said again and again: those without a passage are known by their words."""
    r = np.random.default_rng(62)
    texts = [words_beside(r, 7, int(r.integers(0, 20)), int(r.integers(0, 20))) for _ in range(40)]
    texts += [words_beside(r, 7, 100, 100)] * 20
    ok, on = passages.hopeful(texts, [100] * 60, 0, list(range(1, 60)), 50, 0.8)
    for j, (may, may_on) in enumerate(zip(ok, on, strict=True), 1):
        passage, goes_on = passages.beside(texts[0], texts[j], 100, 100, 50, 0.8)
        assert (may or not passage) and (may_on or not goes_on)
    assert ok.sum() < 20


def test_hopeful_rules_nothing_out_that_is_found():
    r, found = np.random.default_rng(63), 0
    for _ in range(60):
        base = r.integers(0, 40, 206)
        texts = []
        for _ in range(8):
            w = np.where(r.random(206) < r.choice([0.5, 0.75, 0.9]), base, r.integers(0, 400, 206)).tolist()
            for p in r.integers(0, 90, 4).tolist():
                w[p : p + int(r.integers(0, 9))] = [int(r.integers(0, 40))] * int(r.integers(0, 9))
            w = [*w[:100], *base[100:106].tolist(), *w[-100:]]
            texts.append(np.array([0] * (206 - len(w)) + w, np.uint32)[-206:])
        ok, on = passages.hopeful(texts, [100] * 8, 0, list(range(1, 8)), 50, 0.8)
        for j, (may, may_on) in enumerate(zip(ok, on, strict=True), 1):
            passage, goes_on = passages.beside(texts[0], texts[j], 100, 100, 50, 0.8)
            assert (may or not passage) and (may_on or not goes_on)
            found += bool(passage) + goes_on
    assert found > 20


def test_work_of_a_seed_is_dealt_out(spark, monkeypatch):
    """A seed with many open occurrences in several parts gives what it gives in one."""
    r = rng(64)
    word = next(w for w in (f"again{i}" for i in range(1000)) if next(iter(passage_seeds(" ".join([w] * 6)))) < 2**64 // passages.SHARE)
    rows = [(i, " ".join([prose(r, 30, 100_000), *[word] * (8 + i % 9), prose(r, 30, 100_000)])) for i in range(12)]
    near = prose(r, 25, 100_000)
    rows += [(100 + i, " ".join([prose(r, 30, 100_000), near, *[word] * 12, near, prose(r, 30, 100_000)])) for i in range(3)]
    want = sorted(passages.repeated_passages(frame(spark, rows)).collect())
    seen, dealt = [], passages.dealt
    monkeypatch.setattr(passages, "dealt", lambda near: (out := dealt(near), seen.append((near.count(), out.count(), near.where("open").count(), out.where("open").count())))[0])
    monkeypatch.setattr(passages, "OPEN", 4)
    got = sorted(passages.repeated_passages(frame(spark, rows)).collect())
    assert got == want and len(want) >= 3
    assert seen[0][1] > seen[0][0] and seen[0][2] == seen[0][3]
