"""Near-duplicates by one-permutation hashing.

Each document's set of word shingles is hashed once; the smallest hash in each bin is its
signature, an empty bin takes the value of the non-empty bin that comes first in an order of its
own (optimal densification), and bands of ROWS bins give the bucket keys. Documents with the
same set form one class, and only classes go on. A bucket links its members to one centre, not to
each other, so its candidate pairs grow with its size; the centre is the member that shares most buckets with most
others. Each pair is confirmed on the full sets.

A star can miss a link between two members that are both unlike the centre. So documents of a bucket
that isn't one component afterwards go through an exact second pass: the shingles of each set in order of
their frequency, rarest first, and of that order only as many as make sure that similar sets have
one in common (a prefix filter). What many documents share, such as a common passage, comes last and
brings nobody together. Those that share such a shingle, but not yet a component, are compared in blocks:
a task gets two blocks of a group, multiplies their incidence matrices and emits links, at most one
fewer than members. No bucket and no group has a cap.

Bands are chosen so that a pair at the threshold shares no bucket with probability below 1e-8.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import bitmap, byte_groups, lean, maybe_in, saved, scratch, ship, small, utf8
from basalt.llm.components import components
from basalt.llm.words import mix, odd, shingle_sets

#: Bands and rows by the least percent they serve. Long bands keep documents that merely share a passage apart.
BANDS = {85: (64, 8), 80: (88, 7)}
GROUP_BYTES = 1 << 20
#: Members of a block and shingles of their sets, and columns of the incidence matrices that are held at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 17, 2048
#: Frequencies are counted by so many leading bits of a shingle's hash: any order is right, a rough one is good.
FREQUENCY_BITS = 20
SHIFT = np.uint64(64 - FREQUENCY_BITS)


@functools.cache
def orders(bins: int) -> np.ndarray:
    """For each bin, a rank of every other bin."""
    return mix(odd(bins, bins, seed=7)).astype(np.uint32)


@functools.cache
def multipliers(bands: int, rows: int) -> np.ndarray:
    return odd(bands, rows, seed=8)


def bucket_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The bucket keys of a non-empty sorted array of distinct hashes, one for each band."""
    n = bands * rows
    bins = (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    full = bins[first]
    signature = np.zeros(n, np.uint64)
    signature[full] = hashes[first]
    if len(full) < n:
        empty = np.ones(n, bool)
        empty[full] = False
        empty = np.flatnonzero(empty)
        signature[empty] = signature[full[np.argmin(orders(n)[empty][:, full], axis=1)]]
    keys = mix((mix(signature.reshape(bands, rows)) * multipliers(bands, rows)).sum(axis=1, dtype=np.uint64))
    return mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)


def unpacked(value: pa.Scalar) -> np.ndarray:
    """The sorted distinct hashes of a set, from their bytes."""
    return np.frombuffer(value.as_buffer(), np.uint64)


def of_sets(docs: DataFrame, text_col: str, width: int, schema: str, row) -> DataFrame:
    """docs' other columns and what row() makes of each text's shingle set (a tuple for each)."""
    rest = [c for c in docs.columns if c != text_col]
    source = docs.select(*rest, F.col(text_col).cast("string"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            column = pc.fill_null(batch.column(len(rest)), "")
            for a, b in byte_groups(column, GROUP_BYTES):
                rows = [row(s) for s in shingle_sets(*utf8(column.slice(a, b - a)), width)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(rest))), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=[*rest, *names])

    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[x.split()[1]] for x in schema.split(", ")]
    return source.mapInArrow(lean(run), f"{kept}, {schema}")


def fingerprint(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """One row for each input row: the id, n_shingles (size of its set), component_id (the smallest
    id that links reach, its own included) and kept (id = component_id).

    Texts are linked if 100 * intersection >= percent * union of their shingle sets (percent is 80 or
    more: there are bands for that). Null, empty and wordless texts have n_shingles 0 and are
    linked with nothing; a text of fewer than `width` words is one shingle. Rows with null ids take
    part, but no null becomes a component_id while the component has another id. Repeated rows get
    the same values. An empty table gives an empty one. Other columns are ignored. Ids sort as
    their type does, so ties cannot occur.
    """
    with scratch(docs.sparkSession):
        rows, named = grouped(narrow(docs, id_col, text_col), width, percent)
        smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
        found = rows.select("id", "fp", "n").join(named.join(smallest, "root").select("fp", "component_id"), "fp", "left")
        found = found.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
        found = saved(found.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))), "near-duplicates", keep=True)
    return found.withColumnRenamed("id", id_col)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component of near_duplicates(), that of the smallest id (of rows that share that id,
    the one whose text has the smallest hash); all columns stay, whatever their names.

    Rows go by id and text, so different texts with one id are told apart; of rows that are equal in both, any one
    stays, also where the text is null or has no words. Rows without an id stay, unless their component has a row with an
    id or another text without one. An empty table gives an empty one. What has to go is broadcast
    where it is measured to be small, so that texts aren't shuffled.
    """
    with scratch(docs.sparkSession):
        rows, named = grouped(narrow(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")), width, percent)
        rows = rows.select("id", "text_hash", "fp").join(named.select("fp", "root"), "fp", "left")
        rows = saved(rows.select(F.col("id").alias("id_"), F.col("text_hash").alias("hash_"), "root"), "copies")
        stays = rows.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id_").isNull(), "id_", "hash_")).alias("first"))
        other = ~(F.col("id_").eqNullSafe(F.col("first.id_")) & (F.col("hash_") == F.col("first.hash_")))
        removed = saved(rows.join(stays, "root").where(other).select("id_", "hash_").distinct(), "removed", keep=True)
        repeated = saved(rows.where("id_ is not null").groupBy("id_", "hash_").count().where("count > 1").select("id_", "hash_"), "repeated", keep=True)
    every = [F.col(f"`{c}`") for c in docs.columns]
    own = F.col(f"`{id_col}`")
    marked = docs.select(F.struct(*every).alias("row_"), own.alias("own_"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text_"))
    same = F.col("own_").eqNullSafe(F.col("id_")) & (F.col("text_") == F.col("hash_"))
    rest = marked.join(small(removed), same, "left_anti")
    if repeated.isEmpty():
        return rest.select("row_.*")
    repeated = small(repeated)
    single = rest.join(repeated, same, "left_anti")
    return single.union(rest.join(repeated, same, "left_semi").dropDuplicates(["own_", "text_"])).select("row_.*")


def grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs (id, text and others) as rows with fp, the fingerprint of the set, and n, its size, for the text; and, for each
    class of rows with one fp that isn't alone, fp, node, first_id and the root of its component."""
    shape = next((x for least, x in BANDS.items() if percent >= least), None)
    if shape is None:
        raise ValueError(f"there are bands for {min(BANDS)} percent or more only")
    ship(docs.sparkSession)

    def signature(s):
        return (fingerprint(s), len(s), bucket_keys(s, *shape).tolist() if len(s) else [])

    rows = saved(of_sets(docs, "text", width, "fp binary, n long, keys array<long>", signature), "signatures")
    # keys depend on fp alone, so any row's will do
    some = rows.where("n > 0").groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = saved(some.withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = components(confirmed(docs, classes, width, percent))
    named = classes.select("fp", "node", "first_id", "copies").join(roots, "node", "left").where("copies > 1 or root is not null")
    return rows, saved(named.withColumn("root", F.coalesce("root", "node")), "named")


def confirmed(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links u, v between classes: enough of them to join all that any similar classes of a bucket join."""
    keys = classes.select("node", "n", F.explode("keys").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = saved(keys.join(sizes, "key"), "buckets")
    # The original of a family of copies is nearer to each of them than they are to each other, so
    # it meets the largest crowd, and buckets that hold it take it as their centre.
    crowds = members.groupBy("node").agg(F.sum("size").alias("crowd"))
    centres = members.join(crowds, "node").groupBy("key").agg(F.max(F.struct("crowd", "node", "n")).alias("centre"))
    starred = members.join(centres, "key").where("node <> centre.node").select(F.col("centre.node").alias("c"), F.col("centre.n").alias("m"), "node", "n")
    pairs = saved(worth_trying(starred, percent), "pairs")
    sets = saved(sets_of(docs, classes, members.select("node").distinct(), width), "sets")
    links = saved(similar(pairs, sets, percent), "links")
    roots = components(links)
    rooted = members.where("size > 2").select("node", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = saved(rooted.join(apart(rooted), "key", "left_semi").select("node", "root").distinct(), "rest")
    if rest.isEmpty():
        return links
    rare = saved(rarest(sets, rest, percent), "prefixes")
    groups = saved(rare.join(apart(rare), "key", "left_semi"), "groups")
    return links if groups.isEmpty() else links.union(saved(in_blocks(clustered(groups), sets, percent), "links"))


def worth_trying(pairs: DataFrame, percent: int) -> DataFrame:
    """u < v of the distinct pairs (node, n and c, m) whose sizes allow a link."""
    near = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    return pairs.where(near).select(F.least("node", "c").alias("u"), F.greatest("node", "c").alias("v")).distinct()


def apart(rows: DataFrame) -> DataFrame:
    """The keys of rows (key, root) whose members aren't one component."""
    return rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")


def rarest(sets: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """node, root, n, key: the rarest shingles of each wanted set (node, root), so many that sets similar enough
    share one of them. Frequencies are summed over each partition, and the driver gets a table of fixed size."""
    own = sets.join(wanted, "node").select("node", "root", "hashes")

    def count(batches):
        total = np.zeros(1 << FREQUENCY_BITS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, (unpacked(x) >> SHIFT).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    found = own.select("hashes").mapInArrow(lean(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(1 << FREQUENCY_BITS, np.int32)
    frequency[found.column("at").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**31 - 1)
    known = sets.sparkSession.sparkContext.broadcast(frequency)

    def prefix(batches):
        for batch in batches:
            lengths, keys = [], []
            for x in batch.column(2):
                x = unpacked(x)
                length = len(x) - -(-percent * len(x) // 100) + 1
                lengths.append((len(x), length))
                keys.append(x[np.lexsort((x, known.value[(x >> SHIFT).astype(np.int64)]))[:length]].view(np.int64))
            if lengths:
                sizes, times = np.array(lengths, np.int64).T
                ids = [np.repeat(batch.column(i).to_numpy(zero_copy_only=False), times) for i in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*ids, np.repeat(sizes, times), np.concatenate(keys))], names=["node", "root", "n", "key"])

    return own.mapInArrow(lean(prefix), "node long, root long, n long, key long")


def parts(members, shingles):
    """Blocks of a group with so many members whose sets have so many shingles."""
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / BLOCK_SHINGLES))


def clustered(rows: DataFrame) -> DataFrame:
    """Members (key, node, root, n) with keys that overlap put together, where fewer sets have to be sent
    to blocks then: a family of copies shares many rare shingles, so its members meet in many keys."""
    first = rows.groupBy("key").agg(F.min("node").alias("first"))
    clusters = components(rows.join(first, "key").select(F.col("node").alias("u"), F.col("first").alias("v")))
    rows = saved(rows.join(clusters.withColumnRenamed("root", "cluster"), "node"), "clustered")
    number, total = F.count(F.lit(1)), F.sum("n")
    by_key = rows.groupBy("cluster", "key").agg((number * parts(number, total)).alias("sent")).groupBy("cluster").agg(F.sum("sent").alias("by_key"))
    nodes = rows.select("cluster", "node", "root", "n").distinct()
    whole = nodes.groupBy("cluster").agg((number * parts(number, total)).alias("whole")).join(by_key, "cluster").where("whole <= by_key").select("cluster")
    together = nodes.join(whole, "cluster", "left_semi").select(F.col("cluster").alias("key"), "node", "root", "n")
    return together.union(rows.join(whole, "cluster", "left_anti").select("key", "node", "root", "n"))


def in_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members (key, node, root, n) of a key with different roots, a spanning set of those of
    each pair of blocks. A block holds about BLOCK members and BLOCK_SHINGLES shingles at most, or one
    larger set."""
    rows = saved(rows, "members")
    blocks = rows.groupBy("key").agg(parts(F.count(F.lit(1)), F.sum("n")).cast("int").alias("blocks"))
    placed = rows.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root")

    def compare(table: pa.Table) -> pa.Table:
        nodes, roots = table.column("node").to_numpy(), table.column("root").to_numpy()
        every = [unpacked(x) for x in table.column("hashes")]
        sizes = np.array(list(map(len, every)))
        _, column, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(every)), sizes)
        shared = times[column] > 1
        number = np.cumsum(times > 1) - 1
        row, column = row[shared], number[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(every), len(every)), np.float32)  # counts are exact up to 2^24
        for begin in range(0, int((times > 1).sum()), COLUMNS):
            a, b = np.searchsorted(column, [begin, begin + COLUMNS])
            part = np.zeros((len(every), COLUMNS), np.float32)
            part[row[a:b], column[a:b] - begin] = 1
            common += part @ part.T
        either = sizes[:, None] + sizes[None, :] - common.astype(np.float64)
        u, v = np.nonzero(np.triu(100.0 * common.astype(np.float64) >= float(percent) * either, 1) & (roots[:, None] != roots))
        found, top = [], dict(zip(roots.tolist(), roots.tolist(), strict=True))
        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            p, q = int(roots[x]), int(roots[y])
            while top[p] != p:
                p = top[p]
            while top[q] != q:
                q = top[q]
            if p != q:
                top[max(p, q)] = min(p, q)
                found.append((int(nodes[x]), int(nodes[y])))
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

    return placed.join(sets, "node").groupBy("key", "i", "j").applyInArrow(compare, "u long, v long")


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, hashes (the whole set, 64 bits a shingle) of the wanted classes, from the text of each class's first id.
    A bitmap of fixed size keeps most other texts from being shuffled; the join decides."""
    need = classes.select("node", "fp", "first_id").join(wanted, "node")
    some = maybe_in(docs.select("id", "text"), F.col("id"), bitmap(need, F.col("first_id")))
    found = of_sets(some, "text", width, "fp binary, hashes binary", lambda s: (fingerprint(s), s.tobytes()))
    # a first id that several equal rows have gives its set once
    return found.join(need.select(F.col("fp").alias("f"), "first_id", "node"), (F.col("fp") == F.col("f")) & F.col("id").eqNullSafe(F.col("first_id"))).dropDuplicates(["node"]).select("node", "hashes")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    both = pairs.join(b, "v").join(a, "u").select("u", "v", "a", "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                every = np.concatenate([unpacked(x), unpacked(y)])
                every.sort()
                common = int(np.count_nonzero(every[1:] == every[:-1]))
                keep.append(100 * common >= percent * (len(every) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(lean(run), "u long, v long")


#: DuckDB SQL of near_duplicates() on `documents`, comparing all texts that share a shingle.
SQL = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM listed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY u, v),
links AS (
  SELECT u, v FROM common JOIN sizes x ON u = x.doc_id JOIN sizes y ON v = y.doc_id
  WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.v FROM reached r JOIN links l ON r.other = l.u),
smallest AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN smallest m ON d.doc_id = m.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id
"""
