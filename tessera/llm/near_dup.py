"""MinHash near-dedup with tensored banding.

Each document's set of word shingles gives two small collections of ``ROWS_OF`` keys each, a key being ``DEPTH``
minhashes. Every pair of a key from the first and one from the second is a table key: ROWS_OF squared tables from twice
ROWS_OF times DEPTH minhashes, about a square root of what separate tables would need. Documents with equal sets are
one class first, so exact copies make no candidates. Keys that no other class has are dropped before they are paired.

Classes that meet in a table are candidates; the connected groups of candidates are verified on full shingle sets.
A group is cut into blocks of about ``BLOCK`` classes; each task holds two blocks and emits a spanning forest of the
confirmed links and never the pairs. First every block is held against itself and its group's first block, which is
linear in the group's size; then, of the remaining pairs of blocks, only those that don't already lie in one component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Forest, Sieve, Workspace, components, give_back, read, remembers, ship, split_mix, take_over

ROWS_OF = 8
DEPTH = 2
BLOCK = 256
KEPT = 400_000
#: Rows of a batch whose texts are unpacked at a time.
ROWS = 1024
#: Shingles that a comparison holds as a dense matrix at a time.
COLUMNS = 4096

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = split_mix(np.arange(1, 2 * ROWS_OF * DEPTH + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
_words: dict[bytes, int] = {}
remembers("near_dup", _words.clear)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``width``-word shingles; a shorter text's words are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    try:
        h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_words) > KEPT:
            _words.clear()
        for w in set(words):
            _words[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = split_mix(out * _GOLD + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """The 2 * ROWS_OF keys of a set that isn't empty."""
    with np.errstate(over="ignore"):
        low = np.array([(m := s * seed, m ^ (m >> np.uint64(32)))[1].min() for seed in _SEEDS])
        keys = low.reshape(2 * ROWS_OF, DEPTH)
        out = keys[:, 0]
        for k in range(1, DEPTH):
            out = split_mix(out * _GOLD + keys[:, k])
    return out


def _sign(width: int):
    def run(batches):
        take_over("near_dup")
        for b in (c.slice(k, ROWS) for c in batches for k in range(0, c.num_rows, ROWS)):
            size, print_, keys = [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, width)
                size.append(len(s))
                print_.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(signature(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(print_, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "print", "keys"])
        give_back()

    return run


def _load(sets: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in sets]


def links(a: list[np.ndarray], b: list[np.ndarray] | None, num: int, den: int):
    """Index pairs (i of a, j of b; i < j within a if b is None) with den * |intersection| >= num * |union|."""
    rows = a + (b or [])
    size = np.array([len(x) for x in rows], np.int64)
    flat = np.concatenate(rows)
    who = np.repeat(np.arange(len(rows)), size)
    _, col, uses = np.unique(flat, return_inverse=True, return_counts=True)
    shared = uses > 1  # a shingle of one document adds to no intersection
    new = np.cumsum(shared) - 1
    on = shared[col]
    col, who = new[col[on]], who[on]
    n, m = (len(a), len(b)) if b is not None else (len(a), len(a))
    both = np.zeros((n, m), np.float32)
    order = np.argsort(col, kind="stable")
    col, who = col[order], who[order]
    for c in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(col, [c, c + COLUMNS])
        x = np.zeros((len(rows), COLUMNS), np.float32)
        x[who[lo:hi], col[lo:hi] - c] = 1
        both += x[:n] @ (x[n:] if b is not None else x).T
    both = both.astype(np.int64)
    union = size[:n, None] + (size[n:] if b is not None else size)[None, :] - both
    ok = den * both >= num * union
    if b is None:
        ok = np.triu(ok, 1)
    return np.argwhere(ok).tolist()


def _verify(num: int, den: int):
    """applyInArrow function over rows (g, i, j, block, node, words): forest edges of blocks i and j. Block i of an own pair (i = j) is held against itself; any other against block j."""

    def run(table: pa.Table) -> pa.Table:
        block, node = table.column("block").to_numpy(), table.column("node").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        order = np.argsort(node, kind="stable")
        block, node = block[order], node[order]
        sets = _load(table.column("words").take(pa.array(order)).to_pylist())
        forest, edges = Forest(len(node)), []
        left, right = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
        pairs = [(left, None)] if i == j else [(left, right)]
        if i == 0 and j:  # the linear round: block j against itself, too
            pairs.append((right, None))
        for x, y in pairs:
            if not len(x) or (y is not None and not len(y)):
                continue
            for p, q in links([sets[k] for k in x], None if y is None else [sets[k] for k in y], num, den):
                p, q = int(x[p]), int((x if y is None else y)[q])
                if forest.join(p, q):
                    edges.append((int(node[p]), int(node[q])))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                c = b.slice(k, 256)
                s = [shingles(x, width).tobytes() for x in c.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(s, pa.binary())], names=["node", "words"])
        _words.clear()  # what later stages run beside shouldn't hold these words
        give_back()

    return run


def cluster(docs: DataFrame, ws: Workspace, width: int, num: int, den: int) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links
    with den * |intersection| >= num * |union|), kept (doc_id = component_id).

    Words are split at ASCII white space after lower-casing A-Z. Null or empty text: no shingles, linked with nothing,
    its own component. Fewer than ``width`` words: one shingle of them all. Texts are whole; rows repeated with the same
    doc_id share a component if their texts link, and are each returned; rows with a null doc_id are left out of linking
    and have a null component; an empty table gives no rows; further columns are ignored.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = ws.put(docs.mapInArrow(_sign(width), "doc_id long, n_shingles long, print binary, keys array<long>"), "signed")
    classes = ws.put(signed.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node"), F.any_value("keys").alias("keys")), "classes")
    # keys that two classes or more have
    keyed = classes.select("node", F.posexplode("keys").alias("k", "key"))
    common = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    own = keyed.join(common, ["k", "key"]).groupBy("node").agg(F.collect_list(F.when(F.col("k") < ROWS_OF, F.struct("k", "key"))).alias("left"), F.collect_list(F.when(F.col("k") >= ROWS_OF, F.struct("k", "key"))).alias("right"))
    tables = own.select("node", F.explode("left").alias("x"), "right").select("node", "x", F.explode("right").alias("y")).select("node", F.col("x.k").alias("i"), F.col("y.k").alias("j"), F.xxhash64("x.key", "y.key").alias("t"))
    tables = ws.put(tables, "tables")
    hubs = tables.groupBy("i", "j", "t").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = tables.join(hubs, ["i", "j", "t"]).select("a", F.col("node").alias("b")).where("a <> b").distinct()
    groups = components(ws, near, "groups")
    ws.free("tables", "classes")
    # blocks
    size = groups.groupBy("root").count()
    dealt = groups.join(size, "root").select(F.col("root").alias("g"), "node", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # the sets of candidates are made where the texts are read, and they alone move
    dealt = ws.put(dealt, "dealt")
    wanted = Sieve(ws, dealt.select(F.xxhash64("node")), "wanted")
    texts = docs.where(F.col("doc_id").isNotNull() & wanted.may_hold(F.xxhash64("doc_id")))
    sets = ws.put(texts.mapInArrow(_sets(width), "node long, words binary").join(dealt, "node").select("g", "block", "blocks", "node", "words"), "sets")
    home = F.when((F.col("block") == 0) & (F.col("blocks") > 1), F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    linear = sets.withColumn("j", F.explode(home)).withColumn("i", F.lit(0).cast("long"))
    edges = ws.put(linear.groupBy("g", "i", "j").applyInArrow(_verify(num, den), "a long, b long"), "edges-1")
    if not size.where(F.col("count") > BLOCK).isEmpty():
        # block 0 is held against itself once; pairs of later blocks unless both lie in one component already
        so_far = components(ws, edges, "links-1")
        big = dealt.where("blocks > 1").join(so_far, "node", "left").withColumn("root", F.coalesce("root", "node"))
        flat = big.groupBy("g", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        a = flat.select("g", F.col("block").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"))
        b = flat.select("g", F.col("block").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"))
        todo = a.join(b, "g").where("((i = j and i = 0) or (i >= 1 and i < j)) and not (lo_i = hi_i and lo_j = hi_j and lo_i = lo_j)").select("g", "i", "j")
        todo = ws.put(todo, "todo")
        wanted = todo.select("g", "i", "j", F.col("i").alias("block")).unionByName(todo.where("i < j").select("g", "i", "j", F.col("j").alias("block")))
        more = sets.join(wanted, ["g", "block"]).groupBy("g", "i", "j").applyInArrow(_verify(num, den), "a long, b long")
        edges = edges.unionByName(ws.put(more, "edges-2"))
    roots = components(ws, edges, "links")
    ws.free("sets")
    by_class = signed.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node"))
    by_class = by_class.join(roots, "node", "left").select("print", F.coalesce("root", "node").alias("component"))
    out = signed.drop("keys").join(by_class, "print", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "documents"), Workspace(spark, "op3"), 3, 85, 100)




#: All pairs that share a shingle, counted, and the components of their links.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS a FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(a[i:(i + 2)], ' ') AS s FROM (SELECT doc_id, a, unnest(range(1, greatest(1, len(a) - 2) + 1)) AS i FROM w WHERE len(a) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS m FROM s p JOIN s q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL) JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)
), c(id, r) USING KEY (id) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.b, min(f.r) FROM c f JOIN link l ON l.a = f.id JOIN recurring.c o ON o.id = l.b WHERE f.r < o.r GROUP BY l.b
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, r AS component_id, doc_id = r AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.id = doc_id
"""
