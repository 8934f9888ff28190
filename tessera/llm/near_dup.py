"""Near duplicates by b-bit MinHash.

A document's set holds its distinct word shingles.  ``bands * rows`` minima are taken; of each only
the low ``BITS`` bits are kept, packed into bit planes.  Documents with equal sets form one class at
once (by a 128-bit digest of the set), so exact copies cost nothing more.  Classes that share all
minima of a band are candidates; a candidate pair's similarity is estimated from its planes, by the
count of equal low bits corrected for chance collisions, and pairs well below the threshold go.  The
rest are confirmed on the full sets: ``100 * shared >= percent * all``.

Within a bucket no step emits all pairs.  First every class is compared with the smallest of
its bucket; the confirmed links give components.  Buckets that still hold several components are
joined to clusters; clusters of more than one block are cut by prefix filtering (similar sets share one of
their rarest shingles), so that a text which many documents carry does not bring them together; and every class outside a cluster's largest component is compared with the
cluster's classes of other components, on full sets, in blocks of bounded size: a task gets a block
of either side and returns only links.  Classes already connected are never compared again, so the
components are those that all pairs would give.  With 32 bands of 4 rows a pair at similarity 0.8
shares no band with probability 5e-8, and the estimate's margin is five deviations.

Null text, or text without words: an empty set, linked with nothing.  Rows without an id are linked
with nothing and keep a null component.  Rows that repeat an id are one document with several texts.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fewer_tasks, stored, worker_cache
from tessera.llm.components import components
from tessera.llm.shingles import mixed, shingle_set

BITS = 4


def _signer(k: int, bands: int, rows: int):
    """Per document: id, set size, set digest, bit planes of the minima and band keys."""
    n = bands * rows
    seeds = np.random.default_rng(3).integers(1, 2 ** 63, n, dtype=np.uint64)

    def minima(s: np.ndarray) -> np.ndarray:
        out = np.full(n, np.iinfo(np.uint64).max)
        for a in range(0, len(s), 1024):
            x = s[a:a + 1024]
            # one multiplication and shift per permutation, on hashes that are mixed already
            h = (x[None, :] ^ seeds[:, None]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            np.minimum(out, h.min(axis=1), out=out)
        return out

    def run(batches):
        worker_cache("near")                 # empties what other operators keep
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                size, d1, d2, planes, keys = [], [], [], [], []
                for t in part.column(1):
                    s = shingle_set(t.as_py(), k)
                    size.append(len(s))
                    if not len(s):
                        for c in (d1, d2, planes, keys):
                            c.append(None)
                        continue
                    x, y = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist()
                    d1.append(x)
                    d2.append(y)
                    m = minima(s)
                    low = (m[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1)
                    planes.append(np.packbits(low.astype(np.uint8), axis=1).view("<i8").ravel())
                    g = m.reshape(bands, rows)
                    key = np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        key = mixed(key * np.uint64(31) + g[:, r])
                    keys.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                     pa.array(planes, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "n", "d1", "d2", "planes", "bands"])

    return run


def estimate(x: str, y: str, n: int) -> F.Column:
    """Similarity from two arrays of bit planes: a minimum counts as equal if all its kept bits
    are; of unequal minima 1 in ``2 ** BITS`` agrees by chance."""
    words = n // 64
    unequal = None
    for w in range(words):
        off = None
        for p in range(BITS):
            diff = F.get(F.col(x), p * words + w).bitwiseXOR(F.get(F.col(y), p * words + w))
            off = diff if off is None else off.bitwiseOR(diff)
        unequal = F.bit_count(off) if unequal is None else unequal + F.bit_count(off)
    chance = 2.0 ** -BITS
    return ((1 - unequal / n) - chance) / (1 - chance)


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int, rows: int) -> DataFrame:
    """``id, s``: the full sets of the wanted documents, written once.  ``rows``: of ``docs``."""
    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(
                [shingle_set(t.as_py(), k).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))],
                names=["id", "s"])

    return stored(fewer_tasks(docs.join(stored(fewer_tasks(wanted, rows), "near-wanted"), "id").mapInArrow(sets, "id long, s array<bigint>"), rows), "near-sets")


def _spread_join(pairs: DataFrame, rows: DataFrame, salts: int = 16) -> DataFrame:
    """Pairs ``a, b`` with the row of ``a``.  One ``a`` may have very many pairs: they are spread by
    ``b``, and its row goes only where some of them are."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    copies = salted.select("a", "salt").distinct().join(rows, "a")
    return salted.join(copies, ["a", "salt"]).drop("salt")


def _confirmed(p: DataFrame, planes: DataFrame, docs: DataFrame, k: int, percent: int, n: int, rows: int) -> DataFrame:
    """Of the (stored) candidate pairs ``a, b`` those whose full sets are similar enough.  ``rows``: of ``docs``."""
    most = p.count()
    j, chance = percent / 100, 2.0 ** -BITS
    equal = chance + (1 - chance) * j
    floor = j - 5 * (equal * (1 - equal) / n) ** 0.5 / (1 - chance)
    est = (_spread_join(p, planes.select(F.col("rep").alias("a"), F.col("planes").alias("x")))
           .join(planes.select(F.col("rep").alias("b"), F.col("planes").alias("y")), "b")
           .where(estimate("x", "y", n) >= floor).select("a", "b").distinct())
    est = stored(fewer_tasks(est, most), "near-estimated")
    full = _full_sets(docs, est.select(F.explode(F.array("a", "b")).alias("id")).distinct(), k, rows)
    both = _spread_join(est.join(full.select(F.col("id").alias("b"), F.col("s").alias("y")), "b"),
                        full.select(F.col("id").alias("a"), F.col("s").alias("x")))
    shared = F.size(F.array_intersect("x", "y"))
    return stored(fewer_tasks(both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct(), most), "near-links")


def _links_of_blocks(percent: int):
    """Links between a block of classes and a block of classes of other components."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if left.num_rows and right.num_rows:
            sets = right.column("s2").to_pylist()
            ids, comp = (right.column(c).to_numpy() for c in ("rep2", "component2"))
            size = np.array([len(x) for x in sets])
            vals = np.concatenate([np.array(x, np.int64) for x in sets])
            owner = np.repeat(np.arange(len(sets)), size)
            order = np.argsort(vals, kind="stable")
            vals, owner = vals[order], owner[order]
            for rep, c, s in zip(*(left.column(x).to_pylist() for x in ("rep", "component", "s"))):
                lo, hi = np.searchsorted(vals, s, "left"), np.searchsorted(vals, s, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(sets))
                hit = np.flatnonzero((100 * shared >= percent * (size + len(s) - shared)) & (comp != c))
                out_a += [rep] * len(hit)
                out_b += ids[hit].tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


_COUNTERS = 4096


def _prefixes(percent: int):
    """The rarest shingles of every class of a part of a cluster: two classes that are similar enough share one."""
    def run(key, sets: pa.Table, counts: pa.Table) -> pa.Table:
        often = np.zeros(_COUNTERS, np.int64)
        often[counts.column("slot").to_numpy()] = counts.column("c").to_numpy()
        reps, tokens = [], []
        for rep, s in zip(sets.column("rep").to_pylist(), sets.column("s")):
            x = s.values.to_numpy()
            n = len(x) - -(-percent * len(x) // 100) + 1
            tokens.append(x[np.lexsort((x, often[x % _COUNTERS]))[:n]])
            reps.append(np.full(len(tokens[-1]), rep))
        cluster = key[0].as_py()
        token = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
        return pa.table({"cluster": pa.array(np.full(len(token), cluster), pa.int64()), "token": pa.array(token, pa.int64()),
                         "rep": pa.array(np.concatenate(reps) if reps else token, pa.int64())})

    return run


def _parts(n: F.Column, size: int) -> F.Column:
    return F.ceil(n / size)


def _upto(n: F.Column) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _spread(n: F.Column) -> F.Column:
    return F.pmod(F.xxhash64("rep"), n)


def _by_prefix(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """``rep, part_of``: clusters cut into parts, so that classes that are similar enough are in one part; classes
    that are similar to no other are left out.  ``sets``: ``rep, cluster, n, s`` (``n``: classes of the cluster).

    A set's shingles are ordered by how often the cluster has them, rarest first; of two sets at the threshold both
    have a shared one among the first ``size - ceil(percent * size / 100) + 1``.  Any order that is the same for the whole
    cluster is right; counts are kept in ``_COUNTERS`` slots per cluster, which tells what a large
    share of the cluster has from the rest."""
    blocks = _parts(F.col("n"), block)
    slot = F.pmod("x", F.lit(_COUNTERS)).cast("int")
    counts = (sets.select("cluster", "n", F.explode("s").alias("x")).groupBy("cluster", "n", slot.alias("slot"))
              .agg(F.count(F.lit(1)).alias("c")))
    left = sets.select("cluster", _spread(blocks).alias("part"), "rep", "s")
    right = stored(counts, "near-counts").select(F.col("cluster").alias("cluster2"), _upto(blocks).alias("part2"), "slot", "c")
    found = stored(left.groupBy("cluster", "part").cogroup(right.groupBy("cluster2", "part2"))
                   .applyInArrow(_prefixes(percent), "cluster long, token long, rep long"), "near-prefixes")
    n_found = found.count()
    first = stored(fewer_tasks(found.groupBy("cluster", "token").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z"), n_found), "near-shared")
    links = found.join(first, ["cluster", "token"]).where("rep > a").select("a", F.col("rep").alias("b")).distinct()
    return components(links, rows=n_found).select(F.col("id").alias("rep"), F.col("component").alias("part_of"))


def _across(rows: DataFrame, docs: DataFrame, k: int, percent: int, n_docs: int, minor_block: int = 256,
            block: int = 512) -> DataFrame:
    """Links between different components of a cluster.  ``rows``: ``rep, component, cluster``; ``n_docs``: rows of ``docs``.  A cluster of more than one
    block is cut by ``_by_prefix`` first: one block is compared at once anyway."""
    sized = stored(fewer_tasks(rows.join(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "cluster"), n_docs), "near-sized")
    full = _full_sets(docs, rows.select(F.col("rep").alias("id")), k, n_docs)
    sets = full.where(F.size("s") > 0).select(F.col("id").alias("rep"), "s").distinct()
    large, rows = sized.where(F.col("n") > block), sized.select("rep", "component", "cluster")
    if not large.isEmpty():
        cut = _by_prefix(large.join(sets, "rep"), percent, block)
        rows = stored(fewer_tasks(sized.where(F.col("n") <= block).select("rep", "component", "cluster").unionByName(
            large.join(cut, "rep").select("rep", "component", F.col("part_of").alias("cluster"))), n_docs), "near-parts")
    per = rows.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    main = stored(fewer_tasks(per.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"),
                                             F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most"), n_docs), "near-clusters")
    at = stored(fewer_tasks(rows.join(main, "cluster").join(sets, "rep"), n_docs), "near-open-sets")
    blocks, minors = _parts(F.col("n"), block), _parts(F.col("n") - F.col("most"), minor_block)
    left = at.where("component <> main").select("cluster", _spread(minors).alias("mb"), _upto(blocks).alias("ob"), "rep", "component", "s")
    right = at.select(
        F.col("cluster").alias("cluster2"), _upto(minors).alias("mb2"), _spread(blocks).alias("ob2"),
        F.col("rep").alias("rep2"), F.col("component").alias("component2"), F.col("s").alias("s2"))
    return (left.groupBy("cluster", "mb", "ob").cogroup(right.groupBy("cluster2", "mb2", "ob2"))
            .applyInArrow(_links_of_blocks(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, block: int = 512,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row.  ``block``: classes per side of a block."""
    n = bands * rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_signer(k, bands, rows),
                                     "id long, n long, d1 long, d2 long, planes array<bigint>, bands array<bigint>"),
                    "near-signatures")
    n_docs = signed.count()              # bounds the rows of what follows
    classes = stored(fewer_tasks(signed.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep")), n_docs), "near-classes")
    member = stored(fewer_tasks(signed.select("id", "n", "d1", "d2").join(classes, ["d1", "d2"], "left").select("id", "n", "rep"), n_docs), "near-members")
    reps = stored(fewer_tasks(signed.join(classes.select("d1", "d2", F.col("rep").alias("id")), ["d1", "d2", "id"])
                  .select(F.col("id").alias("rep"), "planes", "bands"), n_docs), "near-representatives")
    planes = reps.select("rep", "planes")
    in_bucket = reps.select("rep", F.explode("bands").alias("key"))

    smallest = stored(fewer_tasks(in_bucket.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z"))
                      .where("a < z").select("key", "a"), bands * n_docs), "near-smallest")
    stars = stored(fewer_tasks(in_bucket.join(smallest, "key").where("rep > a").select("a", F.col("rep").alias("b")).distinct(), bands * n_docs), "near-pairs")
    links = _confirmed(stars, planes, texts, k, percent, n, n_docs)
    label = components(links, rows=bands * n_docs).select(F.col("id").alias("rep"), "component")

    # buckets of several components, and the clusters they form
    rest = stored(fewer_tasks(in_bucket.join(smallest, "key").join(label, "rep", "left")
                  .select("key", "a", "rep", F.coalesce("component", "rep").alias("component")), bands * n_docs), "near-buckets")
    open_keys = stored(fewer_tasks(rest.where("rep > a").groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                       .where("lo < hi").select("key"), bands * n_docs), "near-open")
    open_rows = stored(fewer_tasks(rest.join(open_keys, "key").select("a", "rep", "component").distinct(), bands * n_docs), "near-open-rows")
    cluster = components(open_rows, "a", "rep", bands * n_docs).select(F.col("id").alias("rep"), "component").withColumnRenamed("component", "cluster")
    more = stored(_across(open_rows.select("rep", "component").distinct().join(cluster, "rep"), texts, k, percent,
                          n_docs, -(-block // 2), block), "near-links")
    # texts of one id in several classes are one document
    own = stored(fewer_tasks(member.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct(), n_docs), "near-own")
    heads = signed.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    several = own.join(heads.select(F.col("id").alias("a")), "a", "left_semi")
    final = components(links.unionByName(more).unionByName(several)).select(F.col("id").alias("rep"), "component")
    # a row without words belongs to the document of its id
    out = member.withColumn("rep", F.coalesce("rep", "id")).join(final, "rep", "left").withColumn(
        "component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
