"""MinHash near-duplicates with sequential Bayesian verification.

1. Each document's set of word shingles gives a fingerprint, a signature and the keys of 32 bands of 4
   minima. Rows with one fingerprint are one node: copies are never compared.
2. Nodes that share a band key are candidates. Their signatures, a byte of each minimum, are compared
   batch by batch in the group of the key; a pair is pruned when the posterior probability of its
   similarity reaching the threshold falls under the miss probability. Of the pairs left, each group
   tells a spanning forest.
3. The components of these forests hold every pair that was not pruned. Each goes to one task, which
   prunes by whole signatures in the same way and verifies survivors on their full shingle sets. Pairs
   already connected are not compared.
4. A component too large for one task is first verified against its least node, in parts of bounded
   size. Only nodes that are not linked to it are then compared with all others, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .graph import components
from .shared import partitions, written

BANDS, ROWS, BATCH = 32, 4, 32
HASHES = BANDS * ROWS
#: of texts, in one block of a component and in one bucket of components
BLOCK_BYTES, BUCKET_BYTES = 32 << 20, 16 << 20


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    x = W.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    return (x[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[HASHES:] >> np.uint64(32)).astype(np.uint32)


def _shingles(w: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, hashes) of distinct shingles, in order of document."""
    h, n, left = w.hashes(lower=True), np.diff(w.bounds), w.left()
    g = W.grams(h, size)
    place = left >= size
    for k in range(1, size):
        short = w.bounds[:-1][n == k]
        if len(short):
            g[short] = W.mix(W.grams(h, k)[short] + np.uint64(k))
            place[short] = True
    at = np.flatnonzero(place)
    doc = w.doc_of()[at]
    _, first = np.unique(g[at] ^ W.mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
    first.sort()
    return doc[first], g[at][first]


def _signatures(doc: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents with shingles, and their HASHES minima."""
    has, start = np.unique(doc, return_index=True)
    out = np.zeros((len(has), HASHES), np.uint32)
    low = (g >> np.uint64(32)).astype(np.uint32)
    for i, (a, b) in enumerate(zip(*_permutations(), strict=True)):
        if len(has):
            out[:, i] = np.minimum.reduceat(low * a + b, start)
    return has, out


def _band_keys(signature: np.ndarray) -> np.ndarray:
    x = signature.astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2])
    for r in range(ROWS):
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, r])
    return key


def _described(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    n = np.zeros(batch.num_rows, np.int64)
    print_ = np.zeros((batch.num_rows, 2), np.uint64)
    keys = np.zeros((batch.num_rows, BANDS), np.uint64)
    low = np.zeros((batch.num_rows, HASHES), np.uint8)
    for w in W.words(batch.column(1)):
        doc, g = _shingles(w, size)
        has, signature = _signatures(doc, g)
        if not len(has):
            continue
        start = np.searchsorted(doc, has)
        at = has + w.first
        n[at] = np.bincount(doc, minlength=w.n_docs)[has]
        for j in (0, 1):
            print_[at, j] = W.mix(np.add.reduceat(W.mix(g + np.uint64(j * 0x632BE59BD9B4E019)), start))
        keys[at] = _band_keys(signature)
        low[at] = (signature >> np.uint32(24)).astype(np.uint8)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(W.signed(keys.ravel())))
    bytes_ = pa.array([x.tobytes() for x in low], pa.binary())
    return pa.record_batch([batch.column(0), pa.array(n), pa.array(W.signed(print_[:, 0].copy())), pa.array(W.signed(print_[:, 1].copy())), flat, bytes_], ["doc_id", "n_shingles", "p1", "p2", "keys", "minima"])


def least_matches(seen: int, threshold: float, miss: float) -> int:
    """Fewest equal minima among `seen` at which P(similarity >= threshold) is at least `miss`.

    With a flat prior the posterior is Beta(m+1, seen-m+1); its upper tail is a binomial sum.
    """
    total = 0.0
    for m in range(seen + 1):
        total += comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if total >= miss:
            return m
    return seen


def _bounds(percent: int, miss: float) -> list[tuple[int, int]]:
    """(minima compared, fewest that must be equal) after each batch."""
    return [(k, least_matches(k, percent / 100, miss)) for k in range(BATCH, HASHES + 1, BATCH)]


def _forest(key: np.ndarray, node: np.ndarray, minima: np.ndarray, need: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of nodes in order of their band keys, ties that connect all pairs of one key that no batch prunes.

    Equal minima have equal bytes, so whole minima never agree where their bytes do not.
    """
    out = []
    edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    sizes = np.diff(edges)
    first = edges[:-1][sizes == 2]
    for k, least in need:
        first = first[(minima[first, :k] == minima[first + 1, :k]).sum(1) >= least]
    out += zip(node[first].tolist(), node[first + 1].tolist(), strict=True)
    for a, n in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        label, near = np.arange(n), minima[a : a + n]
        for p in range(n - 1):
            rest = p + 1 + np.flatnonzero(label[p + 1 :] != label[p])
            for k, least in need:
                if len(rest):
                    rest = rest[(near[rest, :k] == near[p, :k]).sum(1) >= least]
            for q in rest.tolist():
                if label[q] != label[p]:
                    out.append((int(node[a + p]), int(node[a + q])))
                    label[label == label[q]] = label[p]
    return out


def _links(ids: np.ndarray, signature: np.ndarray, sets: list[np.ndarray], percent: int, miss: float, first: int | None = None, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning set of verified links between the first of a task's documents (or all) and the others.

    Documents marked in joined are known to be connected.
    """
    keys, label, out, need = _band_keys(signature), np.arange(len(ids)), [], _bounds(percent, miss)
    if joined is not None:
        label[joined] = len(ids)
    for p in range(len(ids) if first is None else first):
        rest = p + 1 + np.flatnonzero(label[p + 1 :] != label[p])
        rest = rest[(keys[rest] == keys[p]).any(1)] if len(rest) else rest
        for k, least in need:
            if len(rest):
                rest = rest[(signature[rest, :k] == signature[p, :k]).sum(1) >= least]
        for q in rest:
            if label[q] == label[p]:
                continue
            a, b = sets[p], sets[q]
            both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                out.append((int(ids[p]), int(ids[q])))
                label[label == label[q]] = label[p]
    return out


def _verified(work: DataFrame, buckets: int, shingle: int, percent: int, miss: float) -> DataFrame:
    """(a, b) links of rows (component, i, j, node, rank, text), each (component, i, j) a task of its own.

    Rows of rank 0 are compared with all of the task, those of rank 1 and 2 with these alone; those of
    rank 2 are connected.
    """

    def told(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("component", "i", "j", "rank", "node")])
        ids, rank = rows["node"].to_numpy(), rows["rank"].to_numpy()
        signature, sets = np.zeros((len(ids), HASHES), np.uint32), [np.zeros(0, np.uint64)] * len(ids)
        for w in W.words(rows["text"]):
            doc, g = _shingles(w, shingle)
            has, s = _signatures(doc, g)
            signature[has + w.first] = s
            for d, x in zip(has, np.split(g, np.searchsorted(doc, has)[1:]), strict=True):
                sets[d + w.first] = x
        task = np.stack([rows[c].to_numpy() for c in ("component", "i", "j")], 1)
        found = []
        for x in np.split(np.arange(len(ids)), np.flatnonzero((task[1:] != task[:-1]).any(1)) + 1):
            found += _links(ids[x], signature[x], [sets[k] for k in x], percent, miss, int((rank[x] == 0).sum()), rank[x] == 2)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    dealt = work.withColumn("bucket", F.pmod(F.xxhash64("component", "i", "j"), F.lit(buckets)))
    return dealt.select("bucket", "component", "i", "j", "node", "rank", "text").groupBy("bucket").applyInArrow(told, "a long, b long")


def _fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, n_shingles long, p1 long, p2 long, keys array<long>, minima binary"
    return written(given.mapInArrow(lambda batches: (_described(b, shingle) for b in batches), schema), "shingles")


def classes(docs: DataFrame, shingle: int = 5, percent: int = 75, miss: float = 1e-6, block: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents link at 100 * intersection >= percent * union of their shingle sets; component_id is
    the least doc_id reachable. Null, empty and blank texts have no shingles and link with nothing.
    Rows that share an id are one document with the links of all of them; ties need no order, since
    links have none. A null id cannot be a class: its row has a null component_id and is kept. `block`
    is the number of texts compared in one task.
    """
    return _classes(docs, _fingerprints(docs, shingle), shingle, percent, miss, block)


def _candidates(nodes: DataFrame, percent: int, miss: float, block: int) -> DataFrame:
    """(node, component): components of nodes that hold every pair with a common band key that is not pruned."""
    buckets, need = 16 * partitions(nodes.sparkSession), _bounds(percent, miss)
    banded = nodes.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    met = banded.join(shared, "key")
    # a key of very many nodes ties them all, unpruned: a larger component loses no pair
    hot = met.where((F.col("n") > block) & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    few = met.where(F.col("n") <= block).select("key", "node").join(nodes.select("node", "minima").hint("merge"), "node")

    def told(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("node", "ascending")])
        minima = np.frombuffer(b"".join(rows["minima"].to_pylist()), np.uint8).reshape(-1, HASHES)
        found = set(_forest(rows["key"].to_numpy(), rows["node"].to_numpy(), minima, need))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    ties = few.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInArrow(told, "a long, b long")
    return components(ties.unionByName(hot))


def _linked(docs: DataFrame, nodes: DataFrame, shingle: int, percent: int, miss: float, block: int) -> DataFrame:
    """(a, b): verified links that connect what is connected."""
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    group = _candidates(nodes, percent, miss, block)
    # the same plan at every size: texts are dealt by id, and no side is sent whole to every executor
    met = given.join(group.hint("merge"), given.doc_id == group.node).withColumn("print", F.xxhash64("text"))
    texts = written(met.groupBy("component", "node", "print").agg(F.first("text").alias("text")), "texts")
    sized = texts.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    large = written(sized.withColumn("blocks", blocks).where("blocks > 1").select("component", "blocks"), "large")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16 * partitions(docs.sparkSession), total // BUCKET_BYTES)
    number = lambda c: F.lit(c).cast("int")
    small = texts.join(large, "component", "left_anti").select("component", number(0).alias("i"), number(0).alias("j"), "node", number(0).alias("rank"), "text")
    links = _verified(small, buckets, shingle, percent, miss)
    if large.isEmpty():
        return links
    placed = texts.join(large, "component").withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    every = F.explode(F.expr("sequence(0, blocks - 1)"))
    root = F.col("node") == F.col("component")
    # the least node meets each part of its component
    star = placed.where(~root).select("component", "blocks", F.col("mine").alias("i"), "node", number(1).alias("rank"), "text")
    star = star.unionByName(placed.where(root).select("component", "blocks", every.alias("i"), "node", number(0).alias("rank"), "text"))
    near = written(_verified(star.select("component", "i", number(0).alias("j"), "node", "rank", "text"), buckets, shingle, percent, miss), "near")
    known = near.select(F.col("a").alias("component"), F.col("b").alias("node")).distinct().withColumn("joined", F.lit(True))
    judged = placed.join(known.hint("merge"), ["component", "node"], "left").withColumn("joined", F.coalesce("joined", root))
    judged = written(judged.select("component", "blocks", "mine", "node", "joined", "text"), "judged")
    # what is not linked to it meets all blocks
    apart = judged.where("not joined")
    parts = written(apart.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("parts")), "apart")
    rows = judged.join(parts, "component")
    ours = rows.where("not joined").select("component", F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int").alias("i"), every.alias("j"), "node", number(0).alias("rank"), "text")
    others = rows.select("component", F.explode(F.expr("sequence(0, parts - 1)")).alias("i"), F.col("mine").alias("j"), "node", F.when(F.col("joined"), 2).otherwise(1).cast("int").alias("rank"), "text")
    far = _verified(ours.unionByName(others), buckets, shingle, percent, miss)
    return links.unionByName(near).unionByName(far)


def _classes(docs: DataFrame, described: DataFrame, shingle: int = 5, percent: int = 75, miss: float = 1e-6, block: int = 4096) -> DataFrame:
    some = described.where("n_shingles > 0 and doc_id is not null")
    nodes = some.groupBy("p1", "p2").agg(F.min(F.struct("doc_id", "keys", "minima")).alias("least")).select("p1", "p2", F.col("least.doc_id").alias("node"), "least.keys", "least.minima")
    nodes = written(nodes, "nodes")
    links = _linked(docs, nodes, shingle, percent, miss, block)
    same = some.select("doc_id", "p1", "p2").join(nodes, ["p1", "p2"]).where("doc_id != node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    # a document whose rows differ stands in several nodes: its id joins them
    many = some.groupBy("doc_id", "p1", "p2").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    twice = same.join(many, same.b == many.doc_id, "left_semi").select("a", "b")
    class_of = components(links.unionByName(twice))
    named = nodes.select("p1", "p2", "node").join(class_of, "node", "left").select("p1", "p2", F.coalesce("component", "node").alias("component_id"))
    out = described.drop("keys", "minima").join(named, ["p1", "p2"], "left")
    has = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(has, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _one_of_each(rows: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    """Of rows with one id (or none) and equal shingles the one of least text; named holds the
    fingerprints of rows that have an id, of which rows without one are copies."""
    names = rows.columns
    given = rows.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(names)))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _described(b.select([0, 1]), shingle)
            yield pa.record_batch([*b.columns, d["n_shingles"], d["p1"], d["p2"]], fields)

    fields = [*given.columns, "_n", "_p1", "_p2"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields)
    all_ = given.mapInArrow(printed, f"{kinds}, _n long, _p1 long, _p2 long")
    some = all_.where("_n > 0").join(named, F.col("_id").isNull() & (F.col("_p1") == F.col("p1")) & (F.col("_p2") == F.col("p2")), "left_anti")
    whole = F.struct(*(f"_keep{i}" for i in range(len(names)))).alias("row")
    one = some.groupBy("_id", "_p1", "_p2").agg(F.min_by(whole, "_text").alias("row")).select("row")
    out = all_.where("_n = 0").select(whole).unionByName(one)
    return out.select(*(F.col(f"row._keep{i}").alias(c) for i, c in enumerate(names)))


def deduplicated(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of docs whose document stays: one document of each class, and all that have none.

    Of rows that share an id, or have none, one of each set of shingles stays; a row without id goes
    if a row with one has its set. Rows without shingles all stay.
    """
    described = _fingerprints(docs, shingle)
    gone = _classes(docs, described, shingle).where("not kept").select("doc_id").distinct()
    some = described.where("n_shingles > 0")
    # ids with several rows, and null: only their rows are looked at one by one
    many = written(some.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "many")
    if many.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    gone = written(gone, "gone")
    single = docs.join(gone.unionByName(many), "doc_id", "left_anti").where("doc_id is not null").select(*docs.columns)
    several = docs.join(many.where("doc_id is not null"), "doc_id", "left_semi").join(gone, "doc_id", "left_anti").select(*docs.columns)
    named = some.where("doc_id is not null").select("p1", "p2").distinct()
    return single.unionByName(_one_of_each(several.unionByName(docs.where("doc_id is null")), named, shingle))
